"""Corpus operators against brute force on small fixtures, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql.functions import lit
from tokenizers import Tokenizer

from pagewright.llm import ann, common, decontam, lang_id, line_dedup, packing, pii, secret_scan, simhash, substring_dedup, token_files, word_encoder

SF = "/root/testdata/sf0.001"
#: Columns that operators use inside, to clash with.
EXTRA = "7 as fp, 'x' as h, 1 as n, 'k' as key, 0 as label, 'q' as tid, 3 as _id, 4 as id, 5 as spans"
SCHEMA = "doc_id long, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *EXTRA.split(", "))


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="session")
def rows(spark):
    """Real documents and hard cases: null and empty texts, repeated rows, null ids, long texts."""
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").collect()]
    rng = random.Random(1)
    noise = "".join(rng.choice("abc de\n") for _ in range(30_000))
    hard = [None, "", " ", "\n\n", "a", "A b", real[0][1], real[0][1], real[3][1].upper(), noise, "password: 'abcdefgh1'", "x" * 5000, "É à ß ﬁ 日本語 𝒳", "+1 (555) 010-9999 a@b.co 1.2.3.4"]
    return real + [(1000 + k, t) for k, t in enumerate(hard)] + [real[5], real[5], (None, "no id"), (None, None)]


def unique(rows):
    return {k: t for k, t in rows if k is not None}


def test_xxh64_matches_the_library():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    start, size = rng.integers(0, 2800, 500), rng.integers(0, 200, 500)
    assert common.xxh64(data, start, size, 42).tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(start, size, strict=True)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_components_of_a_long_chain_keep_estimates_small(spark, monkeypatch):
    """Each of the joins doubled the digits of the size that Spark estimates for its result, until the driver had no heap left."""
    sizes, plain = [], common.checkpoint

    def noted(df):
        out = plain(df)
        sizes.append(out._jdf.queryExecution().logical().stats().sizeInBytes())
        return out

    monkeypatch.setattr(common, "checkpoint", noted)
    ids = random.Random(3).sample(range(300), 300)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()}
    assert got == dict.fromkeys(range(1, 300), 0)
    assert len(sizes) > 10 and max(sizes) < 1 << 63


def test_checkpoint_of_an_unknown_size_keeps_rows_and_its_file(spark):
    from pyspark.sql import functions as F

    a = common.checkpoint(spark.range(20).selectExpr("id", "if(id % 3 = 0, null, struct(id as x, 'é' as y)) as v"))
    b = common.checkpoint(a.join(a.select("id", F.col("v").alias("w")), "id", "left").join(a.select("id", F.array("v").alias("u")), "id"))
    assert b.schema.simpleString() == "struct<id:bigint,v:struct<x:bigint,y:string>,w:struct<x:bigint,y:string>,u:array<struct<x:bigint,y:string>>>"
    want = [None if k % 3 == 0 else (k, "é") for k in range(20)]
    assert [(r.id, r.v, r.w, r.u) for r in b.orderBy("id").collect()] == [(k, x, x, [x]) for k, x in enumerate(want)]
    assert b._jdf.queryExecution().logical().rdd().getCheckpointFile().isDefined()
    common.release(b)


def slow_fingerprint(text, n):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, rows):
    prints = {t: slow_fingerprint(t, 4) for _, t in rows}
    all_of = sorted(set(prints.values()))
    group = {f: f for f in all_of}
    changed = True
    while changed:
        changed = False
        for a in all_of:
            for b in all_of:
                if (a ^ b).bit_count() <= 4 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    least = defaultdict(list)
    for k, t in rows:
        if k is not None:
            least[group[prints[t]]].append(k)
    want = Counter((k, f"{prints[t]:016x}", min(least[group[prints[t]]], default=None)) for k, t in rows)
    assert Counter(map(tuple, simhash.near_duplicates(table(spark, rows), 4, 4).collect())) == want
    assert simhash.near_duplicates(table(spark, []), 4, 4).count() == 0


@pytest.mark.parametrize("agree", [2, 3, 4])
def test_keys_of_any_number_of_blocks_meet_all_close_pairs(spark, agree):
    rng = random.Random(agree)
    base = [rng.getrandbits(64) for _ in range(40)]
    all_ = base + [x ^ sum(1 << b for b in rng.sample(range(64), 4)) for x in base]
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in all_], "f0 long")
    keys = defaultdict(set)
    for r in simhash.pigeonhole_keys(rows, 4, agree).collect():
        keys[r.f0 & ((1 << 64) - 1)].add(r.key)
    assert all(keys[x] & keys[y] for x, y in zip(all_[:40], all_[40:], strict=True))
    assert simhash.agreeing(10**6) == 2 and simhash.agreeing(10**8) == 3 and simhash.agreeing(10**10) == 4


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = sorted({centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "f0 long")
    links = simhash.hamming_links(simhash.pigeonhole_keys(df, 4), 1, 4)
    got = {r.node: r.root for r in common.components(links).collect()}
    group = dict(zip(signed, signed, strict=True))
    changed = True
    while changed:
        changed = False
        for a, x in zip(prints, signed, strict=True):
            for b, y in zip(prints, signed, strict=True):
                if (a ^ b).bit_count() <= 4 and group[x] != group[y]:
                    group[x] = group[y] = min(group[x], group[y])
                    changed = True
    assert {x: got.get(x, x) for x in signed} == group


def test_similar_documents_share_a_component(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs, pairs = [], 120
    for k in range(pairs):
        a = [word() for _ in range(300)]
        b = list(a)
        for i in rng.sample(range(300), 6):  # 30 of 296 shingles change: similarity 0.82
            b[i] = word()
        docs += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    got = {r.doc_id: r.component_id for r in simhash.similar(table(spark, docs)).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(pairs)) >= 0.85 * pairs
    assert all(got[2 * k] == 2 * k for k in range(pairs))


def test_similar_equals_exact_shingle_similarity(spark):
    """Pairs on both sides of 0.8: all at or over it are linked and none under it, as brute force says; texts without a word are equal."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs = []
    for k in range(150):
        a = [word() for _ in range(200)]
        b = list(a)
        for i in rng.sample(range(200), 2 + k % 7):
            b[i] = word()
        docs += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    docs += [(1000, None), (1001, " \n"), (1002, "one two"), (1003, "One  two"), (1003, "One  two"), (None, docs[0][1])]
    grams = []
    for _, t in docs:
        w = (t or "").lower().split()
        grams.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    group = list(range(len(docs)))
    for i, x in enumerate(grams):
        for j, y in enumerate(grams[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                group = [group[j] if g == group[i] else g for g in group]
    least = defaultdict(list)
    for (k, _), g in zip(docs, group, strict=True):
        least[g] += [k] if k is not None else []
    want = Counter((k, min(least[g])) for (k, _), g in zip(docs, group, strict=True))
    assert Counter(map(tuple, simhash.similar(table(spark, docs)).collect())) == want
    assert simhash.similar(table(spark, [])).count() == 0


def slow_secrets(t):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets(spark, rows):
    rng = random.Random(5)
    parts = ["password", "TOKEN", "api_key", "apikey", ": ", "=", '"', "'", " ", "abcd", "12345678", "AKIA", "ABCDEFGHIJKL", "0" * 16, "deadbeef" * 3, "é", "\n"]
    more = rows + [(5000 + k, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for k in range(400)]
    got = Counter(map(tuple, secret_scan.digest(secret_scan.secrets(table(spark, more))).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()))
    want = Counter()
    for k, t in more:
        b = slow_secrets(t or "")
        want[(k, *(sum(x[3] == kind for x in b) for kind in secret_scan.KINDS), sha(",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in b)))] += 1
    assert got == want
    assert secret_scan.secrets(table(spark, [])).count() == 0


def test_entropy_spans_against_whole_counts(spark):
    rng = random.Random(6)
    texts = ["key " + "".join(rng.choice(a) for _ in range(n)) + " end" for n in (24, 30, 64, 200) for a in (secret_scan.ALPHABET[:62], "abcABC12", "0123456789ABCDEF", "ab1")]
    texts += ["id 123e4567-e89b-12d3-a456-426614174000 x", "sha256-" + "".join(rng.choice(secret_scan.ALPHABET[:62]) for _ in range(40)), "q exampleKEY1" + "".join(rng.choice(secret_scan.ALPHABET[:62]) for _ in range(30)), "token=" + "aB3" * 9 + " " + "x" * 8 + "0000" + "".join(rng.choice(secret_scan.ALPHABET[:62]) for _ in range(90))]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind.startswith("entropy")] for r in secret_scan.secrets(table(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        want, left = [], list(t)
        for start, _, end, _ in slow_secrets(t):
            left[start:end] = " " * (end - start)
        for m in re.finditer(secret_scan.CANDIDATE, "".join(left)):
            c = m[0]
            is_hex = re.fullmatch("[0-9a-fA-F]+", c) is not None
            both = re.search("[0-9]", c) and re.search("[a-fA-F]" if is_hex else "[A-Za-z]", c)
            if not both or any(re.search(a, c) for a in secret_scan.ALLOWED) or re.search(secret_scan.ALLOWED_BEFORE, t[max(0, m.start() - 12) : m.start()]):
                continue
            kind = "entropy_hex" if is_hex else "entropy_text"
            w, least = secret_scan.CLASSES[kind]
            entropy = lambda s, w=w: -sum(n / w * np.log2(n / w) for n in Counter(s).values())
            rich = [i for i in range(len(c) - w + 1) if entropy(c[i : i + w]) >= least - 1e-12]
            if rich and not re.search(secret_scan.ALLOWED_SPAN, c[rich[0] : rich[-1] + w]):
                want.append((kind, m.start() + rich[0], m.start() + rich[-1] + w))
        assert got[k] == want, t
    assert sum(map(len, got.values())) > 5


def test_a_text_of_very_many_secrets_and_a_very_long_string(spark):
    rng = random.Random(8)
    many = "".join(f"token=abcdefgh{k % 10} {k:032x} " for k in range(20_000))
    long = "".join(rng.choice(secret_scan.ALPHABET[:62]) for _ in range(100_000))
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.secrets(table(spark, [(1, many), (2, long)]))).collect()}
    assert (got[1].n_assign, got[1].n_hex) == (20_000, 20_000)
    b = slow_secrets(many)
    assert got[1].base_sha256 == sha(",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in b))
    assert got[2].spans == "entropy_text:0:100000"


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[100]  # a third of the queries has many equal vectors
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [1.0] * 3), (2400, [None] * 16), (None, x[0].tolist()), (200, x[200].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as leaf", "3 as ids")
    found = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    y, hit = x.astype(float), 0
    assert sorted(found) == list(range(0, 1500, 100))
    for q, got in found.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        assert len(got) == 10 and all(abs(s - d[v]) < 1e-12 and v != q for v, s in got)
        assert got == sorted(got, key=lambda g: (g[1], g[0]))
        d[q] = np.inf
        hit += len({v for v, _ in got} & set(np.lexsort((np.arange(1500), d))[:10].tolist()))
    assert hit >= 0.9 * 10 * len(found)
    assert ann.nearest(df.limit(0)).count() == 0
    assert [tuple(r) for r in ann.nearest(df.where("vec_id in (0, 1)")).collect()] == [(0, 1, 1, pytest.approx(np.sqrt(((y[0] - y[1]) ** 2).sum())))]


def test_repeated_rows_hide_no_equal_vector(spark):
    """Of equal vectors the nearest are the smallest ids, however often rows are repeated."""
    rows = [(k, [1.0, 2.0]) for k in range(1, 15) for _ in range(3)] + [(1, [1.0, 2.0])] * 11 + [(100, [1.0, 2.0])] * 12
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(100, k, k, 0.0) for k in range(1, 11)]


def slow_private(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_personal_data(spark, rows):
    rng = random.Random(2)
    more = rows + [(5000 + k, "".join(rng.choice("a1.@ +-()25b") for _ in range(rng.randrange(60)))) for k in range(1500)]
    more += [(9000, "4111 1111 1111 1111, x@y, 256.1.1.1 1.2.3.4.5 account no 12345678 IBAN DE89 3704 0044 0532 0130 00 see https://a.example/p?q=1.")]
    found = pii.personal_data(table(spark, more))
    got = Counter(map(tuple, pii.digest(found).drop("spans").collect()))
    want = Counter()
    for k, t in more:
        s = slow_private(t or "")
        want[(k, *(sum(x[0] == kind for x in s) for kind in pii.KINDS), pii.base_hash(s), sum(x[0] in pii.KINDS for x in s))] += 1
    assert got == want
    assert {"url", "iban", "account"} <= {s.kind for r in found.where("doc_id = 9000").collect() for s in r.spans}


def test_word_encoder_equals_the_tokenizer(spark, rows):
    path = word_encoder.default_path()
    enc, tok = word_encoder.WordEncoder(path), Tokenizer.from_file(path)
    hard = ["<|endoftext|> a<|startoftext|>b", "\t a b\x85c İI ſ ǅ ́ é ΑΣ Σ.", "it's I'LL don't ÀÉÎ", "a\x1cb \x0b", "'" * 300, "12.5%%% ١٢", "É² ½x ſŸ ¿Qué? ŉ ß ﬁ", None]
    rng = random.Random(2)
    noise = ["".join(rng.choice("abcdeinthoABC .,;!?-19é²ßÀŸſ\n'’<|") for _ in range(rng.randrange(90))) for _ in range(400)]
    texts = [t for _, t in rows] + hard + noise
    ids, cut = enc.encode_all(pa.array(texts, pa.string()), 9)
    assert cut[0] == 0 and cut[-1] == len(ids)
    for k, t in enumerate(texts):
        assert ids[cut[k] : cut[k + 1]].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 9]


def test_token_files_round_trip(spark, rows):
    tok = Tokenizer.from_file(word_encoder.default_path())
    got = token_files.token_files(table(spark, rows), word_encoder.default_path(), width=64).collect()
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for k, t in rows if k is not None}
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        if r.doc_id is not None:
            assert (r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)
    assert token_files.token_files(table(spark, []), word_encoder.default_path()).count() == 0


def test_sequences_and_masks_are_read_at_random(tmp_path):
    w = token_files.ShardWriter(f"file://{tmp_path}", "s", 8)
    flat = np.arange(8 * 700 + 3, dtype="<u2")
    w.add(pa.array([1]), flat[:5000], np.array([0, 5000]))
    w.add(pa.array([2, None]), flat[5000:], np.array([0, len(flat) - 5000, len(flat) - 5000]))
    w.close()
    again = token_files.ShardWriter(f"file://{tmp_path}", "s", 8)  # the task once more, after its files got their names
    again.add(pa.array([1, 2, None]), flat, np.array([0, 5000, len(flat), len(flat)]))
    again.close()
    r = token_files.ShardReader(f"file://{tmp_path}", "s")
    for k in (0, 255, 256, 699):
        assert r.sequence(k).tolist() == flat[8 * k : 8 * k + 8].tolist() and r.mask(k).all()
    assert r.mask(700).tolist() == [True] * 3 + [False] * 5
    assert [(d, s, len(x)) for d, s, x in r.documents()] == [(1, 0, 5000), (2, 5000, 603), (None, 5603, 0)]


def test_language(spark, rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.97 and all(0 <= r.score <= 1 for r in got)
    hard = docs.select("doc_id", "text", "lang").where("doc_id < 30").unionByName(spark.createDataFrame([(500, None, None), (501, "12 %%", "en"), (None, "the house", None), (502, "", "en")], "doc_id long, text string, lang string"))
    said = {r.doc_id: r.lang_pred for r in lang_id.identify(hard.selectExpr("*", "1 as score", "2 as held")).collect()}
    assert said[500] == said[501] == said[502] == "und" and said[None] != "und"
    assert [r.lang_pred for r in lang_id.identify(spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")).collect()] == ["und"]


def test_language_stage_rejects_what_is_in_no_learned_language(spark):
    import corpus_pipeline

    rng = random.Random(1)
    junk = ["%% 12 $$ 99 -- a " * 30, "#@!$ 0123 {}[] ;; ~~ x " * 20, "Это предложение написано на русском языке и его нельзя узнать. " * 6, "これは日本語の文章です。学習した言語ではありません。" * 6, "Αυτό είναι ένα κείμενο στα ελληνικά. " * 6, "12 %% a", '{"k": 12345, "v": [1, 2, 3]}']
    junk.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(500)))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = {r.doc_id for r in docs.where(r"text rlike '\\p{L}'").select("doc_id").collect()}
    more = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(junk)], SCHEMA)
    kept = corpus_pipeline.language(spark, docs.unionByName(more, allowMissingColumns=True), "")
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids == clean


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def mutated(rng, x, most):
    x = list(x)
    for _ in range(rng.randint(0, most) if x else 0):
        i, k = rng.randrange(max(1, len(x))), rng.random()
        if k < 0.3:
            del x[i : i + 1]
        elif k < 0.6:
            x.insert(i, "z")
        else:
            x[i : i + 1] = "y"
    return "".join(x)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_bit_parallel_distance(threshold):
    rng = random.Random(threshold)
    pairs = []
    while len(pairs) < 800:
        a = "".join(rng.choice("abc") for _ in range(rng.randint(8, 70)))
        b = mutated(rng, a, 5)
        if abs(len(a) - len(b)) <= threshold:
            pairs.append((a, b))
    (a, m), (b, n) = (line_dedup._matrix(list(x)) for x in zip(*pairs, strict=True))
    assert line_dedup.edits_within(a, m, b, n, threshold).tolist() == [distance(x, y) <= threshold for x, y in pairs]


def test_large_groups_of_lines_lose_no_link():
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(50))
    lines = [mutated(rng, base, 4) for _ in range(90)] + [mutated(rng, "".join(rng.choice("abc ") for _ in range(48)), 1) for _ in range(10)]

    def roots(edges):
        up = list(range(len(lines)))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return [find(k) for k in range(len(lines))]

    want = [(a, b) for a in range(len(lines)) for b in range(a) if distance(lines[a], lines[b]) <= 2]
    got = list(line_dedup._Group(lines, 2).forest(np.arange(len(lines))))
    assert roots(got) == roots(want) and all(distance(lines[a], lines[b]) <= 2 for a, b in got)


def lines_left(spark, docs, threshold):
    """(doc_id, n_lines, n_removed, hash) of each document by brute force over all pairs of lines."""
    least = {}
    for k, t in docs:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                least[x] = min(least.get(x, float("inf")), float("inf") if k is None else k)
    said = spark.createDataFrame([(x,) for x in least] or [("",)], "line string").selectExpr("line", "xxhash64(line) a", "xxhash64(1, line) b").collect()
    tie = {r.line: (r.a, r.b) for r in said}
    stay = []
    for x in sorted(least, key=lambda x: (least[x], tie[x])):
        near = lambda y, x=x: abs(len(x) - len(y)) <= (most := min(threshold, min(len(x), len(y)) // line_dedup.PER_EDIT)) and distance(x, y) <= most
        if not any(near(y) for y in stay):
            stay.append(x)
    stay, out = set(stay), Counter()
    for k, t in docs:
        if t is None:
            out[(k, 0, 0, sha(""))] += 1
            continue
        kept, seen = [], set()
        for x in t.split("\n"):
            if x.strip(" ") and (x not in stay or x in seen or least[x] != (float("inf") if k is None else k)):
                continue
            kept.append(x)
            seen.add(x) if x.strip(" ") else None
        out[(k, len(t.split("\n")), len(t.split("\n")) - len(kept), sha("\n".join(kept)))] += 1
    return out


@pytest.mark.parametrize("block", [4, 1024])
def test_lines(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "CHUNK", 8)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(2)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.choice([9, 11, 19, 21, 31, 45]))) for _ in range(30)]
    docs = [(k, "\n".join(mutated(rng, rng.choice(base), 3) for _ in range(rng.randrange(6)))) for k in range(120)]
    docs += [(500, ""), (501, None), (502, "\n\n"), (503, docs[3][1]), (503, docs[3][1]), (None, docs[4][1]), (None, "only a row without an id has this"), (504, "}\n{\n}\nb")]
    want = lines_left(spark, docs, 2)
    df = table(spark, docs)
    assert Counter(map(tuple, line_dedup.digest(line_dedup.dedup_lines(df)).collect())) == want
    left = line_dedup.filter_lines(df)
    assert left.columns == df.columns
    assert Counter(sha(r.text) if r.text is not None else sha("") for r in left.collect()) == Counter(x[3] for x in want.elements())
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_a_line_goes_only_if_one_that_stays_is_near(spark):
    """Twelve lines, each two edits from the next: of each three neighbours one stays."""
    chain = ["a" * (40 - 2 * k) + "b" * 2 * k for k in range(12)]
    got = line_dedup.dedup_lines(table(spark, list(enumerate(chain)))).collect()
    assert Counter(map(tuple, line_dedup.digest(line_dedup.dedup_lines(table(spark, list(enumerate(chain))))).collect())) == lines_left(spark, list(enumerate(chain)), 2)
    assert sum(r.n_removed for r in got) == 6


def test_lines_of_every_length_take_part(spark, monkeypatch):
    """All lines but blank ones: equal short lines, pairs at the lengths where an edit more is allowed."""
    monkeypatch.setattr(line_dedup, "CHUNK", 8)
    rng = random.Random(12)
    draw = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(n))
    texts = [draw(rng.choice([1, 2, 3, 4, 5, 7, 9, 10, 11, 12, 19, 20, 28, 29, 30, 31])) for _ in range(90)]
    texts += [mutated(rng, x, 3) for x in texts for _ in range(2)] + ["And ornd.", "And ornd.", "x" * 29, "x" * 30, " ", "", "  "]
    for threshold in (1, 2):
        got = line_dedup.digest(line_dedup.dedup_lines(table(spark, list(enumerate(texts))), threshold)).collect()
        assert Counter(map(tuple, got)) == lines_left(spark, list(enumerate(texts)), threshold)


def test_decontamination(spark, rows):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench += [(900, None), (901, ""), (902, "Short ITEM here"), (902, "Short ITEM here"), (903, "É é"), (904, bench[1][1])]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = rows + [(700, "so a short item here, and " + bench[0][1] + " and on"), (701, bench[2][1][:200]), (702, "é É"), (703, "É é é"), (704, "K elvin short item hereabouts")]
    grams = defaultdict(set)
    for k, t in bench:
        w = words(t)
        for i in range(max(len(w) - 9, min(len(w), 1))):
            grams[tuple(w[i : i + 10])].add(str(k))
    sizes, want, clean = {len(g) for g in grams}, Counter(), Counter()
    for k, t in docs:
        w, hit, items = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    items |= grams[g]
        want[(k, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit))] += 1
        clean[k] += not hit
    df, b = table(spark, docs), spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "1 as w", "'z' as gram")
    assert Counter(map(tuple, decontam.report(df, b).collect())) == want
    kept = decontam.remove(df, b)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == +clean
    cut = decontam.remove(df, b, whole=False)
    assert cut.columns == df.columns and {r.doc_id: r.text for r in cut.collect()}[702].strip() == "é É" and decontam.report(cut, b).where("contaminated and doc_id = 700").count() == 0
    assert decontam.report(table(spark, []), b).count() == 0 and decontam.report(df, b.limit(0)).where("contaminated").count() == 0


def test_packing(spark, rows):
    tok = Tokenizer.from_file(word_encoder.default_path())
    got = packing.pack(table(spark, rows), word_encoder.default_path(), capacity=256, ids=True).collect()
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for k, t in rows if k is not None}
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(k for k, _ in rows)
    bins = defaultdict(list)
    for r in got:
        if r.doc_id is not None:
            x = ids[r.doc_id][256 * r.piece : 256 * r.piece + 256]
            assert (r.start, r.length, r.ids_crc32, r.ids) == (256 * r.piece, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), x)
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 256
    assert len(bins) <= 1.02 * sum(r.length for r in got) / 256 + 2
    assert packing.pack(table(spark, []), word_encoder.default_path()).count() == 0


def test_packing_plan_keeps_all_items():
    rng = random.Random(1)
    for _ in range(60):
        c = rng.randint(5, 60)
        counts = {rng.randint(1, c): rng.randint(0, 30) for _ in range(10)}
        got = Counter()
        for items, many in packing.plan(counts, c):
            assert sum(items) <= c and many > 0
            for n in items:
                got[n] += many
        assert got == Counter(counts) - Counter()


def slow_repeats(docs, length):
    seen = Counter()
    for _, t in docs:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = Counter()
    for k, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[(k, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g)))] += 1
    return out


def test_repeated_strings(spark):
    rng = random.Random(7)
    u, v = "".join(rng.choice("abcdefgh ") for _ in range(4000)), "".join(rng.choice("xyz ") for _ in range(3000))
    texts = [u[:2000], v[:100] + u[300:705] + v[100:200], v[200:250] + u[300:700], u[1000:1399], "a" * 900, "b" * 399, "b" * 400 + "c", "", None, v + v[:900]]
    texts += [v[500:1200] + u[3000:3500] + v[500:1200], "é" * 400, u[2500:2700] + "Q" + u[2701:3100]] + [u[100 + k : 900] + str(k) + u[1400:1900] for k in range(12)] + [u[:2000]]
    docs = [*enumerate(texts), (0, texts[0]), (None, texts[1])]
    got = substring_dedup.remove_repeats(table(spark, docs)).collect()
    assert Counter(tuple(r)[:5] for r in got) == slow_repeats(docs, 400)
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(table(spark, docs), length=100)


def test_passages_of_words_that_other_documents_have(spark):
    rng = random.Random(17)
    draw = lambda n: [rng.choice("the of in a is to or be it on at".split()) + rng.choice(["", "", "x", "yy"]) for _ in range(n)]
    u, v, own = draw(400), draw(90), draw(60)
    docs = [" ".join(u[:200]), " ".join(draw(30) + u[100:151] + draw(30)), " ".join(draw(30) + u[220:270]), "\n".join(v), "  " + "\t ".join(draw(9) + v[20:85]), " ".join(own + draw(5) + own)]
    docs += [" ".join(u[200 + k : 300 + k]) for k in range(9)] + ["", None, " ".join(draw(50)), " ".join(draw(20))] + [" ".join(own[:40])] * 2 + [" ".join(u[:60])] * 3
    docs = [*enumerate(docs), (None, docs[3])]
    seen = defaultdict(set)
    for k, (_, t) in enumerate(docs):
        w = (t or "").encode().split()
        for i in range(len(w) - 50):
            seen[tuple(w[i : i + 51])].add(k)
    want = Counter()
    for d, t in docs:
        w = (t or "").encode().split()
        want[(d, len({j for i in range(len(w) - 50) if len(seen[tuple(w[i : i + 51])]) > 1 for j in range(i, i + 51)}))] += 1
    assert Counter((r.doc_id, r.n_passage_words) for r in substring_dedup.remove_repeats(table(spark, docs)).collect()) == want


def hard_documents(spark):
    """Labelled documents with null and empty texts, rows repeated, ids missing and repeated, near copies, and columns whose names operators use inside."""
    real = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 90").collect()]
    t = next(r[1] for r in real if r[1] and len(r[1].split()) > 120)
    w = t.split(" ")
    more = [(500, t), (500, t), (501, " ".join([*w[:-1], "changed"])), (None, t), (None, "an own text without any id at all, twice"), (None, "an own text without any id at all, twice"), (502, None), (503, ""), (504, None), (505, "x"), (506, "x"), (3, "another text under an id that is taken"), (507, "word " * 9000)]
    rows = real + [(k, x, None, "src0", None if x is None else len(x)) for k, x in more]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as n", "'k' as key", "2 as h", "'w' as gram", "3 as pos")


def near_groups(rows):
    """The rows (doc_id, text) that stay, by brute force: one of each component of shingle sets with a similarity of 0.8."""
    sets = []
    for _, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or (sets[i] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i])
    return groups.values()


def near_copies(rng, groups):
    """Per (copies, words, changed): texts made of one by changing so many words; so pairs lie on both sides of 0.8, some of them very short."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out = []
    for copies, words, changed in groups:
        a = [word() for _ in range(words)]
        for _ in range(copies):
            b = list(a)
            for i in rng.sample(range(words), changed):
                b[i] = word()
            out.append(" ".join(b[: words - rng.randrange(2)]))
    return list(enumerate(out))


def test_similar_sets_are_proposed_by_simhash(spark):
    """The bits are those that over half the distinct shingles' XXH64 set, and sets at 0.8 share a key and a table in it."""
    rows = near_copies(random.Random(21), [(2, 200, 4)] * 60)
    got = {r.doc_id: r for r in simhash._signatures(table(spark, rows), 5, 0.8).collect()}
    for k, t in rows[:10]:
        w = t.split()
        h = [xxhash.xxh64_intdigest(x, 42) for x in {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}]
        assert got[k].n == len(h) and got[k].f0 & ((1 << 64) - 1) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    bits, groups = 4, simhash.key_groups(4, 0.8)
    fps = {k: np.array([[getattr(r, f"f{i}") for i in range(simhash.WORDS)]], np.int64).view(np.uint64) for k, r in got.items()}
    same = lambda x, y, at: simhash._value(fps[x], at) == simhash._value(fps[y], at)
    assert all(any(same(k, k + 1, at) and any(same(k, k + 1, x) for x in tables) for at, tables in simhash._sampled(bits, groups)) for k in range(0, len(rows), 2))


def test_similar_in_chunks_equals_brute_force(spark, monkeypatch):
    """Keys and groups cut into chunks lose no link, nor do sets of one to a few shingles."""
    monkeypatch.setattr(simhash, "HELD", 8)
    monkeypatch.setattr(simhash, "HELD_MOST", 16)
    monkeypatch.setattr(simhash, "SETS", 8)
    rows = near_copies(random.Random(22), [(60, 120, 2), (60, 150, 3), *[(3, n, n > 30) for n in range(4, 40)]])
    want = Counter((k, min(group)[0]) for group in near_groups(rows) for k, _ in group)
    assert Counter(map(tuple, simhash.similar(table(spark, rows)).collect())) == want and 1 < len({c for _, c in want}) < len(rows)


def test_near_duplicates_run_few_jobs(spark):
    """A job's stages, plans and broadcasts stay in the driver's memory for long: their number must not follow the sizes of groups."""
    import corpus_pipeline

    docs = table(spark, near_copies(random.Random(23), [(300, 200, 4), *[(2, 100, 2)] * 50])).cache()
    docs.count()
    spark.sparkContext.setJobGroup("near", "near duplicates")
    try:
        corpus_pipeline.near_duplicates(spark, docs, SF).count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near"))
    assert 0 < jobs <= 120, jobs


def test_pipeline_stages_on_hard_rows(spark):
    import corpus_pipeline

    docs = hard_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pairs = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and not pairs(kept) - Counter(rows)
    assert {k for k, t in pairs(kept)} >= {500, 501, 3, None} and not {502, 503, 504} & {k for k, _ in pairs(kept)} and pairs(kept)[(500, rows[[k for k, _ in rows].index(500)][1])] == 2
    without = corpus_pipeline.language(spark, docs.withColumn("lang", lit(None).cast("string")), SF)
    assert pairs(without) == Counter((k, t) for k, t in rows if t and (n := len(re.findall(r"[^\W\d_]", t))) and n >= corpus_pipeline.LETTERS * len(re.findall(r"\S", t)))
    left = corpus_pipeline.lines(spark, docs, SF)
    assert left.columns == docs.columns and left.count() == len(rows)
    assert Counter((r.doc_id, sha(r.text or "")) for r in left.collect()) == Counter((x[0], x[3]) for x in lines_left(spark, rows, 2).elements())
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in left.collect())
    near = corpus_pipeline.near_duplicates(spark, docs, SF)
    got = pairs(near)
    assert near.columns == docs.columns
    for group in near_groups(rows):
        stay = [x for x in set(group) if got[x]]
        ids = [k for k, _ in group if k is not None]
        assert sum(got[x] for x in set(group)) == 1 and (not ids or stay[0][0] == min(ids)), group
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words(r.text)] for i in range(max(len(w) - 9, min(len(w), 1)))}
    sizes = {len(g) for g in grams}
    clean = Counter((k, t) for k, t in rows if not any(tuple(w[i : i + n]) in grams for w in [words(t)] for n in sizes for i in range(len(w) - n + 1)))
    assert pairs(corpus_pipeline.decontamination(spark, docs, SF)) == clean and len(clean) < len(rows)
    tok = Tokenizer.from_file(word_encoder.default_path())
    ids = Counter()
    for k, t in rows:
        x = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for piece in range(0, len(x), 2048):
            ids[(k, piece // 2048, tuple(x[piece : piece + 2048]))] += 1
    assert Counter((r.doc_id, r.piece, tuple(r.ids)) for r in corpus_pipeline.pack(spark, docs, SF).collect()) == ids


def test_held_out_and_dead_rows_take_no_part_in_the_sample(spark):
    """A language of sixty texts among sixty thousand rows without text, and labels that only held-out documents have."""
    many = spark.range(60_000).selectExpr("id as doc_id", "cast(null as string) as text", "'xx' as lang")
    good = spark.range(60_000, 60_200).selectExpr("id as doc_id", "concat('a text of language xx number ', id) as text", "case when crc32(cast(cast(id as string) as binary)) % 3 = 1 then 'held' else 'xx' end as lang")
    rows = lang_id.sample(many.unionByName(good))
    assert {x for x, _ in rows} == {"xx"} and len(rows) == good.where("lang = 'xx'").count()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.checkpoint(stage(spark, docs, SF))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now and now <= ids, name
        ids = now
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").collect()} == ids
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
