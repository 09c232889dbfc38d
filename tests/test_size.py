"""Work in proportion to the tables: what queries shuffle, on hard rows, and that they are right there."""

from pathlib import Path

import duckdb
import pytest

from pagewright import catalog

SF = "/root/testdata/sf0.001"


def _children(node):
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if kind.endswith("QueryStageExec"):
        return [node.plan()]
    if kind == "ReusedExchangeExec":
        return []
    return [node.children().apply(i) for i in range(node.children().size())]


def shuffled(df):
    """The rows of a query; the bytes (not compressed) and rows that each of its shuffles wrote, and the greatest share of one partition."""
    rows, found, todo, share = df.collect(), [], [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "ShuffleQueryStageExec":
            sizes = list(node.mapStats().get().bytesByPartitionId()) if node.mapStats().isDefined() else []
            share = max(sizes, default=0) / max(1, sum(sizes))
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            value = lambda k: node.metrics().get(k).get().value()  # noqa: B023, E731
            found.append((value("dataSize"), value("shuffleRecordsWritten"), share))
        todo += _children(node)
    return rows, found


@pytest.fixture()
def large(spark):
    """Joins as of large tables: a side is broadcast only where a query says so."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture()
def tables(spark, tmp_path):
    """Writes tables, with the smallest ones beside them, and gives their folder."""

    def put(**own):
        for t in catalog.BASE:
            if t in own:
                own[t].write.parquet(str(tmp_path / f"{t}.parquet"))
            else:
                (tmp_path / f"{t}.parquet").symlink_to(Path(SF) / f"{t}.parquet")
        return str(tmp_path)

    return put


def other(name, folder):
    con = duckdb.connect()
    for t in catalog.BASE:
        p = Path(folder) / f"{t}.parquet"
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    result = con.execute(catalog.oracle_sql()[name])
    return [d[0] for d in result.description], result.fetchall()


def same(name, df, folder, rows=None):
    names, theirs = other(name, folder)
    got = sorted((tuple(r[c] for c in names) for r in (df.collect() if rows is None else rows)), key=repr)
    assert got == sorted(theirs, key=repr)
    assert got


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
_COMMON = " ".join(f"word{chr(97 + k)}" for k in range(20))


def _odd_documents():
    """Texts without language, text or id, repeated rows and lines, words in one, two and three texts and in other languages."""
    rows = [(k, f"{_COMMON} plain prose\nand a second line of plain prose\n{_COMMON} plain prose", "en", "src1", 1) for k in range(4)]
    rows += [(10, f"{_COMMON} strange lines proses\nonce 12 it's ABC2 known onand the", "en", "src0", 1)] * 2 + [(10, f"{_COMMON} strange", "de", "src1", 1)]
    rows += [(20 + k, f"{_COMMON} seul\nla ligne seule deux fois l’eau\nfuera plain prose and line", "fr", "src2", 1) for k in range(2)]
    rows += [(30 + k, f"plain prose of no tongue {_COMMON}", None, "src1", 1) for k in range(4)]
    rows += [(40, None, "en", "src0", 1), (41, "", "en", "src0", 1), (42, "\n\n", "de", None, 1), (None, f"{_COMMON} idless", "en", "src0", 1), (None, f"{_COMMON} idless", "en", "src0", 1)]
    rows += [(50 + k, "and plain prose second line of fuera seul la ligne", "es", "src1", 1) for k in range(3)] + [(60, f"{_COMMON} and plain prose second line of plain", "de", "src1", 1)]
    return rows


LEXICON = ("a1_word_tickets", "a9_prose_gate", "k10_diagnostic_view", "k10_located_view", "k10_sources_view", "k10_unique_view", "l20_collapsed_tickets", "l3_misspellings", "l5_stem_candidates", "l6_run_check", "l7_rule_names", "q19_potential_translation", "u1_all_findings", "u5_wrong_in_all_languages")


@pytest.mark.parametrize(("name", "common"), [*((name, 4_000_000) for name in LEXICON), ("a1_word_tickets", 1), ("a9_prose_gate", 1), ("l6_run_check", 1)])
def test_odd_documents(spark, tables, monkeypatch, name, common):
    """Null languages, ids and texts, repeated rows; with every known word in the broadcast, and with few."""
    from pagewright.operators import lexis

    monkeypatch.setattr(lexis, "COMMON", common)
    folder = tables(documents=spark.createDataFrame(_odd_documents(), DOCUMENTS))
    same(name, catalog.QUERIES[name](spark, folder), folder)


def test_lines_are_not_shuffled_with_every_word(spark, tables, large):
    """a line of 4,000 words goes through a shuffle a few times, not once a word."""
    line = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(4000))
    folder = tables(documents=spark.createDataFrame([(k, line, "en", "src0", 1) for k in range(3)], DOCUMENTS))
    df = catalog.QUERIES["a9_prose_gate"](spark, folder)
    rows, found = shuffled(df)
    same("a9_prose_gate", df, folder, rows)
    assert sum(size for size, _, _ in found) < 20 * 3 * len(line)


@pytest.mark.parametrize("name", ["a1_word_tickets", "l20_collapsed_tickets", "u1_all_findings", "k10_located_view", "l6_run_check", "l7_rule_names", "k10_diagnostic_view", "l5_stem_candidates", "q19_potential_translation", "u5_wrong_in_all_languages", "k10_unique_view", "k10_sources_view"])
def test_common_words_are_settled_where_they_are_read(spark, tables, large, name):
    """F2, F3, F5 to F10, F15: of texts of common words few rows are shuffled, and no hot key."""
    text = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(100))
    empty = {t: spark.read.parquet(f"{SF}/{t}.parquet").limit(0) for t in ("pages", "events")}
    rows = [(k, f"{text} rare{chr(97 + k % 26)}{chr(97 + k // 26)}", "en", "src0", 1) for k in range(400)] + [(400 + k, " ".join(text.split()[k : k + 10]), "fr", "src0", 1) for k in range(2)]
    folder = tables(documents=spark.createDataFrame(rows, DOCUMENTS).repartition(4), **(empty if name == "u1_all_findings" else {}))
    df = catalog.QUERIES[name](spark, folder)
    rows, found = shuffled(df)
    if name not in ("l5_stem_candidates", "k10_sources_view"):  # which have none here
        same(name, df, folder, rows)
    assert sum(n for _, n, _ in found) < 400 * 100 / 4


def test_pages_are_flattened_in_small_parts():
    """what Python holds of a batch is 64 pages or a megabyte, not the batch."""
    import pyarrow as pa

    from pagewright.operators import markup

    def parts(texts, **limits):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["page_id", "html"])
        got = list(markup.slices([batch], 1, **limits))
        assert [x for b in got for x in b.column(1).to_pylist()] == texts
        return [b.num_rows for b in got]

    assert parts(["x"] * 200) == [64, 64, 64, 8]
    assert parts([None, "", "y" * 10, "y" * 5, "y" * 6, None, "y" * 11, "z"], size=10) == [3, 1, 2, 1, 1]
    assert parts([]) == []


ASSETS = ("a6_page_bloat", "a7_baseline", "a11_routing", "j14_asset_sizes", "j15_script_reach", "l19_script_scan", "o4_largest_assets", "o4_more_than_five", "q25_bloat_deltas", "q25_bloat_issues", "w7_over_baseline")


def _lines(spark, rows):
    frame = spark.read.parquet(f"{SF}/lineitem.parquet")
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    keys = spark.createDataFrame(rows, "o long, p long")
    return keys.selectExpr(*[f"cast({'o' if c == 'l_orderkey' else 'p' if c == 'l_partkey' else 'null'} as {k}) as {c}" for c, k in kinds.items()])


@pytest.mark.parametrize("name", ASSETS)
def test_odd_references(spark, tables, name):
    """Pages without the asset that nearly all have, with it twice, with assets that are not there; parts that are there twice; null keys."""
    parts = spark.read.parquet(f"{SF}/part.parquet")
    rows = [(k, 2 + (k * m) % 60) for k in range(1, 120) for m in (1, 3, 7)] + [(20, 1), (40, 1), (40, 1), (21, 1), (60, 99999999), (61, 99999999), (None, 5), (None, 1), (62, None)]
    folder = tables(lineitem=_lines(spark, rows), part=parts.union(parts.where("p_partkey in (1, 4, 5, 6)")))
    same(name, catalog.QUERIES[name](spark, folder), folder)


@pytest.mark.parametrize("name", ASSETS)
def test_no_shuffle_by_the_asset_of_all_pages(spark, tables, large, name):
    """F11 to F14, F16: a shuffle gives no task the pages of the asset that nearly all have."""
    folder = tables(lineitem=_lines(spark, [(k, 2 + k % 50 if k % 4 == 0 else None) for k in range(1, 8001)]))
    df = catalog.QUERIES[name](spark, folder)
    rows, found = shuffled(df)
    assert (rows or name == "o4_more_than_five") and max(share for _, n, share in found if n >= 1000) < 0.5
