"""Results in the order and form they are handed on in: sorted views, delimited pairs, the sitemap, tickets, bloat deltas, table functions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..catalog import portable, query, relation, table
from ..functions import text as T
from .lexis import unknown
from .rules import cases

# --- orders: rows are sorted by ranges, in as many tasks as there are; none holds all ---------------------------------------


@query("o1_findings_in_order", "select p.url, f.issue_type, f.pos, f.detail from {all_findings} f join pages p on p.page_id = f.page_id order by all")
def o1(spark, sf_dir):
    found = table(spark, sf_dir, "all_findings").join(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    return found.select("url", "issue_type", "pos", "detail").orderBy("url", "issue_type", "pos", "detail")


@query("o2_ledger_in_order", "select type, url, word, status from {ledger_old} order by type, url, word")
def o2(spark, sf_dir):
    return table(spark, sf_dir, "ledger_old").select("type", "url", "word", "status").orderBy("type", "url", "word")


@query("o3_links_in_order", "select page_id, url, href from {anchors} order by page_id, url, href")
def o3(spark, sf_dir):
    rows = table(spark, sf_dir, "anchors").select("page_id", "url", "href")
    return rows.orderBy(*rows.columns)


cases("c_dictionary", "line, pos", ("# head", 1), ("zoo", 2), ("Apple", 3), ("# more", 4), ("apple", 5), ("bar", 6), ("", 7))


@query("o7_dictionary_in_order", "select line, row_number() over (order by case when line like '#%' then 0 else 1 end, case when line like '#%' then pos else 0 end, lower(line), line) as r from {c_dictionary} where line <> ''")
def o7(spark, sf_dir):
    """Comments first as they stood, then the words without regard to case; a dictionary's lines are few."""
    lines = table(spark, sf_dir, "c_dictionary").where("line <> ''").agg(F.collect_list(F.struct(F.when(F.startswith("line", F.lit("#")), F.struct(F.lit(0).alias("a"), F.col("pos").alias("b"))).otherwise(F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"))).alias("k"), F.lower("line").alias("l"), F.col("line"))).alias("x"))
    return lines.select(F.posexplode(F.array_sort("x")).alias("r", "y")).select("y.line", (F.col("r") + 1).cast("long").alias("r"))


@query("o8_routing_in_order", "select a.url, count(distinct r.page_id) as reach from {assets} a join {page_refs} r on r.asset_id = a.asset_id where a.ext = '.js' group by a.url order by reach desc, url")
def o8(spark, sf_dir):
    a = table(spark, sf_dir, "assets").where("ext = '.js'").join(table(spark, sf_dir, "page_refs"), "asset_id")
    return a.groupBy("url").agg(F.count_distinct("page_id").alias("reach")).orderBy(F.desc("reach"), "url")


@query("u7_distinct_anchors", "select distinct page_id, lower(href) as href from {anchors}")
def u7(spark, sf_dir):
    """The visible forms of a page's links, each once: distinct where the page is, so nothing is shuffled."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1)), lambda x: F.lower(x)))
    return table(spark, sf_dir, "pages_x").select("page_id", F.explode(found).alias("href"))


@query("s17_script_files", "select url, bytes from {assets} where url like '%.js' and not url like '%/base64assets/%' and bytes <= 32 * 1024 * 1024 order by lower(url)")
def s17(spark, sf_dir):
    a = table(spark, sf_dir, "assets").select("url", "bytes")
    inner = F.array_contains(F.split("url", "/"), "base64assets")
    return a.where(F.endswith("url", F.lit(".js")) & ~inner & (F.col("bytes") <= 32 << 20)).orderBy(F.lower("url"))


# --- forms -------------------------------------------------------------------------------------------------------------------


@query("k9_sitemap", "select '<url><loc>' || replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</loc></url>' as line from {page_index} where not url like '%page=2%' and url like '%://%' ")
def k9(spark, sf_dir):
    """A line of the sitemap for each page that is not excluded; the frame around them is the writer's."""
    loc = F.col("url")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        loc = F.replace(loc, F.lit(sign), F.lit(name))
    kept = table(spark, sf_dir, "page_index").where(~F.contains("url", F.lit("page=2")) & F.contains("url", F.lit("://")))
    return kept.select(F.concat(F.lit("<url><loc>"), loc, F.lit("</loc></url>")).alias("line"))


_QUOTED = "case when contains({f}, '{d}') or contains({f}, '\"') then '\"' || replace({f}, '\"', '\"\"') || '\"' else {f} end"


def _line(d: str) -> str:
    return f" || '{d}' || ".join(_QUOTED.format(f=f, d=d) for f in ("status", "message", "source"))


@query("k6_csv_pair", f"select pos, {_line(';')} as semicolon, {_line(',')} as comma from {{fetch_log}}")
def k6(spark, sf_dir):
    """A row as a line for either locale."""
    fields = [F.col(c) for c in ("status", "message", "source")]
    return table(spark, sf_dir, "fetch_log").select("pos", T.csv_line(";", *fields).alias("semicolon"), T.csv_line(",", *fields).alias("comma"))


cases("c_cells", "said", ("=1+1",), ("+x",), ("-y",), ("@z",), ("~tab",), ("plain",), ("",))


@query("k5_formula_guard", r"select said, case when regexp_matches(x, '^[=+@\t\r-]') then chr(39) || x else x end as safe, x as back from (select said, replace(said, '~', chr(9)) as x from {c_cells}) t")
def k5(spark, sf_dir):
    """The guard against formulas, and what takes it off again."""
    safe = T.guarded(F.replace("said", F.lit("~"), F.lit("\t")))
    return table(spark, sf_dir, "c_cells").select("said", safe.alias("safe"), T.unguarded(safe).alias("back"))


@query("a1_word_tickets", r"select doc_id, lower(w) as word, first(w order by pos) as spelled, min(pos) as first_pos, count(*) as n from (select doc_id, unnest(m) as w, unnest(range(1, len(m) + 1)) as pos from (select doc_id, regexp_extract_all(text, '([\p{L}]+)', 1) as m from documents) t) u where not exists (select 1 from (select distinct word from {lexicon}) l where l.word = lower(u.w)) group by doc_id, lower(w)")
def a1(spark, sf_dir):
    """Words that no lexicon has, of each document by case-insensitive form: as first spelled, where, how often."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"([\p{L}]+)"), F.lit(1))).alias("pos", "w")).withColumn("word", F.lower("w"))
    missing = unknown(spark, sf_dir, words, F.col("langs").isNotNull())
    return missing.groupBy("doc_id", F.lower("w").alias("word")).agg(F.min_by("w", "pos").alias("spelled"), (F.min("pos") + 1).cast("long").alias("first_pos"), F.count("*").alias("n"))


_SCRIPT = r"<script>([^<]*)"


@query("w4_script_ordinals", f"select page_id, '#' || unnest(range(1, len(m) + 1)) as ordinal, unnest(m) as src from (select page_id, regexp_extract_all(html, '{_SCRIPT}', 1) as m from pages) t")
def w4(spark, sf_dir):
    """A page's scripts by their place in it."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_SCRIPT), F.lit(1))).alias("at", "src")).select("page_id", F.concat(F.lit("#"), (F.col("at") + 1).cast("string")).alias("ordinal"), "src")


# --- bloat -------------------------------------------------------------------------------------------------------------------

# Kilobytes from which scripts, style sheets and embedded files are too large, and a page too far above the baseline.
_KB = {"js": 500, "css": 500, "base64": 100, "above": 3000}
relation(
    "page_weight",
    r"""select b.page_id, b.refs, b.total, b.js, b.css, b.large_js, b.large_css, (b.page_id % 7) * 1000 as inlined, (b.page_id % 5) * 30000 as base64, b.page_id % 11 % 2 as json from {bloat} b""",
)
_FLAGS = f"case when large_js > 0 then 'OVERSIZED_JS' end, case when large_css > 0 then 'OVERSIZED_CSS' end, case when inlined > 0 then 'INLINED_CSS' end, case when base64 >= {_KB['base64']} * 1024 then 'BASE64_LARGE' end, case when json > 0 then 'JSON_BLOBS' end"


def _flags():
    rules = {"OVERSIZED_JS": F.col("large_js") > 0, "OVERSIZED_CSS": F.col("large_css") > 0, "INLINED_CSS": F.col("inlined") > 0, "BASE64_LARGE": F.col("base64") >= _KB["base64"] * 1024, "JSON_BLOBS": F.col("json") > 0}
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


@query("q25_bloat_issues", f"select page_id, array_to_string(list_sort(list_filter([{_FLAGS}], lambda x: x is not null)), '|') as issues from {{page_weight}}")
def q25(spark, sf_dir):
    return table(spark, sf_dir, "page_weight").select("page_id", F.array_join(F.array_sort(_flags()), "|").alias("issues"))


@query(
    "q25_bloat_deltas",
    f"""with w as (select *, list_filter([{_FLAGS}], lambda x: x is not null) as flags from {{page_weight}}), s as (select min(js) as js0, min(css) as css0, min(total) as total0, min(refs) as refs0 from w where total = (select min(total) from w)),
    d as (select page_id, refs - refs0 as refs, total - total0 as total, js - js0 as js, css - css0 as css, flags, len(list_filter(flags, lambda x: x in ('BASE64_LARGE', 'INLINED_CSS', 'JSON_BLOBS'))) > 0 as marked from w, s where total > total0)
    select page_id, refs, total, js, css, coalesce(nullif(array_to_string(list_sort(list_concat(list_filter(flags, lambda x: not x like 'OVERSIZED%'), list_filter([case when js >= {_KB["js"]} * 1024 then 'EXTRA_JS' end, case when css >= {_KB["css"]} * 1024 then 'EXTRA_CSS' end], lambda x: x is not null))), '|'), ''), 'ABOVE_BASELINE') as issues
    from d where (total >= {_KB["above"]} * 1024 or marked) and (js >= {_KB["js"]} * 1024 or css >= {_KB["css"]} * 1024 or marked)""",
)
def q25_deltas(spark, sf_dir):
    """What pages have above the lightest one, if that is much or they are marked for something else."""
    w = table(spark, sf_dir, "page_weight").withColumn("flags", _flags())
    least = w.agg(F.min("total").alias("total0"))
    base = w.join(F.broadcast(least), w["total"] == least["total0"]).agg(*[F.min(c).alias(f"{c}0") for c in ("js", "css", "total", "refs")])  # one row
    d = w.crossJoin(F.broadcast(base)).where("total > total0").select("page_id", *[(F.col(c) - F.col(f"{c}0")).alias(c) for c in ("refs", "total", "js", "css")], "flags")
    marked = F.arrays_overlap("flags", F.array(*[F.lit(x) for x in ("BASE64_LARGE", "INLINED_CSS", "JSON_BLOBS")]))
    js, css = F.col("js") >= _KB["js"] * 1024, F.col("css") >= _KB["css"] * 1024
    kept = d.where(((F.col("total") >= _KB["above"] * 1024) | marked) & (js | css | marked))
    said = F.array_sort(F.concat(F.filter("flags", lambda x: ~F.startswith(x, F.lit("OVERSIZED"))), F.array_compact(F.array(F.when(js, "EXTRA_JS"), F.when(css, "EXTRA_CSS")))))
    return kept.select("page_id", "refs", "total", "js", "css", F.when(F.size(said) > 0, F.array_join(said, "|")).otherwise("ABOVE_BASELINE").alias("issues"))


# --- table functions -----------------------------------------------------------------------------------------------------------


@udtf(returnType="pos int, start int, word string")
class Tokens:
    """The words of a text with their places."""

    def eval(self, text: str):
        for k, m in enumerate(re.finditer(r"[^\W\d_]+", text or "")):
            yield k + 1, m.start() + 1, m[0]


@query("e7_token_rows", r"select page_id, pos, word from (select page_id, unnest(range(1, len(m) + 1)) as pos, unnest(m) as word from (select page_id, regexp_extract_all(regexp_extract(html, '<title>([^<]*)', 1), '([\p{L}]+)', 1) as m from pages) t) u")
def e7(spark, sf_dir):
    """The tokenizer as a table function, for those who call it from SQL; queries of the library take words by expressions."""
    spark.udtf.register("pw_tokens", Tokens)
    table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title")).createOrReplaceTempView("pw_titles")
    return spark.sql("select page_id, cast(pos as bigint) as pos, word from pw_titles, lateral pw_tokens(title)")


#: Extractors as a user writes them; the last is no expression and is passed over.
EXTRACTORS = {"server": r"Server: ([^~]+)", "length": r"Content-Length: ([0-9]+)", "broken": r"(["}


@query("e4_user_extractors", "select id, 'server' as name, regexp_extract(said, 'Server: ([^~]+)', 1) as value from {c_sidecars} union all select id, 'length', regexp_extract(said, 'Content-Length: ([0-9]+)', 1) from {c_sidecars}")
def e4(spark, sf_dir):
    def valid(pattern: str) -> bool:
        try:
            re.compile(pattern)
        except re.error:
            return False
        return True

    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.regexp_extract("said", p, 1).alias("value")) for k, p in EXTRACTORS.items() if valid(p)])
    return table(spark, sf_dir, "c_sidecars").select("id", F.inline(rows))


cases("c_blobs", "id, said", (1, "// ===== one.js · script 1~var a;~// ===== two.js · script 2~x~y"), (2, "no header"), (3, "~// ===== three.js · script~"))


@query("j11b_header_offsets", "select id, start, split_part(substr(line, 10), ' · script', 1) as name from (select id, line, coalesce(sum(length(line) + 1) over (partition by id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as start from (select id, unnest(l) as line, unnest(range(1, len(l) + 1)) as pos from (select id, string_split(said, '~') as l from {c_blobs}) t) u) v where line like '// ===== %'")
def j11b(spark, sf_dir):
    """Where each script of a bundle begins, and its name: offsets are summed along the lines of one bundle."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, name: string>>)").alias("out"))

    def step(acc, line):
        here = F.struct(acc["at"].alias("start"), F.substring_index(F.substring(line, 10, 1 << 20), " · script", 1).alias("name"))
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), F.when(F.startswith(line, F.lit("// ===== ")), F.array_append(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(F.split("said", "~"), start, step, lambda acc: acc["out"])
    return table(spark, sf_dir, "c_blobs").select("id", F.inline(found))


portable("s3_saved_rows", "select c1, c2, c4, c6 from {parsed_lines} where c3 = 'saved' and n >= 6")
portable("s5_index_last_wins", "select url, file, source from (select url, message as file, source, row_number() over (partition by message order by pos desc) as r from {fetch_log} where status = 'saved') x where r = 1")
portable("b2_image_sizes", "select asset_id, case when declared <> bytes then 'CONTENT_LENGTH_MISMATCH' when bytes > 1048576 then 'OVERSIZED_IMAGE' else 'ok' end as verdict from (select asset_id, bytes, case when asset_id % 10 = 0 then bytes - 1 else bytes end as declared from {assets}) t")

# Hexadecimal heads of a PNG of 640 x 480, one of 1 x 9, a GIF of 6000 x 10 and something else.
cases("c_images", "id, h", (1, "89504E470D0A1A0A0000000D4948445200000280000001E0"), (2, "89504E470D0A1A0A0000000D494844520000000100000009"), (3, "47494638396170170A00F70000"), (4, "00112233"), (5, ""))


@query("b3_dimensions", "select id, w, h, case when w is null then 'unknown' when w <= 1 or h <= 1 then 'DEGENERATE' when w > 5000 or h > 5000 then 'HUGE' else 'ok' end as verdict from (select id, case when h like '89504E47%' then ('0x' || substr(h, 33, 8))::bigint when h like '47494638%' then ('0x' || substr(h, 15, 2) || substr(h, 13, 2))::bigint end as w, case when h like '89504E47%' then ('0x' || substr(h, 41, 8))::bigint when h like '47494638%' then ('0x' || substr(h, 19, 2) || substr(h, 17, 2))::bigint end as h from {c_images}) t")
def b3(spark, sf_dir):
    """Width and height from the first 24 bytes of a PNG (big-endian) or GIF (little-endian)."""
    b = F.unhex("h")
    big = lambda at: F.conv(F.hex(F.substring(b, at, 4)), 16, 10).cast("long")
    little = lambda at: F.conv(F.concat(F.hex(F.substring(b, at + 1, 1)), F.hex(F.substring(b, at, 1))), 16, 10).cast("long")
    png, gif = F.startswith("h", F.lit("89504E47")), F.startswith("h", F.lit("47494638"))
    rows = table(spark, sf_dir, "c_images").select("id", F.when(png, big(17)).when(gif, little(7)).alias("w"), F.when(png, big(21)).when(gif, little(9)).alias("h"))
    return rows.withColumn("verdict", F.when(F.col("w").isNull(), "unknown").when((F.col("w") <= 1) | (F.col("h") <= 1), "DEGENERATE").when((F.col("w") > 5000) | (F.col("h") > 5000), "HUGE").otherwise("ok"))


@query("b11_asset_findings", "select url, 'CONTENT_LENGTH_MISMATCH' as issue from {assets} where asset_id % 10 = 0 and not url like '%/a/7%' union all select url, 'OVERSIZED_IMAGE' from {assets} where asset_id % 10 <> 0 and bytes > 1048576 and not url like '%/a/7%' union all select url, 'METADATA' from {assets} where asset_id % 4 = 1")
def b11(spark, sf_dir):
    """Everything said of an asset in one pass: sizes unless it is excluded, metadata always; a mismatch of lengths goes before the size."""
    a = table(spark, sf_dir, "assets").withColumn("declared", F.when(F.col("asset_id") % 10 == 0, F.col("bytes") - 1).otherwise(F.col("bytes")))
    measured = ~F.contains("url", F.lit("/a/7"))
    size = F.when(F.col("declared") != F.col("bytes"), "CONTENT_LENGTH_MISMATCH").when(F.col("bytes") > 1 << 20, "OVERSIZED_IMAGE")
    found = F.array_compact(F.array(F.when(measured, size), F.when(F.col("asset_id") % 4 == 1, "METADATA")))
    return a.select("url", F.explode(found).alias("issue"))


cases("c_blocks", "id, said, class", (1, "nav", "menu top"), (2, "main", "content"), (3, "ad", "top menu big"), (4, "none", ""))


@query("h5_pruned_blocks", "select id from {c_blocks} where said not in ('style', 'script', 'nav') and not list_has_all(string_split(class, ' '), ['menu', 'top'])")
def h5(spark, sf_dir):
    """Blocks that neither their tag nor a set of class tokens, all of which they have, takes out."""
    boilerplate = F.size(F.array_except(F.array(F.lit("menu"), F.lit("top")), F.split("class", " "))) == 0
    return table(spark, sf_dir, "c_blocks").where(~F.col("said").isin("style", "script", "nav") & ~boilerplate).select("id")
