"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import portable, query, relation, table
from ..functions import text as T

relation("runs", "select doc_id, lang, elements(cut(text, '\n')) as line from {documents}")
relation("values_", "select doc_id, elements(cut(text, ' ')) as value from {documents} union all select page_id, url from {pages} union all select page_id, file from {page_index} union all select event_id, props from {events} union all select event_id, concat(event_id, event_id * 12345678) from {events}")


@query("x29_entropy", "select doc_id, round(entropy(c), 9) as bits from (select doc_id, unnest(string_split(text, '')) as c from documents where text <> '') group by doc_id")
def x29(spark, sf_dir):
    """Bits a character of every whole text: characters are counted where the text is, so a document sends one row a distinct character."""
    signs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    counts = signs.groupBy("doc_id", "c").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return counts.select("doc_id", F.round(F.log2("all") - F.col("s") / F.col("all"), 9).alias("bits"))


@query(
    "l8_value_classes",
    r"""with d as (select trim(value) as v, count(*) as c from {values_} group by 1), e as (select v as w, entropy(x) as e from (select v, unnest(string_split(v, '')) as x from d) group by v), v as (select v, c, coalesce(e, 0) as e from d left join e on w = v) select verdict, cast(sum(c) as bigint) as n from (select c, case when v = '' then 'too_short' when regexp_matches(v, '^[a-zA-Z][a-zA-Z0-9+.\-]*:') then 'url'
 when regexp_matches(v, '\{\{.*?\}\}') then 'template' when regexp_matches(v, '[?&][A-Za-z0-9_.\-]+=') then 'query' when regexp_matches(v, '[{}\[\]]|":\s') then 'structured'
 when regexp_matches(v, '^/|[^/\s]+/[^/\s]+/') then 'path' when contains(v, ' ') then 'check' when lower(v) in ('true', 'false', 'null', 'yes', 'no', 'on', 'off') then 'config_literal' when length(v) < 3 then 'too_short'
 when length(v) >= 8 and regexp_matches(v, '^[0-9]+$') then 'digits' when length(v) >= 16 and regexp_matches(v, '^[0-9a-fA-F]+$') then 'hex'
 when length(v) >= 8 and round(e, 9) > 3.8 then 'high_entropy' else 'check' end as verdict from v) t group by verdict""",
)
def l8(spark, sf_dir):
    """Each distinct value is classified once, with the number of times it stands somewhere."""
    values = table(spark, sf_dir, "values_").groupBy("value").agg(F.count("*").alias("n"))
    return values.groupBy(T.classify(F.col("value")).alias("verdict")).agg(F.sum("n").alias("n"))


_CANON = r"regexp_replace(html, '<[^>]*>', ' ', 'g')"
for _n, _c in (("&nbsp;", " "), ("&shy;", ""), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _CANON = f"replace({_CANON}, '{_n}', '{_c}')"


@query("x20_canonical_text", f"select page_id, length(t) as n, sha256(t) as h from (select page_id, trim(regexp_replace(translate(regexp_replace({_CANON}, '[{T.INVISIBLE}]', '', 'g'), '–‘’', '-'''''), '[ \\t\\r\\n]+', ' ', 'g')) as t from {{pages_x}})")
def x20(spark, sf_dir):
    t = table(spark, sf_dir, "pages_x").select("page_id", T.canonical(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("h"))


@query("x22_excerpt", r"select page_id, case when s > 1 then '...' else '' end || translate(substr(html, s, 81), chr(13) || chr(10), '  ') || case when length(html) > s + 80 then '...' else '' end as excerpt from (select page_id, html, greatest(instr(html, '<article>') - 40, 1) as s from pages) where instr(html, '<article>') > 0")
def x22(spark, sf_dir):
    at = F.instr("html", "<article>")
    return table(spark, sf_dir, "pages").where(at > 0).select("page_id", T.excerpt(F.col("html"), at, 40).alias("excerpt"))


@query("k1_sanitized_field", "select doc_id, sha256(translate(replace(text, ' ', '/'), chr(13) || chr(10) || chr(9), '   ')) as h from documents")
def k1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.sanitized(F.col("text"), " "), 256).alias("h"))


@query("k3_csv_line", """select event_id, case when contains(a, ',') or contains(a, '"') then '"' || replace(a, '"', '""') || '"' else a end || ',' || case when contains(props, ',') or contains(props, '"') then '"' || replace(props, '"', '""') || '"' else props end as line from (select event_id, props, case when regexp_matches(v, '^[=+@-]') then '''' || v else v end as a from (select event_id, props, case when event_id % 3 = 0 then '=1+' || user_id when event_id % 3 = 1 then '-x,' || event_type else event_type end as v from events))""")
def k3(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("=1+"), F.col("user_id").cast("string"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("-x,"), F.col("event_type"))).otherwise(F.col("event_type"))
    return e.select("event_id", T.csv_line(",", v, F.col("props")).alias("line"))


@query("k4_csv_parse", "select event_id, event_type as a, props as b, user_id as n from events")
def k4(spark, sf_dir):
    """A line composed, then parsed again by the CSV reader's own expression."""
    e = table(spark, sf_dir, "events").select("event_id", T.csv_line(",", F.col("event_type"), F.col("props"), F.col("user_id").cast("string")).alias("line"))
    return e.select("event_id", F.from_csv("line", F.lit("a string, b string, n bigint"), {"sep": ",", "quote": '"', "escape": '"'}).alias("x")).select("event_id", "x.*")


@query("l12_homoglyphs", "select doc_id, word, case when length(word) - 1 < 1 then 'latin' else 'cyrillic' end as intruder from (select distinct doc_id, replace(lower(w), 'a', 'а') as word, w from (select doc_id, unnest(regexp_extract_all(text, '([a-z]{3,8}a[a-z]*)', 1)) as w from documents)) where regexp_matches(word, '[а]') and regexp_matches(word, '[a-z]') and length(regexp_replace(word, '[^а]', '', 'g')) < length(regexp_replace(word, '[^a-z]', '', 'g'))")
def l12(spark, sf_dir):
    """Words of both scripts whose Cyrillic letters are the fewer; ties go to Latin as the intruder."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]{3,8}a[a-z]*)"), F.lit(1)))).alias("w")).distinct()
    words = words.select("doc_id", F.replace(F.lower("w"), F.lit("a"), F.lit("а")).alias("word"))
    cyrillic, latin = F.regexp_count("word", F.lit(r"[\u0400-\u04FF]")), F.regexp_count("word", F.lit(r"[A-Za-z\u00C0-\u024F]"))
    return words.where((cyrillic > 0) & (latin > 0)).withColumn("intruder", F.when(cyrillic < latin, "cyrillic").otherwise("latin")).where("intruder = 'cyrillic'")


@query("l13_confusable_hyphens", f"select doc_id, count(*) as n from (select doc_id, unnest(regexp_extract_all(replace(text, ' ', '‐'), '([A-Za-z][{T.HYPHENS}])', 1)) as x from documents) group by doc_id")
def l13(spark, sf_dir):
    t = F.replace("text", F.lit(" "), F.lit("‐"))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(t, F.lit(f"[A-Za-z][{T.HYPHENS}]")).cast("long").alias("n")).where("n > 0")


portable("k2_composed_line", "select pos, concat_ws('|', url, replace(status, '|', '/'), message) as line from {fetch_log}")
portable("k14_header_sidecar", "select page_id, concat_ws('\n', '=== REQUEST ===', concat('GET ', url), '=== RESPONSE ===', 'Content-Type: text/html', concat('Content-Length: ', length(html))) as header from {pages}")
portable("s11_head_only", "select page_id, length(split_part(substring(html, 1, 16384), '</head', 1)) > 100 as long_head, regexp_extract(split_part(substring(html, 1, 16384), '</head', 1), '<title>([^<]*)', 1) as title from {pages}")
portable("x30_token_shapes", r"select count(case when matches(word, r'^[0-9]+$') then 1 end) as digits, count(case when matches(word, r'^[0-9a-f]+$') then 1 end) as hex, count(case when matches(word, r'^[a-z]+(-[a-z]+)*$') then 1 end) as slug, count(case when matches(word, r'\p{L}') then 1 end) as letter, lang from {tokens} group by lang")
portable("x33_occurrences", "select page_id, cast((length(html) - length(replace(html, '<p>', ''))) / 3 as bigint) as n from {pages}")
portable("x32_truncate", "select doc_id, case when length(line) > 40 then concat(substring(line, 1, 39), '…') else line end as short from {runs}")
portable("f15_plausible_file", r"select page_id, length(file) <= 260 and not matches(file, r'^[- ]|[\s\x00-\x1f]') as ok from {page_index}")
portable("x41_bytes", "select asset_id, cast(floor(bytes / 1024) as bigint) as kb, concat(cast(floor(bytes / 1024) as bigint), ' kB') as said from {assets}")
portable("l2_word_identifier", r"select lang, count(case when matches(word, r'^[\p{L}\p{M}-]+$') then 1 end) as words, count(*) as n from {tokens} group by lang")
portable("l16_anchor_split", r"select page_id, head, tail from (select page_id, regexp_extract(s, r'^(\p{L}+)', 1) as head, regexp_extract(s, r'>(\p{L}+)$', 1) as tail from (select page_id, elements(regexp_extract_all(html, r'(\p{L}+</a>\p{L}+)', 1)) as s from {pages_x}) u) t where length(tail) = 1")
portable("l29_language_family", "select lang, count(*) as n from {documents} where lang = 'en' or lang like 'en-%' or lang like 'd%' group by lang")
portable("x26_element_snippet", "select page_id, substring(html, greatest(instr(html, '<h1>') - 20, 1), 80) as snippet from {pages} where instr(html, '<h1>') > 0")
portable("x27_script_context", r"select page_id, rx_replace(s, r'\s+', ' ') as context from (select page_id, regexp_extract(html, r'<script>([^<]*)', 1) as s from {pages}) t where s <> ''")
portable("l9_data_attributes", r"select v, case when matches(v, r'^[.#][A-Za-z]') then 'css_selector' when matches(v, r'^[a-z0-9]+(-[a-z0-9]+){2,}$') then 'slug' when matches(v, r'^[A-Za-z][A-Za-z0-9_-]* [A-Za-z][A-Za-z0-9_-]*[0-9]$') then 'id_list' else 'check' end as verdict from (select distinct case page_id % 4 when 0 then concat('#p', page_id) when 1 then concat('a-b-', page_id) when 2 then concat('one two', page_id) else 'prose' end as v from {pages}) t")
portable("l10_script_literals", "select event_id, case when lit in ('click', 'value', 'none', 'body', 'iframe') then 'vocabulary' when matches(lit, r'^[a-z]+=[^,;&]*([,;&][a-z]+=[^,;&]*)*$') then 'options' when matches(lit, r'</?[A-Za-z]') then 'markup' when matches(lit, r'^[A-Z]{2,6}$') then 'acronym' else 'check' end as verdict from (select event_id, case event_id % 6 when 0 then event_type when 1 then concat('k=', event_id, ',b=no') when 2 then '<div' when 3 then 'ABC' when 4 then 'some words' else 'click' end as lit from {events}) t")
