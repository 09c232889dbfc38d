"""Content-quality detectors: one relation findings(page_id, issue_type, detail, context) of all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import FLAGSHIP, native, portable, query, relation, table
from ..functions.text import INVISIBLE
from .lexis import RARE, vocabulary

_IN = f"[{INVISIBLE}]"
_IN_META = f"[{INVISIBLE}\t\r\n]"
# Inline elements whose seams are looked at, containers that hold no text of their own, blocks that do, elements whose end tag must be there.
_INLINE = "a|b|i|em|strong|span"
_CONTAINERS = "div|section|article|aside|header|footer|main"
_BLOCKS = "p|h1|h2|h3|h4|h5|h6|li|td|th|blockquote|article|div"
_PAIRED = ("a", "b", "i", "em", "strong", "span", "div", "section", "article", "ul", "ol", "table")

#: Detectors that take each match of a pattern: relation, issue, place, pattern.
_MATCHES = {
    "q06": ("LIGATURE", "text", r"([ﬀ-ﬆ])"),
    "q10": ("WORD_COLLISION", "html", rf"(\p{{Ll}}</?(?:{_INLINE})(?:\s[^<>]*)?>\p{{Lu}}\p{{L}}*)"),
    "q11": ("SPLIT_WORD_ANCHOR", "html", r"</a>([\p{L}\p{N}]+)\s"),
    "q12": ("MISPLACED_ANCHOR_EMPTY", "html", r"(<a\s[^>]*>\s*</a>)"),
    "q13": ("ADJACENT_ANCHOR", "html", r"(</a><a\s[^>]*>[^<]*)"),
    "q15": ("UNWANTED_PATTERN", "text", r"(\{\{[^}]*\}|\$\$\$|%%%)"),
}
_TITLE, _META = r"<title>([^<]*)", r'<meta[^>]*content="([^"]*)"'
_BLOCK, _BARE = rf"<(?:{_BLOCKS})(?:\s[^>]*)?>([^<]+)", rf"<({_CONTAINERS})(?:\s[^>]*)?>([^<]+)"
_STARTED = "concat(case page_id % 11 when 0 then 'oops' when 1 then chr(65279) when 2 then ' ' else '' end, html)"
_WITH_BOM = "case when page_id % 13 = 0 then replace(html, '<article>', concat('<article>', chr(65279))) else html end"


relation("page_text", r"select page_id, url, rx_replace(rx_replace(html, r'(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' '), r'<[^>]*>', ' ') as text from {pages_x}")
for _q, (_issue, _place, _pattern) in _MATCHES.items():
    relation(_q, f"select page_id, unnest(range(1, len(m) + 1)) as pos, '{_issue}' as issue_type, unnest(m) as detail, '' as context from (select page_id, regexp_extract_all({_place}, '{_pattern}', 1) as m from {{{'page_text' if _place == 'text' else 'pages_x'}}}) t")
relation("q01", rf"select page_id, 1 as pos, 'MALFORMED_HTML/CONTENT_BEFORE_DOCTYPE' as issue_type, substr(h, 1, 20) as detail, '' as context from (select page_id, regexp_replace(regexp_replace({_STARTED}, '^' || chr(65279), ''), '^[ \t\r\n]+', '') as h from {{pages_x}}) t where h <> '' and not regexp_matches(substr(h, 1, 64), '(?i)^(<!doctype|<html|<\?xml)')")
_OPEN = " + ".join(f"greatest(len(regexp_extract_all(html, '<{t}[\\s>]')) - len(regexp_extract_all(html, '</{t}>')), 0)" for t in _PAIRED)
_CLOSE = " + ".join(f"greatest(len(regexp_extract_all(html, '</{t}>')) - len(regexp_extract_all(html, '<{t}[\\s>]')), 0)" for t in _PAIRED)
relation("q02", f"select page_id, pos, issue_type, cast(n as varchar) as detail, '' as context from (select page_id, 1 as pos, 'MALFORMED_HTML/TagNotClosed' as issue_type, {_OPEN} as n from {{pages_x}} union all select page_id, 2, 'MALFORMED_HTML/TagNotOpened', {_CLOSE} from {{pages_x}}) t where n > 0")
relation("q03", f"select page_id, unnest(range(1, len(m) + 1)) as pos, 'CONTROL_CHARS_IN_CONTENT' as issue_type, unnest(list_transform(m, lambda x: regexp_extract(x, '({_IN_META})', 1))) as detail, unnest(list_transform(m, lambda x: substr(x, 1, 40))) as context from (select page_id, list_concat(list_concat(list_filter(regexp_extract_all(html, '{_TITLE}', 1), lambda x: regexp_matches(x, '{_IN}')), list_filter(regexp_extract_all(html, '{_META}', 1), lambda x: regexp_matches(x, '{_IN_META}'))), list_filter(regexp_extract_all(html, '{_BLOCK}', 1), lambda x: regexp_matches(x, '{_IN}'))) as m from {{pages_x}}) t")
relation("q09", rf"select page_id, pos, 'BARE_TEXT_IN_CONTAINER' as issue_type, trim(said) as detail, tag as context from (select page_id, unnest(range(1, len(m) + 1)) as pos, unnest(m) as said, unnest(tags) as tag from (select page_id, regexp_extract_all(html, '{_BARE}', 2) as m, regexp_extract_all(html, '{_BARE}', 1) as tags from {{pages_x}}) t) u where regexp_replace(said, '[\s{INVISIBLE}]', '', 'g') <> ''")
relation("q14", "select page_id, 1 as pos, 'LANGUAGE_MISMATCH' as issue_type, a || '/' || b as detail, '' as context from (select page_id, lower(regexp_extract(html, '<html lang=\"([A-Za-z]+)', 1)) as a, lower(regexp_extract(html, 'name=\"language\" content=\"([A-Za-z]+)', 1)) as b from {pages_x}) t where a <> '' and b <> '' and a <> b")
relation("q16", f"select page_id, 1 as pos, 'EMBEDDED_BOM_IN_BODY' as issue_type, cast(instr(h, chr(65279)) as varchar) as detail, '' as context from (select page_id, {_WITH_BOM} as h from {{pages_x}}) t where instr(h, chr(65279)) > 1")
relation("q17", f"select page_id, 1 as pos, 'INVISIBLE_CHAR_IN_BODY' as issue_type, c as detail, cast(count(*) as varchar) as context from (select page_id, unnest(regexp_extract_all(text, '({_IN})', 1)) as c from {{page_text}}) t group by page_id, c")


def _found(issue: str, details, contexts=None):
    """array<struct<pos, issue_type, detail, context>> of an array of details."""
    row = lambda x, c, i: F.struct((i + 1).cast("long").alias("pos"), F.lit(issue).alias("issue_type"), x.alias("detail"), c.alias("context"))
    if contexts is None:
        return F.transform(details, lambda x, i: row(x, F.lit(""), i))
    return F.transform(F.zip_with(details, contexts, lambda x, c: F.struct(x.alias("x"), c.alias("c"))), lambda y, i: row(y["x"], y["c"], i))


def _if(test, issue: str, detail):
    return _found(issue, F.when(test, F.array(detail)).otherwise(F.array().cast("array<string>")))


def _all(place: str, pattern: str, group: int = 1):
    return F.regexp_extract_all(place, F.lit(pattern), F.lit(group))


def _detectors() -> dict:
    """Each detector as one expression over page_id, html and text, all of which a single pass over the pages can work out."""
    out = {q: _found(issue, _all(place, pattern)) for q, (issue, place, pattern) in _MATCHES.items()}
    head = F.regexp_replace(F.regexp_replace(F.expr(_STARTED.replace("chr(65279)", "'﻿'")), "^﻿", ""), r"^[ \t\r\n]+", "")
    out["q01"] = _if((head != "") & ~F.substring(head, 1, 64).rlike(r"(?i)^(<!doctype|<html|<\?xml)"), "MALFORMED_HTML/CONTENT_BEFORE_DOCTYPE", F.substring(head, 1, 20))
    more = F.transform(F.array(*[F.regexp_count("html", F.lit(rf"<{t}[\s>]")) - F.regexp_count("html", F.lit(f"</{t}>")) for t in _PAIRED]), lambda x: x)
    total = lambda sign: F.aggregate(more, F.lit(0), lambda acc, x: acc + F.greatest(sign * x, F.lit(0)))
    codes = F.array(*[F.struct(F.lit(k).cast("long").alias("pos"), F.lit(f"MALFORMED_HTML/{code}").alias("issue_type"), total(sign).cast("string").alias("detail"), F.lit("").alias("context")) for k, code, sign in ((1, "TagNotClosed", 1), (2, "TagNotOpened", -1))])
    out["q02"] = F.filter(codes, lambda x: x["detail"] != "0")
    shown = lambda pattern, invisible: F.filter(_all("html", pattern), lambda x: x.rlike(invisible))
    said = F.concat(shown(_TITLE, _IN), shown(_META, _IN_META), shown(_BLOCK, _IN))
    out["q03"] = F.transform(said, lambda x, i: F.struct((i + 1).cast("long").alias("pos"), F.lit("CONTROL_CHARS_IN_CONTENT").alias("issue_type"), F.regexp_extract(x, f"({_IN_META})", 1).alias("detail"), F.substring(x, 1, 40).alias("context")))
    bare = _found("BARE_TEXT_IN_CONTAINER", _all("html", _BARE, 2), _all("html", _BARE))
    seen = F.filter(bare, lambda x: F.regexp_replace(x["detail"], rf"[\s{INVISIBLE}]", "") != "")
    out["q09"] = F.transform(seen, lambda x: F.struct(x["pos"].alias("pos"), x["issue_type"].alias("issue_type"), F.trim(x["detail"]).alias("detail"), x["context"].alias("context")))
    a, b = F.lower(F.regexp_extract("html", '<html lang="([A-Za-z]+)', 1)), F.lower(F.regexp_extract("html", 'name="language" content="([A-Za-z]+)', 1))
    out["q14"] = _if((a != "") & (b != "") & (a != b), "LANGUAGE_MISMATCH", F.concat(a, F.lit("/"), b))
    bom = F.instr(F.expr(_WITH_BOM.replace("chr(65279)", "'﻿'")), "﻿")
    out["q16"] = _if(bom > 1, "EMBEDDED_BOM_IN_BODY", bom.cast("string"))
    chars = _all("text", f"({_IN})")
    out["q17"] = F.transform(F.array_distinct(chars), lambda c: F.struct(F.lit(1).cast("long").alias("pos"), F.lit("INVISIBLE_CHAR_IN_BODY").alias("issue_type"), c.alias("detail"), F.size(F.filter(chars, lambda x: x == c)).cast("string").alias("context")))
    return dict(sorted(out.items()))


def _pages(spark, sf_dir):
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " "), r"<[^>]*>", " ")
    return table(spark, sf_dir, "pages_x").select("page_id", "url", "html", text.alias("text"))


_ALL = ("q01", "q02", "q03", "q06", "q09", "q10", "q11", "q12", "q13", "q14", "q15", "q16", "q17")
for _q in _ALL:
    native(_q)(lambda spark, sf_dir, q=_q: _pages(spark, sf_dir).select("page_id", F.inline(_detectors()[q])))


@native("all_findings")
def all_findings(spark, sf_dir):
    """All detectors in one pass over the pages."""
    return _pages(spark, sf_dir).select("page_id", F.inline(F.concat(*_detectors().values())))


relation("q19", "select t.doc_id as page_id, 'POTENTIAL_TRANSLATION' as issue_type, l.lang as detail, t.lang as context from {tokens} t join {lexicon} l on l.word = t.word and l.lang <> t.lang left join {lexicon} own on own.word = t.word and own.lang = t.lang where own.word is null group by t.doc_id, l.lang, t.lang having count(*) >= 5")


@native("q19")
def q19(spark, sf_dir):
    """A text's words that are rare in its own language and in another's lexicon, from the languages' vocabularies."""
    words = vocabulary(spark, sf_dir).where("lang is not null").groupBy("word")
    rare = F.col("n") < RARE
    met = words.agg(F.collect_list(F.when(rare, F.struct("lang", "ids"))).alias("rare"), F.collect_list(F.when(~rare, F.col("lang"))).alias("others")).where((F.size("rare") > 0) & (F.size("others") > 0))
    rows = met.select("others", F.inline("rare")).select("lang", "ids", F.explode("others").alias("other")).select(F.explode("ids").alias("doc_id"), "lang", "other")
    found = rows.groupBy("doc_id", "lang", "other").agg(F.count("*").alias("n")).where("n >= 5")
    return found.select(F.col("doc_id").alias("page_id"), F.lit("POTENTIAL_TRANSLATION").alias("issue_type"), F.col("other").alias("detail"), F.col("lang").alias("context"))


relation("all_findings", " union all ".join(f"select page_id, pos, issue_type, detail, context from {{{q}}}" for q in _ALL))
# Fixed values of the sample suppression rules: type, text, page pattern, place in the order.
relation("rules", "select 1 as idx, 'UNWANTED_PATTERN' as type, '$$$' as value, '%/fr/%' as page union all select 2, 'UNWANTED_PATTERN', '%', '%' union all select 3, 'BARE_TEXT_IN_CONTAINER', 'nothing like it', '%' union all select 4, 'BARE_TEXT_IN_CONTAINER', 'the', '%/en/%'")
relation("suppressed", "select f.page_id, f.issue_type, f.detail, f.context, min(r.idx) as rule from {all_findings} f join {pages} p on p.page_id = f.page_id join {rules} r on r.type = f.issue_type and instr(concat(f.detail, ' ', f.context), r.value) > 0 and p.url like r.page group by f.page_id, f.issue_type, f.detail, f.context")

for _q, _slug in {"q01": "content_before_doctype", "q02": "parse_errors", "q03": "control_chars", "q06": "ligatures", "q09": "bare_text", "q10": "word_collisions", "q11": "split_word_anchors", "q12": "empty_anchors", "q13": "adjacent_anchors", "q14": "language_mismatch", "q15": "unwanted_patterns", "q16": "embedded_bom", "q17": "invisible_in_body", "q19": "potential_translation"}.items():
    portable(f"q{int(_q[1:])}_{_slug}", f"select page_id, {'' if _q == 'q19' else 'pos, '}issue_type, detail, context from {{{_q}}}")

portable(FLAGSHIP, "select f.page_id, p.url, f.pos, f.issue_type, f.detail, f.context from {all_findings} f join {pages} p on p.page_id = f.page_id")
portable("f8_suppressed_findings", "select page_id, issue_type, detail, context, rule from {suppressed}")
portable("f8_kept_findings", "select f.page_id, f.issue_type, count(*) as n from {all_findings} f left join (select distinct page_id, issue_type, detail, context from {suppressed}) s on s.page_id = f.page_id and s.issue_type = f.issue_type and s.detail = f.detail and s.context = f.context where s.page_id is null group by f.page_id, f.issue_type")
portable("a15_rule_hits", "select r.idx, count(s.rule) as hits from {rules} r left join {suppressed} s on s.rule = r.idx group by r.idx")
portable("a2_parse_errors", "select issue_type, count(*) as pages, min(page_id) as first_page from {q02} group by issue_type")
portable("a3_invisible_counts", "select detail, cast(sum(cast(context as bigint)) as bigint) as n, count(*) as pages, min(page_id) as first_page from {q17} group by detail")
portable("a17_triage_cards", "select p.url, f.issue_type, case when f.issue_type in ('UNWANTED_PATTERN', 'CONTROL_CHARS_IN_CONTENT') then f.detail else '' end as card, count(*) as n from {all_findings} f join {pages} p on p.page_id = f.page_id group by 1, 2, 3")
portable("a23_issue_types", "select page_id, count(distinct issue_type) as types, min(issue_type) as first_type from {all_findings} group by page_id")
portable("a22_first_of_key", "select page_id, issue_type, detail from (select page_id, issue_type, detail, row_number() over (partition by page_id, issue_type order by pos, detail) as r from {all_findings}) t where r = 1")
portable("o6_worst_types", "select page_id, issue_type, n from (select page_id, issue_type, count(*) as n, row_number() over (partition by page_id order by count(*) desc, issue_type) as r from {all_findings} group by page_id, issue_type) t where r <= 2")
portable("w1_renumbered", "select page_id, issue_type, detail, case when n > 1 then concat('[', case when r < 10 then concat('0', r) else cast(r as varchar(9)) end, '] ', detail) else detail end as said from (select page_id, issue_type, detail, row_number() over (partition by page_id, issue_type order by pos asc nulls last, detail) as r, count(*) over (partition by page_id, issue_type) as n from {all_findings}) t")
portable("u4_seam_tokens", r"select page_id, count(*) as n from (select distinct page_id, elements(regexp_extract_all(rx_replace(html, '<[^>]*>', ''), r'(\p{L}+)', 1)) as w from {pages_x}) a where not exists (select 1 from (select distinct page_id as p, elements(regexp_extract_all(rx_replace(html, '<[^>]*>', ' '), r'(\p{L}+)', 1)) as v from {pages_x}) b where b.p = a.page_id and b.v = a.w) group by page_id")
portable("h8_page_language", "select page_id, coalesce(nullif(lower(regexp_extract(html, '<html lang=\"([a-z]{2})', 1)), ''), nullif(lower(regexp_extract(html, 'name=\"language\" content=\"([a-z]{2})', 1)), ''), 'en') as lang from {pages_x}")
portable("h10_page_text", "select page_id, cast(length(text) as bigint) as n, hex_sha256(text) as h from {page_text}")
portable("h4_attributes", r"select name, count(*) as n from (select elements(regexp_extract_all(html, r'\s([a-z-]+)=\x22[^\x22]*\x22', 1)) as name from {pages_x}) t where name not in ('href', 'class') group by name")
portable("h7_boilerplate_pruned", r"select page_id, cast(length(html) - length(rx_replace(html, r'<div class=\x22ad\x22>[^<]*</div>', '')) as bigint) as cut from {pages_x}")
portable("h9_language_sets", "select page_id, case when url like '%/de/%' then 'de,en' when url like '%/fr/%' then 'fr' else lang end as langs from (select page_id, url, regexp_extract(html, '<html lang=\"([a-z]+)', 1) as lang from {pages}) t")
portable("w9_first_rule", "select issue_type, rule, count(*) as n from {suppressed} group by issue_type, rule")


@query("w2_inline_ranks", f"select page_id, unnest(range(1, len(m) + 1)) as r, unnest(m) as x from (select page_id, regexp_extract_all(html, '<({_INLINE})[ >]', 1) as m from {{pages_x}}) t")
def w2(spark, sf_dir):
    """Each inline element of a page with its place among them in document order."""
    return table(spark, sf_dir, "pages_x").select("page_id", F.posexplode(_all("html", f"<({_INLINE})[ >]")).alias("at", "x")).select("page_id", (F.col("at") + 1).cast("long").alias("r"), "x")
