"""Rules on single values, over the cases they distinguish and over the driver's tables; each has a form of its own for either engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, relation, table


def cases(name: str, columns: str, *rows: tuple) -> None:
    """A relation of cases, the same literal rows in both engines; texts hold no quotes or backslashes, and ~ for a line end."""
    said = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    relation(name, f"select * from (values {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) as t({columns})")


def _lines(c: str):
    return F.replace(c, F.lit("~"), F.lit("\n"))


# --- dates -------------------------------------------------------------------------------------------------------------

cases("c_times", "said", ("2024-01-02 03:04:05",), ("2024-01-02T03:04:05",), ("2024-01-02",), ("2024-13-02 00:00:00",), ("nonsense",), ("",), ("2023-12-31 23:59:59",))


@query("x36_timestamps", "select said, strftime(coalesce(try_strptime(said, '%Y-%m-%d %H:%M:%S'), try_cast(said as timestamp)), '%Y-%m-%d %H:%M:%S') as parsed from {c_times}")
def x36(spark, sf_dir):
    """The strict form first, then whatever else is a timestamp; null if nothing is."""
    said = table(spark, sf_dir, "c_times")
    return said.select("said", F.date_format(F.coalesce(F.try_to_timestamp("said", F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp("said")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


cases("c_http_dates", "said", ("Tue, 15 Nov 1994 08:12:31 GMT",), ("Sun, 06 Nov 1994 08:49:37 GMT",), ("Sunday, 06-Nov-94 08:49:37 GMT",), ("Wed, 31 Feb 2024 00:00:00 GMT",), ("",), ("Thu, 01 Jan 1970 00:00:00 GMT",))


@query("x37_http_dates", "select said, strftime(try_strptime(said, '%a, %d %b %Y %H:%M:%S GMT'), '%Y-%m-%d %H:%M:%S') as utc from {c_http_dates}")
def x37(spark, sf_dir):
    bare = F.regexp_extract("said", "^[A-Z][a-z]{2}, (.*) GMT$", 1)
    return table(spark, sf_dir, "c_http_dates").select("said", F.date_format(F.try_to_timestamp(F.nullif(bare, F.lit("")), F.lit("dd MMM yyyy HH:mm:ss")), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("x38_age", "select event_id, cast(floor((epoch(timestamp '2026-01-31 00:00:00') - epoch(date_trunc('second', ts))) / 86400) as bigint) as age, floor((epoch(timestamp '2026-01-31 00:00:00') - epoch(date_trunc('second', ts))) / 86400) > 30 as stale from events")
def x38(spark, sf_dir):
    """Whole days up to a day that is given, so that the result does not change with the clock."""
    seconds = F.unix_timestamp(F.lit("2026-01-31 00:00:00")) - F.unix_timestamp("ts")
    age = F.floor(seconds / 86400)
    return table(spark, sf_dir, "events").select("event_id", age.alias("age"), (age > 30).alias("stale"))


@query("x40_overdue", "select type, url, word, cast(date '2026-01-31' - age_found as date) as found, date '2026-01-31' - age_found + 14 <= date '2026-01-31' as overdue from {ledger_old}")
def x40(spark, sf_dir):
    today = F.to_date(F.lit("2026-01-31"))
    found = F.date_sub(today, F.col("age_found"))
    return table(spark, sf_dir, "ledger_old").select("type", "url", "word", found.alias("found"), (F.date_add(found, 14) <= today).alias("overdue"))


# --- texts -------------------------------------------------------------------------------------------------------------

cases("c_robots", "said", ("noindex, follow",), ("FOLLOW,  Index ,",), ("index",), ("",), (" , nofollow,, noindex",), ("noindexed, x",), ("none",))


@query("x35_normalized_robots", "select said, array_to_string(list_sort(list_filter(list_transform(string_split(lower(said), ','), lambda x: trim(x)), lambda x: x <> '')), ',') as robots from (select said from {c_robots} union all select regexp_extract(html, 'name=\"robots\" content=\"([^\"]*)\"', 1) from {pages_x})")
def x35(spark, sf_dir):
    said = table(spark, sf_dir, "c_robots").union(table(spark, sf_dir, "pages_x").select(F.regexp_extract("html", 'name="robots" content="([^"]*)"', 1)))
    parts = F.filter(F.transform(F.split(F.lower("said"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return said.select("said", F.array_join(F.array_sort(parts), ",").alias("robots"))


@query("f16_noindex", "select said, list_contains(list_transform(string_split(lower(said), ','), lambda x: trim(x)), 'noindex') as noindex from (select said from {c_robots} union all select regexp_extract(html, 'name=\"robots\" content=\"([^\"]*)\"', 1) from {pages_x})")
def f16(spark, sf_dir):
    said = table(spark, sf_dir, "c_robots").union(table(spark, sf_dir, "pages_x").select(F.regexp_extract("html", 'name="robots" content="([^"]*)"', 1)))
    return said.select("said", F.array_contains(F.transform(F.split(F.lower("said"), ","), lambda x: F.trim(x)), "noindex").alias("noindex"))


_BEFORE = r"(?s)(.{1,24})https?://"
# What the characters before an address say of its place; the first that fits counts.
_PLACES = (("href=", "link"), ("src=", "src"), ("action=", "form-action"), ("poster=", "poster"), ("cite=", "cite"), ("content=", "meta-url"))


@query("x16_locator", f"select page_id, case {' '.join(f'''when contains(b, '{k}') then '{v}' ''' for k, v in _PLACES)} else 'url' end as place, count(*) as n from (select page_id, unnest(regexp_extract_all(lower(html), '{_BEFORE}', 1)) as b from {{pages_x}}) t group by all")
def x16(spark, sf_dir):
    """The class of each address by the 24 characters before it."""
    before = table(spark, sf_dir, "pages_x").select("page_id", F.explode(F.regexp_extract_all(F.lower("html"), F.lit(_BEFORE), F.lit(1))).alias("b"))
    place = F.coalesce(*[F.when(F.contains("b", F.lit(k)), v) for k, v in _PLACES], F.lit("url"))
    return before.groupBy("page_id", place.alias("place")).agg(F.count("*").alias("n"))


@query("x24_word_window", "select doc_id, case when length(text) <= 150 then text else case when p > 76 then '…' else '' end || substr(text, greatest(p - 75, 1), p + 75 - greatest(p - 75, 1) + 1) || case when p + 75 < length(text) then '…' else '' end end as excerpt from (select doc_id, text, instr(text, ' the ') as p from documents) t where p > 0")
def x24(spark, sf_dir):
    """75 characters on either side of a word, an ellipsis where something is cut; short texts whole."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.instr("text", " the ").alias("at")).where("at > 0")
    first = F.greatest(F.col("at") - 75, F.lit(1))
    cut = F.concat(F.when(F.col("at") > 76, "…").otherwise(""), F.substring(F.col("text"), first, F.col("at") + 75 - first + 1), F.when(F.col("at") + 75 < F.length("text"), "…").otherwise(""))
    return d.select("doc_id", F.when(F.length("text") <= 150, F.col("text")).otherwise(cut).alias("excerpt"))


_TOKEN = r"([\p{L}\p{M}\p{Nd}_'-]+|[.,!?;:()\[\]<>\x22])"
_SPANS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|https?://[^\s<>]+"


@query("l1_tokens", rf"select doc_id, len(m) as tokens, len(list_filter(m, lambda x: regexp_matches(x, '\p{{L}}'))) as words, m[1] as first, m[len(m)] as last from (select doc_id, regexp_extract_all(regexp_replace(text, '{_SPANS}', ' ', 'g'), '{_TOKEN.replace(chr(39), chr(39) * 2)}', 1) as m from documents) t")
def l1(spark, sf_dir):
    """Words, numbers and single signs of a text outside e-mail addresses and URLs."""
    m = F.regexp_extract_all(F.regexp_replace("text", _SPANS, " "), F.lit(_TOKEN), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", m.alias("m")).select("doc_id", F.size("m").cast("long").alias("tokens"), F.size(F.filter("m", lambda x: x.rlike(r"\p{L}"))).cast("long").alias("words"), F.get("m", F.lit(0)).alias("first"), F.get("m", F.size("m") - 1).alias("last"))


@query("x28_word_index", r"select doc_id, list_position(m, 'the') as at, list_position(m, 'und') as at_und from (select doc_id, regexp_extract_all(lower(text), '([\p{L}]+)', 1) as m from documents) t where list_contains(m, 'the') or list_contains(m, 'und')")
def x28(spark, sf_dir):
    """The place of a word among all words of a text; null where it is no whole word of it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1)).alias("m"))
    at = lambda w: F.nullif(F.array_position("m", F.lit(w)).cast("int"), F.lit(0))
    return d.select("doc_id", at("the").alias("at"), at("und").alias("at_und")).where("at is not null or at_und is not null")


cases("c_templates", "said, kind, url, n", ("{n} x {kind}~~~~at {url}", "LIGATURE", "/a", 2), ("{kind}~{word}~{url}", "404", "/b", 1), ("~~{url}", "SEO", "/c", 0), ("none", "x", "/d", 3))


@query("x45_template", r"select url, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(said, '~', chr(10)), '{kind}', kind), '{url}', url), '{n}', cast(n as varchar)), '[^\n]*\{[a-z]+\}[^\n]*', '', 'g'), '\n\n+', chr(10), 'g'), '^\n', '')) as filled from {c_templates}")
def x45(spark, sf_dir):
    """Names filled in, lines with a name that nothing fills left out, blank lines collapsed."""
    t = _lines("said")
    for name in ("kind", "url"):
        t = F.replace(t, F.lit("{" + name + "}"), F.col(name))
    t = F.replace(t, F.lit("{n}"), F.col("n").cast("string"))
    kept = F.filter(F.split(t, "\n"), lambda x: (x != "") & ~x.rlike(r"\{[a-z]+\}"))
    return table(spark, sf_dir, "c_templates").select("url", F.trim(F.array_join(kept, "\n")).alias("filled"))


# --- headers and files ---------------------------------------------------------------------------------------------------

cases(
    "c_sidecars", "id, said",
    (1, "=== REQUEST ===~GET https://a.test/x HTTP/1.1~Host: a.test~=== RESPONSE ===~Content-Type: text/html~Content-Length: 12~content-type: second~Set-Cookie: sid=1; Path=/~Set-Cookie: lang=de~Set-Cookie: sid=2"),
    (2, "=== REQUEST ===~POST /y~Content-Type: in/request~=== RESPONSE ===~Server: s"),
    (3, "Content-Type: no/section"),
    (4, ""),
    (5, "=== REQUEST ===~GET /z~=== RESPONSE ===~Content-Type:text/css~no colon here"),
)


@query("s9_header_sidecar", r"select id, key, first(value order by pos) as value from (select id, pos, lower(trim(split_part(line, ':', 1))) as key, trim(substr(line, instr(line, ':') + 1)) as value from (select id, unnest(range(1, len(l) + 1)) as pos, unnest(l) as line from (select id, string_split(split_part(said, '=== RESPONSE ===', 2), '~') as l from {c_sidecars}) t) u where instr(line, ':') > 1) v group by id, key")
def s9(spark, sf_dir):
    """The response's headers, of each name the first."""
    lines = F.filter(F.split(F.element_at(F.split("said", "=== RESPONSE ==="), F.least(F.lit(2), F.size(F.split("said", "=== RESPONSE ===")))), "~"), lambda x: F.instr(x, ":") > 1)
    rows = table(spark, sf_dir, "c_sidecars").where(F.contains("said", F.lit("=== RESPONSE ==="))).select("id", F.posexplode(lines).alias("pos", "line"))
    rows = rows.select("id", "pos", F.lower(F.trim(F.split("line", ":")[0])).alias("key"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value"))
    return rows.groupBy("id", "key").agg(F.min_by("value", "pos").alias("value"))


@query("s10_request_url", r"select id, regexp_extract(split_part(said, '=== RESPONSE ===', 1), '~GET ([^ ~]+)', 1) as requested from {c_sidecars}")
def s10(spark, sf_dir):
    request = F.split("said", "=== RESPONSE ===")[0]
    get = F.filter(F.split(request, "~"), lambda x: F.startswith(x, F.lit("GET ")))
    return table(spark, sf_dir, "c_sidecars").select("id", F.coalesce(F.split(F.get(get, F.lit(0)), " ")[1], F.lit("")).alias("requested"))


@query("x43_cookie_names", r"select id, array_to_string(list_sort(list_distinct(regexp_extract_all(said, 'Set-Cookie: ([^=;~]+)=', 1))), ',') as names from {c_sidecars}")
def x43(spark, sf_dir):
    lines = F.filter(F.split("said", "~"), lambda x: F.startswith(x, F.lit("Set-Cookie: ")))
    names = F.transform(lines, lambda x: F.split(F.substring_index(x, "Set-Cookie: ", -1), "=")[0])
    return table(spark, sf_dir, "c_sidecars").select("id", F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("names"))


# Hexadecimal first bytes.
cases(
    "c_heads", "id, h",
    (1, "EFBBBF3C68746D6C3E"), (2, "FFFE3C00"), (3, "FEFF003C"), (4, "3C6D65746120636861727365743D225554462D38223E"), (5, "3C6D65746120636861727365743D6B6F69382D723E"), (6, "3C703E"), (7, ""),
    (8, "255044462D312E37"), (9, "89504E470D0A1A0A"), (10, "FFD8FFE0"), (11, "474946383961"), (12, "524946460000000057454250"), (13, "5249464600000000574156"), (14, "20203C21444F43545950452068746D6C3E"), (15, "0000255044462D"),
)


@query("s12_encoding", r"select id, case when h like 'EFBBBF%' then 'utf-8' when h like 'FFFE%' then 'utf-16le' when h like 'FEFF%' then 'utf-16be' when m <> '' then m else 'windows-1252' end as encoding from (select id, h, lower(regexp_extract(decode(case when regexp_matches(h, '^([0-7].)*$') then from_hex(h) else from_hex('') end), '<meta charset=[\x22\x27]?([A-Za-z0-9-]+)', 1)) as m from {c_heads}) t")
def s12(spark, sf_dir):
    """A mark at the start, else what the first 4096 bytes declare, else the old default."""
    head = F.decode(F.substring(F.unhex("h"), 1, 4096), "ISO-8859-1")
    declared = F.lower(F.regexp_extract(head, r"<meta charset=[\x22\x27]?([A-Za-z0-9-]+)", 1))
    begins = lambda x: F.startswith(F.hex(F.unhex("h")), F.lit(x))
    return table(spark, sf_dir, "c_heads").select("id", F.when(begins("EFBBBF"), "utf-8").when(begins("FFFE"), "utf-16le").when(begins("FEFF"), "utf-16be").when(declared != "", declared).otherwise("windows-1252").alias("encoding"))


@query("f12_sniffed", "select id, case when instr(h, '255044462D') > 0 then 'pdf' when h like 'FFD8FF%' then 'jpeg' when h like '89504E470D0A1A0A%' then 'png' when h like '47494638%' then 'gif' when h like '52494646%' and substr(h, 17, 8) = '57454250' then 'webp' when regexp_matches(decode(case when regexp_matches(h, '^([0-7].)*$') then from_hex(h) else from_hex('') end), '(?i)<!doctype html|<html|<head|<body') or h like 'EFBBBF3C68746D6C%' then 'html' else 'unknown' end as kind from {c_heads}")
def f12(spark, sf_dir):
    """What a file is by its first bytes."""
    b = F.unhex("h")
    word = lambda at, n: F.hex(F.substring(b, at, n))
    html = F.decode(b, "ISO-8859-1").rlike("(?i)<!doctype html|<html|<head|<body")
    kind = F.when(F.contains(F.decode(b, "ISO-8859-1"), F.lit("%PDF-")), "pdf").when(word(1, 3) == "FFD8FF", "jpeg").when(word(1, 8) == "89504E470D0A1A0A", "png").when(word(1, 4) == "47494638", "gif")
    return table(spark, sf_dir, "c_heads").select("id", kind.when((word(1, 4) == "52494646") & (word(9, 4) == "57454250"), "webp").when(html, "html").otherwise("unknown").alias("kind"))


cases("c_types", "id, by_name, by_header, by_bytes, policy", *[(k, a, b, c, p) for k, (a, b, c, p) in enumerate([("html", "html", "html", "TrustByteSniff"), ("html", "pdf", "pdf", "TrustByteSniff"), ("html", "pdf", "unknown", "TrustByteSniff"), ("html", "pdf", "html", "TrustHeader"), ("pdf", "unknown", "html", "TrustHeader"), ("image", "html", "unknown", "TrustExtension"), ("image", "image", "pdf", "Quarantine"), ("image", "image", "image", "Quarantine"), ("pdf", "pdf", "pdf", "TrustHeader")])])


@query("f10_file_types", "select id, case when by_name = by_header and by_header = by_bytes then by_name when policy = 'TrustByteSniff' then case when by_bytes <> 'unknown' then by_bytes when by_header <> 'unknown' then by_header else by_name end when policy = 'TrustHeader' then case when by_header <> 'unknown' then by_header else by_name end when policy = 'TrustExtension' then by_name else 'quarantine' end as kind, not (by_name = by_header and by_header = by_bytes) as mismatch from {c_types}")
def f10(spark, sf_dir):
    """Three signals: if they agree that is it, else the policy decides which is believed."""
    same = F.size(F.array_distinct(F.array("by_name", "by_header", "by_bytes"))) == 1
    known = lambda *c: F.coalesce(*[F.when(F.col(x) != "unknown", F.col(x)) for x in c], F.col("by_name"))
    kind = F.when(same, F.col("by_name")).when(F.col("policy") == "TrustByteSniff", known("by_bytes", "by_header")).when(F.col("policy") == "TrustHeader", known("by_header")).when(F.col("policy") == "TrustExtension", F.col("by_name"))
    return table(spark, sf_dir, "c_types").select("id", kind.otherwise("quarantine").alias("kind"), (~same).alias("mismatch"))


cases("c_gps", "id, d, m, s, ref, alt, below", (1, 52.0, 31.0, 12.0, "N", 34.0, 0), (2, 13.0, 24.0, 18.0, "W", 10.5, 1), (3, 33.0, 51.0, 35.9, "S", 0.0, 0), (4, 0.0, 0.0, 0.0, "E", 3.0, 1))


@query("x42_gps", "select id, round(cast(d + m / 60 + s / 3600 as double) * case when ref in ('S', 'W') then -1 else 1 end, 9) as degrees, cast(case when below = 1 then -alt else alt end as double) as altitude from (select id, cast(d as double) as d, cast(m as double) as m, cast(s as double) as s, ref, cast(alt as double) as alt, below from {c_gps}) t")
def x42(spark, sf_dir):
    g = table(spark, sf_dir, "c_gps")
    deg = F.aggregate(F.array(*[F.col(c).cast("double") for c in ("s", "m", "d")]), F.lit(0.0), lambda acc, x: acc / 60 + x)
    return g.select("id", F.round(F.when(F.col("ref").isin("S", "W"), -deg).otherwise(deg), 9).alias("degrees"), F.when(F.col("below") == 1, -F.col("alt").cast("double")).otherwise(F.col("alt").cast("double")).alias("altitude"))


cases("c_files", "file, said, known", ("de.dic", "haus~baum", None), ("fr.dic", "maison", "x"), ("en.dic", "house", "no"), ("xx.dic", None, "x"), ("yy.dic", None, None))


@query("l22_integrity", "select file, case when said is null then 'MissingFile' when sum is null then 'MissingChecksum' when sum = sha256(said) then 'Pass' else 'Mismatch' end as verdict from (select file, said, case known when 'x' then sha256(coalesce(said, '')) when 'no' then sha256('other') end as sum from {c_files}) t")
def l22(spark, sf_dir):
    """A dictionary's bytes against its recorded checksum."""
    f = table(spark, sf_dir, "c_files").withColumn("sum", F.when(F.col("known") == "x", F.sha2(F.coalesce("said", F.lit("")), 256)).when(F.col("known") == "no", F.sha2(F.lit("other"), 256)))
    return f.select("file", F.when(F.col("said").isNull(), "MissingFile").when(F.col("sum").isNull(), "MissingChecksum").when(F.sha2("said", 256) == F.col("sum"), "Pass").otherwise("Mismatch").alias("verdict"))


# --- addresses -----------------------------------------------------------------------------------------------------------

cases("c_globs", "pat", ("https://*/en/*",), ("*example.net*",), ("*/de/*.html",), ("http://nothing",), ("*a_b*",), ("*",), ("*(x)+[y]*",))


@query("f9_glob", "select pat, count(u) as n from {c_globs} left join (select url as u from {pages} union all select 'http://x/a_b.html' union all select '(x)+[y].z') p on p.u like replace(replace(replace(pat, '%', '!%'), '_', '!_'), '*', '%') escape '!' group by pat")
def f9(spark, sf_dir):
    """Globs, of which only * is special, as anchored expressions."""
    globs = table(spark, sf_dir, "c_globs")
    rx = F.concat(F.lit("^"), F.replace(F.regexp_replace("pat", r"([.+?^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("u")).union(spark.createDataFrame([("http://x/a_b.html",), ("(x)+[y].z",)], "u string"))
    return globs.join(urls, F.regexp_like("u", rx), "left").groupBy("pat").agg(F.count("u").alias("n"))


cases("c_paths", "root, path", ("/data/site", "a/b.html"), ("/data/site", "../x"), ("/data/site", "a/../../site/b"), ("/data/site", "/etc/passwd"), ("/data/site", "a/./b/../c"), ("/data/site", "../../../.."), ("/data/site", "../site2/x"), ("/data/site", ""))
_DUCK_PATH = "case when path like '/%' then path else root || '/' || path end || '/'"
for _ in range(8):
    _DUCK_PATH = f"regexp_replace(regexp_replace({_DUCK_PATH}, '/(\\.?/)+', '/', 'g'), '^(/\\.\\.)+/|/[^/]*[^/.][^/]*/\\.\\./', '/')"


@query("f7_path_containment", f"select root, path, full_path || '/' like root || '/%' as inside from (select root, path, rtrim({_DUCK_PATH}, '/') as full_path from {{c_paths}}) t")
def f7(spark, sf_dir):
    """A path, its dots resolved, is the root or below it."""
    whole = F.when(F.startswith("path", F.lit("/")), F.col("path")).otherwise(F.concat("root", F.lit("/"), "path"))
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))
    full = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/"))
    return table(spark, sf_dir, "c_paths").select("root", "path", F.startswith(F.concat(full, F.lit("/")), F.concat("root", F.lit("/"))).alias("inside"))


cases("c_scope", "link", ("https://a.test/x",), ("HTTPS://a.test/x",), ("/rel",), ("//other.test/y",), ("https://CDN.a.test/z",), ("https://a.test/logout?x",), ("https://evil.test/a.test",), ("mailto:x",), ("",))


@query("f2_download_scope", "select link, (link like 'https://a.test%' or link like '/%' or lower(link) like 'https://cdn.a.test%') and not lower(link) like '%/logout%' as inside from {c_scope}")
def f2(spark, sf_dir):
    """The site's own links (case counts) and relative ones, those of an allowed subdomain (it does not), without exclusions."""
    inside = F.startswith("link", F.lit("https://a.test")) | F.startswith("link", F.lit("/")) | F.startswith(F.lower("link"), F.lit("https://cdn.a.test"))
    return table(spark, sf_dir, "c_scope").select("link", (inside & ~F.contains(F.lower("link"), F.lit("/logout"))).alias("inside"))


cases("c_modal", "url", ("https://a.test/p?modal=%2Fdetail%2Fone&x=1",), ("https://a.test/p?x=1&modal=/two.html",), ("https://a.test/p?modal=three/",), ("https://a.test/p?modal=%2Ffour%3Fq%3D1%23f",), ("https://a.test/p?modal=",), ("https://a.test/p",))


@query("x5_modal_target", r"select url, case when t = '' then '' else case when t like '/%' then 'https://a.test' || t else 'https://a.test/' || t end || case when t like '%/' or regexp_matches(t, '\.[^./]+$') then '' else '.html' end end as target from (select url, regexp_replace(url_decode(regexp_extract(url, '[?&]modal=([^&]*)', 1)), '[?#].*$', '') as t from {c_modal}) u")
def x5(spark, sf_dir):
    """The page a modal parameter names: decoded, absolute, without query and fragment, with a suffix where it has none."""
    t = F.regexp_replace(F.url_decode(F.coalesce(F.parse_url("url", F.lit("QUERY"), F.lit("modal")), F.lit(""))), "[?#].*$", "")
    whole = F.concat(F.lit("https://a.test"), F.when(F.startswith(t, F.lit("/")), "").otherwise("/"), t, F.when(F.endswith(t, F.lit("/")) | t.rlike(r"\.[^./]+$"), "").otherwise(".html"))
    return table(spark, sf_dir, "c_modal").select("url", F.when(t == "", "").otherwise(whole).alias("target"))


cases("c_scripts", "url", ("https://a.test/js/app.0123456789abcdef0123456789ABCDEF.js?v=1",), ("https://a.test/js/app.js",), ("https://a.test/js/app.0123456789abcdef.js",), ("https://b.test/x.y.ffffffffffffffffffffffffffffffff.js",), ("https://a.test/",))


@query("x10_script_key", r"select url, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1), '\.[0-9a-fA-F]{32}\.js$', '.js') as key from {c_scripts}")
def x10(spark, sf_dir):
    """The path of a script without the digest that changes with each release."""
    path = F.parse_url("url", F.lit("PATH"))
    stem = F.regexp_extract(path, r"^(.*)\.[0-9a-fA-F]{32}\.js$", 1)
    return table(spark, sf_dir, "c_scripts").select("url", F.when(stem != "", F.concat(stem, F.lit(".js"))).otherwise(path).alias("key"))


cases("c_css", "id, css", (1, "a{b:url(x.png)} c{d:url( \"y.png\" )}"), (2, "@import url(data:text/css;base64,AA); e{f:URL(z.gif)}"), (3, "g{h:i}"), (4, "url()"))


@query("x3_css_urls", r"select id, u from (select id, trim(unnest(regexp_extract_all(css, '(?i)url\(\s*[\x22\x27]?([^\x22\x27)]*)[\x22\x27]?\s*\)', 1))) as u from {c_css}) t where u <> '' and not u like 'data:%'")
def x3(spark, sf_dir):
    found = F.split("css", r"(?i)url\(")
    inner = F.transform(F.slice(found, 2, F.size(found)), lambda x: F.trim(F.regexp_replace(F.substring_index(x, ")", 1), r"[\x22\x27]", "")))
    return table(spark, sf_dir, "c_css").select("id", F.explode(inner).alias("u")).where((F.col("u") != "") & ~F.startswith("u", F.lit("data:")))


# --- words ---------------------------------------------------------------------------------------------------------------

cases("c_arabic", "word, known", ("احمد", 0), ("أحمد", 1), ("اسلام", 0), ("إسلام", 1), ("اكتب", 1), ("بيت", 0), ("ارنب", 0))


@query("l14_alternative_spelling", "select w.word as found, k.word as known from (select word from {c_arabic} where known = 0) w join (select word from {c_arabic} where known = 1) k on substr(w.word, 1, 1) = 'ا' and substr(k.word, 1, 1) in ('أ', 'إ') and substr(k.word, 2) = substr(w.word, 2)")
def l14(spark, sf_dir):
    """Words that begin with a bare alif and are known with a hamza on it."""
    words = table(spark, sf_dir, "c_arabic")
    known = words.where("known = 1").select(F.col("word").alias("known"))
    tried = words.where("known = 0").where(F.startswith("word", F.lit("ا"))).select(F.col("word").alias("found"), F.explode(F.array(*[F.concat(F.lit(x), F.substring("word", 2, 1 << 20)) for x in "أإ"])).alias("known"))
    return tried.join(known, "known").select("found", "known")


cases("c_prefixed", "word", ("non-pre-war",), ("pre-",), ("Pre-non-",), ("war-pre",), ("nonpre-x",), ("non-",))


@query("x31_prefix_stripping", "select word, nullif(regexp_replace(word, '(?i)^((non|pre)-)+', ''), '') as bare from {c_prefixed}")
def x31(spark, sf_dir):
    """Known prefixes taken off as long as there are any; nothing is left of a bare prefix."""
    bare = F.col("word")
    for _ in range(4):
        bare = F.when(F.lower(F.substring(bare, 1, 4)).isin("non-", "pre-"), F.substring(bare, 5, 1 << 20)).otherwise(bare)
    return table(spark, sf_dir, "c_prefixed").select("word", F.nullif(bare, F.lit("")).alias("bare"))
