"""Queries over the URL functions: resolution, scope, admission, naming, query strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import portable, query, table
from ..functions import urls as U

_REFS = """select page_id, url, 'abs' as k, concat(url, '&z=1') as ref from pages union all select page_id, url, 'root', '/a/b' from pages
 union all select page_id, url, 'rel', './x.html' from pages union all select page_id, url, 'proto', '//cdn.example.com/x' from pages
 union all select page_id, url, 'mail', 'mailto:a@b.c' from pages union all select page_id, url, 'num', '42' from pages
 union all select page_id, url, 'blank', '  ' from pages union all select page_id, url, 'ip', 'http://10.0.0.1/x' from pages union all select page_id, url, 'ftp', 'ftp://h/x' from pages"""
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_RESOLVED = rf"""case when ref is null or trim(ref) = '' or regexp_matches(trim(ref), '^[#?]') or regexp_matches(trim(ref), '(?i)^(data|mailto|tel|javascript):') or regexp_matches(trim(ref), '^-?[0-9]+$') then null
 when starts_with(trim(ref), '//') then 'https:' || trim(ref) when regexp_matches(trim(ref), '^[A-Za-z][A-Za-z0-9+.-]*://') then trim(ref)
 when starts_with(trim(ref), '/') then regexp_extract(url, '{_SCHEME}', 1) || trim(ref)
 else regexp_extract(url, '{_SCHEME}', 1) || case when regexp_extract({_PATH}, '^(.*/)', 1) = '' then '/' else regexp_extract({_PATH}, '^(.*/)', 1) end || regexp_replace(trim(ref), '^(\./)+', '') end"""


def _refs(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    kinds = {"abs": F.concat("url", F.lit("&z=1")), "root": F.lit("/a/b"), "rel": F.lit("./x.html"), "proto": F.lit("//cdn.example.com/x"), "mail": F.lit("mailto:a@b.c"), "num": F.lit("42"), "blank": F.lit("  "), "ip": F.lit("http://10.0.0.1/x"), "ftp": F.lit("ftp://h/x")}
    return p.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("ref")) for k, v in kinds.items()])).alias("x")).select("page_id", "url", "x.*")


@query("x1_resolve", f"with r as ({_REFS}) select page_id, k, {_RESOLVED} as resolved from r")
def x1(spark, sf_dir):
    return _refs(spark, sf_dir).select("page_id", "k", U.resolve(F.col("ref"), F.col("url")).alias("resolved"))


@query(
    "f3_admission",
    f"""with r as ({_REFS}), s as (select page_id, k, ref, {_RESOLVED} as u from r)
 select page_id, k, case when trim(ref) = '' then 'empty' when u is null then 'unresolvable' when not lower(split_part(u, '://', 1)) in ('http', 'https') then 'scheme:' || lower(split_part(u, '://', 1))
 when regexp_matches(regexp_extract(u, '://([^/?#:]*)', 1), '^[0-9]+(\\.[0-9]+){{0,3}}$') then 'ip-literal:' || regexp_extract(u, '://([^/?#:]*)', 1)
 when not lower(regexp_extract(u, '^([A-Za-z]+://[^/?#:]*)', 1)) in ('https://cdn.example.com', 'https://thther.example.org') then 'off-host:' || lower(regexp_extract(u, '://([^/?#:]*)', 1)) else 'ok' end as verdict from s""",
)
def f3(spark, sf_dir):
    return _refs(spark, sf_dir).select("page_id", "k", U.admission(F.col("ref"), F.col("url"), ["https://cdn.example.com", "https://thther.example.org"]).alias("verdict"))


@query("x7_normalize_url", r"select page_id, lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) || substr(b, length(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) + 1) as norm from (select page_id, regexp_replace(trim(regexp_replace(url, '[?#].*$', '')), '^/+|/+$', '', 'g') as b from pages)")
def x7(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalized(F.col("url")).alias("norm"))


@query("x11_file_name", rf"select page_id, sha256(url) || case when regexp_extract({_PATH}, '(\.[^./]*)$', 1) = '' then '.htm' else regexp_extract({_PATH}, '(\.[^./]*)$', 1) end as file from pages")
def x11(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.file_name(F.col("url")).alias("file"))


@query("x6_without_query_keys", "select page_id, regexp_extract(url, '^([^?#]*)', 1) || case when kept = '' then '' else '?' || kept end || regexp_extract(url, '(#.*)$', 1) as url2 from (select page_id, url, array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: string_split(x, '=')[1] <> 'ref'), '&') as kept from pages)")
def x6(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.without_keys(F.col("url"), "ref").alias("url2"))


@query("f5_ip_literal", r"select h, regexp_matches(h, '^(0x[0-9a-fA-F]+|[0-9]+)(\.(0x[0-9a-fA-F]+|[0-9]+)){0,3}$') or regexp_matches(h, '^\[[0-9a-fA-F:.]+\]$') as ip from (select unnest(['10.0.0.1', '0x7f.1', '2130706433', '[::1]', 'a.example', '1.2.3.4.5']) as h union all select distinct regexp_extract(url, '://([^/?#:]*)', 1) from pages)".replace("{0,3}", "(\\.(0x[0-9a-fA-F]+|[0-9]+))?(\\.(0x[0-9a-fA-F]+|[0-9]+))?").replace(r"(\.(0x[0-9a-fA-F]+|[0-9]+))(\.", r"(\.(0x[0-9a-fA-F]+|[0-9]+))?(\.", 1))
def f5(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#:]*)", 1).alias("h")).distinct()
    given = spark.createDataFrame([(x,) for x in ("10.0.0.1", "0x7f.1", "2130706433", "[::1]", "a.example", "1.2.3.4.5")], "h string")
    return given.unionByName(hosts).select("h", U.is_ip_literal(F.col("h")).alias("ip"))


portable("f1_url_exclusions", "select page_id, url from {pages} where not (lower(url) like '%/de/%' or lower(url) like '%example.net%')")
portable("f4_host_key", r"select lower(regexp_extract(url, r'^([A-Za-z]+://[^/?#:]*)', 1)) as host, count(*) as n from {pages} group by 1")
portable("f6_crawlable_scheme", "select page_id, lower(split_part(url, '://', 1)) in ('http', 'https') as crawlable from {pages}")
portable("f13_requested_kind", r"with e as (select page_id, url, lower(regexp_extract(regexp_extract(url, r'^[A-Za-z]+://[^/?#]*([^?#]*)', 1), r'(\.[^./]*)$', 1)) as ext from {pages}) select page_id, ext, ext in ('', '.htm', '.html') as looks_html, ext = '.pdf' as looks_pdf from e")
portable("x4_fetch_form", "select page_id, case when lower(url) like '%page=2%' then regexp_extract(url, 'page=([^&#]*)', 1) else split_part(url, '?', 1) end as fetched from {pages}")
portable("x8_bloat_ref", "select asset_id, lower(rx_replace(concat(url, '?v=', bytes), r'[?#].*$', '')) as ref from {assets}")
portable("x9_short_names", r"select page_id, rx_replace(file, '^[0-9a-f]{64}', '') as short, rx_replace(concat('a.', substring(file, 1, 32), '.js'), r'\.[0-9a-f]{32}', '') as busted from {page_index}")
portable("x12_url_path", "select page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path from {pages}")
portable("x14_redirect_target", "select pos, case when message like 'Response status code does not indicate success%' then null when message like '%://%' then regexp_extract(message, r'([^ ]*://[^ ]*)', 1) else trim(message) end as target from {fetch_log}")
portable("x15_redirect_status", "select pos, lower(trim(status)) in ('found', 'movedpermanently') as redirect from {fetch_log}")
