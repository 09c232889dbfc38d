"""The link graph: indexes, joins on names and URLs, redirect chains, canonicals, missing pages, self links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import portable, query, relation, table
from .bloat import reach, referred

_NORM = "rx_replace(rx_replace(trim(url), '[?#].*$', ''), '/+$', '')"
relation("parsed_lines", "select pos, trim(split_part(line, '|', 1)) as c1, trim(split_part(line, '|', 2)) as c2, trim(split_part(line, '|', 3)) as c3, trim(split_part(line, '|', 4)) as c4, trim(split_part(line, '|', 5)) as c5, trim(split_part(line, '|', 6)) as c6, array_length(cut(rx_replace(line, '[|]', '~'), '~')) as n from {fetch_lines}")
relation("redirects", f"select url, target, pos from (select {_NORM} as url, {_NORM.replace('url', 'message')} as target, pos, row_number() over (partition by {_NORM} order by pos) as r from {{fetch_log}} where status in ('Found', 'MovedPermanently')) x where r = 1")
relation("anchors", r"""select page_id, url, elements(regexp_extract_all(html, r'<a\s[^>]*href="([^"]*)"', 1)) as href from {pages_x}""")
relation("canonicals", "select page_id, url, regexp_extract(html, r'<link rel=\"canonical\" href=\"([^\"]*)\"', 1) as target from {pages_x} where html like '%rel=\"canonical\"%'")

portable("s1_corpus_scan", "select page_id, url, cast(length(html) as bigint) as n_chars from {pages} where url like 'https://%'")
portable("s2_fetch_log_scan", "select c2 as url, c3 as status, c4 as message, count(*) as n from {parsed_lines} where n >= 4 group by c2, c3, c4")
portable("s4_index_build", "select c4 as file, c2 as url, c5 as source from {parsed_lines} where lower(c3) like '%saved%' and n > 3 and not c4 like '%.unverified'")
portable("s6_index_first_wins", "select url, message, source from (select replace(url, ':443', '') as url, message, source, row_number() over (partition by replace(url, ':443', '') order by pos) as r from {fetch_log} where status = 'saved') x where r = 1")
portable("j1_file_to_url", "select a.file, a.url, a.source, length(p.html) > 2000 as large from {page_index} a left join {pages} p on p.url = a.url")
portable("j2_url_to_file", "select p.page_id, min(i.file) as file from {pages} p left join {page_index} i on lower(i.url) = lower(p.url) group by p.page_id")
portable("j3_orphans", "select i.file from {page_index} i left join (select file from {page_index} where page_id % 7 <> 0) k on lower(k.file) = lower(i.file) where k.file is null")
portable("j4_not_crawled", "select c.path from (select concat('/p', event_id % 700) as path from {events} group by 1) c left join (select distinct replace(url, 'https://site.test', '') as path from {fetch_log}) f on f.path = c.path where f.path is null")
portable("j5_missing_target_source", "select n.needle, min(p.page_id) as first_page, count(*) as pages from (select distinct concat('href=\"/', w, '\"') as needle from (select 'The' as w union all select 'the' union all select 'attion' union all select 'to') t) n join {pages} p on lower(p.html) like concat('%', lower(n.needle), '%') group by n.needle")
portable("j6_canonical_chain", "select a.page_id, a.target, b.target as next from {canonicals} a join {canonicals} b on lower(b.url) = lower(a.target)")
portable("j7_canonical_missing", "select c.page_id, c.target from {canonicals} c left join {pages} p on lower(p.url) = lower(c.target) left join {pages} q on lower(q.url) = lower(rx_replace(c.target, '/$', '')) where p.url is null and q.url is null")
portable("j8_redirect_chain", "select a.url, a.target as hop1, b.target as hop2, case when c.target in (a.url, b.url) then null else c.target end as hop3 from {redirects} a left join {redirects} b on b.url = a.target and b.url <> a.url left join {redirects} c on c.url = b.target and c.url not in (a.url, b.url)")
portable("j9_boilerplate_group", "select page_id, grp from (select p.page_id, g.grp, row_number() over (partition by p.page_id order by g.exact desc, length(g.prefix) desc) as r from {pages} p join (select 'en' as grp, 'https://' as prefix, 0 as exact union all select 'm', 'https://m.', 0 union all select 'http', 'http://', 0 union all select 'first', 'https://m.ththth.example.net/en/25', 1) g on case when g.exact = 1 then split_part(p.url, '#', 1) = g.prefix else p.url like concat(g.prefix, '%') end) x where r = 1")
portable("j10_language_override", "select page_id, langs from (select p.page_id, g.langs, row_number() over (partition by p.page_id order by length(g.prefix) desc) as r from (select page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path from {pages}) p join (select '/' as prefix, 'en' as langs union all select '/de/', 'de,en' union all select '/fr/8', 'fr') g on p.path like concat(g.prefix, '%')) x where r = 1")
query("j15_script_reach", "select a.url, count(distinct r.page_id) as pages from {assets} a join {page_refs} r on r.asset_id = a.asset_id where a.ext = '.js' group by a.url")(reach)
portable("q22_redirects", "select url, hop1 as target from (select a.url, a.target as hop1, b.target as hop2 from {redirects} a join {redirects} b on b.url = a.target) x where hop2 is not null")
portable("q23_not_found", "select distinct replace(url, ':443', '') as url, '404' as issue_type from {fetch_log} where lower(concat(url, status, message)) like '%notfound%'")
portable("q20_canonical", "select c.page_id, case when not lower(regexp_extract(c.target, '^[A-Za-z]+://([^/?#]*)', 1)) like '%.example.%' then 'CANONICAL_EXTERNAL' when p.url is null then 'CANONICAL_404' when d.target is not null and d.target <> c.target then 'CANONICAL_CHAIN' else 'ok' end as verdict from {canonicals} c left join {pages} p on lower(p.url) = lower(c.target) left join {canonicals} d on lower(d.url) = lower(c.target)")
portable("a21_snapshot_duration", "select cast(ts as date) as day, min(ts) as first, max(ts) as last, count(*) as records, sum(case when status = 'NotFound' then 1 else 0 end) > 0 as has_missing from {fetch_log} group by cast(ts as date)")
portable("a13_extensions", r"select ext, count(*) as files, cast(sum(bytes) as bigint) as bytes from {assets} group by ext")
portable("w8_throughput", "select pos, per_step from (select pos, (pos - lag(pos, 3) over (partition by source order by pos)) / 3.0e0 as per_step from {fetch_log}) x where per_step is not null")


@query("j14_asset_sizes", "select r.page_id, cast(sum(a.bytes) as bigint) as bytes, count(*) as refs from {page_refs} r left join {assets} a on a.asset_id = r.asset_id group by r.page_id")
def j14(spark, sf_dir):
    """A page's references, known or not, and the bytes of those that are known."""
    return referred(spark, sf_dir, how="left").groupBy("page_id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("refs"))


@query("q24_self_links", 'select distinct a.page_id, a.url, \'SELFLINK\' as issue_type from {anchors} a where regexp_extract(a.href, \'^([A-Za-z]+://[^/?#]*[^?#]*)\', 1) = regexp_extract(a.url, \'^([A-Za-z]+://[^/?#]*[^?#]*)\', 1) and not contains(a.href, \'#\')')
def q24(spark, sf_dir):
    """Anchors that lead to their own page: same origin and path, no fragment."""
    bare = lambda c: F.regexp_extract(c, r"^([A-Za-z]+://[^/?#]*[^?#]*)", 1)
    pages = table(spark, sf_dir, "pages_x").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    return pages.where((bare("href") == bare("url")) & ~F.contains("href", F.lit("#"))).select("page_id", "url", F.lit("SELFLINK").alias("issue_type")).distinct()


@query("j8_redirect_recursive", "with recursive walk(start, here, depth) as (select url, target, 1 from {redirects} union all select w.start, r.target, w.depth + 1 from walk w join {redirects} r on r.url = w.here where w.depth < 3 and r.target <> w.start) select start, max(depth) as depth from walk group by start")
def j8r(spark, sf_dir):
    """The chain's depth by three joins, as far as a chain is followed."""
    r = table(spark, sf_dir, "redirects").select("url", "target")
    walk = r.select(F.col("url").alias("start"), F.col("target").alias("at"), F.lit(1).alias("depth"))
    out = walk
    for depth in (2, 3):
        walk = walk.join(r, (walk["at"] == r["url"]) & (r["target"] != walk["start"])).select("start", F.col("target").alias("at"), F.lit(depth).alias("depth"))
        out = out.unionByName(walk)
    return out.groupBy("start").agg(F.max("depth").alias("depth"))
