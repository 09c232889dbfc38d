"""Relations made from the driver's tables: a fetch log, an index, pages with planted defects, assets, findings, a ledger."""

from __future__ import annotations

from ..catalog import relation

relation(
    "fetch_log",
    """select event_id as pos, ts, concat('https://site.test/p', event_id % 500) as url,
    case event_type when 'error' then 'NotFound' when 'purchase' then 'Found' when 'signup' then 'MovedPermanently' else 'saved' end as status,
    case when event_type in ('purchase', 'signup') then concat('https://site.test/p', (event_id * 7 + 3) % 500, case when event_id % 4 = 0 then '/?q=1' else '' end)
      when event_type = 'error' then 'Response status code does not indicate success: 404 (Not Found).'
      else concat('f', event_id % 300, '.html') end as message,
    case when event_id % 5 = 0 then 'list' else 'discovery' end as source
  from {events}""",
)
relation("fetch_lines", "select pos, concat_ws(' | ', cast(pos as string), url, status, message, source, case when status = 'saved' then 'text/html' end) as line from {fetch_log} union all select -1 - pos, concat_ws(' | ', url, status) from {fetch_log} where pos % 50 = 0")
relation("page_index", "select page_id, url, concat(hex_sha256(url), '.html') as file, case when page_id % 9 = 0 then 'list' else 'discovery' end as source from {pages}")
relation(
    "pages_x",
    """select p.page_id, p.url, replace(replace(p.html, '<head>', concat('<head>',
      case when p.page_id % 3 <> 0 then '' when p.page_id % 2 = 0 then concat('<link rel="canonical" href="', p.url, '">')
        when p.page_id % 5 = 0 then '<link rel="canonical" href="https://other.test/x">'
        else concat('<link rel="canonical" href="', coalesce(n.url, 'https://site.test/missing'), '">') end,
      case when p.page_id % 4 = 0 then '' else concat('<meta name="description" content="', trim(repeat('word ', cast(p.page_id % 50 as int))), '">') end,
      case when p.page_id % 6 = 0 then '<meta name="robots" content="noindex, follow">' else '' end,
      case when p.page_id % 8 = 0 then '<meta name="language" content="de">' else '' end)),
    '<article>', concat('<article>',
      case when p.page_id % 5 = 0 then '<a href="/x">Foo</a>t bar <b>hello</b>World <a href="/a">A</a><a href="/b">B</a>' else '' end,
      case when p.page_id % 7 = 0 then '​ ﬁt {{name} <a href="/e"></a>' else '' end,
      case when p.page_id % 10 = 0 then concat('<a href="', p.url, '">self</a>') else '' end)) as html
  from {pages} p left join {pages} n on n.page_id = p.page_id + 1""",
)
relation("assets", "select p_partkey as asset_id, concat('https://site.test/a/', p_partkey, case when p_partkey % 2 = 0 then '.js' else '.css' end) as url, case when p_partkey % 2 = 0 then '.js' else '.css' end as ext, cast(p_size as bigint) * 20000 as bytes from {part}")
relation("page_refs", "select l_orderkey as page_id, l_partkey as asset_id from {lineitem} union select l_orderkey, 1 from {lineitem} where l_orderkey % 20 <> 0")
relation(
    "tokens",
    r"select doc_id, lang, elements(distinct_of(regexp_extract_all(lower(text), r'([\p{L}]+)', 1))) as word from {documents}",
)
relation("lexicon", "select lang, word from {tokens} group by lang, word having count(*) >= 3")
relation(
    "issues",
    """select page_id, url, 'SELFLINK' as type, '' as word from {pages_x} where page_id % 10 = 0
    union all select page_id, url, 'LIGATURE' as type, 'fi' as word from {pages_x} where page_id % 7 = 0
    union all select page_id, url, 'SPLIT_WORD_ANCHOR' as type, 'Foot' as word from {pages_x} where page_id % 5 = 0""",
)
relation(
    "ledger_old",
    """select type, url, word, case page_id % 4 when 0 then 'new' when 1 then 'pending' when 2 then 'wontfix' else 'fixed' end as status,
    cast(page_id % 60 as int) as age_found, cast(page_id % 45 as int) as age_seen from {issues} where page_id % 3 <> 0""",
)
relation("ledger_new", "select type, upper(url) as url, word, page_id from {issues} where page_id % 3 <> 1")
