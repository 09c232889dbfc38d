"""The issue ledger: merge of detections, decisions, retention, overdue issues, roll-ups to tickets."""

from __future__ import annotations

from ..catalog import portable, relation

_KEY = "lower(concat(type, '|', url, '|', word))"
relation("old_keyed", f"select {_KEY} as k, type, url, word, status, age_found, age_seen from {{ledger_old}}")
relation("new_keyed", f"select {_KEY} as k, type, url, word from {{ledger_new}}")
relation("merged", "select o.type, o.url, o.word, o.status, o.age_found, 0 as age_seen from {old_keyed} o where exists (select 1 from {new_keyed} n where n.k = o.k) union all select n.type, n.url, n.word, 'new', 0, 0 from {new_keyed} n where not exists (select 1 from {old_keyed} o where o.k = n.k)")
relation("decisions", "select k, min(case when age_found % 2 = 0 then 'wontfix' else '' end) as status, min(concat('seen ', age_found)) as comment from {old_keyed} where age_found % 5 = 0 group by k")

portable("j17_merge", "select type, url, word, status, age_found from {merged}")
portable("j18_merge_exempt", "select type, url, word, status from {merged} where type <> 'LIGATURE' union all select type, url, word, status from {ledger_old} where type = 'LIGATURE'")
portable("j19_decisions", "select o.type, o.url, o.word, coalesce(nullif(d.status, ''), o.status) as status, coalesce(d.comment, '') as comment from {old_keyed} o left join {decisions} d on d.k = o.k")
portable("j20_cms_label", "select l.type, l.url, coalesce(c.lang, 'none') as label from {ledger_old} l left join (select distinct url, regexp_extract(html, '<html lang=\"([a-z]+)', 1) as lang from {pages}) c on c.url = l.url")
portable("j21_partition", "select type, url, word, case when b.u is null then 'rest' else 'bag' end as part from {ledger_old} l left join (select distinct url as u from {pages_x} where page_id % 6 = 0) b on b.u = l.url")
portable("t1_quality_promoted", "select f.issue_type as type, p.url, case when f.issue_type in ('UNWANTED_PATTERN', 'LIGATURE') then f.detail else '' end as word, count(*) as n from {all_findings} f join {pages} p on p.page_id = f.page_id group by 1, 2, 3")
portable("t2_links_promoted", "select '404' as type, url, '' as word from {fetch_log} where status = 'NotFound' group by url union all select 'REDIRECT', url, target from {redirects}")
portable("t3_purged", "select type, url, word, status, age_seen from {ledger_old} where not (status = 'fixed' and age_seen > 30)")
portable("t4_reviewable", "select type, count(*) as n from {merged} where status in ('new', 'pending') group by type")
portable("t5_split_anchor_words", r"select page_id, w from (select page_id, elements(regexp_extract_all(html, r'>([^<>]+)</a>', 1)) as w from {pages_x}) t where length(w) <= 3 group by page_id, w")
portable("x39_retention", "select status, count(*) as kept from {ledger_old} where status <> 'fixed' or age_seen <= 20 group by status")
portable("a12_status_counts", "select status, count(*) as n from {merged} group by status")
portable("a24_contexts", "select lower(url) as k, type, count(distinct word) as words, min(word) as first from {merged} group by lower(url), type")
portable("k11_ticket_text", "select url, concat(url, chr(10), '  ', count(*), ' issues, worst ', min(type), case when count(case when age_found >= 14 then 1 end) > 0 then ', overdue' else '' end) as ticket from {merged} group by url")
portable("x34_status_rollup", "select type, status, count(*) as n from {ledger_old} group by rollup (type, status)")
portable("a14_history", "select cast(ts as date) as snapshot, count(*) as files, cast(floor(sum(floor(value))) as bigint) as size, count(case when event_type = 'error' then 1 end) as hits, count(distinct user_id) as tokens from {events} group by cast(ts as date)")
portable("f17_known_defects", "select m.doc_id, m.word from {everywhere_missing} m join {documents} d on d.doc_id = m.doc_id join (select 'src1' as source, 'th%' as literal union all select 'src2', 'an%') k on k.source = d.source and m.word like k.literal")
