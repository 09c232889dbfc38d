"""Files by their bytes and names: type classification, image sizes, PDF markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import portable, query, relation, table

# A file for each page: its declared type, its extension and its first bytes, of which each third disagrees.
relation(
    "file_signals",
    """select page_id, case page_id % 4 when 0 then '.pdf' when 1 then '.png' when 2 then '.html' else '' end as ext,
    case page_id % 5 when 0 then 'application/pdf' when 1 then 'image/png' when 2 then 'text/html; charset=utf-8' when 3 then 'text/html' else '' end as header,
    case page_id % 3 when 0 then '%PDF-1.7 x' when 1 then '89504E470D0A1A0A' else '<!DOCTYPE html><html>' end as head from {pages}""",
)
relation(
    "file_votes",
    r"""select page_id, case when ext = '.pdf' then 'pdf' when ext in ('.png', '.jpg', '.gif', '.webp') then 'image' else 'html' end as by_name,
    case when lower(header) like 'application/pdf%' then 'pdf' when lower(header) like 'image/%' then 'image' when lower(header) like 'text/html%' then 'html' else 'unknown' end as by_header,
    case when head like '%PDF-%' then 'pdf' when matches(head, '^(89504E47|FFD8FF|47494638|52494646)') then 'image' when matches(head, r'(?i)<!doctype html|<html|<head|<body') then 'html' else 'unknown' end as by_bytes from {file_signals}""",
)
portable("f11_content_types", "select page_id, lower(split_part(header, ';', 1)) in ('text/html', 'application/xhtml+xml') as html, lower(header) = 'application/pdf' as pdf, lower(header) like 'image/%' as image from {file_signals}")
portable("f14_settled", "select by_name, by_header, by_bytes, count(*) as n, case when by_name = by_bytes then 'settled' else 'renamed' end as outcome from {file_votes} group by by_name, by_header, by_bytes")
portable("x44_extracted_tokens", r"select event_id, regexp_extract(props, r'\x22k\x22: ([0-9]+)', 1) as k from {events}")
relation("pdfs", r"select page_id, concat('%PDF-1.7', case page_id % 3 when 0 then ' /Title (A title)' else '' end, case page_id % 2 when 0 then ' /Lang (en)' else '' end, case page_id % 5 when 0 then ' /MarkInfo << /Marked true >> /StructTreeRoot 4 0 R' else '' end, case page_id % 7 when 0 then ' /Outlines 5 0 R' else '' end) as body from {pages}")
relation("pdf_markers", r"select page_id, regexp_extract(body, r'/Title \(([^)]*)\)', 1) as title, regexp_extract(body, r'/Lang \(([^)]*)\)', 1) as lang, case when body like '%/Marked true%' then 1 else 0 end as tagged, case when body like '%/StructTreeRoot%' then 1 else 0 end as struct_tree, case when body like '%/Outlines%' then 1 else 0 end as outlines from {pdfs}")
portable("b9_pdf_markers", "select page_id, title, lang, tagged, struct_tree, outlines from {pdf_markers}")
portable("b10_pdf_gaps", "select page_id, concat(case when title = '' then 'title ' else '' end, case when lang = '' then 'lang ' else '' end, case when tagged = 0 then 'tags ' else '' end, case when outlines = 0 then 'outlines' else '' end) as gaps, (case when title = '' then 1 else 0 end) + (case when lang = '' then 1 else 0 end) + (case when tagged = 0 then 1 else 0 end) as n from {pdf_markers}")
