"""Search metadata of pages, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import portable, query, relation, table

# Default limits and robots values that make a page indexable.
TITLE, DESCRIPTION = (30, 60), (70, 160)
INDEXABLE = ("", "index", "follow", "follow,index", "index,follow")

relation(
    "seo_fields",
    r"""select page_id, url, trim(regexp_extract(html, r'<title>([^<]*)', 1)) as title, trim(regexp_extract(html, 'name="description" content="([^"]*)"', 1)) as description,
    lower(replace(regexp_extract(html, 'name="robots" content="([^"]*)"', 1), ' ', '')) as robots, regexp_extract(html, 'name="keywords" content="([^"]*)"', 1) as keywords,
    cast((length(html) - length(replace(html, '<h1', ''))) / 3 as bigint) as h1 from {pages_x}""",
)
portable("h13_seo_fields", "select page_id, url, title, cast(length(title) as bigint) as title_length, description, cast(length(description) as bigint) as description_length, robots, keywords, h1 from {seo_fields}")
portable("x34_title_core", "select page_id, case when title like '%.' then substring(title, 1, length(title) - 1) when title like '%*' then rx_replace(title, '[*]+$', '') else null end as core from {seo_fields}")
portable("seo_index_from_list", "select s.page_id, 'robots:index+source:list' as issue_type from {seo_fields} s join {page_index} i on i.page_id = s.page_id where i.source = 'list' and s.robots in ('', 'index', 'index,follow')")


def issues(fields):
    """One row an issue of an indexable page; too short is said of the whole title, too long too where there is no template."""
    t, d = F.length("title"), F.length("description")
    rules = {
        "MissingTitle": t == 0,
        "TitleTooShort": (t > 0) & (t < TITLE[0]),
        "TitleTooLong": t > TITLE[1],
        "MissingDescription": d == 0,
        "DescriptionTooShort": (d > 0) & (d < DESCRIPTION[0]),
        "DescriptionTooLong": d > DESCRIPTION[1],
        "MetaKeywordsPresent": F.col("keywords") != "",
        "MissingH1": F.col("h1") == 0,
        "MultipleH1": F.col("h1") > 1,
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return fields.where(F.col("robots").isin(*INDEXABLE)).select("page_id", "url", F.explode(found).alias("issue_type"))


@query(
    "q21_seo",
    """select page_id, url, issue_type from (select page_id, url, unnest(list_filter([case when length(title) = 0 then 'MissingTitle' end, case when length(title) between 1 and 29 then 'TitleTooShort' end,
 case when length(title) > 60 then 'TitleTooLong' end, case when length(description) = 0 then 'MissingDescription' end, case when length(description) between 1 and 69 then 'DescriptionTooShort' end,
 case when length(description) > 160 then 'DescriptionTooLong' end, case when keywords <> '' then 'MetaKeywordsPresent' end, case when h1 = 0 then 'MissingH1' end, case when h1 > 1 then 'MultipleH1' end], lambda x: x is not null)) as issue_type
 from {seo_fields} where robots in ('', 'index', 'follow', 'follow,index', 'index,follow'))""",
)
def q21(spark, sf_dir):
    return issues(table(spark, sf_dir, "seo_fields"))
