"""All registered queries and the SQL that each is compared with.

A query is either a function of (spark, sf_dir) with SQL for the other engine beside it, or one text of portable
SQL over named relations, which Spark plans as temporary views and the other engine as common table expressions.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "findings"
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The SQL each query is compared with, as written: relations in braces.
SAID: dict[str, str] = {}
#: Derived relations by name: portable SQL that names base tables and other relations in braces.
RELATIONS: dict[str, str] = {}

#: How Spark makes a relation where that is not the text the other engine runs.
NATIVE: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

_BRACED = re.compile(r"\{(\w+)\}")


def _named(sql: str) -> list[str]:
    """The relations that a text names; other braces are its own."""
    return [n for n in dict.fromkeys(_BRACED.findall(sql)) if n in BASE or n in RELATIONS]


def relation(name: str, sql: str) -> None:
    RELATIONS[name] = sql


def native(name: str):
    """Register a function that makes a relation in Spark; the other engine makes it from the relation's text."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        NATIVE[name] = f
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived relation."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in NATIVE:
        return NATIVE[name](spark, sf_dir)
    return spark.sql(_spark_sql(spark, sf_dir, RELATIONS[name]))


def _view(spark: SparkSession, sf_dir: str, name: str) -> str:
    view = f"pw_{name}_{zlib.crc32(sf_dir.encode()):x}"
    table(spark, sf_dir, name).createOrReplaceTempView(view)
    return view


def _spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> str:
    views = {n: _view(spark, sf_dir, n) for n in _named(sql)}
    return _calls(_BRACED.sub(lambda m: views.get(m[1], m[0]), sql), {"rx_replace": ("regexp_replace", ""), "hex_sha256": ("sha2", ", 256"), "matches": ("regexp_like", ""), "elements": ("explode", ""), "array_length": ("size", ""), "cut": ("split", ""), "distinct_of": ("array_distinct", "")})


def _calls(sql: str, names: dict[str, tuple[str, str]]) -> str:
    """Rename function calls and add arguments at their end."""
    for name, (to, more) in names.items():
        while m := re.search(rf"\b{name}\(", sql):
            depth, at, quoted = 1, m.end(), False
            while depth:
                c = sql[at]
                quoted ^= c == "'"
                depth += 0 if quoted else (c == "(") - (c == ")")
                at += 1
            sql = f"{sql[: m.start()]}{to}({sql[m.end() : at - 1]}{more}){sql[at:]}"
    return sql


def other_sql(sql: str) -> str:
    """Portable SQL for the other engine: relations in front, raw strings plain, calls by its names."""
    needed: list[str] = []

    def need(text: str) -> None:
        for n in _named(text):
            if n in RELATIONS and n not in needed:
                need(RELATIONS[n])
                needed.append(n)

    need(sql)
    plain = lambda t: re.sub(r"(?<![\w'])r'", "'", _BRACED.sub(lambda m: m[1] if m[1] in _named(m[0]) else m[0], t))
    body = plain(sql).strip()
    if needed:
        ctes = ",\n".join(f"{n} as ({plain(RELATIONS[n]).strip()})" for n in needed)
        own = re.match(r"with\s+(recursive\s+)?", body)
        body = f"with {own[1] or ''}{ctes},\n{body[own.end() :]}" if own else f"with {ctes}\n{body}"
    return _calls(body, {"rx_replace": ("regexp_replace", ", 'g'"), "hex_sha256": ("sha256", ""), "matches": ("regexp_matches", ""), "elements": ("unnest", ""), "array_length": ("len", ""), "cut": ("string_split", ""), "distinct_of": ("list_distinct", "")})


def query(name: str, sql: str | None = None):
    """Register a function, and the SQL that it is compared with (which may name relations in braces)."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if sql:
            SAID[name] = sql
        return f

    return register


def portable(name: str, sql: str) -> None:
    """Register one text of SQL for both engines."""
    query(name, sql)(lambda spark, sf_dir: spark.sql(_spark_sql(spark, sf_dir, sql)))


def oracle_sql() -> dict[str, str]:
    return {name: other_sql(sql) for name, sql in SAID.items()}


from . import plans  # noqa: E402, F401  (registers everything)
