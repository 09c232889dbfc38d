"""Benchmark decontamination with DataFrame functions alone: the windows of documents against a hash set of test n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_UPPER, checkpoint, sized

#: Bytes of the hash set of windows up to which it is broadcast, over ten million windows; beyond it the windows of the documents are shuffled.
SET_BYTES = 512 << 20

# Words are what remains between these, before and after A-Z are lower-cased.
_CUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lower(c):
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def _words(c):
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), _CUT), "")


def _hashes(w: str, hashed: str, n: int):
    """The hash of each window of n words, from the words' own hashes."""
    last = F.size(w) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(hashed, i, n)))).otherwise(F.array().cast("array<bigint>"))


def windows(benchmark: DataFrame, n: int) -> DataFrame:
    """One row a distinct window: n (its words), gram (joined by spaces), hash and items, the items that have it, in order."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), _words(_lower(F.col("text"))).alias("w"))
    size = F.size("w")
    all_of = F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.slice("w", i, n))).when(size > 0, F.array("w"))
    grams = items.select("item_id", F.explode(all_of).alias("g")).groupBy("g").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return grams.select(F.size("g").alias("n"), F.array_join("g", " ").alias("gram"), F.xxhash64(F.transform("g", lambda x: F.xxhash64(x))).alias("hash"), "items")


def hits(df: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row a document: doc_id, h (its text's hash), n_words, copies (equal rows), spans (array<struct<first, n>> of words, from 1), items.

    A window is n consecutive words of an item, or all of a shorter item. Every window of a document is hashed and
    looked up in the set of the items' windows; a hash that is there is verified word for word.
    """
    grams = checkpoint(windows(benchmark, n))
    sizes = sorted(r["n"] for r in grams.select("n").distinct().collect()) or [n]  # n values at most
    docs = df.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), _words(_lower(F.col("text"))).alias("w"))
    docs = docs.withColumn("hashed", F.transform("w", lambda x: F.xxhash64(x)))
    head = F.array(F.lit(None).cast("bigint"))  # a row of each document's own, which equals nothing
    rows = docs.select("doc_id", "h", "w", F.size("w").alias("n_words"), F.posexplode(F.concat(head, *[_hashes("w", "hashed", m) for m in sizes])).alias("place", "hash"))
    before, first = F.lit(0), F.lit(None).cast("int")
    for m in sizes:
        first = F.when(F.col("n") == m, F.col("place") - before).otherwise(first)
        before = before + F.greatest(F.col("n_words") - (m - 1), F.lit(0))
    same = (rows["hash"] == grams["hash"]) & (F.array_join(F.slice("w", F.greatest(first, F.lit(1)), F.col("n")), " ") == F.col("gram"))
    found = rows.join(sized(grams, SET_BYTES), same, "left").where((F.col("place") == 0) | F.col("gram").isNotNull())
    span = F.when(F.col("gram").isNotNull(), F.struct(first.alias("first"), "n"))
    return (
        found.groupBy("doc_id", "h", F.col("n_words").cast("long").alias("n_words"))
        .agg(F.count_if(F.col("place") == 0).alias("copies"), F.collect_set(span).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    )


def report(df: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or wordless text has no words and no hits; repeated rows each come back; null ids stay; items with a
    null text have no windows; empty tables give no rows or no hits. Other columns are not read.
    """
    found = hits(df, benchmark, n)
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1))))).cast("long")
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "copies")
    return out.select(*[c for c in out.columns if c != "copies"], F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("c")).drop("c")


def remove(df: DataFrame, benchmark: DataFrame, n: int = 10, whole: bool = True) -> DataFrame:
    """df without the documents that hold a window (whole), or with the hit words' text cut out of them.

    All columns stay as they are. A null text is kept.
    """
    found = checkpoint(hits(df, benchmark, n).where(F.size("spans") > 0).select(F.col("doc_id").alias("pw__id"), F.col("h").alias("pw__h"), F.col("spans").alias("pw__spans")))
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("pw__id")) & (F.xxhash64("text") == F.col("pw__h"))
    if whole:
        return df.join(sized(found.drop("pw__spans")), here, "left_anti")
    # The words and what lies between them alternate; a hit word and what follows it go.
    hit = F.array_distinct(F.flatten(F.transform("pw__spans", lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1))))
    joined = df.join(sized(found), here, "left")
    pieces = joined.withColumn("pw__hit", hit).withColumn("pw__w", F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" + r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0)))
    kept = F.array_join(F.filter("pw__w", lambda x, i: ~F.array_contains("pw__hit", i + 1)), "")
    lead = F.regexp_extract("text", "^" + _CUT, 0)
    return pieces.withColumn("text", F.when(F.col("pw__hit").isNull(), F.col("text")).otherwise(F.concat(lead, kept))).select(*df.columns)
