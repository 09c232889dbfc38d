"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. All but the last return
the columns of documents. run() writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontam, lang_id, line_dedup, packing, simhash
from pagewright.llm.common import checkpoint, documents, remove, shared_dir, sized
from pagewright.llm.word_encoder import default_path
from pagewright.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: The least share of letters in a document's characters without white space; the cleanest documents with signs after each word have 0.58.
LETTERS = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, texts of which under LETTERS is letters, and those the network finds more like texts in no language than like any it learned.

    Others keep their rows as they are, repeated ones too. Where no document is labelled, only the first two rules hold.
    """
    rows = lang_id.sample(docs)
    if rows:
        network = lang_id.train(rows + lang_id.rejects(2 * max(1, len(rows) // len({x for x, _ in rows}))))
        found = lang_id.predict(docs, network, *docs.columns, names=("pw__lang", "pw__score")).where(F.col("pw__lang") != lang_id.UNDETERMINED)
    else:
        found = docs.where("text is not null")
    letters = F.regexp_count("text", F.lit(r"\p{L}"))
    return found.where((letters > 0) & (letters >= LETTERS * F.regexp_count("text", F.lit(r"\S")))).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that another document keeps, or that are within an edit in ten characters, two at most, of a line that stays.

    Every document stays, if with an empty text; null texts stay null. Rows with equal ids keep the same lines.
    """
    return line_dedup.filter_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Of rows with equal id and text one stays. A row without an id comes after all that have one, then the least hash
    of the text stays. Texts without a word (null ones too) are one group.
    """
    keyed = docs.withColumn("pw__h", F.xxhash64("text"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col("pw__h").alias("h"))
    found = simhash.similar(keyed.select(key.alias("doc_id"), "text"), shingle=5, similarity=0.8)
    rows = found.groupBy(F.col("doc_id.id").alias("pw__id"), F.col("doc_id.h").alias("pw__h2")).agg((F.min("doc_id") != F.min("component_id")).alias("gone"), F.count("*").alias("n"))
    said = checkpoint(rows.where("gone or n > 1"))
    here = keyed["doc_id"].cast("long").eqNullSafe(F.col("pw__id")) & (keyed["pw__h"] == F.col("pw__h2"))
    left = keyed.join(sized(said.where("gone")), here, "left_anti")
    twice = sized(said.where("not gone"))
    once = left.join(twice, here, "left_anti").select(*docs.columns)
    return once.unionByName(left.join(twice, here, "left_semi").dropDuplicates(["doc_id", "pw__h"]).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold ten consecutive words of a benchmark item, or all of a shorter one; repeated rows alike, null and empty texts stay."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens, with the ids of each piece; repeated rows are packed each, an empty or null text is the end id alone."""
    return packing.pack(docs, default_path(), capacity=2048, end=0, ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: A trained network, edit joins and a tokenizer are no SQL; tests/llm compares each stage and the chain with brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)  # nothing reads it again
        before = path
    return docs
