"""Streams over the event log, each with the batch query that it must equal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table


def source(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A file stream of event files with an event time of type timestamp."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def throughput(events: DataFrame) -> DataFrame:
    """Events in windows of 8 hours that slide by 2, late data up to an hour."""
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "8 hours", "2 hours")).agg(F.count("*").alias("n"))


def sessions(events: DataFrame) -> DataFrame:
    """Sessions of a user, ended by 4 hours without an event."""
    return events.withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", "4 hours")).agg(F.count("*").alias("n"))


def first_visits(events: DataFrame) -> DataFrame:
    """Each user and type once within the watermark."""
    return events.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["user_id", "event_type"])


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: below spark.checkpoint.dir, or on this machine if the session is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named}/stream-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="pagewright-stream-")


def run(spark: SparkSession, folder: str, schema, build, to: str, checkpoint: str) -> None:
    """All that is there now, appended to a Parquet table; a later run with the same checkpoint goes on where this one ended."""
    build(source(spark, folder, schema)).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def streamed(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """What a stream over the event files appends until it has read all that is there."""
    folder = shared_folder(spark)
    events = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(events).schema
    run(spark, f"{sf_dir}/events[.]parquet", schema, build, f"{folder}/out", f"{folder}/state")  # a pattern may name one file; a plain path has to be a folder
    return spark.read.parquet(f"{folder}/out")


@query("st3_throughput_windows", "select w as start, count(*) as n from (select unnest([time_bucket(interval '2 hours', ts), time_bucket(interval '2 hours', ts) - interval '2 hours', time_bucket(interval '2 hours', ts) - interval '4 hours', time_bucket(interval '2 hours', ts) - interval '6 hours']) as w from events) group by w")
def st3(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return throughput(e).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("st4_sessions", "select user_id, min(ts) as start, count(*) as n from (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id) as s from (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '4 hours' then 0 else 1 end as new from events)) group by user_id, s")
def st4(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("st2_visited_set", "select user_id, event_type from events group by user_id, event_type")
def st2(spark, sf_dir):
    """A stream that passes each key on once within the watermark."""
    return streamed(spark, sf_dir, first_visits).select("user_id", "event_type")


@query("st1_append_log", "select event_id, user_id, event_type from events where event_type in ('error', 'signup')")
def st1(spark, sf_dir):
    """A stream that appends the lines of a log that are kept."""
    return streamed(spark, sf_dir, lambda e: e.where(F.col("event_type").isin("error", "signup")).select("event_id", "user_id", "event_type"))
