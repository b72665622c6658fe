"""The commit log as a stream, and event-time windows over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import TableStore


def log_stream(store: TableStore) -> DataFrame:
    """Operations as a streaming DataFrame (seq, op, k, v, file), staged ones included; join ``commits_stream`` on the file for committed ones and their versions."""
    kind = T.StructType([*store.schema.fields, T.StructField("op", T.StringType()), T.StructField("seq", T.LongType())])
    return store.spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{store.path}/data").withColumn("file", F.regexp_extract(F.input_file_name(), "data/([^/]+)/", 1))


def commits_stream(store: TableStore) -> DataFrame:
    """(version, txn_id, file) for each file of each commit, as commits appear."""
    kind = "version long, txn_id long, files array<string>, dead long"
    return store.spark.readStream.schema(kind).json(f"{store.path}/commits").select("version", "txn_id", F.explode("files").alias("file"))


def windowed_counts(events: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """Counts by event-time window and keys of a stream, with a watermark. Zone-less timestamps are read in the session's zone."""
    timed = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    return timed.groupBy(F.window("_time", window), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")
