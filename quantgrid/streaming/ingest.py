"""Structured Streaming: take up vendor files as they arrive, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import Profile, number, pick, sample_name


def stream_long_tables(spark: SparkSession, folder: str, columns: list[str], profile: Profile, *, delimiter: str = "\t") -> DataFrame:
    """(sample_id, feature_id, value) of the rows of long tables that arrive in a folder."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.readStream.schema(schema).csv(folder, sep=delimiter, header=True)
    name = lambda names: F.col(f"`{pick(columns, names)}`")
    return raw.select(sample_name(name(profile.samples)).alias("sample_id"), name(profile.features).alias("feature_id"), number(name(profile.quantities)).alias("value")).where("sample_id is not null and feature_id is not null")


def append_cells(cells: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of cells to a Parquet table, once for each file; ends when all files are taken up."""
    return cells.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_means(events: DataFrame, *, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, key, n, mean) of (ts, key, value) per window; rows that are later than `late` are dropped. Streams and tables."""
    w, events = F.window(time, window), events.withColumn(time, F.col(time).cast("timestamp"))
    out = events.withWatermark(time, late).groupBy(w.alias("w"), "key").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "key", "n", "mean")
