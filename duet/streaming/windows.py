"""The same windows on a stream or a table: tumbling, sliding and session windows, deduplication, file intake.

Late rows: a watermark on event time bounds the state; rows that come later than it are dropped from windows that are closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(df: DataFrame, ts: str, width: str, by: list[str], aggregates: list, late: str | None = None) -> DataFrame:
    rows = df.withWatermark(ts, late) if late else df
    out = rows.groupBy(F.window(ts, width), *by).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def sliding(df: DataFrame, ts: str, width: str, hop: str, by: list[str], aggregates: list, late: str | None = None) -> DataFrame:
    rows = df.withWatermark(ts, late) if late else df
    out = rows.groupBy(F.window(ts, width, hop), *by).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], aggregates: list, late: str | None = None) -> DataFrame:
    """Sessions that close once ``gap`` has passed since their last row."""
    rows = df.withWatermark(ts, late) if late else df
    out = rows.groupBy(F.session_window(ts, gap), *by).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in out.columns if c != "session_window"])


def dedupe(df: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def file_stream(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Take in all files that are new since the last run and stop: incremental intake that survives restarts."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
