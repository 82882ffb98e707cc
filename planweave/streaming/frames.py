"""Streams of a running capture: the best frame of every window, sessions.

Batch and stream share the aggregate; the stream adds an event-time window, a watermark for
late frames and, in append mode, one row a window once it has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, schema, per_batch: int | None = None) -> DataFrame:
    """Stream of the Parquet files at ``path``, a folder that grows by files or one file, at most
    ``per_batch`` of them a batch."""
    path = path.rstrip("/")
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may be one file, a plain path must be a folder


def best_frames(frames: DataFrame, keys: list[str], ts: str = "ts", score: str = "sharpness", id_: str = "frame_idx", window: str = "1 second", lateness: str | None = "10 seconds", least: float | None = None) -> DataFrame:
    """keys, window start, id, score of the sharpest frame of each window (ties: the first id).
    State is one struct a key and window; the watermark bounds how many windows stay open."""
    src = frames.withWatermark(ts, lateness) if frames.isStreaming and lateness else frames
    best = src.groupBy(*keys, F.window(ts, window).alias("w")).agg(F.max_by(F.struct(F.col(id_).alias("id"), F.col(score).alias("score")), F.struct(F.col(score), -F.col(id_))).alias("b"))
    out = best.select(*keys, F.col("w.start").alias("start"), F.col("b.id").alias(id_), F.col("b.score").alias(score))
    return out if least is None else out.filter(F.col(score) >= least)


def sessions(events: DataFrame, keys: list[str], ts: str = "ts", gap: str = "30 minutes", lateness: str | None = "1 hour") -> DataFrame:
    """Runs of events no further apart than ``gap``: keys, start, stop, n."""
    src = events.withWatermark(ts, lateness) if events.isStreaming and lateness else events
    return src.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def write(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append finished windows to Parquet; exactly once by the checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
