"""Frames worth reconstructing, from the scores that capture devices send all day.

A device (``user_id``) reports frames: time, score (``value``, the sharpness) and kind; kinds listed
as blank are flat pictures. Of every day of a device the job keeps at most ``frames`` frames, the
best of their windows and spread over the day, with the profile and the warnings of that day.

Incremental: a file stream takes the files that are new since its checkpoint and ends. What a batch
brings is landed under the batch's number, then the days it touches are worked out anew from all
that has landed, so late and reordered files give the same result as one file with everything, and
a batch that runs twice writes the same partitions twice. Days that nothing new came for are neither
read nor written.

    python -m jobs.capture_frames INPUT OUTPUT [--config FILE]

INPUT: event_id, ts, user_id, event_type, value (Parquet; a file, or a folder that grows by files).
OUTPUT: landed/ (by batch and day; rows without a time, a device or a score have no day and go no
further), frames/ and clips/ (by day), checkpoint/.

Rows that are alike in all five columns are one report; frames of equal score go to the smaller
event_id, windows of equal score to the earlier one; an empty table gives empty output; further
columns are ignored. A run needs the input to exist, a folder without files included."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.operators import aggregate, select
from planweave.streaming import frames as windows

from .common import main, write_counted

log = logging.getLogger("jobs.capture_frames")
COLUMNS = "event_id long, ts timestamp, user_id long, event_type string, value double"
DAY_US = 86_400_000_000
KEYS = ["user_id", "day"]
FRAMES = "user_id long, event_id long, slot long, score double, day date"
CLIPS = "user_id long, first timestamp, last timestamp, usable_frames long, blurry_windows long, flat_windows long, sharpness_median double, sharpness_p10 double, warnings string, day date"


def reports(rows: DataFrame) -> DataFrame:
    """The five columns and the UTC day."""
    typed = rows.select(F.col("event_id").cast("long"), F.col("ts").cast("timestamp"), F.col("user_id").cast("long"), F.col("event_type").cast("string"), F.col("value").cast("double"))
    return typed.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros("ts") / DAY_US).cast("int")))


def chosen(rows: DataFrame, config: dict) -> DataFrame:
    """Frames of every device and day: user_id, event_id, slot, score, day."""
    best = windows.best_frames(rows, KEYS, "ts", "value", "event_id", config["window"], None, config["least_score"])
    slot = F.floor(F.pmod(F.unix_micros("start"), F.lit(DAY_US)) * config["windows_a_day"] / DAY_US).cast("long")
    spread = select.spread_top(best.withColumn("slot", slot), KEYS, "slot", "value", config["frames"], config["windows_a_day"])
    return spread.select("user_id", "event_id", "slot", F.col("value").alias("score"), "day")


def profiles(rows: DataFrame, config: dict) -> DataFrame:
    """Profile and warnings of every device and day."""
    flatness = F.when(F.col("event_type").isin(config["blank_types"]), 1.0).otherwise(0.0)
    index = F.pmod(F.unix_micros("ts"), F.lit(DAY_US))
    probes = rows.select(*KEYS, index.alias("index"), F.col("value").alias("sharpness"), flatness.alias("flatness"))
    verdict = aggregate.video_profile(probes, KEYS, "index", DAY_US // config["windows_a_day"], config["least_score"], config["flat_share"])
    times = rows.groupBy(*KEYS).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    sized = verdict.join(times, KEYS).withColumns({"duration_s": F.unix_seconds("last") - F.unix_seconds("first"), "width": F.lit(config["width"]), "height": F.lit(config["height"])})
    warned = aggregate.video_warnings(sized, config["fps"])
    return warned.select("user_id", "first", "last", "usable_frames", "blurry_windows", "flat_windows", "sharpness_median", "sharpness_p10", F.concat_ws(" ", "warnings").alias("warnings"), "day")


def take(batch: DataFrame, number: int, output: str, config: dict) -> int:
    """Land one batch and renew the days it touches; how many rows came."""
    spark = batch.sparkSession
    usable = F.col("user_id").isNotNull() & F.col("value").isNotNull()
    rows = reports(batch).withColumns({"day": F.when(usable, F.col("day")), "batch": F.lit(number).cast("long")})
    count = write_counted(rows, f"{output}/landed", ["batch", "day"], log)
    landed = spark.read.schema(f"{COLUMNS}, batch long, day date").parquet(f"{output}/landed")
    touched = landed.filter((F.col("batch") == number) & F.col("day").isNotNull()).select("day").distinct()  # days of a batch: few
    renewed = landed.join(F.broadcast(touched), "day").select("event_id", "ts", "user_id", "event_type", "value", "day").distinct()
    write_counted(chosen(renewed, config), f"{output}/frames", ["day"], log)
    write_counted(profiles(renewed, config), f"{output}/clips", ["day"], log)
    return count


def run(spark: SparkSession, source: str, output: str, config: dict) -> None:
    """Take what is new in ``source``; returns when all of it is in the output."""
    schema = spark.read.parquet(source).schema if _any(spark, source) else COLUMNS
    stream = windows.files(spark, source, schema, config["files_a_batch"])
    counts: dict[int, int] = {}
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: counts.update({number: take(batch, number, output, config)}))
        .option("checkpointLocation", f"{output}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    log.info("read %d new rows of %s in %d batches", sum(counts.values()), source, len(counts))


def _any(spark: SparkSession, source: str) -> bool:
    """Whether there is a file to take the schema from."""
    return not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path").limit(1).isEmpty()


def result(spark: SparkSession, output: str) -> DataFrame:
    """A row for each kept frame and for each device's day without one."""
    frames = spark.read.schema(FRAMES).parquet(f"{output}/frames")
    clips = spark.read.schema(CLIPS).parquet(f"{output}/clips").drop("first", "last")
    return clips.join(frames, KEYS, "left").select("user_id", F.col("day").cast("string").alias("day"), "event_id", "slot", "score", "usable_frames", "blurry_windows", "flat_windows", *[F.round(c, 6).alias(c) for c in ("sharpness_median", "sharpness_p10")], "warnings")


def sql(config: dict) -> str:
    """DuckDB SQL for ``result`` over the whole events."""
    n, k, least = config["windows_a_day"], config["frames"], config["least_score"]
    blank = ", ".join(f"'{t}'" for t in config["blank_types"])
    return f"""
WITH e AS (
  SELECT DISTINCT event_id, user_id, ts, value, event_type, CAST(ts AS DATE) AS day,
         (epoch_us(ts) % {DAY_US}) // {DAY_US // n} AS slot, coalesce(event_type IN ({blank}), false) AS flat
  FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL),
best AS (
  SELECT user_id, day, slot, event_id, value FROM e
  QUALIFY row_number() OVER (PARTITION BY user_id, day, slot ORDER BY value DESC, event_id) = 1),
good AS (SELECT *, least({k - 1}, slot * {k} // {n}) AS stretch FROM best WHERE value >= {least}),
turn AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, stretch ORDER BY value DESC, slot) = 1 AS first FROM good),
kept AS (
  SELECT user_id, day, event_id, slot, value FROM turn
  QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY first DESC, value DESC, slot) <= {k}),
w AS (SELECT user_id, day, slot, max(CASE WHEN flat THEN 0 ELSE value END) AS best, bool_and(flat) AS flat FROM e GROUP BY ALL),
verdict AS (
  SELECT user_id, day, count(*) FILTER (best >= {config['least_score']}) AS usable_frames, count(*) FILTER (flat) AS flat_windows, count(*) AS n FROM w GROUP BY ALL),
scores AS (
  SELECT user_id, day, coalesce(median(value) FILTER (NOT flat), 0.0) AS sharpness_median, coalesce(quantile_cont(value, 0.1) FILTER (NOT flat), 0.0) AS sharpness_p10,
         epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 AS duration_s FROM e GROUP BY ALL),
clips AS (
  SELECT user_id, day, usable_frames, n - usable_frames - flat_windows AS blurry_windows, flat_windows, sharpness_median, sharpness_p10,
         concat_ws(' ', CASE WHEN duration_s < 20 THEN 'too_short' END, CASE WHEN {min(config['width'], config['height'])} < 700 THEN 'low_resolution' END,
           CASE WHEN sharpness_median < 40 THEN 'mostly_blurry' END,
           CASE WHEN flat_windows > 0 THEN 'blank_seconds=' || CAST(round_even(flat_windows / {config['fps']}, 0) AS INT) END,
           CASE WHEN usable_frames < 12 THEN 'few_usable=' || usable_frames END) AS warnings
  FROM verdict JOIN scores USING (user_id, day))
SELECT c.user_id, CAST(c.day AS VARCHAR) AS day, event_id, slot, value AS score, usable_frames, blurry_windows, flat_windows, round(sharpness_median, 6) AS sharpness_median, round(sharpness_p10, 6) AS sharpness_p10, warnings
FROM clips c LEFT JOIN kept k ON k.user_id = c.user_id AND k.day = c.day
"""


if __name__ == "__main__":
    main("capture_frames", "Choose the frames of each device and day from what is new.", run)
