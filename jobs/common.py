"""What the jobs share: settings, counting what passes, the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def defaults(name: str) -> dict:
    """Settings of the job's own config file."""
    return json.loads((Path(__file__).parent / f"{name}.json").read_text())


def settings(spark: SparkSession, name: str, path: str | None) -> dict:
    """The job's settings, those of the file at ``path`` over its own; a setting it doesn't know is refused."""
    known = defaults(name)
    if not path:
        return known
    text = spark.read.text(path, wholetext=True).first()[0] if "://" in path else Path(path).read_text()
    given = json.loads(text)
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"{name}: unknown settings {', '.join(unknown)}")
    return {**known, **given}


def write_counted(df: DataFrame, path: str, by: list[str], log: logging.Logger) -> int:
    """Write ``df`` over the partitions it has rows for, leaving others; log and return how many rows went."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    log.info("wrote %d rows to %s", seen.get["rows"], path)
    return seen.get["rows"]


def main(name: str, what: str, run: Callable[[SparkSession, str, str, dict], None], args: list[str] | None = None) -> None:
    """The command line: makes the session, runs the job, stops the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=what)
    parser.add_argument("input", help="table to read (any path that Spark can read)")
    parser.add_argument("output", help="folder of the output")
    parser.add_argument("--config", help=f"JSON file over jobs/{name}.json")
    parser.add_argument("--master", help="Spark master, where spark-submit doesn't name it")
    asked = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from planweave.session import session

    spark = session(name, asked.master)
    try:
        run(spark, asked.input, asked.output, settings(spark, name, asked.config))
    finally:
        spark.stop()
