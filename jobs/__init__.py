"""Runnable jobs and their registered queries. A registered query runs its job's function twice into
one new folder below ``spark.checkpoint.dir`` and returns the output as the second run leaves it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planweave.operators.graph import shared_folder

from . import capture_frames, document_register
from .common import defaults


def job1_capture_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames chosen from the events, with the profile of their clip and day."""
    out = shared_folder(spark, "capture-frames")
    for _ in range(2):
        capture_frames.run(spark, f"{sf_dir}/events.parquet", out, defaults("capture_frames"))
    return capture_frames.result(spark, out)


def job2_document_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register of the documents with their sheet numbers."""
    out = shared_folder(spark, "document-register")
    for _ in range(2):
        document_register.run(spark, f"{sf_dir}/documents.parquet", out, defaults("document_register"))
    return document_register.result(spark, out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_capture_frames, job2_document_register)}


def oracle_sql() -> dict[str, str]:
    return {"job1_capture_frames": capture_frames.sql(defaults("capture_frames")), "job2_document_register": document_register.sql(defaults("document_register"))}
