"""Shared storage: the folder every executor and the driver can reach.

``spark.checkpoint.dir`` names it. Tables that cut lineage and the binary files
some operators write go below it, each under a fresh name, so that a task that is
run twice (speculation, a lost executor) never overwrites another attempt's file:
readers only open the paths that the committed manifest table lists.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder. Where none is configured, a local one is made if the whole
    application is one process; on a cluster that is an error, for machines don't share it."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="planweave-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh URI below the shared folder."""
    return f"{shared_dir(spark)}/planweave/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a shared Parquet table and read it back: cuts lineage,
    and a later loss of an executor recomputes nothing above it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    _until_exit(spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that no later step reads, through Hadoop's file system."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(manifest: DataFrame, each: int = 8) -> DataFrame:
    """A small table of work items (a file or block a row) dealt evenly: an item a task while
    there are few, about ``each`` of them a task beyond that."""
    items = manifest.count()
    return manifest.repartition(max(1, min(items, max(4 * manifest.sparkSession.sparkContext.defaultParallelism, -(-items // each)))))


def file_system(uri: str):
    """(pyarrow file system, path) of a URI; local paths, file://, hdfs:// and object stores
    (Hadoop's names for S3 stand for pyarrow's)."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def make_dir(spark: SparkSession, uri: str) -> None:
    """A scratch folder for binary files."""
    files, path = file_system(uri)
    files.create_dir(path, recursive=True)
    _until_exit(spark, uri)


def _until_exit(spark: SparkSession, uri: str) -> None:
    """Scratch of this application goes when its driver ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from ``names`` that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 1500) -> None:
    """Fewer rows an Arrow batch for the session: texts are long, and a batch is held in the
    executor's and the worker's memory at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def trimmed(run):
    """A partition function that gives freed memory back to the system when its task ends:
    workers are reused, and what one task needed would else stay with its process."""
    from functools import wraps

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Freed memory goes back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
