"""Token counts by a separator scan over flat, unindexed token files.

The files hold token ids and end-of-document ids, nothing else: no index, no header. A
file is cut into blocks of a fixed number of ids that any executor reads by range; a
vectorised search finds the separators of each block. A block knows neither how many
documents end before it nor where its first document began: a prefix scan over one row
a block (sums of counts, last separator so far) supplies both, which stitches documents
that cross any number of block boundaries. Every block is read once.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import file_system, make_dir, materialize, scratch, small_batches, spread, trimmed
from .tokens import default_vocabulary, shared_encoder, slices, terminated

DTYPE = "<u2"
END = 50256
BLOCK = 4 << 20  # ids


def write_flat(docs: DataFrame, vocabulary: str | None = None, end: int = END, roll: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """Encode ``docs(doc_id, text)`` and append them to flat files; returns the committed
    ``files(path, tokens)`` and ``order(path, ordinal, doc_id)``, who wrote what where.
    A special token's string inside a text is text, so ``end`` occurs only as separator."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    if (most := max(end, shared_encoder(vocabulary, special_is_text=True).library.get_vocab_size() - 1)) > np.iinfo(DTYPE).max:
        raise ValueError(f"ids up to {most} don't fit the files' {8 * np.dtype(DTYPE).itemsize} bits")
    folder = scratch(spark, "flat")
    make_dir(spark, folder)
    small_batches(spark)

    def run(batches):
        import pyarrow as pa

        encoder = shared_encoder(vocabulary, special_is_text=True)
        files, base = file_system(folder)
        out = name = None
        written = ordinal = 0
        for batch in slices(batches):
            ids, counts = terminated(*encoder.encode(batch.column("text")), end)
            if out is not None and written >= roll:
                out.close()
                out = None
            if out is None:
                name, written, ordinal = f"{uuid.uuid4().hex}.tok", 0, 0
                out = files.open_output_stream(f"{base}/{name}", compression=None)
            out.write(ids.astype(DTYPE).tobytes())
            written += 2 * len(ids)
            n = len(counts)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column("doc_id")], names=["path", "ordinal", "doc_id"])
            ordinal += n
        if out is not None:
            out.close()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = materialize(slim.mapInArrow(trimmed(run), "path string, ordinal long, doc_id long"), "order")
    return order.select("path").distinct(), order


def scan_block(ids: np.ndarray, end: int) -> np.ndarray:
    """Offsets of the separators in a block."""
    return np.flatnonzero(ids == end)


def scan(paths: DataFrame, end: int = END, block: int = BLOCK, dtype: str = DTYPE) -> DataFrame:
    """``paths(path)`` -> one row per document: path, ordinal (in the file), start, n_tokens
    (without the separator), complete (false for ids after a file's last separator).
    An empty file has no document; two separators in a row make an empty one."""
    width = np.dtype(dtype).itemsize

    def cut(batches):
        import pandas as pd

        for batch in batches:
            for path in batch["path"]:
                files, name = file_system(path)
                n = files.get_file_info(name).size // width
                yield pd.DataFrame({"path": path, "block": np.arange(-(-n // block), dtype=np.int64), "file_tokens": n})

    blocks = materialize(paths.select("path").mapInPandas(trimmed(cut), "path string, block long, file_tokens long"), "blocks")

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, k, total in zip(batch["path"], batch["block"], batch["file_tokens"]):
                files, name = file_system(path)
                begin = int(k) * block
                n = min(block, int(total) - begin)
                with files.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(n * width, begin * width), dtype)
                ends = scan_block(ids, end) + begin
                before = np.concatenate([[-1], ends[:-1]])  # -1: began in an earlier block
                if begin + n == total and (not len(ends) or ends[-1] != total - 1):  # unterminated rest
                    before = np.append(before if len(ends) else before[:0], ends[-1] if len(ends) else -1)
                    yield pd.DataFrame({"path": path, "block": k, "place": np.arange(len(ends) + 1), "stop": np.append(ends, total), "before": before, "complete": np.arange(len(ends) + 1) < len(ends)})
                elif len(ends):
                    yield pd.DataFrame({"path": path, "block": k, "place": np.arange(len(ends)), "stop": ends, "before": before, "complete": True})

    dealt = spread(blocks)
    found = materialize(dealt.mapInPandas(trimmed(run), "path string, block long, place long, stop long, before long, complete boolean"), "separators")
    each = found.filter("complete").groupBy("path", "block").agg(F.count("*").alias("n"), F.max("stop").alias("last"))
    prior = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.join(each, ["path", "block"], "left").select(
        "path", "block", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("ended"), F.coalesce(F.max("last").over(prior), F.lit(-1)).alias("open")
    )
    start = F.when(F.col("before") < 0, F.col("open")).otherwise(F.col("before")) + 1
    return found.join(carry, ["path", "block"]).select(
        "path", (F.col("ended") + F.col("place")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), "complete"
    )


def token_counts(docs: DataFrame, vocabulary: str | None = None, block: int = BLOCK) -> DataFrame:
    """Flat files of ``docs`` scanned for separators: doc_id, n_tokens. Null and empty texts
    have 0; null ids keep their row; repeated rows get one each; no document, no row."""
    files, order = write_flat(docs, vocabulary)
    counts = scan(files, block=block)
    return order.join(counts, ["path", "ordinal"]).select("doc_id", "n_tokens")


def corpus_tokens(spark: SparkSession, docs: DataFrame) -> int:
    return token_counts(docs).agg(F.sum("n_tokens")).first()[0] or 0
