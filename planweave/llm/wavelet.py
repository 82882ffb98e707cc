"""Token shards as wavelet matrices: one compressed, searchable file a shard.

A sequence of ids below 2**k is kept as k bit-planes, most significant bit first; each
plane stably moves the ids with a 0 in front of those with a 1. With ranks on each plane
the file answers ``access(i)``, ``rank(id, i)`` (occurrences before i), ``count(id)`` and
``select(id, j)`` (place of the j-th occurrence) without the ids being stored anywhere.

File: magic, a JSON header of fixed-width length (documents, ids, planes, block table),
the documents' ids and lengths, then the planes cut into blocks of 64 KiB, each
compressed on its own with Zstandard, so a query decompresses only the blocks it needs.
One count a block (zeros before it) is stored; ranks inside a block are popcounts.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import file_system, give_back, make_dir, materialize, scratch, small_batches, spread, trimmed
from .tokens import default_vocabulary, shared_encoder, slices, terminated

MAGIC = b"PWWMTX01"
BLOCK = 1 << 16  # bytes of a plane
END = 2
TEXT = 2 << 20  # bytes of text encoded at once: what is made of them takes many times that
POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def planes_of(ids: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Packed bit-planes (most significant first) and their number."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    row = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    planes = []
    for k in range(bits - 1, -1, -1):
        ones = ((row >> row.dtype.type(k)).astype(np.uint8) & 1).view(bool)
        planes.append(np.packbits(ones, bitorder="little"))
        if k:
            row = np.concatenate([row.compress(~ones), row.compress(ones)])
    return planes, bits


def ids_of(planes: list[np.ndarray], n: int) -> np.ndarray:
    """All ids of packed planes, from the last plane up."""
    bits = len(planes)
    kind = np.uint16 if bits <= 16 else np.uint32
    row = None
    for k, plane in enumerate(reversed(planes)):
        ones = np.unpackbits(plane, count=n, bitorder="little").view(bool)
        if row is None:
            row = ones.astype(kind)
            continue
        at = np.flatnonzero(ones)
        zeros = n - len(at)
        up = np.empty(n, kind)
        up[at] = row[zeros:] | kind(1 << k)
        up[np.flatnonzero(~ones)] = row[:zeros]
        row = up
    return row.astype(np.uint32)


def encode_file(ids: np.ndarray, doc_ids: list, counts: np.ndarray) -> bytes:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    planes, bits = planes_of(ids)
    body, table, zeros = [], [], []
    at = 0
    for plane in planes:
        sizes, before, seen = [], [], 0
        for s in range(0, len(plane), BLOCK):
            part = plane[s : s + BLOCK]
            before.append(seen)
            seen += min(len(ids) - 8 * s, 8 * len(part)) - int(POPCOUNT[part].sum(dtype=np.int64))
            raw = pack(part.tobytes())
            sizes.append(len(raw))
            body.append(raw)
        table.append([at, sizes, before])
        at += sum(sizes)
        zeros.append(seen)
    docs = pack(json.dumps(doc_ids).encode()), pack(np.asarray(counts, "<i8").tobytes())
    head = json.dumps({"tokens": len(ids), "bits": bits, "docs": len(doc_ids), "parts": [len(x) for x in docs], "planes": table, "zeros": zeros}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *docs, *body])


class WaveletMatrix:
    """A file of ``encode_file``; ``read(offset, length)`` fetches bytes of it."""

    def __init__(self, read):
        import zstandard

        self.read = read
        self.unpack = zstandard.ZstdDecompressor().decompress
        start = read(0, 16)
        if start[:8] != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(start[8:], "little")
        self.head = json.loads(read(16, size))
        self.n, self.bits = self.head["tokens"], self.head["bits"]
        a, b = self.head["parts"]
        self.doc_ids = json.loads(self.unpack(read(16 + size, a)))
        self.counts = np.frombuffer(self.unpack(read(16 + size + a, b)), "<i8")
        self.base = 16 + size + a + b
        self.cache: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self.cache:
            at, sizes, _ = self.head["planes"][level]
            raw = self.read(self.base + at + sum(sizes[:k]), sizes[k])
            self.cache[level, k] = np.frombuffer(self.unpack(raw), np.uint8)
        return self.cache[level, k]

    def _zeros_before(self, level: int, i: int) -> int:
        if i >= self.n:
            return self.head["zeros"][level]
        k, rest = divmod(i, 8 * BLOCK)
        part = self._block(level, k)
        whole, odd = divmod(rest, 8)
        ones = int(POPCOUNT[part[:whole]].sum(dtype=np.int64)) + (int(POPCOUNT[part[whole] & ((1 << odd) - 1)]) if odd else 0)
        return self.head["planes"][level][2][k] + rest - ones

    def _bit(self, level: int, i: int) -> int:
        k, rest = divmod(i, 8 * BLOCK)
        return int(self._block(level, k)[rest >> 3] >> (rest & 7) & 1)

    def _down(self, level: int, i: int, bit: int) -> int:
        z = self._zeros_before(level, i)
        return self.head["zeros"][level] + i - z if bit else z

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            out = out << 1 | bit
            i = self._down(level, i, bit)
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits:
            return 0, 0
        lo, hi = 0, i
        for level in range(self.bits):
            bit = token >> (self.bits - 1 - level) & 1
            lo, hi = self._down(level, lo, bit), self._down(level, hi, bit)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        lo, hi = self._range(token, min(max(i, 0), self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """Place of occurrence ``j`` (from 0); IndexError if there are fewer."""
        lo, hi = self._range(token, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        i = lo + j
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            want = i - (self.head["zeros"][level] if bit else 0)
            low, high = 0, self.n - 1  # first place with want + 1 such bits up to it
            while low < high:
                mid = (low + high) // 2
                z = self._zeros_before(level, mid + 1)
                if (mid + 1 - z if bit else z) > want:
                    high = mid
                else:
                    low = mid + 1
            i = low
        return i

    def ids(self) -> np.ndarray:
        planes = [np.concatenate([self._block(level, k) for k in range(len(sizes))]) if sizes else np.empty(0, np.uint8) for level, (_, sizes, _) in enumerate(self.head["planes"])]
        self.cache.clear()
        return ids_of(planes, self.n)


def encoded(batches, encoder, end: int = END):
    """(ids, counts, doc_ids) of record batches, a slice of texts at a time."""
    for batch in slices(batches, most=TEXT):
        yield *terminated(*encoder.encode(batch.column("text")), end), batch.column("doc_id").to_pylist()


def write_shards(docs: DataFrame, vocabulary: str | None = None, end: int = END, roll: int = 2 << 20, partitions: int | None = None) -> DataFrame:
    """Write token shards of ``docs(doc_id, text)`` in ascending doc_id order (nulls first, ties
    in the order of the input) and return the manifest ``(part, k, path, docs, tokens)``.

    Ranges of ids are dealt by sampled bounds; each task encodes its sorted rows and closes
    a shard at about ``roll`` ids, so memory holds one shard whatever the table's size."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    folder = scratch(spark, "shards")
    make_dir(spark, folder)
    small_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # A counter lets rows of one id fall into several ranges; no text is read to find the ranges.
    keyed = slim.withColumn("row", F.monotonically_increasing_id())
    dealt = (keyed.repartitionByRange(partitions, "doc_id", "row") if partitions else keyed.repartitionByRange("doc_id", "row")).sortWithinPartitions("doc_id", "row").drop("row")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = shared_encoder(vocabulary)
        files, base = file_system(folder)
        ids, counts, names, held, k = [], [], [], 0, 0

        def close():
            nonlocal ids, counts, names, held, k
            all_ids, sizes = np.concatenate(ids), np.concatenate(counts)
            name = f"{uuid.uuid4().hex}.pwm"
            with files.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(encode_file(all_ids, names, sizes))
            row = [[part], [k], [f"{folder}/{name}"], [len(names)], [len(all_ids)]]
            ids, counts, names, held, k = [], [], [], 0, k + 1
            del all_ids, sizes
            give_back()
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.int64()), pa.array(row[2]), pa.array(row[3], pa.int64()), pa.array(row[4], pa.int64())], names=["part", "k", "path", "docs", "tokens"])

        for i, c, n in encoded(batches, encoder, end):
            ids.append(i)
            counts.append(c)
            names += n
            held += len(i)
            if held >= roll:
                yield close()
        if names:
            yield close()

    return materialize(dealt.mapInArrow(trimmed(run), "part long, k long, path string, docs long, tokens long"), "manifest")


def with_offsets(manifest: DataFrame) -> DataFrame:
    """The manifest with ``first``, the ids before each shard: sums inside each part, then over parts."""
    inside = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("all"))
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("all").over(across), F.lit(0)).alias("base"))
    return manifest.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(before, "part").withColumn("first", F.col("base") + F.col("inside")).drop("base", "inside")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, first in zip(batch["path"], batch["first"]):
                files, name = file_system(path)
                with files.open_input_file(name) as f:
                    shard = WaveletMatrix(lambda at, n, f=f: f.read_at(n, at))
                    raw = memoryview(shard.ids().astype("<u4").tobytes())
                stops = np.cumsum(shard.counts)
                starts = stops - shard.counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
                yield pd.DataFrame({"doc_id": pd.array(shard.doc_ids, dtype="Int64"), "start": starts + int(first), "n_tokens": shard.counts, "ids_crc32": np.array(crc, np.int64)})

    return spread(materialize(with_offsets(manifest).select("path", "first"), "offsets")).mapInPandas(trimmed(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, vocabulary: str | None = None, partitions: int | None = None) -> DataFrame:
    """Write shards of ``docs`` and read them back. Null and empty texts have the end id
    alone; repeated rows get a row each; a null id sorts first; no document, no shard."""
    return read_shards(write_shards(docs, vocabulary, partitions=partitions))
