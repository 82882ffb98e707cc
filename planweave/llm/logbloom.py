"""Log-frequency Bloom filters: approximate counts of hashes in about 12 bits an entry.

A count c has level 1 + floor(log c / log BASE); a hash is put in once for each level up to its
own, so a reader probes level 1, 2, ... until one is absent. Errors are one-sided and rare: a count
can only be read too high. The range of hashes is cut into buckets; each has a segment of its own,
sized for what it holds, so segments are built where a bucket's counts are summed. Segments travel
to the workers by broadcasts of at most ``SLICE`` bytes, one after the other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordstream import U, mix

BASE = 1.5
BITS = 12  # an entry
PROBES = 6
SLICE = 16 << 20  # bytes of filter a broadcast
HELD = 48 << 20  # bytes of broadcasts a worker keeps from one use to the next

#: The smallest count of each level, 0 being that of no entry; strictly growing up to 2 ** 63.
LEAST = [0, 1]
while LEAST[-1] < 1 << 62:
    LEAST.append(max(LEAST[-1] + 1, int(np.ceil(BASE ** (len(LEAST) - 1) - 1e-9))))
_LEAST = np.array(LEAST, np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Level of each count."""
    return np.searchsorted(_LEAST, counts, "right") - 1


def _walk(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and step of a hash's probes at a level, before they are cut to a segment."""
    first = mix(hashes + U(level * 0xE7037ED1A0B428DB & (1 << 64) - 1))
    return first, mix(first) | U(1)


def segment(hashes: np.ndarray, levels: np.ndarray, size: int | None = None) -> bytes:
    """Bits of a bucket (least significant bit of a byte first); ``size`` bytes, or as many as its entries ask for."""
    size = size or max(8, -(-BITS * int(levels.sum()) // 64) * 8)
    held = np.zeros(size * 8, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        chosen = hashes[levels >= level]
        at, step = _walk(chosen, level)
        for _ in range(PROBES):
            held[((at >> U(8)) % U(size * 8)).astype(np.int64)] = True
            at = at + step
    return np.packbits(held, bitorder="little").tobytes()


def bucket_bits(size: int, most: int, least: int = 10, largest: int = 20) -> int:
    """Bits of a hash that name its bucket, so that ``size`` gives about ``most`` a bucket; beyond a
    million buckets, whose table every worker holds, buckets grow instead."""
    return min(largest, max(least, int(size // most).bit_length()))


class Filters:
    """Segments of one or more kinds of hashes, cut into slices that are broadcast."""

    def __init__(self, slices, kinds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], shift: int, most: int, size: int):
        self.slices, self.kinds, self.shift, self.most, self.size = slices, kinds, shift, most, size

    @classmethod
    def broadcast(cls, segments: DataFrame, shift: int, most: int, slice_bytes: int = SLICE) -> Filters:
        """``segments(kind int, bucket long, bits binary)``. The driver holds the sizes and one slice at a time."""
        sizes = segments.select("kind", "bucket", F.octet_length("bits").alias("size")).toArrow().sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kind, bucket, size = (np.asarray(sizes.column(c)).astype(np.int64) for c in ("kind", "bucket", "size"))
        of, place, used, n = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), 0, 0
        for k, s in enumerate(size.tolist()):
            if used and used + s > slice_bytes:
                n, used = n + 1, 0
            of[k], place[k], used = n, used, used + s
        sc = segments.sparkSession.sparkContext
        slices = []
        for k in range(n + 1 if len(size) else 0):
            mine = np.flatnonzero(of == k)
            low, high = (int(kind[mine[0]]), int(bucket[mine[0]])), (int(kind[mine[-1]]), int(bucket[mine[-1]]))
            at = F.struct(F.col("kind").cast("long").alias("a"), F.col("bucket").cast("long").alias("b"))
            edge = lambda e: F.struct(F.lit(e[0]).cast("long").alias("a"), F.lit(e[1]).cast("long").alias("b"))
            rows = segments.filter((at >= edge(low)) & (at <= edge(high))).select("kind", "bucket", "bits").toArrow().sort_by([("kind", "ascending"), ("bucket", "ascending")])
            slices.append(sc.broadcast(b"".join(rows.column("bits").to_pylist())))
        kinds = {}
        for one in np.unique(kind).tolist():
            n_buckets = 1 << (64 - shift)
            table = [np.full(n_buckets, -1, np.int64), np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)]
            mine = kind == one
            for column, values in zip(table, (of, place, size)):
                column[bucket[mine]] = values[mine]
            kinds[one] = tuple(table)
        return cls(slices, kinds, shift, most, int(size.sum()))

    def destroy(self) -> None:
        for one in self.slices:
            one.destroy()

    def levels(self, asked: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Level of each hash of each kind, 0 where it is absent."""
        out = {kind: np.zeros(len(hashes), np.int8) for kind, hashes in asked.items()}
        where = {kind: (hashes >> U(self.shift)).astype(np.int64) for kind, hashes in asked.items()}
        for k, one in enumerate(self.slices):
            held = None
            for kind, hashes in asked.items():
                if kind not in self.kinds:
                    continue
                of, place, size = self.kinds[kind]
                active = np.flatnonzero(of[where[kind]] == k)
                for level in range(1, self.most + 1):
                    if not len(active):
                        break
                    held = np.frombuffer(one.value, np.uint8) if held is None else held
                    at = where[kind][active]
                    base, bits = place[at], (size[at] * 8).astype(U)
                    next_, step = _walk(hashes[active], level)
                    for _ in range(PROBES):
                        spot = ((next_ >> U(8)) % bits).astype(np.int64)
                        kept = (held[base + (spot >> 3)] >> (spot & 7).astype(np.uint8)) & 1 == 1
                        if not kept.all():
                            active, base, bits, next_, step = active[kept], base[kept], bits[kept], next_[kept], step[kept]
                        next_ = next_ + step
                    out[kind][active] = level
            if self.size > HELD:
                vars(one).pop("_value", None)  # the worker reads the slice again from its broadcast file
        return out
