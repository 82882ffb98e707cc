"""SimHash near-duplicates: segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. Two
fingerprints at Hamming distance d have embeddings at Manhattan distance at most d, so
the Manhattan distance is a lower bound that never loses a link. The counts are kept in
thermometer code (0, 1, 2 -> 00, 01, 11) inside one long, which turns a step of one on
one coordinate into a bit flip and keeps the whole search in native integer expressions.

Grid range-join: two embeddings at Manhattan distance 2 or less have a common grid point
at distance 1 or less from both, so each fingerprint is put at its own grid point and at
the neighbours, and fingerprints that meet at a point are compared exactly. Points where
two meet give that pair. Fingerprints that meet in a crowd are embedded again with
segments of one bit: there all that meet at a point differ in 2 bits or less and there are
65 at most, so a point gives a star and no group is ever expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .store import fresh, materialize, small_batches, trimmed

LOW = 0x5555555555555555
BLOCK = 1 << 20  # bytes of a text that are split into words at once


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def shingle_hashes(text: str | None, words: int, block: int = BLOCK) -> Iterator[np.ndarray]:
    """XXH64 hashes (seed 42) of the shingles of one text in arrays, repeats kept; none without
    words. A long text is split a block at a time, so memory holds one block's words."""
    import re

    import xxhash

    digest = xxhash.xxh64_intdigest
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    space, at, some, held = re.compile(rb"[ \t-\r]"), 0, False, []
    while at < len(raw):
        stop = len(raw)
        if stop - at > block and (m := space.search(raw, at + block)):
            stop = m.start()
        held += raw[at:stop].split()
        at = stop
        if len(held) < words:
            continue
        joined = b" ".join(held)
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(held) - words + 1].tolist()
        yield np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts))
        some = True
        held = held[len(held) - words + 1 :]
    if not some and held:
        yield np.array([digest(b" ".join(held), 42)], np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of one text, signed. ASCII letters are lower-cased, words are runs
    of anything but ASCII white space, shingles are ``words`` of them joined by a space,
    repeats counted (a shorter text is one shingle). A bit is set where over half the
    XXH64 hashes (seed 42) have it. Null and wordless texts give 0."""
    return folded(shingle_hashes(text, words))


def folded(hashes) -> int:
    """SimHash of arrays of hashes, signed."""
    counts, n = np.zeros(64, np.int64), 0
    for array in hashes:
        n += len(array)
        for at in range(0, len(array), 65536):
            counts += np.unpackbits(array[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0]) if n else 0


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, text_hash, fp)``; no shuffle, only ids and
    two longs leave the workers."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            fps = pa.array([fingerprint(texts[i].as_py(), words) for i in range(batch.num_rows)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), fps], names=["doc_id", "text_hash", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, text_hash long, fp long")


def embed(fp: Column) -> Column:
    """Thermometer-coded bit counts of the 32 two-bit segments."""
    shifted = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(shifted).bitwiseAND(_long(LOW))
    both = fp.bitwiseAND(shifted).bitwiseAND(_long(LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _near_points(e: Column) -> Column:
    """The grid point of a thermometer code and those one step away: a count of 0 can only
    grow, one of 2 only fall, one of 1 do both (else the array has a null)."""
    points = [e]
    for k in range(0, 64, 2):
        low, high = _long(1 << k), _long(2 << k)
        points.append(e.bitwiseXOR(F.when(e.bitwiseAND(high) != 0, high).otherwise(low)))  # 2 -> 1, else 0 <-> 1
        points.append(F.when(e.bitwiseAND(_long(3 << k)) == low, e.bitwiseXOR(high)))  # 1 -> 2
    return F.array(*points)


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints ``fps(fp long)`` -> ``edges(a, b)`` whose components are exactly
    those of the relation "2 or fewer differing bits"."""
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2  # exact
    embedded = fps.select("fp", embed(F.col("fp")).alias("e"))
    placed = embedded.select("fp", F.explode(_near_points(F.col("e"))).alias("point")).filter("point is not null")
    met = placed.groupBy("point").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    met = materialize(met, "met")
    pairs = met.filter("n = 2").select("a", "b").filter(close)

    crowd = placed.join(met.filter("n > 2").select("point"), "point", "left_semi").select("fp").distinct()
    finest = F.array(F.lit(0).cast("long"), *[_long(1 << k) for k in range(64)])
    stars = (
        crowd.select("fp", F.explode(finest).alias("step"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("step")).alias("point"))
        .agg(F.collect_set("fp").alias("near"))  # 65 at most
        .filter(F.size("near") > 1)
        .select(F.array_min("near").alias("a"), F.explode("near").alias("b"))
        .filter((F.col("a") != F.col("b")) & close)
    )
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` -> one row per document: ``doc_id, text_hash, fp, group, component_id``.

    ``group`` is the smallest fingerprint (signed) of the component, ``component_id`` its
    smallest doc_id. Null and empty texts share fingerprint 0 and are linked like any
    other; rows with a null doc_id keep their fingerprint and take the smallest id of
    their component (null if it has none); repeated rows give repeated rows; an empty
    table gives none; other columns are ignored.
    """
    rows = materialize(fingerprints(docs, words), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = connected_components(links(distinct.select("fp")))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("group"), "first")
    smallest = named.groupBy("group").agg(F.min("first").alias("component_id"))
    of = named.join(smallest, "group").select("fp", "group", "component_id")
    return rows.join(of, "fp").select("doc_id", "text_hash", "fp", "group", "component_id")


def first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of ``groups(doc_id, text_hash, group)``, that with the
    smallest (doc_id, text hash); all columns pass. Of repeated rows one stays."""
    least = F.lit(-(1 << 63)).cast("long")  # stands for a null id
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", least).alias("k"), "text_hash")  # an id before none
    k, h, row = fresh(docs, "k", "h", "row")
    chosen = groups.groupBy("group").agg(F.min(key).alias("c")).select(F.col("c.k").alias(k), F.col("c.text_hash").alias(h))
    keyed = docs.withColumns({k: F.coalesce(F.col("doc_id").cast("long"), least), h: F.xxhash64("text")})
    order = Window.partitionBy(k, h).orderBy(h)  # the join's own partitioning: no second shuffle
    return keyed.join(chosen, [k, h], "left_semi").withColumn(row, F.row_number().over(order)).filter(F.col(row) == 1).select(*docs.columns)


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """``first_of_groups`` of the groups of ``near_duplicates``."""
    return first_of_groups(docs, near_duplicates(docs, words))


def near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """Digest of ``near_duplicates``: doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
