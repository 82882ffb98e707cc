"""Near copies by the exact Jaccard similarity of word shingles, for corpus stages.

SimHash fingerprints of the shingles are searched first, as the operator does (segment
counts, grid range-join, ``simhash.links``), and each link is verified on the exact sets.
Similar texts often differ in more fingerprint bits than a grid can search, so the rest
comes from a prefix filter, which loses no pair: the shingles of all texts are put in one
order, and two sets of similarity ``4/5`` or more share one of the first
``n - ceil(4 n / 5) + 1`` of each. The order puts shingles common in a sample last (it
changes speed, never results). Only the first shingle two texts share has to find them, so
a place in the order that leaves too few shingles after it doesn't count. Sizes and parity sketches of 256 and 2048 bits, for large
sets 16384 bits, whose differing bits are at most the shingles in one set only, drop
candidates before the sets are compared exactly.

Each prefix shingle first gives a star, which joins most copies in a number of candidates
linear in the rows; pairs that are still in different components are then compared in
full, so the components are those of the whole relation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .simhash import first_of_groups, folded, links, shingle_hashes
from .store import materialize, release, small_batches, trimmed

SKETCH = ("s0", "s1", "s2", "s3")
SAMPLED, COMMON, FEWEST = 8192, 100_000, 4  # texts sampled, common shingles remembered, texts that make one common
LARGE = 1500  # shingles of a set with the largest sketch: smaller ones would be full
NODE = "node long, n int, fp long, s0 long, s1 long, s2 long, s3 long, wide array<long>, huge array<long>"


def hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Shingle hashes of a text, repeats kept; null and wordless texts have one of their own."""
    return np.concatenate([*shingle_hashes(text, words)] or [np.zeros(1, np.uint64)])


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(hashes(text, words).view("<i8"))


def _node(own: np.ndarray) -> int:
    """Name of a set: the hash of its shingles."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).astype(np.int64))


def _mapped(docs: DataFrame, row, schema: str) -> DataFrame:
    """``row(shingle array)`` of each text after its doc_id and text_hash."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = StructType.fromDDL(f"doc_id long, text_hash long, {schema}")
    arrow = to_arrow_schema(full)

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            made = [row(texts[i].as_py()) for i in range(batch.num_rows)]
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*made), list(arrow)[2:])] if made else [pa.array([], f.type) for f in list(arrow)[2:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *columns], names=arrow.names)

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(trimmed(run), full)


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles met often in a sample of texts, sorted; at most ``COMMON``."""
    share = docs.count() // SAMPLED + 1
    sample = docs.filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(share)) == 0)
    each = _mapped(sample, lambda t: (shingles(t, words),), "own array<long>").select(F.explode("own").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("met")).filter(F.col("met") >= FEWEST).orderBy(F.desc("met"), "shingle").limit(COMMON)
    return np.sort(np.array([r.shingle for r in often.collect()], np.int64))


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, node, n, fp, sketches, prefix of each row."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))

    def row(text):
        every = hashes(text, words)
        own = np.unique(every.view("<i8"))
        n = len(own)
        huge = np.packbits((np.bincount(own & 16383, minlength=16384) & 1).astype(np.uint8)).view("<i8")
        wide = np.bitwise_xor.reduce(huge.reshape(8, 32))  # parities add up
        sketch = np.bitwise_xor.reduce(wide.reshape(8, 4)).tolist()
        often = common.value[np.minimum(np.searchsorted(common.value, own), len(common.value) - 1)] == own if len(common.value) else np.zeros(n, bool)
        prefix = np.concatenate([own[~often], own[often]])[: n - (4 * n + 4) // 5 + 1]
        return (_node(own), n, folded([every]), *sketch, wide, huge if n > LARGE else None, prefix)

    return _mapped(docs, row, f"{NODE}, prefix array<long>")


def _early(pa: Column, na: Column, pb: Column, nb: Column) -> Column:
    """Whether a shingle at places ``pa`` and ``pb`` (from 0) can be the first that two sets of
    similarity 4/5 share: what follows it must suffice for an overlap of 4 (na + nb) / 9."""
    return (pa * 9 <= na * 5 - nb * 4) & (pb * 9 <= nb * 5 - na * 4)


def _close(a: str, b: str) -> Column:
    """Whether sizes and sketches of two nodes allow a similarity of 4/5."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH), F.lit(0))
    return (F.least(na, nb) * 5 >= F.greatest(na, nb) * 4) & (apart * 9 <= na + nb)


def _verified(docs: DataFrame, of: DataFrame, candidates: DataFrame, words: int) -> DataFrame:
    """Those of ``candidates(a, b)`` whose sets have a similarity of 4/5 or more."""
    pairs = candidates.filter("a != b").distinct()
    left, right = (of.select(F.col("node").alias(k), *[F.struct("n", *SKETCH).alias(f"of_{k}"), F.col("wide").alias(f"wide_{k}"), F.col("huge").alias(f"huge_{k}")]) for k in "ab")
    pairs = pairs.join(left, "a").join(right, "b").filter(_close("of_a", "of_b"))
    for name in ("wide", "huge"):
        apart = F.aggregate(F.zip_with(f"{name}_a", f"{name}_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, bits: total + bits)
        pairs = pairs.filter(F.coalesce(apart, F.lit(0)) * 9 <= F.col("of_a.n") + F.col("of_b.n"))
    pairs = materialize(pairs.select("a", "b"), "candidates")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(of.join(ends, "node", "left_semi").select(F.col("text_hash").alias("wanted")), "wanted")
    texts = docs.join(wanted, F.xxhash64("text") == F.col("wanted"), "left_semi")

    def row(text):
        own = shingles(text, words)
        return _node(own), own

    sets = _mapped(texts, row, "node long, own array<long>").select("node", "own").dropDuplicates(["node"])
    left, right = (sets.select(F.col("node").alias(k), F.col("own").alias(f"own_{k}")) for k in "ab")
    common = F.size(F.array_intersect("own_a", "own_b"))
    out = materialize(pairs.join(left, "a").join(right, "b").filter(common * 9 >= (F.size("own_a") + F.size("own_b")) * 4).select("a", "b"), "links")
    release(pairs, wanted)
    return out


def near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` -> ``doc_id, text_hash, group`` of each row: the groups are the components of
    the relation "Jaccard similarity of the sets of ``words``-word shingles is 0.8 or more".
    A text of fewer words is one shingle; null and wordless texts are alike."""
    signatures = materialize(_signatures(docs, words), "signatures")
    rows = materialize(signatures.select("doc_id", "text_hash", "node"), "rows")
    of = signatures.groupBy("node").agg(F.min("text_hash").alias("text_hash"), *[F.first(c).alias(c) for c in ("n", "fp", *SKETCH, "wide", "huge", "prefix")])
    of = materialize(of, "nodes")
    release(signatures)
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]

    # SimHash: texts of one fingerprint, and of fingerprints within reach of the grid.
    first = materialize(of.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    alike = of.select("fp", "node").join(first, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = [first.select(F.col("fp").alias(k), F.col("first").alias(f"first_{k}")) for k in "ab"]
    near = links(first.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))

    # A shingle's rows never meet in one task: what is asked of all of them is an aggregate, and the join
    # that gives it back has one row a shingle on its other side, so a hot one is split.
    each = materialize(of.select("node", "n", F.posexplode("prefix").alias("pos", "shingle")), "shingles")
    met = each.groupBy("shingle").agg(F.min(F.struct("node", "n", "pos")).alias("centre"), F.max("node").alias("last")).filter("centre.node < last").drop("last")
    begins = materialize(each.join(met, "shingle").select("shingle", "node", "n", "pos", "centre"), "prefixes")
    release(each)
    near_first = _early(F.col("pos"), F.col("n"), F.col("centre.pos"), F.col("centre.n"))
    stars = begins.filter(near_first).select(F.col("centre.node").alias("a"), F.col("node").alias("b"))
    linked = _verified(docs, of, alike.unionByName(near).select(*ordered).unionByName(stars), words)

    # What is still apart: shingles that meet in several components.
    labels = materialize(connected_components(linked), "labels")
    placed = begins.select("shingle", "node", "pos").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = materialize(placed, "labelled")
    several = placed.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("shingle")
    kept = materialize(placed.join(several, "shingle", "left_semi").join(of.select("node", "n", *SKETCH), "node"), "placed")
    release(begins, placed)
    # Sets of similarity 4/5 have sizes of the same or of neighbouring powers of 5/4, so rows of a shingle
    # meet by size, too.
    sized = kept.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + 1e-9))
    beside = sized.withColumn("size", F.explode(F.array(*[F.col("size") + d for d in (-1, 0, 1)])))
    early = _early(F.col("x.pos"), F.col("x.n"), F.col("y.pos"), F.col("y.n"))
    meets = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.size") == F.col("y.size"))
    apart = beside.alias("x").join(sized.alias("y"), meets & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & early & _close("x", "y"))
    rest = _verified(docs, of, apart.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), words)
    release(kept, of, first)
    labels = connected_components(linked.unionByName(rest))
    return rows.join(labels, "node", "left").select("doc_id", "text_hash", F.coalesce("label", "node").alias("group"))


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near copies, as ``simhash.keep_one``; all columns pass."""
    return first_of_groups(docs, near_copies(docs, words))
