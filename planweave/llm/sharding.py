"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards carries weights; a document descends it by one
weighted hash draw a level: every child of the node draws ln(u) / weight with u from a
hash of document and child, and the largest draw wins. A draw depends on nothing but
the document, the child and the child's weight, so a change of one weight moves
documents only into or out of the subtrees whose weights change. A tree grows by a new
region of its own, which therefore takes documents only into itself.

All of it is native column expressions; a level evaluates only the children of the node
that was reached.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

SEED = 97


@dataclass(frozen=True)
class Node:
    """A region or rack with children, or a shard with a number."""

    name: str
    children: tuple = ()
    shard: int | None = None
    own: float = 1.0
    weight: float = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "weight", sum(c.weight for c in self.children) if self.children else float(self.own))

    def shards(self) -> list[int]:
        return [self.shard] if self.shard is not None else [s for c in self.children for s in c.shards()]


def even_tree(shards: int, regions: int = 2, racks: int = 2) -> Node:
    """``shards`` of weight 1 dealt over regions and racks."""
    places: dict[int, dict[int, list[int]]] = {}
    for s in range(shards):
        region = s * regions // shards
        rack = s * regions * racks // shards % racks
        places.setdefault(region, {}).setdefault(rack, []).append(s)
    return Node("root", tuple(Node(f"g{g}", tuple(Node(f"g{g}k{k}", tuple(Node(f"s{s}", shard=s) for s in own)) for k, own in by.items())) for g, by in places.items()))


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    n = max(tree.shards()) + 1
    return Node("root", (*tree.children, Node(f"x{n}", (Node(f"x{n}k0", (Node(f"s{n}", shard=n, own=weight),)),))))


def _draw(key: Column, child: Node) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name), F.lit(SEED)), 11)
    return F.ln((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(child.weight)


def place(key: Column, node: Node) -> Column:
    """Shard number of a document key: one draw a level."""
    if node.shard is not None:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if len(live) == 1:
        return place(key, live[0])
    draws = F.array(*[_draw(key, c) for c in live])
    won = F.array_position(draws, F.array_max(draws))
    return reduce(lambda out, kc: out.when(won == kc[0] + 1, place(key, kc[1])), list(enumerate(live))[1:-1], F.when(won == 1, place(key, live[0]))).otherwise(place(key, live[-1]))


def assign(docs: DataFrame, tree: Node | None = None, bucket_rows: int = 50_000) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes + 1; null text: 1), text_crc32, law
    ``key``, shard, slot (gapless from 0 within the shard), grown_shard.

    Slots: a shard's rows fall into hash buckets of about ``bucket_rows``; a slot is the
    number of rows in earlier buckets plus the rank in the own one, so no task ranks a
    whole shard; buckets that repeated rows overfill are cut further. A null id is a key like any other; repeated rows get a slot each; equal
    ids share a shard; an empty table gives no row; other columns are ignored.
    """
    tree = tree or even_tree(8)
    key = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    )
    row = F.monotonically_increasing_id().alias("row")
    put = materialize(rows.select("*", place(F.col("doc_id"), tree).cast("int").alias("shard"), place(F.col("doc_id"), grown(tree)).cast("int").alias("grown_shard"), row), "shards")
    buckets = max(16, put.count() // bucket_rows)
    put = put.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(5)), F.lit(buckets)).cast("int"))
    # A bucket that repeated rows have filled is cut by row number.
    counts = materialize(put.groupBy("shard", "bucket").agg(F.ceil(F.count("*") / (2 * bucket_rows)).alias("cuts")), "buckets")
    put = put.join(counts, ["shard", "bucket"]).withColumn("cut", F.pmod("row", "cuts"))
    counts = put.groupBy("shard", "bucket", "cut").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket", "cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", "cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = Window.partitionBy("shard", "bucket", "cut").orderBy("doc_id", "text_crc32", "size")
    ranked = put.withColumn("rank", F.row_number().over(rank) - 1)
    return ranked.join(offsets, ["shard", "bucket", "cut"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"), "grown_shard"
    )
