"""Graphs by keyed iteration: components, breadth-first levels. Each round is one join and one
aggregate, its result checkpointed to the shared folder, so lineage and plans stay short."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def _shared(spark: SparkSession) -> str:
    """URI of the shared folder. Where the session names none, a local one is made if the whole
    application is one process; on a cluster that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="planweave-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A checkpoint as a Parquet table of the shared folder, a fraction of one of rows in size. What was
    shuffled for it goes when it is written, the table itself with ``release`` or the application."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = shared_folder(spark, "stored"), spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` that nothing reads any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(table._stored)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder below the shared one; nothing else ever uses its name."""
    return f"{_shared(spark).rstrip('/')}/planweave/{name}-{uuid.uuid4().hex}"


def components(edges: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node of each node's component, within the keys: keys, node, label. Labels are
    hooked and halved (each node also asks its label's label), so rounds grow with the
    logarithm of the longest path."""
    e = edges.select(*keys, F.col(a).alias("a"), F.col(b).alias("b"))
    both = checkpointed(e.unionByName(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    nodes = checkpointed(both.groupBy(*keys, F.col("a").alias("node")).agg(F.min("b").alias("m")).select(*keys, "node", F.least("node", "m").alias("label")))
    while True:
        seen = both.join(nodes.select(*keys, F.col("node").alias("b"), "label"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = nodes.join(seen, [*keys, "node"], "left").select(*keys, "node", "label", F.least("label", "near").alias("new"))
        # everything that shared the old label may follow to the smallest new one
        moved = hooked.groupBy(*keys, F.col("label").alias("_l")).agg(F.min("new").alias("_m"))
        low = hooked.withColumnRenamed("label", "_l").join(moved, [*keys, "_l"]).select(*keys, "node", F.col("_l").alias("label"), F.least("new", "_m").alias("new"))
        jump = low.select(*keys, F.col("node").alias("new"), F.col("new").alias("_j"))
        after = checkpointed(low.join(jump, [*keys, "new"], "left").select(*keys, "node", "label", F.least("new", F.coalesce("_j", "new")).alias("new")))
        changed = after.filter("new <> label").limit(1).count()
        nodes = after.select(*keys, "node", F.col("new").alias("label"))
        if not changed:
            break
    return nodes


TILE = 256  # cells a side of the tiles that are labelled on their own


def _labelled(iy: np.ndarray, ix: np.ndarray) -> np.ndarray:
    """Index of the first cell (by row, then column) of each cell's 4-connected component; the cells
    are sorted by row and column. Runs along rows are joined where they overlap the next row's."""
    new = np.append(True, (np.diff(iy) != 0) | (np.diff(ix) != 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ix)) - 1
    wide = int(ix.max() - ix.min()) + 2
    at = lambda y, x: y * wide + (x - ix.min())
    y = iy[first]
    lo = np.searchsorted(at(y, ix[last]), at(y + 1, ix[first]), "left")
    hi = np.searchsorted(at(y, ix[first]), at(y + 1, ix[last]), "right")
    many = np.maximum(hi - lo, 0)
    p = np.repeat(np.arange(len(first)), many)
    q = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    parent = np.arange(len(first))
    while len(p):  # hook roots under smaller roots until every pair is inside a tree
        while ((up := parent[parent]) != parent).any():
            parent = up
        p, q = parent[p], parent[q]
        apart = p != q
        p, q = p[apart], q[apart]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
    while ((up := parent[parent]) != parent).any():
        parent = up
    return first[parent][np.cumsum(new) - 1]


def cell_components(cells: DataFrame, keys: list[str]) -> DataFrame:
    """4-connected components of a sparse raster: keys, ix, iy, label (row and column of the first
    cell). Tiles of a bounded size are labelled each in a task; the graph has only edges between
    tile components that touch across a border."""
    base = cells.select(*keys, F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy")).distinct()
    schema = StructType([*base.schema.fields, StructField("ly", LongType()), StructField("lx", LongType())])
    names = [f.name for f in schema]

    def label(rows):
        rows = rows.sort_values(["iy", "ix"], ignore_index=True)
        iy, ix = rows["iy"].to_numpy(), rows["ix"].to_numpy()
        first = _labelled(iy, ix)
        return rows.assign(ly=iy[first], lx=ix[first])[names]

    tiled = base.groupBy(*keys, F.floor(F.col("ix") / TILE), F.floor(F.col("iy") / TILE)).applyInPandas(label, schema)
    own = checkpointed(tiled.select(*keys, "ix", "iy", F.struct(F.col("ly").alias("iy"), F.col("lx").alias("i0")).alias("node")))
    edge = lambda c: F.pmod(F.col(c), F.lit(TILE))
    parts = []
    for c, other in (("ix", "iy"), ("iy", "ix")):
        here = own.filter(edge(c) == TILE - 1).select(*keys, (F.col(c) + 1).alias(c), other, F.col("node").alias("a"))
        there = own.filter(edge(c) == 0).select(*keys, c, other, F.col("node").alias("b"))
        parts.append(here.join(there, [*keys, c, other]).select(*keys, "a", "b"))
    edges = checkpointed(parts[0].unionByName(parts[1]).distinct())
    if not edges.head(1):
        return own.withColumnRenamed("node", "label")
    labels = components(edges, keys)
    return own.join(labels, [*keys, "node"], "left").select(*keys, "ix", "iy", F.coalesce("label", "node").alias("label"))


def bfs_levels(edges: DataFrame, start: DataFrame, keys: list[str]) -> DataFrame:
    """Steps from the start nodes: keys, node, level. A round is one frontier join."""
    seen = checkpointed(start.select(*keys, "node").distinct().withColumn("level", F.lit(0)))
    level = 0
    while True:
        front = seen.filter(F.col("level") == level).select(*keys, F.col("node").alias("a"))
        new = front.join(edges.select(*keys, "a", "b"), [*keys, "a"]).select(*keys, F.col("b").alias("node")).distinct().join(seen.select(*keys, "node"), [*keys, "node"], "left_anti")
        new = checkpointed(new.withColumn("level", F.lit(level + 1)))
        if not new.head(1):
            break
        seen = checkpointed(seen.unionByName(new))
        level += 1
    return seen


def _flooded(free: np.ndarray, at: np.ndarray, value: np.ndarray, step: int) -> np.ndarray:
    """Smallest value that reaches each free cell of a padded tile, ``step`` more a move, from given cells."""
    wide = free.shape[1]
    best = np.where(free, np.iinfo(np.int64).max, np.int64(-1)).ravel()
    np.minimum.at(best, at, value)
    front = np.unique(at)
    while len(front):
        reached = []
        for move in (1, -1, wide, -wide):
            to, came = front + move, best[front] + step
            closer = came < best[to]
            np.minimum.at(best, to[closer], came[closer])
            reached.append(to[closer])
        front = np.unique(np.concatenate(reached))
    return best


def flood(cells: DataFrame, keys: list[str], seeds: DataFrame, tile: int = TILE) -> DataFrame:
    """Steps of each cell from the nearest seed by 4-neighbour moves, and whose it is: keys, ix, iy,
    steps, owner; of equally near seeds the smaller owner. ``seeds(keys, ix, iy, owner long)`` lie in
    cells; cells that no seed reaches have no row.

    A tile is flooded in a task, from the seeds in it and from what is known at its border; what gets
    better there goes to the tiles beside it, and only tiles that got better news flood again. Rounds
    grow with the tiles that a path crosses, not with its steps, and between rounds only borders are
    written."""
    place = lambda c: F.floor(F.col(c) / tile).cast("long")
    wide = tile + 2
    local = (F.pmod(F.col("iy"), F.lit(tile)) + 1) * wide + F.pmod(F.col("ix"), F.lit(tile)) + 1
    by = [*keys, "tx", "ty"]
    at = lambda df: df.withColumns({"ix": F.col("ix").cast("long"), "iy": F.col("iy").cast("long")}).withColumns({"tx": place("ix"), "ty": place("iy"), "c": local.cast("int")})
    tiles = checkpointed(at(cells.select(*keys, "ix", "iy")).groupBy(*by).agg(F.collect_set("c").alias("cells")))
    entry = F.struct("c", F.lit(0).cast("long").alias("d"), F.col("owner").cast("long").alias("o"))
    first = checkpointed(at(seeds.select(*keys, "ix", "iy", "owner")).groupBy(*by, "c").agg(F.min("owner").alias("owner")).groupBy(*by).agg(F.collect_list(entry).alias("news")))
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.select(*by).schema)
    entries = "array<struct<c:int,d:bigint,o:bigint>>"

    def run(row, start):
        """(border known before, values of the flooded tile, owners) of a tile, None without better news."""
        held = {e["c"]: (e["d"], e["o"]) for e in (row.known if row.known is not None else [])}
        free = np.zeros(wide * wide, bool)
        free[np.asarray(row.cells)] = True
        news = [(e["c"], e["d"], e["o"]) for e in row.news if free[e["c"]] and (e["d"], e["o"]) < held.get(e["c"], (np.inf, 0))]
        if not news and not start:
            return None
        every = news + [(c, d, o) for c, (d, o) in held.items()] + ([(e["c"], e["d"], e["o"]) for e in row.seeds if free[e["c"]]] if row.seeds is not None else [])
        if not every:
            return held, np.full(wide * wide, np.iinfo(np.int64).max), np.zeros(1, np.int64)
        owners = np.unique([o for _, _, o in every])
        value = np.array([d * len(owners) + np.searchsorted(owners, o) for _, d, o in every], np.int64)
        return held, _flooded(free.reshape(wide, wide), np.array([c for c, _, _ in every]), value, len(owners)), owners

    inner = np.arange(wide * wide).reshape(wide, wide)
    sides = [(inner[1:-1, 1], -1, 0, tile), (inner[1:-1, -2], 1, 0, -tile), (inner[1, 1:-1], 0, -1, tile * wide), (inner[-2, 1:-1], 0, 1, -tile * wide)]
    rim = np.unique(np.concatenate([s[0] for s in sides]))

    def spread(batches):
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                if (done := run(row, False)) is None:
                    continue
                held, best, owners = done
                n, top = len(owners), np.iinfo(np.int64).max
                value = lambda c: (int(best[c] // n), int(owners[best[c] % n]))  # noqa: B023, E731
                known = {int(c): value(c) for c in rim if 0 <= best[c] < top}
                better = {c for c, v in known.items() if v < held.get(c, (np.inf, 0))}
                sent = [{"dx": dx, "dy": dy, "c": int(c) + shift + (dx if dx else dy * wide), "d": known[c][0] + 1, "o": known[c][1]} for side, dx, dy, shift in sides for c in side.tolist() if c in better]
                out.append((*[getattr(row, k) for k in by], [{"c": c, "d": d, "o": o} for c, (d, o) in known.items()], sent))
            yield pd.DataFrame(out, columns=[*by, "known", "sent"])

    state = tiles.select(*by).limit(0).withColumn("known", F.lit(None).cast(entries))
    news = first
    while True:
        asked = tiles.join(news, by).join(state, by, "left").join(first.withColumnRenamed("news", "seeds"), by, "left").select(*by, "cells", "known", "news", "seeds")
        done = checkpointed(asked.mapInPandas(spread, f"{named}, known {entries}, sent array<struct<dx:int,dy:int,c:int,d:bigint,o:bigint>>"))
        state = checkpointed(state.join(done, by, "left_anti").unionByName(done.select(*by, "known")))
        sent = done.select(*by, F.explode("sent").alias("s"))
        moved = sent.select(*keys, (F.col("tx") + F.col("s.dx")).alias("tx"), (F.col("ty") + F.col("s.dy")).alias("ty"), F.struct("s.c", "s.d", "s.o").alias("e"))
        news = checkpointed(moved.groupBy(*by).agg(F.collect_list("e").alias("news")))
        if not news.head(1):
            break

    def settle(batches):
        for b in batches:
            for row in b.itertuples(index=False):
                _, best, owners = run(row, True)
                c = np.flatnonzero((best >= 0) & (best < np.iinfo(np.int64).max))
                fixed = {k: getattr(row, k) for k in keys}
                yield pd.DataFrame({**fixed, "ix": row.tx * tile + c % wide - 1, "iy": row.ty * tile + c // wide - 1, "steps": best[c] // len(owners), "owner": owners[best[c] % len(owners)]})

    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.select(*keys).schema] + ["ix long, iy long, steps long, owner long"])
    whole = tiles.join(state, by, "left").join(first.withColumnRenamed("news", "seeds"), by, "left").filter("known is not null or seeds is not null")
    none = F.array().cast(entries).alias("news")
    return whole.select(*by, "cells", "known", none, "seeds").mapInPandas(settle, out)


def grid_path(cells: DataFrame, keys: list[str], a: tuple[int, int], b: tuple[int, int]) -> DataFrame:
    """Length of the shortest 4-neighbour path between two cells: keys, steps (no row if none)."""
    at = lambda p: (F.col("ix") == p[0]) & (F.col("iy") == p[1])
    reached = flood(cells, keys, cells.filter(at(a)).select(*keys, "ix", "iy", F.lit(0).alias("owner")))
    return reached.filter(at(b)).select(*keys, "steps")
