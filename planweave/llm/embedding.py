"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to length one and rotated to principal axes, largest variance first
(the rotation is fitted on a bounded sample; it is orthogonal, so it changes speed and
never results). Tiles are the leaves of a tree of median cuts along the leading axes,
written once each to the shared folder. Inside a pair of tiles the products of the
leading dimensions are accumulated first; with the norms of what is left, Cauchy-Schwarz
bounds the cosine, and pairs that cannot reach the threshold stop there. Survivors take
more dimensions and finally the exact cosine of the original vectors in double precision.
Each tile has a box around its leading coordinates and the norms of its rest: a pair of
tiles whose boxes are too far apart is never formed, and of one whose boxes are so close
that every vector must link, links are counted without any product.

What travels is one row a tile and a list of near tiles; tasks read the packed tiles from
the shared folder, so no vector is copied once a pair. A pair of tiles returns one row a
linked vector (how many it links to, and one tree edge), never the links themselves, so a
dense cluster costs memory linear in its size. Equal vectors are compared once and counted
by their copies.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import file_system, make_dir, materialize, scratch, spread, trimmed

TILE = 4096
SAMPLE = 4096
LEAD = 16  # axes of the boxes
STAGES = (16, 32)  # leading dimensions after which bounds are taken
TOGETHER = 4  # near tiles a work item
SLACK = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large and very small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(sample: np.ndarray) -> np.ndarray:
    """Principal axes (columns), largest variance first."""
    d = sample.shape[1]
    cov = np.cov(sample, rowvar=False).reshape(d, d) if len(sample) > 1 else np.eye(d)
    return np.linalg.eigh(cov)[1][:, ::-1].copy()


def cuts(points: np.ndarray, leaves: int) -> list:
    """A tree of median cuts as ``[axis, value, left, right]``; an empty list is a leaf."""
    if leaves < 2 or len(points) < 16:
        return []
    spread_of = np.ptp(points, axis=0)
    axis = int(spread_of.argmax())
    value = float(np.median(points[:, axis]))
    low = points[:, axis] < value
    if not low.any() or low.all():
        return []
    return [axis, value, cuts(points[low], leaves // 2), cuts(points[~low], leaves - leaves // 2)]


def leaf_of(points: np.ndarray, tree: list) -> np.ndarray:
    """Number of the leaf of each point (1 at the root, children 2k and 2k + 1)."""
    out = np.ones(len(points), np.int64)
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if node and len(at):
            up = points[at, node[0]] >= node[1]
            out[at] = 2 * out[at] + up
            todo += [(node[2], at[~up]), (node[3], at[up])]
    return out


def box(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest leading coordinates, and norm of the rest, of a tile."""
    rest = np.sqrt((turned[:, LEAD:] ** 2).sum(axis=1))
    full = np.column_stack([turned[:, :LEAD], rest])
    return full.min(axis=0), full.max(axis=0)


def distances(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the squared distance between vectors of one box and of each of many."""
    gap = np.maximum(0, np.maximum(lows - high, low - highs))
    span = np.maximum(highs - low, high - lows)
    span[:, -1] = highs[:, -1] + high[-1]  # what is left may point apart
    return (gap * gap).sum(axis=1), (span * span).sum(axis=1)


def candidate_pairs(a: np.ndarray, b: np.ndarray, threshold: float, rows: int = 512):
    """Blocks of index pairs whose cosine may reach the threshold, by suffix-norm bounds."""
    d = a.shape[1]
    cuts = [k for k in STAGES if k < d] or [d]
    rest = [(np.sqrt((a[:, k:] ** 2).sum(1)), np.sqrt((b[:, k:] ** 2).sum(1))) for k in cuts]
    for s in range(0, len(a), rows):
        part = a[s : s + rows]
        first = part[:, : cuts[0]] @ b[:, : cuts[0]].T
        first += np.outer(rest[0][0][s : s + rows], rest[0][1])
        i, j = np.nonzero(first >= threshold - SLACK)
        del first
        for at in range(0, len(i), 200_000):  # bounded, however many survive
            p, q = i[at : at + 200_000] + s, j[at : at + 200_000]
            for k in range(1, len(cuts)):
                c = cuts[k]
                keep = np.einsum("ij,ij->i", a[p, :c], b[q, :c]) + rest[k][0][p] * rest[k][1][q] >= threshold - SLACK
                p, q = p[keep], q[keep]
            if len(p):
                yield p, q


def compare(xa: np.ndarray, xb: np.ndarray | None, rotation: np.ndarray, threshold: float, copies: np.ndarray):
    """(links of each vector weighted by copies, parent of each in a forest of links).

    ``xb`` None compares a tile with itself. Indices run over ``xa`` then ``xb``."""
    unit = _unit(xa if xb is None else np.concatenate([xa, xb]))
    turned = unit @ rotation
    n = len(xa)
    base = 0 if xb is None else n
    links, parent = np.zeros(len(unit), np.int64), np.arange(len(unit))
    for p, q in candidate_pairs(turned[:n], turned[base:], threshold):
        q = q + base
        if xb is None:
            p, q = p[p < q], q[p < q]
        real = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
        p, q = p[real], q[real]
        np.add.at(links, p, copies[q])
        np.add.at(links, q, copies[p])
        while len(p):  # hook roots under smaller roots until every link is inside a tree
            p, q = parent[p], parent[q]
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent[:] = up
            p, q = parent[p], parent[q]
            open_ = p != q
            p, q = p[open_], q[open_]
            np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
    while True:
        up = parent[parent]
        if (up == parent).all():
            return links, parent
        parent = up


def compare_all(sizes: tuple[int, int], copies: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """``compare`` of two tiles (or of one, ``same``) of which every pair links."""
    n = sizes[0]
    a, b = copies[:n].sum(), copies[n:].sum()
    links = a - copies if same else np.concatenate([np.full(n, b), np.full(sizes[1], a)])
    return links, np.zeros(len(copies), np.int64)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> one row per vector: vec_id, n_links, component_id,
    kept. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; so do vectors of different lengths. Any finite magnitude is valid.
    Repeated rows are vectors of their own (equal vectors link with each other); null ids
    keep their row and never name a component that has another id. An empty table gives no
    row; other columns are ignored."""
    # Floats stay floats where they are stored and moved; every product is in double precision.
    single = dict(vectors.dtypes)["embedding"] in ("array<float>", "array<tinyint>", "array<smallint>")
    number = F.col("embedding").cast("array<float>" if single else "array<double>")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), number.alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    # Equal vectors have one 128-bit name.
    name = F.when(F.coalesce(fine, F.lit(False)), F.struct(F.xxhash64("v").alias("h"), F.xxhash64(F.lit(7), "v").alias("g")))
    marked = base.withColumn("name", name)
    distinct = marked.filter("name is not null").groupBy("name").agg(F.first("v").alias("v"), F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id())
    distinct = materialize(distinct, "distinct")

    out = None
    for (width,) in distinct.select(F.size("v")).distinct().collect():  # vector lengths: a few
        mine = distinct.filter(F.size("v") == width)
        part = _links(mine, width, threshold, tile, "<f4" if single else "<f8")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    out = materialize(out, "links")
    labels = connected_components(out.filter("node != parent").select(F.col("node").alias("a"), F.col("parent").alias("b")))
    counts = out.groupBy("node").agg(F.sum("links").alias("links"))
    named = distinct.select("node", "name", "first", "copies").join(labels, "node", "left").join(counts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    known = named.join(smallest, "label").select(F.col("name").alias("of"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    joined = marked.select("vec_id", "name").join(known, F.col("name") == F.col("of"), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(distinct: DataFrame, width: int, threshold: float, tile: int, kind: str) -> DataFrame:
    """``(node, links, parent)`` from every pair of near tiles."""
    spark = distinct.sparkSession
    sample = _unit(np.array([r.v for r in distinct.orderBy(F.xxhash64("node", F.lit(3))).limit(SAMPLE).select("v").collect()], np.float64).reshape(-1, width))
    rotation = axes(sample)
    leading = rotation[:, :LEAD].copy()
    tree = cuts(sample @ leading, min(SAMPLE // 4, -(-distinct.count() // tile)))

    def locate(batches):
        import pandas as pd

        for b in batches:
            x = np.array(b["v"].tolist(), np.float64).reshape(-1, width)
            yield pd.DataFrame({"node": b["node"], "copies": b["copies"], "leaf": leaf_of(_unit(x) @ leading, tree), "raw": [r.tobytes() for r in x.astype(kind)]})

    placed = materialize(distinct.select("node", "copies", "v").mapInPandas(trimmed(locate), "node long, copies long, leaf long, raw binary"), "placed")
    # A leaf is cut by hash into pieces of about `tile` vectors.
    pieces = placed.groupBy("leaf").agg(F.ceil(F.count("*") / tile).alias("pieces"))  # a row a leaf: SAMPLE / 4 at most
    tiled = placed.join(F.broadcast(pieces), "leaf").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")))
    folder = scratch(spark, "tiles")
    make_dir(spark, folder)

    def pack(rows):
        import pandas as pd

        x = np.frombuffer(b"".join(rows["raw"]), kind).reshape(-1, width)
        low, high = box(_unit(x.astype(np.float64)) @ rotation)
        name = f"{uuid.uuid4().hex}.npz"
        held = io.BytesIO()
        np.savez(held, nodes=rows["node"].to_numpy(np.int64), copies=rows["copies"].to_numpy(np.int64), x=x)
        files, base = file_system(folder)
        with files.open_output_stream(f"{base}/{name}", compression=None) as f:
            f.write(held.getvalue())
        return pd.DataFrame({"tile": [name], "low": [low], "high": [high]})

    tiles = materialize(tiled.select("leaf", "piece", "node", "copies", "raw").groupBy("leaf", "piece").applyInPandas(pack, "tile string, low array<double>, high array<double>"), "tiles")
    listed, reach = tiles._scratch, 2 - 2 * threshold

    def near(batches):
        """Near tiles of each tile, itself and those of greater names, and whether all pairs link."""
        import pandas as pd
        import pyarrow.dataset as ds

        files, base = file_system(listed)
        for mine in batches:
            for other in ds.dataset(base, filesystem=files, format="parquet").to_batches(batch_size=8192):  # the table of boxes, a block at a time
                names = np.array(other.column("tile").to_pylist(), object)
                if not len(names):
                    continue
                lows, highs = (np.array(other.column(c).to_pylist()) for c in ("low", "high"))
                for tile_, low, high in zip(mine["tile"], mine["low"], mine["high"]):
                    least, most = distances(np.asarray(low), np.asarray(high), lows, highs)
                    here = np.flatnonzero((names >= tile_) & (least <= reach + SLACK))
                    for at in range(0, len(here), TOGETHER):
                        part = here[at : at + TOGETHER]
                        yield pd.DataFrame({"tile": [tile_], "others": [names[part].tolist()], "sure": [(most[part] < reach - SLACK).tolist()]})

    work = materialize(spread(tiles).mapInPandas(trimmed(near), "tile string, others array<string>, sure array<boolean>"), "near")

    def match(batches):
        import pandas as pd

        files, base = file_system(folder)

        def load(name):
            with files.open_input_file(f"{base}/{name}") as f:
                held = np.load(io.BytesIO(f.read()))
                return held["nodes"], held["copies"], held["x"].astype(np.float64)

        for batch in batches:
            for name, others, sure in zip(batch["tile"], batch["others"], batch["sure"]):
                nodes, copies, x = load(name)
                for other, all_link in zip(others, sure):
                    same = other == name
                    n2, c2, x2 = (nodes[:0], copies[:0], None) if same else load(other)
                    all_nodes, all_copies = np.concatenate([nodes, n2]), np.concatenate([copies, c2])
                    links, parent = compare_all((len(nodes), len(n2)), all_copies, same) if all_link else compare(x, x2, rotation, threshold, all_copies)
                    some = np.flatnonzero(links)
                    yield pd.DataFrame({"node": all_nodes[some], "links": links[some], "parent": all_nodes[parent[some]]})

    return spread(work, 1).mapInPandas(trimmed(match), "node long, links long, parent long")
