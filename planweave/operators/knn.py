"""The k nearest neighbours at any density, over a partition of space with measured leaves.

Points are split by the quantiles of the widest side of what holds them, sixteen ways a round, until
no part has more than ``LEAF`` positions; a dense corner is split as deep as it needs and an empty
quarter not at all. The quantiles are sketches that combine before the shuffle. Each leaf then answers
for its own points with one matrix of distances. A point whose k-th neighbour is no farther than the
border of its leaf is done; the others go down the tree to the leaves that their reach touches, are
answered there too, and keep the nearest of all. Both looks run a leaf a group, so memory is bounded
by the leaf; leaves with many visitors are copied, so that no group is larger for them.

Points at one position are one position there, which stands for its smallest ids: a million points on
a spot cost what one does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

LEAF = 1000  # positions
FAN = 16
SMALL = 50_000  # split nodes that are broadcast at most; more of them are joined by a shuffle
VISITORS = 20_000  # of a leaf in one group


def _nearest(of: np.ndarray, of_id, to: np.ndarray, to_id, k: int):
    """Row, column and distance of the k nearest ``to`` of each ``of``, itself left out; of equally
    near ones those with the smaller id."""
    rank = np.empty(len(to_id), np.int64)
    rank[np.argsort(to_id, kind="stable")] = np.arange(len(to_id))
    step = max(1, 2_000_000 // max(1, len(to)))
    for at in range(0, len(of), step):
        part = of[at : at + step]
        d2 = sum((part[:, i, None] - to[None, :, i]) ** 2 for i in range(of.shape[1]))
        d2[of_id[at : at + step, None] == to_id[None, :]] = np.inf
        least = np.partition(d2, k - 1, axis=1)[:, k - 1] if k <= d2.shape[1] else np.full(len(part), np.inf)
        row, col = np.nonzero((d2 <= least[:, None]) & np.isfinite(d2))
        d = np.sqrt(d2[row, col])
        order = np.lexsort((rank[col], d, row))
        row, col, d = row[order], col[order], d[order]
        first = np.searchsorted(row, np.arange(len(part)))
        kept = np.arange(len(row)) - first[row] < k
        yield at + row[kept], col[kept], d[kept]


def _split(points: DataFrame, keys: list[str], axes: list[str], most: int) -> tuple[DataFrame, list[tuple[DataFrame, bool]]]:
    """``points`` with their leaf (``node``) and its borders, and the splits of each round
    ``(keys, node, axis, cuts)`` with whether they are few enough to broadcast."""
    n = range(len(axes))
    levels: list[tuple[DataFrame, bool]] = []
    now = checkpointed(points.withColumns({"node": F.lit(0).cast("long"), **{f"_lo{i}": F.lit(float("-inf")) for i in n}, **{f"_hi{i}": F.lit(float("inf")) for i in n}}))
    shares = [j / FAN for j in range(1, FAN)]
    while True:
        sides = [F.struct((F.max(a) - F.min(a)).alias("wide"), F.lit(i).alias("axis"), ((F.max(a) + F.min(a)) / 2).alias("mid"), F.percentile_approx(a, shares, 400).alias("cuts"), F.max(a).alias("top")) for i, a in enumerate(axes)]
        seen = now.groupBy(*keys, "node").agg(F.count("*").alias("n"), F.greatest(*sides).alias("_s") if len(axes) > 1 else sides[0].alias("_s"))
        # a cut below the largest value leaves rows on both sides; the middle is always one
        cuts = F.array_sort(F.array_distinct(F.filter(F.array_append("_s.cuts", F.col("_s.mid")), lambda c: c < F.col("_s.top"))))
        split = checkpointed(seen.filter((F.col("n") > most) & (F.col("_s.wide") > 0)).select(*keys, "node", F.col("_s.axis").alias("axis"), cuts.alias("cuts")))
        many = split.count()
        if not many:
            return now, levels
        levels.append((split, many <= SMALL))
        at = now.join(F.broadcast(split) if many <= SMALL else split, [*keys, "node"], "left")
        value = F.get(F.array(*axes), F.col("axis"))
        child = F.size(F.filter("cuts", lambda c: c < value))
        below, above = F.get("cuts", F.col("_child") - 1), F.get("cuts", F.col("_child"))
        moved = at.withColumn("_child", F.when(F.col("cuts").isNotNull(), child))
        borders = {f"_lo{i}": F.when(F.col("axis") == i, F.greatest(f"_lo{i}", below)).otherwise(F.col(f"_lo{i}")) for i in n} | {f"_hi{i}": F.when(F.col("axis") == i, F.least(f"_hi{i}", above)).otherwise(F.col(f"_hi{i}")) for i in n}
        moved = moved.withColumns({**borders, "node": F.when(F.col("_child").isNotNull(), F.xxhash64("node", "_child")).otherwise(F.col("node"))})
        now = checkpointed(moved.drop("axis", "cuts", "_child"))


def k_nearest(points: DataFrame, keys: list[str], id_: str, axes: list[str], k: int, leaf: int = LEAF) -> DataFrame:
    """The k nearest other points of each point within its keys: keys, id, other, distance, rank (from
    1; of equally near ones the smaller id comes first). Fewer where there are not k others. Points
    with a null or non-finite coordinate have no neighbours and are nobody's. Ids are unique in a key."""
    finite = [F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) & (F.abs(F.col(a).cast("double")) < float("inf")) for a in axes]
    own = points.select(*keys, F.col(id_).alias("id"), *[(F.col(a).cast("double") + 0.0).alias(a) for a in axes])
    for ok in finite:
        own = own.filter(ok)
    own = checkpointed(own)
    spot = Window.partitionBy(*keys, *axes).orderBy("id")
    first_ids = own.withColumn("_r", F.row_number().over(spot)).filter(F.col("_r") <= k + 1)
    spots = checkpointed(first_ids.groupBy(*keys, *axes).agg(F.array_sort(F.collect_list("id")).alias("ids")))
    places = spots.select(*keys, F.element_at("ids", 1).alias("id"), *axes)
    now, levels = _split(places, keys, axes, leaf)
    of_type = {f.name: f.dataType.simpleString() for f in places.schema}
    borders = [f"_{s}{i}" for s in ("lo", "hi") for i in range(len(axes))]
    named = ", ".join(f"`{c}` {of_type[c]}" for c in [*keys, "id", *axes])
    found_as = f"{named}, node long, others array<{of_type['id']}>, distances array<double>"

    def answer(of: pd.DataFrame, to: pd.DataFrame) -> tuple[list, list, np.ndarray]:
        xy, ids, to_ids = of[axes].to_numpy(float), of["id"].to_numpy(), to["id"].to_numpy()
        others, distances = [to_ids[:0]] * len(of), [np.zeros(0)] * len(of)
        far = np.full(len(of), np.inf)
        for row, col, d in _nearest(xy, ids, to[axes].to_numpy(float), to_ids, k):
            rows, start, count = np.unique(row, return_index=True, return_counts=True)
            for r, s, n in zip(rows.tolist(), start.tolist(), count.tolist()):
                others[r], distances[r] = to_ids[col[s : s + n]], d[s : s + n]
                if n == k:
                    far[r] = d[s + n - 1]
        return others, distances, far

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        others, distances, far = answer(group, group)
        xy = group[axes].to_numpy(float)
        room = np.minimum(xy - group[[f"_lo{i}" for i in range(len(axes))]].to_numpy(float), group[[f"_hi{i}" for i in range(len(axes))]].to_numpy(float) - xy).min(axis=1)
        out = group[[*keys, "id", *axes, "node"]].copy()
        out["others"], out["distances"], out["reach"] = others, distances, np.where(far < room, 0.0, far * (1 + 1e-9))
        return out

    first = now.select(*keys, "id", *axes, "node", *borders).groupBy(*keys, "node").applyInPandas(inside, f"{found_as}, reach double")
    if levels:
        first = checkpointed(first)
        visits = first.filter("reach > 0").select(*keys, "id", *axes, "reach", F.col("node").alias("home"), F.lit(0).cast("long").alias("node"))
        for split, few in levels:
            at = visits.join(F.broadcast(split) if few else split, [*keys, "node"], "left")
            value = F.get(F.array(*axes), F.col("axis"))
            children = F.sequence(F.size(F.filter("cuts", lambda c: c < value - F.col("reach"))), F.size(F.filter("cuts", lambda c: c < value + F.col("reach"))))
            at = at.withColumn("_child", F.explode(F.when(F.col("cuts").isNotNull(), children).otherwise(F.array(F.lit(-1)))))
            visits = at.withColumn("node", F.when(F.col("_child") >= 0, F.xxhash64("node", "_child")).otherwise(F.col("node"))).drop("axis", "cuts", "_child")
        visits = checkpointed(visits.filter("node <> home").drop("home", "reach"))
        guests = visits.groupBy(*keys, "node").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("_copies"))
        hosts = now.select(*keys, "id", *axes, "node").join(guests, [*keys, "node"]).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
        guests_of = visits.join(guests, [*keys, "node"]).withColumn("_copy", F.pmod(F.xxhash64("id"), F.col("_copies")).cast("int")).drop("_copies")

        def elsewhere(of: pd.DataFrame, to: pd.DataFrame) -> pd.DataFrame:
            out = of[[*keys, "id", *axes, "node"]].copy()
            out["others"], out["distances"], _ = answer(of, to)
            return out

        by = [*keys, "node", "_copy"]
        more = guests_of.groupBy(*by).cogroup(hosts.groupBy(*by)).applyInPandas(elsewhere, found_as)
        first = first.drop("reach").unionByName(more)
    near = first.select(*keys, *axes, F.explode(F.arrays_zip("others", "distances")).alias("p")).select(*keys, *axes, F.col("p.others").alias("_spot"), F.col("p.distances").alias("distance"))
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, *axes).orderBy("distance", "_spot"))).filter(F.col("_r") <= k)
    ids_of = spots.select(*keys, F.element_at("ids", 1).alias("_spot"), "ids")
    beside = best.join(ids_of, [*keys, "_spot"]).select(*keys, *axes, "ids", "distance")
    around = beside.unionByName(spots.select(*keys, *axes, "ids", F.lit(0.0).alias("distance")))
    offered = around.select(*keys, *axes, "distance", F.explode("ids").alias("other"))
    ranked = offered.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, *axes).orderBy("distance", "other"))).filter(F.col("_r") <= k + 1)
    gathered = ranked.groupBy(*keys, *axes).agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)
    told = own.join(gathered, [*keys, *axes]).select(*keys, "id", F.posexplode(others).alias("_p", "x"))
    return told.select(*keys, "id", F.col("x.other").alias("other"), F.col("x.distance").alias("distance"), (F.col("_p") + 1).alias("rank"))
