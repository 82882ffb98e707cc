"""Normals of points without them: principal axes of neighbours, the nearest ones at any density."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import k_nearest


def estimate(points: DataFrame, keys: list[str], k: int = 16, id_: str = "point_id") -> DataFrame:
    """Unit normal of the k nearest neighbours' covariance: keys, id, nx, ny, nz. Covariances are
    aggregates over the neighbour pairs; the 3x3 decompositions run in Arrow batches. Points
    with fewer than three neighbours get +z."""
    pairs = k_nearest(points.select(*keys, id_, "x", "y", "z"), keys, id_, ["x", "y", "z"], k)
    there = points.select(*keys, F.col(id_).alias("other"), "x", "y", "z")
    axes = ("x", "y", "z")
    cov = pairs.join(there, [*keys, "other"]).groupBy(*keys, "id").agg(F.count("*").alias("n"), *[F.covar_pop(a, b).alias(f"c{a}{b}") for i, a in enumerate(axes) for b in axes[i:]])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cov.select(*keys, "id").schema)

    def solve(batches):
        for b in batches:
            m = np.stack([[b["cxx"], b["cxy"], b["cxz"]], [b["cxy"], b["cyy"], b["cyz"]], [b["cxz"], b["cyz"], b["czz"]]]).transpose(2, 0, 1)
            v = np.linalg.eigh(m)[1][:, :, 0] if len(b) else np.zeros((0, 3))
            v[(b["n"] < 3).to_numpy()] = (0, 0, 1)
            yield pd.concat([b[[*keys, "id"]].reset_index(drop=True), pd.DataFrame(v, columns=["nx", "ny", "nz"])], axis=1)

    found = cov.mapInPandas(solve, f"{fields}, nx double, ny double, nz double").withColumnRenamed("id", id_)
    base = points.select(*keys, id_).join(found, [*keys, id_], "left")
    return base.select(*keys, id_, F.coalesce("nx", F.lit(0.0)).alias("nx"), F.coalesce("ny", F.lit(0.0)).alias("ny"), F.coalesce("nz", F.lit(1.0)).alias("nz"))


def orient(points: DataFrame, tx: str = "cx", ty: str = "cy", tz: str = "cz") -> DataFrame:
    """Normals turned towards a target of each row (its camera)."""
    d = F.col("nx") * (F.col(tx) - F.col("x")) + F.col("ny") * (F.col(ty) - F.col("y")) + F.col("nz") * (F.col(tz) - F.col("z"))
    return points.withColumns({n: F.when(d < 0, -F.col(n)).otherwise(F.col(n)) for n in ("nx", "ny", "nz")})
