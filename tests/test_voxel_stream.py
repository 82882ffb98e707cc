"""A stream with state of its own against thinning at once."""

import datetime as dt

import numpy as np

from planweave.operators import select
from planweave.streaming import frames, voxels

SCHEMA = "scene string, ts timestamp, point_id long, x double, y double, z double"


def at(second):
    return dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=float(second))


def test_voxels_kept_over_batches(spark, tmp_path):
    """A voxel is met in several batches, its points come out of order, one comes too late."""
    r = np.random.default_rng(9)
    walk = [("s", t, i, *(float(v) for v in r.integers(0, 4, 3) * 0.3 + 0.01)) for i, t in enumerate(np.sort(r.uniform(0, 60, 300)))]
    order = np.argsort([w[1] + r.uniform(0, 4) for w in walk])  # up to 4 seconds out of order
    walk = [walk[i] for i in order]
    late = ("s", 1.0, 9000, 0.0, 0.0, 0.0)
    batches = [walk[:100], walk[100:200], [*walk[200:], late, ("s", None, 9001, 0.0, 0.0, 0.0)], [("s", 400.0, 9002, 50.0, 0.0, 0.0)], [("s", 900.0, 9003, 90.0, 0.0, 0.0)]]
    before = {x.key: x.value for x in spark.sql("SET").collect()}
    for rows in batches:
        spark.createDataFrame([(s, None if t is None else at(t), i, x, y, z) for s, t, i, x, y, z in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = frames.files(spark, f"{tmp_path}/in", SCHEMA, 1)
        voxels.write(voxels.thin(stream, ["scene"], 0.3, quiet="90 seconds", lateness="10 seconds", seed=3), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert {x.key: x.value for x in spark.sql("SET").collect()} == before
    got = sorted(tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    taken = spark.createDataFrame([(s, at(t), i, x, y, z) for s, t, i, x, y, z in [*walk, batches[3][0]]], SCHEMA)
    want = sorted((x.point_id, x.scene, x.x, x.y, x.z) for x in select.voxel_thin(taken, ["scene"], 0.3, seed=3).collect())
    assert got == want  # the last point's voxel is still open
