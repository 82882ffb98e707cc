"""A cloud that arrives point by point, thinned while it comes: one point a voxel, kept as state.

Every voxel holds its best point so far and waits on a timer until nothing has come for ``quiet``;
then the point is given out and the voxel forgotten, so state is as large as what is being walked
through, not as the cloud. Points out of order are taken as long as the watermark allows, later ones
are refused, and what is given out is what thinning the taken points at once would keep."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.select import by_hash

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Best(StatefulProcessor):
    """The row of smallest ``rank_of_point`` of a group, given out once the group has been quiet."""

    def __init__(self, columns: list[str], schema: StructType, quiet_ms: int):
        self.columns, self.schema, self.quiet_ms = columns, schema, quiet_ms

    def init(self, handle):
        self.handle = handle
        self.best = handle.getValueState("best", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        held = self.best.get() if self.best.exists() else None
        last = held[-1] if held else None
        for part in rows:
            part = part.sort_values(["rank_of_point", self.columns[0]])
            row = part.iloc[0]
            came = int(part["came_ms"].max())
            last = came if last is None else max(last, came)
            found = (*(row[c] for c in self.columns), int(row["rank_of_point"]), 0)
            if held is None or (found[-2], found[0]) < (held[-2], held[0]):
                held = found
        self.best.update((*(_plain(v) for v in held[:-1]), last))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.quiet_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.best.get()
        self.best.clear()
        yield pd.DataFrame([held[:-2]], columns=self.columns)

    def close(self):
        pass


def _plain(value):
    return value.item() if hasattr(value, "item") else value


def thin(points: DataFrame, keys: list[str], size: float, ts: str = "ts", id_: str = "point_id", quiet: str = "10 seconds", lateness: str = "10 seconds", seed: int = 0, axes: tuple = ("x", "y", "z")) -> DataFrame:
    """Stream of one point a voxel: its id, keys and coordinates. The point is that of
    ``select.voxel_thin`` with the same seed. Points without a time or a coordinate are left out."""
    columns = [id_, *keys, *axes]
    for c in (ts, *axes):
        points = points.filter(F.col(c).isNotNull())
    voxel = {f"voxel_{i}": F.floor(F.col(a) / size).cast("long") for i, a in enumerate(axes)}
    rows = points.select(ts, *columns).withWatermark(ts, lateness).withColumns({**voxel, "rank_of_point": by_hash(id_, seed), "came_ms": F.unix_millis(ts)})
    out = StructType([points.schema[c] for c in columns])
    state = StructType([*out.fields, StructField("rank_of_point", LongType()), StructField("last_ms", LongType())])
    wait = int(pd.Timedelta(quiet).total_seconds() * 1000)
    grouped = rows.groupBy(*keys, *voxel)
    return grouped.transformWithStateInPandas(Best(columns, state, wait), outputStructType=out, outputMode="Append", timeMode="EventTime")


def write(stream: DataFrame, path: str, checkpoint: str):
    """Take what is there, append finished voxels to Parquet and end; exactly once by the checkpoint. The
    session's state store setting is as before when this returns."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # read when the query starts
    try:
        return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
