"""Text lists of timestamps, as RGB-D recorders write them, and their association."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import pose, quaternion_rotation, vector
from ..operators.join import nearest
from ..operators.select import every_nth

DEPTH_SCALE = 5000.0
# fx, fy, cx, cy and lens terms k1, k2, p1, p2, k3 of the recorders (fixed values).
INTRINSICS = {
    "freiburg1": (517.3, 516.5, 318.6, 255.3, (0.2624, -0.9531, -0.0054, 0.0026, 1.1633)),
    "freiburg2": (520.9, 521.0, 325.1, 249.7, (0.2312, -0.7849, -0.0033, -0.0001, 0.9172)),
    "freiburg3": (535.4, 539.2, 320.1, 247.6, (0.0, 0.0, 0.0, 0.0, 0.0)),
}


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """``t double, rest array<string>, folder string``; comments and blank lines dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    parts = F.split("line", r"\s+")
    return lines.filter((F.col("line") != "") & ~F.startswith("line", F.lit("#"))).select(F.get(parts, F.lit(0)).cast("double").alias("t"), F.slice(parts, 2, 1 << 20).alias("rest"), F.regexp_extract("file", r"^(.*)/[^/]*$", 1).alias("folder"))


def poses(rows: DataFrame) -> DataFrame:
    """Rows ``tx ty tz qx qy qz qw`` as camera-to-world poses."""
    v = [F.get("rest", F.lit(i)).cast("double") for i in range(7)]
    return rows.select("folder", "t", pose(quaternion_rotation(*v[3:]), vector(*v[:3])).alias("pose"))


def intrinsics(folder: Column) -> Column:
    """fx, fy, cx, cy of the recorder that the folder's name gives, the first one by default."""
    name = F.lower(folder)
    out = default = None
    for k, (fx, fy, cx, cy, dist) in INTRINSICS.items():
        s = F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("fx", "fy", "cx", "cy"), (fx, fy, cx, cy))], F.array(*[F.lit(float(x)) for x in dist]).alias("dist"))
        out = F.when(F.contains(name, F.lit(k)), s) if out is None else out.when(F.contains(name, F.lit(k)), s)
        default = s if default is None else default
    return out.otherwise(default)


def sequence(spark: SparkSession, folder: str, stride: int = 1, max_frames: int | None = None, max_time_diff: float = 0.02) -> DataFrame:
    """Depth pictures of a recording with the nearest colour picture and pose: folder, t, depth,
    rgb, pose, intrinsics. Frames without a pose in reach are dropped; every ``stride``-th depth
    picture is considered, in order, until there are ``max_frames``."""
    depth = every_nth(read_list(spark, f"{folder}/depth.txt").select("folder", "t", F.get("rest", F.lit(0)).alias("depth")), ["folder"], "t", stride)
    rgb = read_list(spark, f"{folder}/rgb.txt").select("folder", F.col("t").alias("rgb_t"), F.get("rest", F.lit(0)).alias("rgb"))
    track = poses(read_list(spark, f"{folder}/groundtruth.txt")).select("folder", F.col("t").alias("pose_t"), "pose")
    out = nearest(nearest(depth, rgb, ["folder"], "t", "rgb_t", max_time_diff, ["rgb"]), track, ["folder"], "t", "pose_t", max_time_diff, ["pose"]).filter("pose is not null and rgb is not null")
    if max_frames is not None:
        from pyspark.sql import Window

        w = Window.partitionBy("folder").orderBy("t")
        out = out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_frames).drop("_r")
    return out.withColumn("intrinsics", intrinsics(F.col("folder")))
