"""Streams in append mode over files that come one after the other, with late and unordered rows."""

import datetime as dt

from planweave.streaming import frames

SCHEMA = "clip string, ts timestamp, frame_idx long, sharpness double"


def at(second):
    return dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=second)


def arriving(spark, folder, batches, run):
    """Rows that ``run(stream, out, checkpoint)`` has written after each batch of files."""
    out, told = f"{folder}/out", []
    for k, rows in enumerate(batches):
        spark.createDataFrame([(c, at(s), i, v) for c, s, i, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run(frames.files(spark, f"{folder}/in", SCHEMA, 1), out, f"{folder}/checkpoint").awaitTermination()
        told.append(sorted(tuple(r) for r in spark.read.parquet(out).collect()))
    return told


FIRST = [("a", s, s, float(s % 7)) for s in range(0, 100, 3)]
SECOND = [("a", 95, 1000, 50.0), ("a", 97, 1001, 50.0), ("a", 15, 1002, 99.0), ("a", 120, 1003, 1.0)]  # 15 is too late by far
THIRD = [("a", 300, 2000, 1.0)]


def test_late_frames_are_taken_until_the_watermark_and_then_refused(spark, tmp_path):
    run = lambda stream, out, checkpoint: frames.write(frames.best_frames(stream, ["clip"], window="10 seconds", lateness="10 seconds").selectExpr("clip", "unix_seconds(start) AS start", "frame_idx", "sharpness"), out, checkpoint)
    first, second, third = arriving(spark, tmp_path, [FIRST, SECOND, THIRD], run)
    kept = [r for r in FIRST + SECOND if r[2] != 1002]
    batch = frames.best_frames(spark.createDataFrame([(c, at(s), i, v) for c, s, i, v in kept], SCHEMA), ["clip"], window="10 seconds", lateness=None)
    want = sorted(tuple(r) for r in batch.selectExpr("clip", "unix_seconds(start) AS start", "frame_idx", "sharpness").collect())
    assert third == want  # each window once, the windows of the last rows are still open
    assert set(first) < set(second) < set(third)
    zero = int(at(0).timestamp())
    assert {r[1] - zero: r[2] for r in third}[90] == 1000 and 1002 not in {r[2] for r in third}
    assert max(r[1] for r in first) < zero + 89 - 10


def test_sessions_close_after_their_gap(spark, tmp_path):
    run = lambda stream, out, checkpoint: frames.write(frames.sessions(stream, ["clip"], gap="20 seconds", lateness="5 seconds").selectExpr("clip", "unix_seconds(start) AS start", "unix_seconds(stop) AS stop", "n"), out, checkpoint)
    batches = [[("a", 0, 0, 0.0), ("a", 10, 1, 0.0), ("b", 0, 2, 0.0)], [("a", 60, 3, 0.0), ("a", 25, 4, 0.0)], [("a", 200, 5, 0.0), ("b", 1, 6, 0.0)]]
    told = arriving(spark, tmp_path, batches, run)
    zero = int(at(0).timestamp())
    plain = [sorted((c, s - zero, e - zero, n) for c, s, e, n in t) for t in told]
    assert plain == [[], [("a", 0, 45, 3), ("b", 0, 20, 1)], [("a", 0, 45, 3), ("a", 60, 80, 1), ("b", 0, 20, 1)]]  # b's late row is refused


def test_a_stream_of_one_file(spark, tmp_path):
    spark.createDataFrame([(c, at(s), i, v) for c, s, i, v in FIRST], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    one = str(next((tmp_path / "in").glob("*.parquet")))
    frames.write(frames.files(spark, one, SCHEMA), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(FIRST)
