"""The jobs on growing, odd and empty copies of their tables, against SQL and reruns."""

import datetime as dt
import json
import logging
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import jobs
from jobs import capture_frames, document_register
from jobs.common import defaults, settings
from test_oracles import rows

ROOT = Path(__file__).resolve().parents[1]
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
DOCUMENTS = "doc_id long, text string, lang string, source string"


def by_sql(sql, **tables):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/**/*.parquet')")
    asked = con.execute(sql)
    names = [c[0] for c in asked.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return rows([tuple(r[i] for i in order) for r in asked.fetchall()])


def by_job(df):
    return rows(df.select(*sorted(df.columns)).collect())


def stamp(day, second, micro=0):
    return dt.datetime(2024, 3, day, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=second, microseconds=micro)


def events(seed, days, n, devices=3):
    """Frames of a few devices; scores repeat, so that there are ties."""
    import random

    r = random.Random(seed)
    kinds = ["view", "error", "click"]
    return [(seed * 10_000 + i, stamp(r.choice(days), r.randrange(86_400), r.randrange(10**6)), r.randrange(devices), r.choice(kinds), float(r.randrange(12) * 10), "{}") for i in range(n)]


def partitions(folder):
    return {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in Path(folder).glob("day=*")}


def test_frames_of_a_growing_input(spark, tmp_path, caplog):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    config = {**defaults("capture_frames"), "files_a_batch": 2}
    spark.createDataFrame(events(1, [1, 2], 400), EVENTS).repartition(5).write.parquet(source)
    with caplog.at_level(logging.INFO, "jobs.capture_frames"):
        capture_frames.run(spark, source, out, config)
    assert "read 400 new rows" in caplog.text and "in 3 batches" in caplog.text
    want = by_sql(capture_frames.sql(config), events=source)
    assert by_job(capture_frames.result(spark, out)) == want and want

    before = partitions(f"{out}/frames")
    caplog.clear()
    with caplog.at_level(logging.INFO, "jobs.capture_frames"):
        capture_frames.run(spark, source, out, config)  # nothing new: nothing read, nothing written
    assert "read 0 new rows" in caplog.text and partitions(f"{out}/frames") == before

    # late rows of day 2, some delivered a second time, a new day; day 1 stays as it was
    late = events(2, [2, 3], 300) + [e for e in events(1, [1, 2], 400) if e[1].day == 2][:40]
    spark.createDataFrame(late, EVENTS).repartition(3).write.mode("append").parquet(source)
    caplog.clear()
    with caplog.at_level(logging.INFO, "jobs.capture_frames"):
        capture_frames.run(spark, source, out, config)
    assert "read 340 new rows" in caplog.text
    after = partitions(f"{out}/frames")
    assert after["day=2024-03-01"] == before["day=2024-03-01"] and after["day=2024-03-02"] != before["day=2024-03-02"] and "day=2024-03-03" in after
    assert by_job(capture_frames.result(spark, out)) == by_sql(capture_frames.sql(config), events=source)

    # all at once and in another order gives the same
    capture_frames.run(spark, source, str(tmp_path / "once"), defaults("capture_frames"))
    assert by_job(capture_frames.result(spark, str(tmp_path / "once"))) == by_job(capture_frames.result(spark, out))


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(events(3, [1, 2], 200), EVENTS).write.parquet(source)
    config = defaults("capture_frames")
    capture_frames.run(spark, source, out, config)
    once = by_job(capture_frames.result(spark, out))
    capture_frames.take(spark.read.parquet(source), 0, out, config)  # as after a crash between output and checkpoint
    assert by_job(capture_frames.result(spark, out)) == once
    assert spark.read.parquet(f"{out}/landed").count() == 200


def test_frames_of_odd_rows(spark, tmp_path):
    """Rows without a time, device or score are refused and kept; rows told twice count once; a single
    file is a table; a device's day without a good frame has a row without one."""
    odd = [(1, None, 1, "view", 50.0, ""), (2, stamp(1, 5), None, "view", 50.0, ""), (3, stamp(1, 6), 1, "view", None, ""), (None, stamp(1, 7), 1, None, 90.0, ""), (5, stamp(1, 8), 2, "view", 1.0, ""), (5, stamp(1, 8), 2, "view", 1.0, ""), (6, stamp(1, 9), 3, "error", 99.0, None)]
    source, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame(odd, EVENTS).withColumnRenamed("props", "DAY").coalesce(1).write.parquet(str(source))
    config = defaults("capture_frames")
    one = str(next(source.glob("*.parquet")))
    for _ in range(2):
        capture_frames.run(spark, one, out, config)
    got = by_job(capture_frames.result(spark, out))
    assert got == by_sql(capture_frames.sql(config), events=source)
    assert spark.read.parquet(f"{out}/landed").filter("day is null").count() == 3 and len(got) == 3


def test_frames_of_nothing(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    capture_frames.run(spark, str(source), out, defaults("capture_frames"))
    spark.createDataFrame([], EVENTS).write.mode("append").parquet(str(source))
    capture_frames.run(spark, str(source), out, defaults("capture_frames"))
    spark.createDataFrame(events(4, [1], 50), EVENTS).write.mode("append").parquet(str(source))
    capture_frames.run(spark, str(source), out, defaults("capture_frames"))
    assert by_job(capture_frames.result(spark, out)) == by_sql(capture_frames.sql(defaults("capture_frames")), events=source)


def documents(n):
    words = ["wall", "door & frame", "é", "\"two\"", "<three>", "line\nbreak", "Ωmega", ""]
    return [(i * 7 % n, None if i % 11 == 0 else " ".join(words[(i + k) % 8] for k in range(i % 13)) * (1 + i % 40), "en", None if i % 5 == 0 else "hot" if i % 3 else f"s{i % 4}") for i in range(n)]


@pytest.mark.parametrize("each", [7, 200_000])
def test_register(spark, tmp_path, each, caplog):
    """Numbers don't depend on the blocks; copies point to the first; nulls and repeats have rows."""
    table = documents(300) + [(None, "without an id", "de", "hot"), (None, "without an id", "de", "hot"), (5, "twice", "en", "hot"), (5, "twice", "en", "hot"), (900, "x" * 200_000, None, "hot")]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(table, DOCUMENTS).repartition(4).write.parquet(source)
    config = {**defaults("document_register"), "rows_a_block": each, "lines_a_sheet": 3}
    with caplog.at_level(logging.INFO, "jobs.document_register"):
        document_register.run(spark, source, out, config)
    assert f"read {len(table)} documents" in caplog.text and f"wrote {len(table)} rows of the register" in caplog.text
    once = by_job(document_register.result(spark, out))
    assert once == by_sql(document_register.sql(config), documents=source)
    document_register.run(spark, source, out, config)
    assert by_job(document_register.result(spark, out)) == once
    index = spark.read.parquet(f"{out}/index").collect()
    per_source = {}
    for r in index:
        per_source.setdefault(r.source, []).append((r.position, r.label))
    assert all(len(v) <= config["listed"] + 1 for v in per_source.values()) and any(x[1].startswith("+") for x in per_source["hot"])


def test_register_of_nothing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], DOCUMENTS).write.parquet(source)
    document_register.run(spark, source, out, defaults("document_register"))
    assert document_register.result(spark, out).count() == 0


def test_settings(spark, tmp_path):
    given = tmp_path / "own.json"
    given.write_text(json.dumps({"frames": 2}))
    assert settings(spark, "capture_frames", str(given)) == {**defaults("capture_frames"), "frames": 2}
    assert settings(spark, "capture_frames", f"file://{given}")["frames"] == 2
    given.write_text(json.dumps({"frame": 2}))
    with pytest.raises(ValueError, match="frame"):
        settings(spark, "capture_frames", str(given))


def test_registered_queries_leave_the_session_as_it_was(spark, tmp_path):
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    assert set(jobs.oracle_sql()) == set(jobs.queries())
    spark.createDataFrame(events(5, [1], 60), EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    first, second = (jobs.job1_capture_frames(spark, str(tmp_path)) for _ in range(2))
    assert by_job(first) == by_job(second) and set(first.inputFiles()).isdisjoint(second.inputFiles())
    assert {r.key: r.value for r in spark.sql("SET").collect()} == before and not spark.catalog.listTables()


def test_command_line(tmp_path):
    (tmp_path / "in").mkdir()
    duckdb.sql(f"COPY (SELECT 1 AS doc_id, 'some text' AS text, 'en' AS lang, 'a' AS source) TO '{tmp_path}/in/a.parquet'")
    ran = subprocess.run([sys.executable, "-m", "jobs.document_register", f"{tmp_path}/in", f"{tmp_path}/out", "--master", "local[1]"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert "read 1 documents" in ran.stderr and list((tmp_path / "out/register").glob("source=a/*.parquet"))
