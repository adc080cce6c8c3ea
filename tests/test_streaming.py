"""Streams over files: what the batch forms give, batch by batch."""

import datetime as dt
import os

import pytest

from plotline.operators import history
from plotline.streaming import jobs

T = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def one_task(spark):
    """One state store and one worker a batch: the files are tiny."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


ROWS = [(1, T, 100), (1, T + dt.timedelta(hours=1), 100), (1, T + dt.timedelta(hours=2), 90), (2, T, 50)]


def stream(spark, path, rows, schema="id long, at timestamp, price int", files=2):
    for i in range(files):
        spark.createDataFrame(rows[i::files] if files > 1 else rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(path))


def results(df, name, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_price_changes(spark, tmp_path):
    got = results(jobs.price_changes(stream(spark, tmp_path / "in", ROWS), "id", "at", ["price"]), "changes", spark)
    assert sorted((r.id, r.price) for r in got) == [(1, 90), (1, 100), (2, 50)]


def test_spending_windows(spark, tmp_path):
    rows = [*ROWS, (9, T + dt.timedelta(days=9), 0)]
    got = results(jobs.spending(stream(spark, tmp_path / "in", rows, files=1), "at", "price", "1 day", "1 day"), "spent", spark)
    assert [r.cost for r in got if r.start == T] in ([340], [])


def batches(spark, path, *parts, schema="id long, at timestamp, price int"):
    """A folder with a file for each part, older parts first."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(path))
        for f in path.glob("part-*"):
            if f.stat().st_mtime > 1_000_000:
                os.utime(f, (k + 1, k + 1))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(df, handle, check):
    q = df.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return q


H = dt.timedelta(hours=1)
KINDS = "id long, at timestamp, status string, note string"


def test_states_over_batches_a_restart_and_a_repeated_batch(spark, tmp_path):
    first = [(1, T, "seen", None), (1, T + H, None, "nice"), (2, T, "seen", "x")]
    second = [(1, T + 3 * H, "dismissed", None), (3, T, "seen", None)]
    late = [(1, T - H, "new", "late note"), (2, T + H, None, "y"), (3, T, "seen", None)]
    source, log = tmp_path / "in", str(tmp_path / "log")
    fold = jobs.last_states(batches(spark, source, first, second, schema=KINDS), "id", ["at"], ["status", "note"])
    run(fold, jobs.state_log(log), tmp_path / "check")
    # a restart with one more file, which holds a late row and one that changes nothing
    spark.createDataFrame(late, KINDS).coalesce(1).write.mode("append").parquet(str(source))
    fold = jobs.last_states(spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(str(source)), "id", ["at"], ["status", "note"])
    run(fold, jobs.state_log(log), tmp_path / "check")
    got = {r.id: (r.created_at, r.updated_at, r.status, r.note) for r in jobs.logged_states(spark, log, "id").collect()}
    assert got == {1: (T - H, T + 3 * H, "dismissed", "nice"), 2: (T, T + H, "seen", "y"), 3: (T, T, "seen", None)}
    want = history.last_state(spark.createDataFrame(first + second + late, KINDS), "id", ["at"], ["status", "note"])
    assert got == {r.id: (r.created_at, r.updated_at, r.status, r.note) for r in want.collect()}
    # each batch holds the keys it has changed, and no others
    by_batch = {}
    for r in spark.read.parquet(log).select("batch", "id").collect():
        by_batch.setdefault(r.batch, set()).add(r.id)
    assert sorted(map(sorted, by_batch.values())) == [[1, 2], [1, 2], [1, 3]]
    # the last batch again
    newest = max(by_batch)
    again = spark.read.parquet(f"{log}/batch={newest:012d}")
    again = spark.createDataFrame(again.collect(), again.schema)
    jobs.state_log(log)(again, newest)
    assert {r.id: (r.created_at, r.updated_at, r.status, r.note) for r in jobs.logged_states(spark, log, "id").collect()} == got
    jobs.compacted(spark, log, "id", str(tmp_path / "log2"))
    assert sorted(map(str, jobs.logged_states(spark, str(tmp_path / "log2"), "id").collect())) == sorted(map(str, jobs.logged_states(spark, log, "id").collect()))


def test_changes_over_batches(spark, tmp_path):
    parts = [[(1, T, 100), (2, T, 50)], [(1, T + H, 100), (1, T - H, 70), (2, T + H, None)], [(1, T + 2 * H, 90), (2, T + 2 * H, 50), (3, None, 5)]]
    got = []
    run(jobs.price_changes(batches(spark, tmp_path / "in", *parts), "id", "at", ["price"]), lambda b, i: got.extend(b.collect()), tmp_path / "check")
    assert sorted((r.id, r.at, r.price or 0) for r in got) == [(1, T, 100), (1, T + 2 * H, 90), (2, T, 50), (2, T + H, 0), (2, T + 2 * H, 50)]


def test_services_fall_silent(spark, tmp_path):
    S = dt.timedelta(seconds=1)
    parts = [[("a", T), ("b", T)], [("b", T + 170 * S)], [("b", T + 340 * S), ("c", T + 900 * S)]]
    beats = batches(spark, tmp_path / "in", *parts, schema="service string, updated_at timestamp")
    got = []
    q = jobs.silent_services(beats).writeStream.outputMode("append").foreachBatch(lambda b, i: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert sorted((r.service, r.last_seen) for r in got) == [("a", T), ("b", T + 340 * S)]


def test_queue(spark, tmp_path):
    got = []
    q = jobs.drain(stream(spark, tmp_path / "in", ROWS), lambda b, i: got.extend(b.collect()), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert len(got) == len(ROWS)
