"""Schedules, streams and rebuilds go on after whatever ends them."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import tables
from shelfspark.plans.reindex import MERGE_TYPES, Rebuild, merge_complete
from shelfspark.streaming import pipeline, progress


def day(n, hour=0):
    return datetime.datetime(2024, 1, n, hour, tzinfo=datetime.timezone.utc)


def changes(spark, rows):
    return spark.createDataFrame(rows, "id string, last_updated_date timestamp, is_deleted boolean")


def test_a_process_that_ends_behind_its_token_holds_nothing_for_ever(spark, tmp_path):
    now = [time.time()]
    p = progress.Progress(spark, f"{tmp_path}/p", stale=600, clock=lambda: now[0])
    p._create("item", "token", 1)  # and no more: not even the time
    assert p.acquire("item") is None
    now[0] += 700
    assert p.acquire("item") == 2


def test_a_run_longer_than_stale_keeps_its_lock(spark, tmp_path):
    now = [1000.0]
    p = progress.Progress(spark, f"{tmp_path}/p", stale=600, clock=lambda: now[0])
    table = changes(spark, [(f"{i:02d}", day(1 + i // 10), i % 7 == 0) for i in range(35)])
    seen, other = [], []

    def index(df):
        seen.extend(r.id for r in df.collect())
        now[0] += 400  # a batch takes less than stale, all of them more
        other.append(p.acquire("item"))

    assert progress.index_changes(p, "item", table, index, lambda df: seen.extend(r.id for r in df.collect()), batch=10) == 35
    assert sorted(seen) == [f"{i:02d}" for i in range(35)] and set(other) == {None} and len(other) == 4
    assert len(p._names("item", "mark")) == 4 and p.acquire("item") == 2
    p.release("item", 2)
    assert p.acquire("item") == 3 and len(p._names("item", "mark")) == 1  # what is not needed is gone


def test_rows_of_the_marks_stamp_that_come_late_are_read(spark, tmp_path):
    p, seen = progress.Progress(spark, f"{tmp_path}/p"), []
    run = lambda rows: progress.index_changes(p, "item", changes(spark, rows), lambda df: seen.extend(r.id for r in df.collect()), lambda df: df.count(), batch=2)
    rows = [("b", day(1), None), ("d", day(2), None), ("f", day(2), None)]
    assert run(rows) == 3 and run(rows) == 0
    rows.append(("g", day(2), None))  # behind the mark by its key
    assert run(rows) == 1 and seen[-1] == "g"
    rows.append(("a", day(2), None))  # before it
    assert run(rows) == 4 and set(seen[-4:]) == {"a", "d", "f", "g"} and run(rows) == 0


def test_a_failed_batch_is_done_again_and_those_before_are_not(spark, tmp_path):
    p, seen = progress.Progress(spark, f"{tmp_path}/p"), []
    table = changes(spark, [(f"{i}", day(1 + i), None) for i in range(6)])

    def index(df):
        ids = [r.id for r in df.collect()]
        if "3" in ids and not seen.count("failed"):
            seen.append("failed")
            raise ValueError
        seen.extend(ids)

    with pytest.raises(ValueError):
        progress.index_changes(p, "item", table, index, lambda df: None, batch=2)
    assert progress.index_changes(p, "item", table, index, lambda df: None, batch=2) == 4
    assert sorted(seen) == ["0", "1", "2", "3", "4", "5", "failed"]


def test_a_child_waits_for_its_parent(spark, tmp_path):
    p = progress.Progress(spark, f"{tmp_path}/p")
    table = changes(spark, [("a", day(1), None)])
    kinds = {"subject": (table, lambda df: df.count(), lambda df: None), "instance": (table, lambda df: df.count(), lambda df: None)}
    token = p.acquire("instance")
    assert progress.scheduled(p, kinds) == {"instance": None, "subject": None}
    p.release("instance", token)
    assert progress.scheduled(p, kinds) == {"instance": 1, "subject": 1}


def test_an_outage_is_raised_and_no_row_is_dead(spark):
    df, dead = spark.range(20).withColumnRenamed("id", "n"), []

    def down(part):
        raise OSError("no connection")

    with pytest.raises(RuntimeError):
        pipeline.one_by_one(df, down, lambda part, error: dead.append(part.count()), wait=0)
    assert dead == []
    done = []

    def picky(part):
        ids = [r.n for r in part.collect()]
        if 7 in ids:
            raise ValueError("seven")
        done.extend(ids)

    pipeline.one_by_one(df, picky, lambda part, error: dead.append([r.n for r in part.collect()]), wait=0)
    assert dead == [[7]] and sorted(done) == [i for i in range(20) if i != 7]


def test_last_events_with_a_map_column(spark):
    df = spark.sql("select * from values ('k', 1, map('a', 'x')), ('k', 2, map('a', 'y')), ('m', 1, map('b', 'z')), ('m', 1, map('b', 'zz')) as t(key, ts, new)")
    assert sorted((r.key, r.ts, r.new) for r in tables.last_events(df).collect()) == [("k", 2, {"a": "y"}), ("m", 1, {"b": "zz"})]


def test_the_log_of_versions_stays_short(spark, tmp_path):
    v = tables.Versions(spark, f"file://{tmp_path}/t")
    for i in range(18):
        v.merge(spark.createDataFrame([(i % 2, str(i))], "id long, x string"), ["id"], batch=("s", i))
    assert len(list((tmp_path / "t/_versions").glob("part-*"))) <= 11
    assert v.log()["version"] == 17 and v.log()["batches"] == {"s": 17}
    v.prune()
    assert len(list((tmp_path / "t/_versions").glob("part-*"))) == 1
    assert sorted(map(tuple, v.read().collect())) == [(0, "16"), (1, "17")]


def test_a_second_run_does_the_failed_ranges_alone(spark, tmp_path):
    source = spark.range(3000).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("id"), F.col("id").alias("n"))
    bad, make = {"0a7", "7ff", "fff"}, lambda df: df.withColumn("double", F.col("n") * 2)
    broken = lambda df: make(df).withColumn("n", F.when(F.substring("id", 1, 3).isin(*bad), F.raise_error(F.lit("broken"))).otherwise(F.col("n")))
    bad_here = {r[0] for r in source.select(F.substring("id", 1, 3)).distinct().collect()} & bad
    if not bad_here:
        bad |= {source.select(F.substring("id", 1, 3)).first()[0]}
        bad_here = {r[0] for r in source.select(F.substring("id", 1, 3)).distinct().collect()} & bad
    rebuild = Rebuild(spark, f"file://{tmp_path}/r", level=3)
    assert rebuild.state() == "UPLOAD_NEW" and len(rebuild.pending()) == 4096
    done = rebuild.run(source, broken)
    assert len(done) == 4096 - len(bad_here) and set(rebuild.pending()) == bad_here and rebuild.state() == "UPLOAD_FAILED"
    assert all("broken" in rebuild.entries()[r]["error"] for r in bad_here)
    again = Rebuild(spark, f"file://{tmp_path}/r", level=3)  # another driver
    assert set(again.run(source, make)) == bad_here and again.state() == "UPLOAD_COMPLETED" and again.run(source, make) == []
    assert sorted(map(tuple, again.read().select("id", "n", "double").collect())) == sorted(map(tuple, make(source).collect()))
    assert sum(e["rows"] for e in again.entries().values()) == 3000


def test_a_merge_is_complete_once_every_type_is(spark, tmp_path):
    runs = {t: Rebuild(spark, f"file://{tmp_path}/{t}", level=1) for t in MERGE_TYPES}
    source = spark.createDataFrame([("0a",), ("f1",)], "id string")
    for t in MERGE_TYPES:
        assert not merge_complete(runs)
        runs[t].run(source, lambda df: df)
    assert merge_complete(runs) and not merge_complete({})
