"""Merkle trees, pending deltas and runs that survive failures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import incremental, merkle
from lakeloom.plans.store import Conflict

T0 = dt.datetime(2024, 1, 1)
DELTAS = "stream_id string, partition_id string, stream_position long, manifest_id string, committed_at timestamp_ntz, extra int"
RUNS = "stream_id string, partition_id string, status string, as_of timestamp_ntz"


def at(h):
    return T0 + dt.timedelta(hours=h)


def test_only_differing_leaves_are_found(spark, rows):
    shape = merkle.Shape(depth=2)
    a = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    b = a.filter("k <> 7").withColumn("v", F.when(F.col("k") == 100, None).otherwise(F.col("v")))
    assert rows(merkle.changed(a, b, ["k"], ["v"], shape)) == [(100, 200), (7, 14)]
    assert merkle.changed(a, a, ["k"], ["v"], shape).count() == 0
    assert rows(merkle.removed(b, a, ["k"], ["v"], shape)) == [(7,)]
    leaves = merkle.differing_leaves(merkle.tree(a, ["k"], ["v"], shape), merkle.tree(b, ["k"], ["v"], shape), shape)
    assert leaves.count() <= 2


def test_null_and_empty_differ(spark):
    shape = merkle.Shape(depth=1)
    a = spark.createDataFrame([(None, "")], "k string, v string")
    b = spark.createDataFrame([("", None)], "k string, v string")
    assert merkle.changed(a, b, ["k"], ["v"], shape).count() == 1


def test_pending(spark, rows):
    d = spark.createDataFrame(
        [
            ("s", "p", 1, "m1", at(1), 0), ("s", "p", 1, "m1", at(1), 0),  # repeated, seen
            ("s", "p", 2, "m2", at(1), 0), ("s", "p", 2, "m3", at(5), 0),  # changed after the run
            ("s", "p", 3, "m4", at(3), 0),  # exactly at the snapshot: not seen
            ("s", "p", 4, "m5", None, 0),  # not committed
            ("s", "p", 5, "m6", at(1), 0), ("s", "p", 5, "m6", at(9), 0),  # committed again, same manifest
            ("s", "q", 1, "m7", at(1), 0),  # no good run
            (None, "p", 1, "m8", at(1), 0),  # null keys are keys
        ],
        DELTAS,
    )
    runs = spark.createDataFrame([("s", "p", "SUCCESS", at(2)), ("s", "p", "SUCCESS", at(3)), ("s", "p", "FAILED", at(9)), ("s", "q", "RUNNING", at(9)), (None, "p", "success ", at(2)), ("s", "q", "SUCCESS", None)], RUNS)
    got = rows(incremental.pending(d, runs).select("stream_id", "partition_id", "stream_position"))
    assert got == [("s", "p", 2), ("s", "p", 3), ("s", "q", 1)]


def test_pending_of_empty_tables(spark):
    assert incremental.pending(spark.createDataFrame([], DELTAS), spark.createDataFrame([], RUNS)).count() == 0


def test_runs_publish_output_and_tree_together(spark, rows, tmp_path):
    run = incremental.IncrementalRun(spark, str(tmp_path), ["k"], ["v"], merkle.Shape(depth=2))
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert run.run(a, lambda df: df) == 0 and run.output().count() == 2
    b = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k int, v string")

    def broken(df):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        run.run(b, broken)
    assert run.store.latest() == 0  # nothing is visible of the failed run
    assert run.run(b, lambda df: df) == 1 and rows(run.output()) == [(2, "c", "upserted"), (3, "d", "upserted")]
    run.run(b, lambda df: df)
    assert run.output().count() == 0 and rows(run.records()) == rows(b)


def test_a_failure_between_output_and_commit(spark, rows, tmp_path):
    run = incremental.IncrementalRun(spark, str(tmp_path), ["k"], ["v"])
    run.run(spark.createDataFrame([(1, "a")], "k int, v string"))
    b, real = spark.createDataFrame([(1, "b")], "k int, v string"), run.store.publish

    def dies(*_, **__):
        raise OSError("driver lost")

    run.store.publish = dies
    with pytest.raises(OSError):
        run.run(b)
    run.store.publish = real
    assert run.store.latest() == 0 and rows(run.records()) == [(1, "a")]
    assert run.run(b) == 1 and rows(run.output()) == [(1, "b", "upserted")]


def test_removed_records_are_passed_on_once(spark, rows, tmp_path):
    run = incremental.IncrementalRun(spark, str(tmp_path), ["k"], ["v"])
    schema = "k int, v string, payload string"
    run.run(spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, None, "z")], schema))
    now = spark.createDataFrame([(1, "a", "other")], schema)
    run.run(now)
    assert rows(run.output()) == [(2, "b", None, "removed"), (None, None, None, "removed")]
    run.run(now)
    assert run.output().count() == 0
    run.run(now.limit(0))
    assert rows(run.output()) == [(1, "a", None, "removed")] and run.records().count() == 0
    run.run(now)
    assert rows(run.output()) == [(1, "a", "other", "upserted")]


def test_only_segments_with_changes_are_written(spark, tmp_path):
    run = incremental.IncrementalRun(spark, str(tmp_path), ["k"], ["v"], merkle.Shape(depth=2, segment_bits=4))
    a = spark.range(400).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    run.run(a)
    run.run(a.withColumn("v", F.when(F.col("k") == 7, "b").otherwise(F.col("v"))))
    first, second = run.store.commit(0), run.store.commit(1)
    assert len(first["rewritten"]) == 16 and len(second["rewritten"]) == 1 and second["segments"].keys() == first["segments"].keys() and run.records().count() == 400


def test_a_source_that_changes_is_read_once(spark, rows, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def one(x):
        calls.add(1)
        return x

    run = incremental.IncrementalRun(spark, str(tmp_path), ["k"], ["v"])
    run.run(spark.createDataFrame([(1, "a")], "k int, v string"))
    now = spark.createDataFrame([(1, "b")], "k int, v string").withColumn("v", F.udf(one, "string").asNondeterministic()("v"))
    run.run(now)
    assert calls.value == 1 and rows(run.output()) == [(1, "b", "upserted")]


def test_two_runs_cannot_publish_one_version(spark, tmp_path):
    run = incremental.IncrementalRun(spark, str(tmp_path), ["k"], ["v"])
    a = spark.createDataFrame([(1, "a")], "k int, v string")

    def other_first(df):
        incremental.IncrementalRun(spark, str(tmp_path), ["k"], ["v"]).run(a, lambda x: x)
        return df

    with pytest.raises(Conflict):
        run.run(a, other_first)
