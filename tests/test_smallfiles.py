"""Small-file cases, the merge plan and the rewrite of a real folder."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import smallfiles
from lakeloom.plans.store import Conflict

T0 = dt.datetime(2024, 1, 1)
DELTAS = "namespace string, stream_id string, partition_id string, stream_position long, delta_type string, manifest_id string, committed_at timestamp_ntz"
ENTRIES = "entry_id long, manifest_id string, stream_id string, partition_id string, stream_position long, uri string, meta_content_length long, meta_record_count long"
TARGETS = "namespace string, capacity_bytes long, capacity_records long, min_file_bytes long"


def test_spellings(spark):
    same = ["s3://b/t/p/f.pq", "S3://b/t/p/f.pq", "s3a://b/t//p/f.pq", "s3://b/t/./p/f.pq ", " s3://b/t%2Fp/f.pq"]
    df = spark.createDataFrame([(u,) for u in same], "u string")
    assert {r[0] for r in df.select(smallfiles.same_object(F.col("u"))).collect()} == {"s3://b/t/p/f.pq"}
    odd = spark.createDataFrame([("s3://b/100%/a+b",), (None,), ("",)], "u string")
    assert [r[0] for r in odd.select(smallfiles.same_object(F.col("u"))).collect()] == ["s3://b/100%/a+b", None, ""]


def tables(spark):
    d = [
        ("n", "s", "p", 1, "append", "m1", T0), ("n", "s", "p", 1, "append", "m2", T0 + dt.timedelta(1)), ("n", "s", "p", 2, "append", "m3", T0), ("n", "s", "k", 1, "append", "m4", T0), ("n", "s", "k", 2, "Delete ", "m5", None),
        ("n", "s", "one", 1, "add", "m6", T0), ("other", "s", "o", 1, "add", "m7", T0),
    ]
    e = [
        (1, "m1", "s", "p", 1, "s3://b/old", 5, 1), (2, "m2", "s", "p", 1, "s3://b/a", 5, 1), (3, "m3", "s", "p", 2, "S3://b//a", 5, 1), (4, "m3", "s", "p", 2, "s3://b/c", 9, None), (5, "m3", "s", "p", 2, "s3://b/big", 10, 1),
        (6, "m3", "s", "p", 2, "s3://b/unknown", None, 1), (7, "m4", "s", "k", 1, "s3://b/k1", 1, 1), (8, "m4", "s", "k", 1, "s3://b/k2", 1, 1), (9, "m6", "s", "one", 1, "s3://b/only", 1, 1), (10, "m7", "s", "o", 1, "s3://b/o1", 1, 1), (11, "m7", "s", "o", 1, "s3://b/o2", 1, 1), (12, "m3", "s", "p", 2, None, 1, 1),
    ]
    return spark.createDataFrame(d, DELTAS), spark.createDataFrame(e, ENTRIES), spark.createDataFrame([("n", 8, 100, 10)], TARGETS)


def test_cases_and_plan(spark, rows):
    assert rows(smallfiles.small_files(*tables(spark)).select("entry_id")) == [(2,), (4,)]
    plan = smallfiles.merge_plan(*tables(spark))
    assert rows(plan.select("entry_id", "output_no")) == [(2, 0), (4, 0)]
    assert smallfiles.plan_summary(plan).first().asDict() | {} == {"namespace": "n", "stream_id": "s", "partition_id": "p", "small_files": 2, "output_files": 1, "bytes": 14, "records": 1}


def test_empty(spark):
    assert smallfiles.merge_plan(*(df.limit(0) for df in tables(spark))).count() == 0


def test_no_output_beyond_its_capacities(spark):
    files = [("s", "p", n, n, 1, 50) for n in range(10)] + [("s", "p", n, n, 50, 0) for n in range(10, 20)] + [("s", "q", 0, 20, None, None), (None, None, 0, 21, 3, 3)]
    df = spark.createDataFrame(files, "stream_id string, partition_id string, stream_position long, entry_id long, b long, r long")
    got = smallfiles.output_numbers(df, ["stream_id", "partition_id"], ["stream_position", "entry_id"], "b", "r", F.lit(100), F.lit(100)).toPandas()
    assert list(got.columns) == [*df.columns, "output_no"] and len(got) == 22
    for _, g in got.groupby(["stream_id", "partition_id", "output_no"], dropna=False):
        assert g["b"].sum() < 150 and g["r"].sum() < 150 and sorted(g["entry_id"]) == list(range(g["entry_id"].min(), g["entry_id"].max() + 1))
    assert got[got["partition_id"] == "p"]["output_no"].nunique() <= 10


def test_listing_versions_and_conflicts(spark, rows, tmp_path):
    one = smallfiles.compacted_listing(spark, str(tmp_path), *tables(spark))
    assert rows(one.replaced().select("entry_id", "output_no")) == [(2, 0), (4, 0)] and one.store.latest() == 1 and one.replaced(0).count() == 0
    assert 2 not in {r["entry_id"] for r in one.files().collect()} and one.files(0).count() == one.files(1).count() + 2
    assert one.merge_small() is None  # nothing small is left in a swarm
    other = smallfiles.FileListing(spark, str(tmp_path))
    real = other._version
    other._version = lambda v=None: (0, one.store.commit(0)) if v in (None, 0) and other._version is not real and not seen.append(1) and len(seen) < 3 else real(v)
    seen: list = []
    with pytest.raises(Conflict):
        other.merge_small()


def test_failed_wave_is_run_again(spark, rows, tmp_path):
    t = smallfiles.CompactedFolder(spark, str(tmp_path), "part")
    t.WAVE_FILES = 2
    for n in range(3):
        t.append(spark.createDataFrame([(n, p) for p in "abc"], "v int, part string").coalesce(1))
    want, real, calls = rows(t.read()), t._rewrite, []

    def sometimes(*args):
        calls.append(1)
        real(*args)
        if len(calls) == 1:
            raise OSError("executor lost after its files were written")

    t._rewrite = sometimes
    t.merge_small(1 << 20, 1 << 20)
    assert rows(t.read()) == want and t.manifest().count() == 3 and t.manifest().agg(F.sum("records")).first()[0] == 9
    t.FOLD = 1
    t.append(spark.createDataFrame([(9, "a")], "v int, part string"))
    assert t.read().count() == 10 and len(t.store.commit(t.store.latest())["add"]) == 1


def test_rewrite_of_a_folder(spark, rows, tmp_path):
    t = smallfiles.CompactedFolder(spark, str(tmp_path), "part")
    for n in range(4):
        t.append(spark.createDataFrame([(n, "a b"), (n + 10, "c")], "v int, part string").repartition(1))
    want = rows(t.read())
    files = lambda: {r["part"]: r["n"] for r in t.manifest().groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert files() == {"part=a b": 4, "part=c": 4}
    v = t.merge_small(1 << 20, 1 << 20)
    assert files() == {"part=a b": 1, "part=c": 1} and rows(t.read()) == want
    assert rows(t.read(v - 1)) == want  # the version before is still there
    assert t.merge_small(1 << 20, 1 << 20) is None


def test_rewrite_of_odd_partition_values(spark, rows, tmp_path):
    t = smallfiles.CompactedFolder(spark, str(tmp_path), "part")
    for n in range(3):
        t.append(spark.createDataFrame([(n, "x:y%z+w =/ä"), (n, None)], "v int, part string").coalesce(1))
    want = rows(t.read())
    assert {r[1] for r in want} == {"x:y%z+w =/ä", None}
    t.merge_small(1 << 20, 1 << 20)
    assert rows(t.read()) == want and t.manifest().count() == 2


def test_conflicting_rewrites(spark, tmp_path):
    a, b = (smallfiles.CompactedFolder(spark, str(tmp_path), "part") for _ in range(2))
    for n in range(3):
        a.append(spark.createDataFrame([(n, "x")], "v int, part string"))
    real, first = a.store.stage, [True]

    def stage():
        if first.pop():
            b.merge_small(1 << 20, 1 << 20)
        return real()

    a.store.stage = stage
    with pytest.raises(Conflict):
        a.merge_small(1 << 20, 1 << 20)
    assert b.read().count() == 3
