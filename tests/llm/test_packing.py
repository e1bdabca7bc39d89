"""Containers: capacities, whole items, fill, the curve."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import packing as K

T0 = dt.datetime(2024, 1, 1)
DELTAS = "namespace string, table_name string, stream_id string, partition_id string, stream_position long, manifest_id string, committed_at timestamp_ntz, content_length long, record_count long, container_id string"
TARGETS = "namespace string, capacity_bytes long, capacity_records long, min_file_bytes long"


def test_curve_visits_every_cell_in_steps_of_one(spark):
    df = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    path = [tuple(r)[1:] for r in sorted(tuple(r) for r in df.select(K.hilbert(F.col("x"), F.col("y"), 3), "x", "y").collect())]
    assert len(set(path)) == 64 and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:], strict=False))


def test_pieces():
    assert K.pieces(5, 5, 10, 10) == [(5, 5)] and K.pieces(0, 0, 10, 10) == [(0, 0)]
    for size, records in ((25, 3), (3, 25), (100, 99), (10, 11), (11, 10)):
        for even in (False, True):
            p = K.pieces(size, records, 10, 10, even)
            assert sum(a for a, _ in p) == size and sum(b for _, b in p) == records and all(0 <= a <= 10 and 0 <= b <= 10 for a, b in p) and len(p) == max(-(-size // 10), -(-records // 10))
    assert K.pieces(25, 3, 10, 10)[0][0] == 10 and K.pieces(25, 3, 10, 10, even=True)[0][0] == 8
    with pytest.raises(ValueError):
        K.pieces(5, 0, 0, 10)


def test_windows_are_close_to_the_least():
    rng = np.random.default_rng(1)
    s, r = rng.integers(1, 400, 3000), rng.integers(1, 300, 3000)
    p = K.Packer(1000, 1000)
    c = np.concatenate([p.window(s[k : k + 1000], r[k : k + 1000]) for k in range(0, 3000, 1000)])
    assert np.bincount(c, s).max() <= 1000 and np.bincount(c, r).max() <= 1000 and c.max() + 1 <= np.ceil(s.sum() / 1000) * 1.05


def test_at_most_so_many_containers_stay_open():
    p = K.Packer(1000, 1000, 8)
    for k in range(5):  # no two fit together
        numbers = p.window(np.full(100, 501), np.zeros(100, dtype=np.int64))
        assert sorted(numbers) == list(range(100 * k, 100 * k + 100)) and len(p.ids) == 8
    assert len(p.window(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))) == 0


def test_neighbours_share_containers():
    """Two windows of the curve share a container only if it was left open."""
    rng = np.random.default_rng(2)
    p, seen = K.Packer(1000, 1000, 4), []
    for _ in range(6):
        seen.append(set(p.window(rng.integers(1, 300, 200), rng.integers(1, 300, 200)).tolist()))
    assert all(len(a & b) <= 4 for n, a in enumerate(seen) for b in seen[n + 1 :])


def test_items_over_half_a_container(spark):
    """No two items fit together: every container holds one, and no task gets more rows than it should."""
    rows = [("hot", "t", "s", f"p{i % 7}", i, "m", T0, 51 + i % 40, 1, "x") for i in range(3000)]
    d = spark.createDataFrame(rows, DELTAS)
    got = K.pack(d, spark.createDataFrame([("hot", 100, 200, 1)], TARGETS), chunk=300, window=64).toPandas()
    assert len(got) == 3000 and got["container_id"].nunique() == 3000
    items = K.placed(K.newest_items(d)).withColumn("key", F.concat_ws("|", *K.KEY))
    sizes = K.ranged(items, K.ranges(3000, 300, 4, 64)).groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
    assert sizes.max() <= 300 and sizes.sum() == 3000


def deltas(spark, n=600):
    rng = random.Random(3)
    out = []
    for i in range(n):
        ns = rng.choice(["hot", "hot", "b", "none"])
        out.append((ns, "t", f"s{i % 9}", "p", i, "m1", T0, rng.choice([None, 0, rng.randint(1, 60), rng.randint(1, 60), 250]), rng.choice([None, 1, 20]), "clash"))
        if i % 10 == 0:
            out.append((*out[-1][:5], "m2", T0 + dt.timedelta(1), 33, 2, "clash"))
            out.append(out[-1])
        if i % 15 == 0:
            out.append((ns, "t", "u", "p", i, "m", None, 5, 5, "clash"))
    return spark.createDataFrame(out, DELTAS)


@pytest.mark.parametrize("chunk", [40, 20_000])
def test_pack(spark, chunk):
    targets = spark.createDataFrame([("hot", 100, 200, 1), ("b", 120, 50, 1), ("b", 120, 50, 1)], TARGETS)
    d = deltas(spark)
    got = K.pack(d, targets, chunk).toPandas()
    items = K.newest_items(d).toPandas()
    assert len(got.groupby(K.KEY)) == len(items) and got["piece_bytes"].sum() == items["bytes"].sum() and got["piece_records"].sum() == items["records"].sum()
    assert not got.duplicated([*K.KEY, "piece_no"]).any()
    assert got[got["namespace"] == "none"]["container_id"].isna().all()
    full = got.dropna(subset=["container_id"]).groupby("container_id")
    assert (full["namespace"].nunique() == 1).all()
    for ns, cap in (("hot", (100, 200)), ("b", (120, 50))):
        x = got[got["namespace"] == ns].groupby("container_id")[["piece_bytes", "piece_records"]].sum()
        assert x["piece_bytes"].max() <= cap[0] and x["piece_records"].max() <= cap[1]
    whole = got.groupby(K.KEY).filter(lambda g: len(g) > 1)
    assert (whole.groupby(K.KEY)["piece_bytes"].sum() > 100).all()
    f = {r["namespace"]: r for r in K.fill(K.pack(d, targets, chunk)).collect()}
    assert f["hot"]["containers"] <= f["hot"]["least_possible"] * 1.1 + 1


def test_long_positions_survive_beside_nulls(spark):
    rows = [("hot", "t", "s", "p", p, "m", T0, 5, 5, "x") for p in (2**62 + 1, None, 3)]
    got = K.pack(spark.createDataFrame(rows, DELTAS).coalesce(1), spark.createDataFrame([("hot", 100, 100, 1)], TARGETS))
    assert {r["stream_position"] for r in got.collect()} == {2**62 + 1, None, 3}


def test_empty(spark):
    assert K.pack(deltas(spark, 5).limit(0), spark.createDataFrame([], TARGETS)).count() == 0
