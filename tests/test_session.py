"""Shared folder, cuts, guarded broadcasts, spreading, shipping."""

import pytest
from pyspark.sql import functions as F

from lakeloom import session as S


def test_shared_folder_of_a_cluster_without_setting(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        S.shared_folder(Session())


def test_cut_keeps_rows_and_drops_what_it_replaces(spark, rows):
    a = S.cut(spark.range(5).withColumn("v", F.col("id") * 2))
    b = S.cut(a.filter("id > 2"), replaces=a)
    assert rows(b) == [(3, 6), (4, 8)] and S.cut(a.sparkSession.createDataFrame([], "x int, s string")).columns == ["x", "s"]
    with pytest.raises(Exception, match="(?i)not.*exist|FILE_NOT_EXIST|FAILED_READ"):
        a.collect()


def test_settings_come_back(spark):
    before = spark.conf.get(S._CLEANUP)
    with S.shuffles_removed(spark):
        assert spark.conf.get(S._CLEANUP) == "true"
    assert spark.conf.get(S._CLEANUP) == before


def test_broadcast_only_below_the_bound(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in plan(S.bounded_broadcast(spark.range(10), 10)) and "ResolvedHint" not in plan(S.bounded_broadcast(spark.range(11), 10))


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert S.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores and S.spread(spark.range(0, 100, 1, cores + 3)).rdd.getNumPartitions() == cores + 3


def test_workers_know_the_package(spark):
    S.ship()
    S.ship()

    def where(parts):
        import lakeloom

        for p in parts:
            p["id"] = len(lakeloom.__version__)
            yield p

    assert spark.range(1).mapInPandas(where, "id long").first()[0] > 0


def test_broadcasts_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    df = spark.range(10).selectExpr("id", "repeat('x', 100) AS `a.b`", "array(id) AS c")
    assert hinted(S.bounded_broadcast(df)) and not hinted(S.bounded_broadcast(df, 9)) and hinted(S.bounded_broadcast(df.limit(0)))
    monkeypatch.setattr(S, "BROADCAST_BYTES", 900)
    assert not hinted(S.bounded_broadcast(df)) and hinted(S.bounded_broadcast(df.limit(3)))
