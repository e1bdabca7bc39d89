"""Streams into tables and the version monitor."""

from lakeloom.catalog import Catalog, Field, Schema
from lakeloom.streaming.sinks import Monitor, upsert_stream


def test_upsert_stream_runs_twice_without_repeating(spark, rows, tmp_path):
    c = Catalog(spark, f"{tmp_path}/cat")
    c.create_table("t", schema=Schema.of([Field("k", "bigint", merge_key=True), Field("v", "string")]))
    src = f"{tmp_path}/src"
    spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string").write.parquet(src)
    go = lambda: upsert_stream(spark.readStream.schema("k bigint, v string").parquet(src), c, "t", f"{tmp_path}/cp").awaitTermination()
    go()
    spark.createDataFrame([(2, "c")], "k bigint, v string").write.mode("append").parquet(src)
    go()
    go()
    assert rows(c.read("t")) == [(1, "a"), (2, "c")]


def test_monitor():
    versions = iter([1, 1, 2, 2])
    seen = []

    def broken(v):
        raise ValueError

    m = Monitor(lambda: next(versions, 2), seen.append, before=broken)
    assert m.run(0.01, 0.1) == 2 and seen == [1, 2] and len(m.errors) == 2
