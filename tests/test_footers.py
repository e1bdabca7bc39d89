"""Bounds of files, what they rule out, and scans that leave files out."""

import datetime as dt
import math

import pytest

from lakeloom.catalog import Catalog
from lakeloom.functions.expressions import Reference
from lakeloom.sources import footers as B

R = Reference


def test_bounds_of_a_file(spark, tmp_path):
    rows = [(1, "a", 1.5, dt.date(2024, 1, 1), None, "x" * 100), (9, "b", math.nan, dt.date(2024, 2, 1), None, "y"), (None, None, None, None, None, None)]
    spark.createDataFrame(rows, "i long, s string, f double, d date, n int, long string").coalesce(1).write.parquet(str(tmp_path / "t"))
    path = next(str(p) for p in (tmp_path / "t").glob("*.parquet"))
    n, b = B.footer(path)
    assert n == 3 and b["i"][:3] == [1, 9, 1] and b["s"][:3] == ["a", "b", 1] and b["d"][:3] == ["2024-01-01", "2024-02-01", 1] and "long" not in b
    may = lambda p: B.may_match(p, b)
    assert may(R("i").eq(5)) and not may(R("i").eq(10)) and not may(R("i").gt(9)) and may(R("i").ge(9)) and not may(R("i").lt(1)) and not may(R("i").isin([0, 10])) and not may(R("i").isin([])) and not may(R("i").between(10, 20))
    assert may(R("f").gt(1000.0))  # NaN is greater
    assert may(R("n").is_null()) and not may(R("n").eq(1)) and not may(R("i").eq(None)) and may(R("i").is_null())
    assert may(R("d").eq(dt.date(2024, 1, 15))) and not may(R("d").gt(dt.date(2024, 2, 1)))
    assert may(R("s").like("b%")) and not may(R("s").like("c%")) and may(R("s").like("%z"))
    assert may(R("long").eq("q")) and may(R("unknown").eq(1)) and may(~R("i").eq(1)) and may(R("i").eq("text"))
    assert not may(R("i").eq(5) & R("s").eq("z")) and may(R("i").eq(50) | R("s").eq("a"))


@pytest.mark.parametrize("most", [64, 0])
def test_footers_by_driver_and_tasks(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(B, "DRIVER_FILES", most)
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t"))
    paths = [f"file:{p}" for p in (tmp_path / "t").glob("*.parquet")]
    assert sum(n for n, _ in B.footers(spark, paths).values()) == 100


def test_planned_files(spark, rows, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.write(spark.range(100).selectExpr("id", "id % 7 AS v").repartitionByRange(5, "id"), "t")
    files = lambda p=None: len(c.read("t", read_as="files", row_filter=p))
    assert files() == 5 and files(R("id").eq(3)) == 1 and files(R("id").lt(0)) == 0 and files(R("v").eq(3)) == 5
    assert rows(c.read("t", row_filter=R("id").eq(3))) == [(3, 3)] and c.read("t", row_filter=R("id").lt(0)).count() == 0
    assert c.read("t", limit=4).count() == 4 and len(c.read("t", limit=4).inputFiles()) == 1 and c.read("t", limit=1000).count() == 100


def test_only_keys_prune_what_is_not_compacted(spark, rows, tmp_path):
    """A filter on another field may not hide the file that overwrites a row."""
    c = Catalog(spark, str(tmp_path))
    c.write(spark.createDataFrame([(1, 1), (2, 1)], "k int, v int"), "t", merge_keys=["k"], compact=False)
    c.write(spark.createDataFrame([(1, 5)], "k int, v int"), "t", mode="merge", compact=False)
    assert rows(c.read("t", row_filter=R("v").eq(1))) == [(2, 1)] and rows(c.read("t", row_filter=R("k").eq(2))) == [(2, 1)]
    c.compact("t")
    assert rows(c.read("t", row_filter=R("v").eq(1))) == [(2, 1)]


def test_merged_rows_keep_their_source_and_order(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.write(spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "c")], "k int, v int, w string").coalesce(1), "t", merge_keys=["k"], compact=False)
    c.write(spark.createDataFrame([(1, 5)], "k int, v int"), "t", mode="merge", compact=False)
    c.write(spark.createDataFrame([(3,)], "k int"), "t", mode="delete", compact=False)
    got = c.read("t", file_path_column="src", ordered=True).collect()
    assert [(r["k"], r["v"], r["w"]) for r in got] == [(2, 1, "b"), (1, 5, "a")] and got[0]["src"] != got[1]["src"]
    assert c.read("t", columns=["v"], file_path_column="src").columns == ["v", "src"]
