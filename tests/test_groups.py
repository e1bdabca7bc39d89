"""Field groups: merging, levels, ranges, shards."""

import pytest
from pyspark.sql import types as T

from lakeloom.operators import groups as G


def test_merge_takes_later_groups_and_explicit_nulls(spark, rows):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (None, "n", 0)], "k int, s string, v int")
    b = spark.createDataFrame([(2, None, True), (3, 5, False), (None, 7, True)], "k int, v int, w boolean")
    assert rows(G.merge_groups([a, b], "k")) == sorted([(1, "x", 1, None), (2, "y", None, True), (3, None, 5, False), (None, "n", 7, True)], key=repr)


def test_dataset(spark, rows, tmp_path):
    g = G.FieldGroups(spark, str(tmp_path), "id")
    g.add_schema("a", T._parse_datatype_string("id int, name string"))
    g.add_schema("b", T._parse_datatype_string("id int, zip string"))
    with pytest.raises(ValueError):
        g.add_schema("c", T._parse_datatype_string("id int, name int"))
    with pytest.raises(ValueError):
        g.add_schema("c", T._parse_datatype_string("other int"))
    assert g.scan().count() == 0
    g.write("a", spark.createDataFrame([(1, "old"), (2, "two")], "id int, name string"))
    g.write("b", spark.createDataFrame([(2, "z2"), (3, "z3")], "id int, zip string"))
    g.write("a", spark.createDataFrame([(1, "new")], "id int, name string"))
    assert rows(g.scan(["id", "name", "zip"])) == sorted([(1, "new", None), (2, "two", "z2"), (3, None, "z3")], key=repr)
    assert rows(g.lookup(2, ["name"])) == [("two",)] and rows(g.scan(["id", "zip"], low=3)) == [(3, "z3")]
    assert sorted(r[0] for s in g.shards(2) for r in g.scan(["id", "name", "zip"], shard=s).select("id").collect()) == [1, 2, 3]
    assert rows(G.LogicalPlan(g).select("id").map(lambda it: (x + 1 for x in it), "id int").collect()) == [(2,), (3,), (4,)]
    g.export(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_from_files(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, x string").write.json(f"{tmp_path}/in")
    assert G.FieldGroups.from_files(spark, f"{tmp_path}/ds", "id", f"{tmp_path}/in", "json").scan().count() == 1


def test_shards_cover_every_key_once():
    for lo, hi, n in ((0, 9, 3), (5, 5, 4), (-7, 100, 13)):
        keys = [k for s in G.range_shards(lo, hi, n) for k in range(s.low, s.high + 1)]
        assert keys == list(range(lo, hi + 1))
    s = G.range_shards("aa", "zz", 4)
    assert all(a.high == b.low and a.open_end for a, b in zip(s, s[1:], strict=False)) and s[0].low == "aa" and s[-1].high == "zz" and not s[-1].open_end
    assert G.range_shards("a", "a", 3) == [G.Shard("a", "a")]
    assert G.Shard(1, 9).meet(5, 20) == (5, 9, False) and G.Shard(1, 9).meet(10, 20) is None and G.Shard(1, 9).meet() == (1, 9, False)


def test_queries_of_shards_count_every_row(spark, tmp_path, rows):
    from lakeloom.queries import reference

    spark.createDataFrame([(k,) for k in (1, 100, 101, 150, 250, 400, 400)], "o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(reference.QUERIES["range_shards_all"](spark, str(tmp_path))) == [(0, 2), (1, 2), (2, 1), (3, 2)]
    spark.createDataFrame([(k, f"n{k}", 1.0, 2) for k in (1, 9, 10, 600)], "c_custkey long, c_name string, c_acctbal double, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    assert rows(reference.QUERIES["field_group_dataset_all"](spark, str(tmp_path)).select("c_custkey", "c_name")) == [(1, "n1"), (10, "n10"), (600, "n600"), (9, "n9")]
