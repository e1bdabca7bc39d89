"""Keyed merge operators on small literal tables and against a plain Python model."""

import random

from pyspark.sql import functions as F

from lakeloom.operators import merge


def test_last_wins(spark, rows):
    df = spark.createDataFrame([("pk1", 1, 0), ("pk1", 5, 1), ("pk4", 3, 2), ("pk4", 6, 3), (None, 1, 4), (None, 2, 5), ("", 9, 6)], "pk string, value int, seq int")
    assert rows(merge.dedupe_last(df, ["pk"], ["seq"])) == sorted([("pk1", 5, 1), ("pk4", 6, 3), (None, 2, 5), ("", 9, 6)], key=repr)


def test_dedupe_of_empty_and_of_odd_columns(spark):
    df = spark.createDataFrame([], "k int, `a.b` int, m map<string,int>")
    out = merge.dedupe_last(df, ["k"], ["a.b"])
    assert out.columns == ["k", "a.b", "m"] and out.count() == 0


def test_merge_order_keeps_smallest_or_largest_and_places_nulls(spark, rows):
    df = spark.createDataFrame([("a", 3, 1), ("a", 1, 2), ("a", 2, 3), ("b", None, 1), ("b", 7, 2)], "k string, v int, s int")
    pick = lambda o: rows(merge.dedupe_merge_order(df, ["k"], [o], ["s"]))
    assert pick(merge.MergeOrder("v", True)) == [("a", 1, 2), ("b", 7, 2)]
    assert pick(merge.MergeOrder("v", False)) == [("a", 3, 1), ("b", 7, 2)]
    assert pick(merge.MergeOrder("v", True, nulls_win=True))[1] == ("b", None, 1)


def test_upsert_with_null_keys(spark, rows):
    base = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    inc = spark.createDataFrame([(None, 3), ("b", 4)], "k string, v int")
    assert rows(merge.upsert(base, inc, ["k"])) == sorted([("a", 1), (None, 3), ("b", 4)], key=repr)


def test_partial_upsert_keeps_missing_columns_and_takes_explicit_nulls(spark, rows):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, n string, v int")
    inc = spark.createDataFrame([(1, None), (3, 30)], "k int, v int")
    assert rows(merge.upsert_partial(base, inc, ["k"], defaults={"n": "new"})) == sorted([(1, "a", None), (2, "b", 20), (3, "new", 30)], key=repr)


def test_equality_delete_is_null_safe_and_ignores_unknown_columns(spark, rows):
    base = spark.createDataFrame([(1, None), (2, "x"), (None, "x")], "a int, b string")
    gone = spark.createDataFrame([(None, "x", 1)], "a int, b string, c int")
    assert rows(merge.equality_delete(base, gone, ["a", "b", "c"])) == sorted([(1, None), (2, "x")], key=repr)
    assert merge.equality_delete(base, gone, ["c"]).count() == 3


def test_ordered_replay_with_deletes_on_another_column(spark, rows):
    s = "pk_col_1 long, col_1 string"
    make = lambda data: spark.createDataFrame(data, s)
    base = [(i % 4, str(i)) for i in range(1000)] + [(4, "fiz"), (5, "buz")]
    delete = lambda *v: spark.createDataFrame([(x,) for x in v], "col_1 string")
    rows_of = lambda data: make(data).withColumn("n", F.monotonically_increasing_id())
    deltas = [
        merge.Delta(0, "upsert", rows_of(base)), merge.Delta(1, "upsert", rows_of([(i, str(i)) for i in range(6)])), merge.Delta(2, "delete", delete("DOESNOTEXIST"), ("col_1",)),
        merge.Delta(3, "delete", delete("1"), ("col_1",)), merge.Delta(4, "upsert", rows_of([(2, "boo"), (3, "bar"), (6, "fiz"), (7, "aaa")])), merge.Delta(5, "delete", delete("fiz", "bar", "boo"), ("col_1",)),
    ]
    assert rows(merge.replay(None, deltas, ["pk_col_1"], ["n"]).select("pk_col_1", "col_1")) == [(0, "0"), (4, "4"), (5, "5"), (7, "aaa")]


def test_replay_against_a_dictionary(spark, rows):
    rng = random.Random(5)
    model: dict = {}
    deltas = []
    for position in range(12):
        if rng.random() < 0.6:
            batch = [(rng.choice([None, 1, 2, 3, 4]), rng.choice(["x", "y", None]), n) for n in range(rng.randint(1, 5))]
            deltas.append(merge.Delta(position, "upsert", spark.createDataFrame(batch, "k int, v string, n int")))
            model |= {k: v for k, v, _ in batch}
        else:
            on = rng.choice([("k",), ("v",), ("k", "v")])
            batch = [(rng.choice([None, 1, 2, 3, 4]), rng.choice(["x", "y", None])) for _ in range(2)]
            deltas.append(merge.Delta(position, "delete", spark.createDataFrame(batch, "k int, v string"), on))
            at = {"k": 0, "v": 1}
            model = {k: v for k, v in model.items() if not any(all((k, v)[at[c]] == b[at[c]] for c in on) for b in batch)}
    rng.shuffle(deltas)
    assert rows(merge.replay(None, deltas, ["k"], ["n"]).select("k", "v")) == sorted(model.items(), key=repr)
