"""Key hashes, transforms and predicates."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions import expressions as E
from lakeloom.functions.transforms import KEY_DELIMITER, Transform, _murmur3, check_sort_keys, hash_bucket, hash_group, misplaced, partition_values, sort_columns


@pytest.mark.parametrize("n", [1, 7, 1000, 2**23 - 1])
def test_bucket_is_the_digest_modulo_n(spark, n):
    keys = [("a", 1), (None, 2), ("", 2), ("ü", None), ("a" * 1000, -5)]
    df = spark.createDataFrame(keys, "k string, n int")
    want = [int(hashlib.sha1(f"{k or ''}{KEY_DELIMITER}{'' if v is None else v}".encode()).hexdigest(), 16) % n for k, v in keys]
    assert [r[0] for r in df.select(hash_bucket(["k", "n"], n)).collect()] == want


def test_group_and_misplaced(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string").withColumn("b", hash_bucket(["k"], 5)).withColumn("g", hash_group(F.col("b"), 2))
    assert misplaced(df, ["k"], 5, "b").count() == 0
    assert misplaced(df.withColumn("b", F.col("b") + 1), ["k"], 5, "b").count() == 2
    with pytest.raises(ValueError):
        hash_bucket(["k"], 0)


def test_murmur3_of_the_public_specification():
    # published check values of 32-bit murmur3 with seed 0
    assert _murmur3(b"") == 0 and _murmur3(b"test") == 0xBA6BD213 and _murmur3(b"Hello, world!") == 0xC0363E43
    assert _murmur3((34).to_bytes(8, "little")) == 2017239379  # the table format's published example


def test_transforms(spark, rows):
    df = spark.createDataFrame([("abcdef", -3, dt.date(1969, 12, 31), dt.datetime(2024, 3, 1, 5)), (None, None, None, None)], "s string, i int, d date, t timestamp_ntz")
    value = lambda name, col, size=None, **k: df.select(Transform(name, size, **k).column(df, col).alias("v")).collect()[0][0]
    assert [value("truncate", "s", 2), value("truncate", "i", 10), value("year", "d"), value("month", "d"), value("day", "d")] == ["ab", -10, -1, -1, -1]
    assert value("hour", "t") == (dt.datetime(2024, 3, 1, 5) - dt.datetime(1970, 1, 1)).days * 24 + 5 and value("void", "s") is None
    out = partition_values(df, [("s", Transform("bucket", 16, "table_format"), "b"), ("t", Transform("day"), "day")]).select("b", "day").collect()
    assert out[0]["b"] is not None and out[1]["b"] is None and out[1]["day"] is None
    for bad in (("unknown", "s", None), ("truncate", "d", 3), ("hour", "s", None), ("bucket", "s", None)):
        with pytest.raises((NotImplementedError, TypeError, ValueError)):
            value(*bad)


def test_sort_keys(spark, rows):
    df = spark.createDataFrame([(2,), (None,), (1,)], "a int")
    assert [r[0] for r in df.orderBy(*sort_columns([("a", False, True)])).collect()] == [None, 2, 1]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in "abcde"])
    with pytest.raises(ValueError):
        check_sort_keys(schema, [(c, Transform("identity")) for c in "abcde"])
    with pytest.raises(ValueError):
        check_sort_keys(schema, [("a", Transform("year"))])
    with pytest.raises(ValueError):
        check_sort_keys(schema, [("a", Transform("identity"))] * 2)


def test_predicates(spark, rows):
    df = spark.createDataFrame([(1, "ab"), (2, None), (None, "b")], "a int, s string")
    a, s = E.Reference("a"), E.Reference("s")
    keep = lambda p: rows(df.filter(E.to_column(p)).select("a"))
    assert keep(a.eq(1) | s.is_null()) == [(1,), (2,)] and keep(~a.eq(1)) == [(2,)] and keep(a.isin([])) == [] and keep(a.between(1, 2) & s.like("a%")) == [(1,)]
    assert keep(E.In(a, (E.Literal(1), E.Reference("a")))) == [(1,), (2,)]
    p = (a.ge(1) & ~s.like("o'x%")) | a.isin([1, 2]) | a.between(1, 3) | s.is_null()
    assert E.infix(p) == "(((((a >= 1) AND NOT ((s LIKE 'o''x%'))) OR (a IN (1, 2))) OR (a BETWEEN 1 AND 3)) OR (s IS NULL))"
    assert E.fields(p) == {"a", "s"}
    with pytest.raises(TypeError):
        E.to_column("a")
