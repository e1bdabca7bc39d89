"""Schemas: flags, type lattice, coercion, updates."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators import evolution as V
from lakeloom.operators.evolution import Field, Schema, SchemaError, Update

t = T._parse_datatype_string


@pytest.mark.parametrize(
    ("a", "b", "c"),
    [("int", "bigint", "bigint"), ("int", "double", "double"), ("int", "float", "double"), ("smallint", "float", "float"), ("decimal(5,2)", "int", "decimal(11,2)"), ("decimal(20,2)", "bigint", "decimal(20,2)"), ("decimal(5,2)", "float", "float"), ("decimal(5,2)", "double", "double"), ("string", "binary", "binary"), ("void", "date", "date"), ("array<int>", "array<bigint>", "array<bigint>"), ("struct<a:int>", "struct<a:bigint,b:string>", "struct<a:bigint,b:string>")],
)
def test_common_types(a, b, c):
    assert V.common_type(t(a), t(b)).simpleString() == c and V.common_type(t(b), t(a)).simpleString() in (c, "struct<a:bigint,b:string>")


@pytest.mark.parametrize(("a", "b"), [("date", "timestamp"), ("boolean", "int"), ("int", "string")])
def test_no_common_type(a, b):
    with pytest.raises(SchemaError):
        V.common_type(t(a), t(b))


def test_flags():
    s = Schema.of([Field("id", "bigint", merge_key=True), Field("v", "double"), Field("e", "date", event_time=True)])
    assert s.merge_keys == ["id"] and s.event_time == "e" and [f.consistency for f in s.fields] == ["VALIDATE", "NONE", "VALIDATE"]
    assert s.struct()["id"].metadata["merge_key"] is True and Schema.from_json(s.to_json()).to_json() == s.to_json()
    for bad in (Field("a", "double", merge_key=True), Field("a", "array<int>", merge_order="asc"), Field("a", "string", event_time=True), Field("a", "int", merge_key=True, consistency="NONE")):
        with pytest.raises(SchemaError):
            Schema.of([bad])
    with pytest.raises(SchemaError):
        Schema.of([Field("a", "int"), Field("A", "int")])


def test_write_coercion(spark, rows):
    s = Schema.of([Field("k", "int", merge_key=True), Field("n", "int"), Field("c", "int", consistency="COERCE"), Field("d", "string", future_default="x")])
    df = spark.createDataFrame([(1, 2**40, 3.0, True)], "K int, n bigint, c double, extra boolean")
    out, new = V.coerce_write(df, s)
    assert out.dtypes == [("k", "int"), ("n", "bigint"), ("c", "int"), ("d", "string"), ("extra", "boolean")] and rows(out) == [(1, 2**40, 3, "x", True)]
    assert new.id == 1 and new.find("extra").id == 5 and s.id == 0
    with pytest.raises(SchemaError):
        V.coerce_write(df, s, mode="MANUAL")
    with pytest.raises(SchemaError):
        V.coerce_write(df.withColumn("K", F.col("K").cast("bigint")), s)
    with pytest.raises(SchemaError):
        V.coerce_write(df.drop("K"), s)
    with pytest.raises(Exception, match="fraction"):
        V.coerce_write(df.withColumn("c", F.lit(1.5)), s)[0].collect()


def test_read_by_id(spark, rows):
    old = Schema.of([Field("a", "int"), Field("b", "string")])
    new = V.apply_updates(old, [Update("rename", "a", "z"), Update("type", "a", "bigint")][:1])
    new = V.apply_updates(new, [Update("type", "z", "bigint"), Update("add", "c", Field("c", "int", past_default=9))])
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert rows(V.coerce_read(df, old, new)) == [(1, "x", 9)] and V.coerce_read(df, old, new).columns == ["z", "b", "c"]


def test_updates():
    s = Schema.of([Field("k", "int", merge_key=True), Field("v", "int", consistency="NONE")])
    for bad in (
        [Update("remove", "v")], [Update("add", "v", "int")], [Update("type", "v", "string")], [Update("type", "k", "bigint")], [Update("consistency", "v", "VALIDATE")], [Update("add", "w", Field("w", "int", nullable=False))],
        [Update("add", "w", "int"), Update("remove", "w")], [Update("rename", "v", "k")], [Update("nullable", "v", False)], [Update("merge_key", "v", True)], [Update("doc", "nope", "x")],
    ):
        with pytest.raises(SchemaError):
            V.apply_updates(s, bad)
    with pytest.raises(SchemaError):
        V.apply_updates(s, [Update("doc", "v", "x")], mode="DISABLED")
    gone = V.apply_updates(s, [Update("remove", "v")], allow_incompatible=True)
    assert V.apply_updates(gone, [Update("add", "v", "string")]).find("v").id == 3
    assert V.apply_updates(s, [Update("type", "v", "bigint"), Update("doc", "v", "d")]).find("v").type == "bigint"
