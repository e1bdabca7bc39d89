"""Readers and writers."""

import decimal

import pytest
from pyspark.sql import types as T

from lakeloom.sources import formats as S


def test_content_types():
    assert S.content_type("s3://a/b.csv.gz") == (S.CSV, "gzip") and S.content_type("x.PQ ") == (S.PARQUET, None) and S.content_type("x") == (S.BINARY, None) and S.content_type("a/b.tsv?x=1") == (S.TSV, None)


@pytest.mark.parametrize("kind", [S.PARQUET, S.ORC, S.JSON, S.CSV, S.TSV, S.PSV, S.FEATHER])
def test_round_trip(spark, rows, tmp_path, kind):
    df = spark.createDataFrame([(1, 'a,"b"', 1.5), (2, "c|d\te", None), (None, "ü", 0.0)], "i int, s string, d double")
    files = S.write(df, f"{tmp_path}/x", kind, records_per_file=2)
    assert len(files) >= 2
    back = S.read(spark, f"{tmp_path}/x", kind, None if kind == S.FEATHER else df.schema).select("i", "s", "d")
    assert rows(back) == rows(df)


def test_unescaped_text_and_booleans(spark, rows, tmp_path):
    (tmp_path / "x.tsv").write_text('a\tb\n"q\tt\nz\tf\n')
    schema = T._parse_datatype_string("a string, b boolean")
    assert rows(S.read_delimited(spark, [f"{tmp_path}/x.tsv"], S.RAW_TSV, schema, S.Delimited(booleans=("t", "f")))) == [('"q', True), ("z", False)]


def test_decimals_are_rounded_half_even_and_overflow_fails(spark, rows, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\nx,0.125\ny,0.375\nz,-2.5\n")
    schema = T._parse_datatype_string("a string, b decimal(4,2)")
    assert rows(S.read_delimited(spark, [f"{tmp_path}/x.csv"], S.CSV, schema)) == [("x", decimal.Decimal("0.12")), ("y", decimal.Decimal("0.38")), ("z", decimal.Decimal("-2.50"))]
    (tmp_path / "y.csv").write_text("a,b\nx,123.4\n")
    with pytest.raises(Exception, match="(?i)overflow|out of range|cannot be represented"):
        S.read_delimited(spark, [f"{tmp_path}/y.csv"], S.CSV, schema).collect()


def test_missing_connectors_say_so(spark):
    for name in ("iceberg", "hudi"):
        with pytest.raises(S.ConnectorUnavailable):
            S.read(spark, ["x"], name)


def test_projection_ignores_case(spark):
    df = spark.createDataFrame([(1,)], "Ab int")
    assert S.project(df, ["aB"]).columns == ["Ab"]
    with pytest.raises(ValueError):
        S.project(df, ["x"])


def test_reader_gate():
    with pytest.raises(S.ReaderIncompatible):
        S.check_readers(T._parse_datatype_string("m map<string,int>"), S.CSV)
    S.check_readers(T._parse_datatype_string("m map<string,int>"), S.PARQUET)


def test_many_urls_and_manifest(spark, rows, tmp_path):
    a, b = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string")
    a.coalesce(1).write.parquet(f"{tmp_path}/a.parquet")
    b.coalesce(1).write.json(f"{tmp_path}/b.json")
    assert sorted(r["a"] for r in S.read_urls(spark, [f"{tmp_path}/a.parquet", f"{tmp_path}/b.json"]).collect()) == [1, 2]
    m = spark.createDataFrame([(f"{tmp_path}/a.parquet", S.PARQUET), (f"{tmp_path}/b.json", None)], "path string, meta_content_type string")
    assert S.from_manifest(spark, m).count() == 2
    S.copy_with(spark, f"{tmp_path}/a.parquet", f"{tmp_path}/c.json", [lambda d: d.selectExpr("a + 1 AS a")], S.PARQUET)
    assert rows(spark.read.json(f"{tmp_path}/c.json")) == [(2,)]
