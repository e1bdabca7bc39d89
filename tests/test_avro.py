"""Avro files of all types, written here and by hand."""

import datetime as dt
import io
import json
from decimal import Decimal

import pytest

from lakeloom.sources import avro, formats
from lakeloom.sources.files import copy_all, located


def test_round_trip(spark, rows, tmp_path):
    schema = "i int, l long, f float, d double, s string, b binary, t boolean, day date, ts timestamp_ntz, m decimal(20,3), a array<int>, p map<string,int>, r struct<x:int,y:string>"
    data = [
        (1, -(2**60), 1.5, -2.25, "é\n", bytearray(b"\x00\xff"), True, dt.date(1969, 12, 31), dt.datetime(2024, 1, 2, 3, 4, 5, 678901), Decimal("-12345.678"), [1, None, -3], {"k": 1, "n": None}, (7, None)),
        (None,) * 13,
        (-1, 0, 0.0, 0.0, "", bytearray(), False, dt.date(1970, 1, 1), dt.datetime(1969, 1, 1), Decimal("0.000"), [], {}, (None, "")),
    ]
    df = spark.createDataFrame(data, schema)
    files = formats.write(df.coalesce(1), str(tmp_path / "t"), formats.AVRO, records_per_file=2)
    assert len(files) == 2 and all(f.endswith(".avro") for f, _ in files)
    got = formats.read(spark, str(tmp_path / "t"), formats.AVRO)
    assert got.dtypes == df.dtypes and rows(got) == rows(df)
    assert formats.read(spark, str(tmp_path / "t"), formats.AVRO, columns=["S"]).columns == ["s"]
    with pytest.raises(FileExistsError):
        formats.write(df, str(tmp_path / "t"), formats.AVRO)


def test_foreign_files():
    """Named types, enums, fixed, wide unions, blocks with byte counts, damaged ends."""
    schema = {"type": "record", "name": "R", "fields": [{"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["A", "B"]}}, {"name": "g", "type": "E"}, {"name": "x", "type": {"type": "fixed", "name": "F", "size": 2}}, {"name": "u", "type": ["null", "long"]}, {"name": "a", "type": {"type": "array", "items": "int"}}]}
    out, sync = bytearray(avro.MAGIC), b"s" * 16
    avro._put_long(out, 1)
    for raw in (b"avro.schema", json.dumps(schema).encode()):
        avro._put_long(out, len(raw))
        out += raw
    out.append(0)
    out += sync
    row = bytearray()
    for v in (1, 0):
        avro._put_long(row, v)
    row += b"hi"
    avro._put_long(row, 1)
    avro._put_long(row, -5)
    avro._put_long(row, -2)  # two items and the bytes that they take
    avro._put_long(row, 2)
    avro._put_long(row, 3)
    avro._put_long(row, 4)
    row.append(0)
    avro._put_long(out, 1)
    avro._put_long(out, len(row))
    out += row + sync
    assert list(avro.rows(io.BytesIO(bytes(out)))) == [[{"e": "B", "g": "A", "x": b"hi", "u": -5, "a": [3, 4]}]]
    assert avro.spark_type(["null", "long", "string"]).simpleString() == "string"
    with pytest.raises(ValueError):
        list(avro.rows(io.BytesIO(bytes(out[:-1]) + b"?")))
    with pytest.raises(ValueError):
        list(avro.rows(io.BytesIO(b"none")))


def test_files_are_copied_by_tasks(spark, tmp_path):
    pairs = []
    for n in range(5):
        (tmp_path / f"a{n}").write_bytes(bytes([n]) * 1000)
        pairs.append((f"file:{tmp_path}/a{n}", f"{tmp_path}/deep/b{n}"))
    copy_all(spark, pairs)
    copy_all(spark, [])
    assert [(tmp_path / "deep" / f"b{n}").read_bytes() for n in range(5)] == [bytes([n]) * 1000 for n in range(5)]
    assert located("file:///x%20y")[1] == "/x y" and located("/plain%20")[1] == "/plain%20"
