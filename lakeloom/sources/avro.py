"""Avro container files without a connector: read to Arrow batches and written from them, one file at a time."""

from __future__ import annotations

import datetime as dt
import io
import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T

MAGIC = b"Obj\x01"
_EPOCH, _DAY = dt.datetime(1970, 1, 1), dt.date(1970, 1, 1)
ROWS = 10_000


def _long(f: io.BytesIO) -> int:
    n = shift = 0
    while True:
        b = f.read(1)[0]
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def _put_long(out: bytearray, v: int) -> None:
    n = (v << 1) ^ (v >> 63)
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def _blocks(f: io.BytesIO, one: Callable[[], Any]) -> Iterator[Any]:
    while n := _long(f):
        if n < 0:
            n = -n
            _long(f)  # bytes of the block
        for _ in range(n):
            yield one()


def _reader(schema: Any, named: dict[str, Any]) -> Callable[[io.BytesIO], Any]:
    """A function that reads one value of the schema."""
    if isinstance(schema, list):
        kinds = [_reader(s, named) for s in schema]
        return lambda f: kinds[_long(f)](f)
    kind, logical = (schema, None) if isinstance(schema, str) else (schema["type"], schema.get("logicalType"))
    if isinstance(kind, dict | list):
        return _reader(kind, named)
    if kind in named and not (isinstance(schema, dict) and ("fields" in schema or "symbols" in schema or "size" in schema)):
        known = kind
        return lambda f: named[known](f)
    text = lambda f: f.read(_long(f))
    match kind, logical:
        case "null", _:
            return lambda f: None
        case "boolean", _:
            return lambda f: f.read(1) == b"\x01"
        case "int", "date":
            return lambda f: _DAY + dt.timedelta(days=_long(f))
        case "long", "timestamp-millis" | "local-timestamp-millis":
            return lambda f: _EPOCH + dt.timedelta(milliseconds=_long(f))
        case "long", "timestamp-micros" | "local-timestamp-micros":
            return lambda f: _EPOCH + dt.timedelta(microseconds=_long(f))
        case ("int" | "long"), _:
            return _long
        case "float", _:
            return lambda f: struct.unpack("<f", f.read(4))[0]
        case "double", _:
            return lambda f: struct.unpack("<d", f.read(8))[0]
        case "bytes", "decimal":
            scale = schema.get("scale", 0)
            return lambda f: _decimal(text(f), scale)
        case "bytes", _:
            return text
        case "string", _:
            return lambda f: text(f).decode()
        case "fixed", _:
            size, scale = schema["size"], schema.get("scale", 0)
            read = (lambda f: _decimal(f.read(size), scale)) if logical == "decimal" else (lambda f: f.read(size))
            named[schema["name"]] = read
            return read
        case "enum", _:
            symbols = schema["symbols"]
            named[schema["name"]] = lambda f: symbols[_long(f)]
            return named[schema["name"]]
        case "array", _:
            item = _reader(schema["items"], named)
            return lambda f: list(_blocks(f, lambda: item(f)))
        case "map", _:
            value = _reader(schema["values"], named)
            return lambda f: dict(_blocks(f, lambda: (text(f).decode(), value(f))))
        case "record", _:
            parts: list[tuple[str, Callable]] = []
            named[schema["name"]] = lambda f: {n: r(f) for n, r in parts}
            parts += [(x["name"], _reader(x["type"], named)) for x in schema["fields"]]
            return named[schema["name"]]
    raise ValueError(f"unknown Avro type {schema}")


def _decimal(raw: bytes, scale: int):
    from decimal import Decimal

    return Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-scale)


def spark_type(schema: Any) -> T.DataType:
    """The Spark type of an Avro type; a union with null is the other type, wider unions are text."""
    if isinstance(schema, list):
        rest = [s for s in schema if s != "null"]
        return spark_type(rest[0]) if len(rest) == 1 else T.StringType()
    kind, logical = (schema, None) if isinstance(schema, str) else (schema["type"], schema.get("logicalType"))
    if isinstance(kind, dict | list):
        return spark_type(kind)
    if logical == "decimal":
        return T.DecimalType(schema["precision"], schema.get("scale", 0))
    if kind == "record":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f in schema["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(schema["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["values"]))
    if logical in ("timestamp-millis", "timestamp-micros", "local-timestamp-millis", "local-timestamp-micros"):
        return T.TimestampNTZType()
    return {"int": T.DateType() if logical == "date" else T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "enum": T.StringType(), "bytes": T.BinaryType(), "fixed": T.BinaryType()}[kind]


def header(f: Any) -> tuple[Any, str, bytes]:
    """(schema, codec, sync mark) of a container file; the stream stands at the first block afterwards."""
    if f.read(4) != MAGIC:
        raise ValueError("no Avro container file")
    text = lambda: f.read(_long(f))
    meta = dict(_blocks(f, lambda: (text().decode(), text())))
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), f.read(16)


def _unpacked(codec: str, raw: bytes) -> bytes:
    if codec == "null":
        return raw
    if codec == "deflate":
        return zlib.decompress(raw, -15)
    if codec == "zstandard":
        return _zstd(raw)
    raise ValueError(f"unknown Avro codec {codec}")


def _zstd(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


def rows(f: Any) -> Iterator[list[dict]]:
    """The records of a file, block by block."""
    schema, codec, sync = header(f)
    one = _reader(schema, {})
    while f.read(1):
        f.seek(-1, 1)
        n, size = _long(f), _long(f)
        block = io.BytesIO(_unpacked(codec, f.read(size)))
        yield [one(block) for _ in range(n)]
        if f.read(16) != sync:
            raise ValueError("a block of an Avro file is damaged")


def avro_type(kind: T.DataType, name: str) -> Any:
    """The Avro type of a Spark type; every value may be null."""
    match kind:
        case T.StructType():
            inner: Any = {"type": "record", "name": name, "fields": [{"name": f.name, "type": avro_type(f.dataType, f"{name}_{n}")} for n, f in enumerate(kind.fields)]}
        case T.ArrayType():
            inner = {"type": "array", "items": avro_type(kind.elementType, name + "_e")}
        case T.MapType():
            inner = {"type": "map", "values": avro_type(kind.valueType, name + "_v")}
        case T.DecimalType():
            inner = {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
        case T.DateType():
            inner = {"type": "int", "logicalType": "date"}
        case T.TimestampType() | T.TimestampNTZType():
            inner = {"type": "long", "logicalType": "timestamp-micros"}
        case _:
            inner = {"boolean": "boolean", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "float", "double": "double", "string": "string", "binary": "bytes"}[kind.simpleString()]
    return ["null", inner]


def _writer(kind: T.DataType) -> Callable[[bytearray, Any], None]:
    def text(out: bytearray, raw: bytes) -> None:
        _put_long(out, len(raw))
        out += raw

    match kind:
        case T.StructType():
            parts = [(f.name, _writer(f.dataType)) for f in kind.fields]
            inner = lambda out, v: [w(out, v[n]) for n, w in parts]
        case T.ArrayType():
            item = _writer(kind.elementType)

            def inner(out, v):
                if v:
                    _put_long(out, len(v))
                    for x in v:
                        item(out, x)
                out.append(0)
        case T.MapType():
            value = _writer(kind.valueType)

            def inner(out, v):
                pairs = list(v.items() if isinstance(v, dict) else v)
                if pairs:
                    _put_long(out, len(pairs))
                    for k, x in pairs:
                        text(out, k.encode())
                        value(out, x)
                out.append(0)
        case T.DecimalType():

            def inner(out, v):
                n = int(v.scaleb(kind.scale))
                text(out, n.to_bytes(n.bit_length() // 8 + 1, "big", signed=True))
        case T.DateType():
            inner = lambda out, v: _put_long(out, (v - _DAY).days)
        case T.TimestampType() | T.TimestampNTZType():
            inner = lambda out, v: _put_long(out, (v.replace(tzinfo=None) - _EPOCH) // dt.timedelta(microseconds=1))
        case T.BooleanType():
            inner = lambda out, v: out.append(bool(v))
        case T.FloatType():
            inner = lambda out, v: out.extend(struct.pack("<f", v))
        case T.DoubleType():
            inner = lambda out, v: out.extend(struct.pack("<d", v))
        case T.StringType():
            inner = lambda out, v: text(out, v.encode())
        case T.BinaryType():
            inner = lambda out, v: text(out, bytes(v))
        case _:
            inner = _put_long

    def maybe(out: bytearray, v: Any) -> None:
        if v is None:
            out.append(0)
        else:
            out.append(2)
            inner(out, v)

    return maybe


def packed(schema: T.StructType, batches: list[pa.RecordBatch]) -> bytes:
    """A container file of the rows, one deflated block per batch."""
    out, sync = bytearray(MAGIC), os.urandom(16)
    text = lambda raw: (_put_long(out, len(raw)), out.extend(raw))
    _put_long(out, 2)
    for k, v in ((b"avro.schema", json.dumps(avro_type(schema, "row")[1]).encode()), (b"avro.codec", b"deflate")):
        text(k)
        text(v)
    out.append(0)
    out += sync
    parts = [(n, _writer(f.dataType)) for n, f in enumerate(schema.fields)]
    for b in batches:
        if not b.num_rows:
            continue
        block = bytearray()
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            for n, w in parts:
                w(block, row[n])
        c = zlib.compressobj(wbits=-15)
        raw = c.compress(bytes(block)) + c.flush()
        _put_long(out, b.num_rows)
        text(raw)
        out += sync
    return bytes(out)
