"""Key strings, hash buckets and partition transforms as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Delimiters of key strings (compaction, conversion).
KEY_DELIMITER, CONVERTER_DELIMITER = "L6kl7u5f", "c303282d"


def key_string(keys: Sequence[str], delimiter: str = KEY_DELIMITER) -> Column:
    """Keys as one string; null is the empty string, as the bucket layout demands."""
    return F.concat_ws(delimiter, *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys])


def key_digest(keys: Sequence[str], delimiter: str = KEY_DELIMITER) -> Column:
    """SHA-1 of the key string, in hex."""
    return F.sha1(key_string(keys, delimiter))


def digest_bucket(hex_digest: Column, n: int) -> Column:
    """The 160-bit digest modulo ``n``: Horner's rule over four 40-bit pieces; a null digest is bucket 0."""
    if not 0 < n < 2**23:
        raise ValueError("bucket counts lie between 1 and 2^23 - 1")
    acc = F.lit(0).cast("long")
    for k in range(4):
        piece = F.conv(F.substring(hex_digest, 1 + 10 * k, 10), 16, 10).cast("long")
        acc = (acc * F.lit(2**40 % n) + piece) % n
    return F.coalesce(acc, F.lit(0)).cast("int")


def hash_bucket(keys: Sequence[str], n: int) -> Column:
    return digest_bucket(key_digest(keys), n)


def hash_group(bucket: Column, groups: int) -> Column:
    return (bucket % groups).cast("int")


def misplaced(df: DataFrame, keys: Sequence[str], n: int, bucket: str) -> DataFrame:
    """Rows that lie in another bucket than their key's."""
    return df.filter(~F.col(bucket).eqNullSafe(hash_bucket(keys, n)))


def murmur3(values: Sequence[bytes], seed: int = 0) -> np.ndarray:
    """32-bit murmur3 of the public specification of many values at once; values of one length share every step."""
    out = np.zeros(len(values), dtype=np.uint32)
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        whole, rest = divmod(size, 4)
        raw = np.frombuffer(b"".join(values[n] for n in rows.tolist()), dtype=np.uint8).reshape(len(rows), size)
        h = np.full(len(rows), seed, dtype=np.uint32)
        blocks = np.ascontiguousarray(raw[:, : 4 * whole]).view("<u4") if whole else np.zeros((len(rows), 0), dtype=np.uint32)
        for k in range(whole):
            h = turn(h ^ turn(blocks[:, k] * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        if rest:
            tail = np.zeros((len(rows), 4), dtype=np.uint8)
            tail[:, :rest] = raw[:, 4 * whole :]
            h ^= turn(tail.view("<u4")[:, 0] * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h ^= np.uint32(size)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        out[rows] = h ^ h >> np.uint32(16)
    return out


def _murmur3(data: bytes, seed: int = 0) -> int:
    """``murmur3`` of one value."""
    return int(murmur3([data], seed)[0])


def table_format_hash(column: str, kind: T.DataType) -> Column:
    """The hash of the public table-format specification, signed: murmur3 with seed 0 over the value's bytes; null stays null.

    Spark's own hash uses another seed and other padding, so this is a UDF over the one column, vectorised by lengths.
    """
    ship()

    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        of = lambda v: v if isinstance(v, bytes) else v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True)
        out = pd.array([None] * len(values), dtype="Int32")
        out[known] = murmur3([of(v) for v in values[known]]).view(np.int32)
        return pd.Series(out)

    c = F.col(f"`{column}`")
    if isinstance(kind, T.DateType):
        c = F.datediff(c, F.lit("1970-01-01").cast("date"))
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.IntegralType):
        c = c.cast("long")
    elif not isinstance(kind, T.StringType | T.BinaryType):
        raise TypeError(f"no bucket for {kind.simpleString()}")
    return F.when(c.isNotNull(), run(F.coalesce(c, F.lit(0).cast("long")) if not isinstance(kind, T.StringType | T.BinaryType) else c))


def table_format_bucket(column: str, kind: T.DataType, n: int) -> Column:
    """Bucket of the public table-format specification: the hash without its sign, by the number of buckets."""
    return F.pmod(table_format_hash(column, kind).bitwiseAND(0x7FFFFFFF), F.lit(n)).cast("int")


@dataclass(frozen=True)
class Transform:
    """identity, bucket, truncate, year, month, day, hour, void or unknown, with a width or a bucket count."""

    name: str
    size: int | None = None
    strategy: str = "default"

    def column(self, df: DataFrame, column: str) -> Column:
        """The transform's value for each row; null stays null. An unknown transform raises."""
        kind, c = df.schema[column].dataType, F.col(f"`{column}`")
        if self.name == "identity":
            return c
        if self.name == "bucket":
            if not self.size or self.size < 1:
                raise ValueError("a bucket transform needs a positive count")
            return hash_bucket([column], self.size) if self.strategy == "default" else table_format_bucket(column, kind, self.size)
        if self.name == "truncate":
            if not self.size or self.size < 1:
                raise ValueError("a truncate transform needs a positive width")
            if isinstance(kind, T.StringType):
                return F.substring(c, 1, self.size)
            if isinstance(kind, T.IntegralType):
                return c - F.pmod(c, F.lit(self.size).cast(kind))
            raise TypeError(f"no truncation of {kind.simpleString()}")
        if self.name in ("year", "month", "day", "hour"):
            if not isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
                raise TypeError(f"{self.name} needs a date or a time, not {kind.simpleString()}")
            if self.name == "year":
                return (F.year(c) - 1970).cast("int")
            if self.name == "month":
                return ((F.year(c) - 1970) * 12 + F.month(c) - 1).cast("int")
            days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))
            return days.cast("int") if self.name == "day" else (days * 24 + F.hour(c)).cast("int")
        if self.name == "void":
            return F.lit(None).cast(kind)
        raise NotImplementedError(f"transform {self.name} can't be evaluated")


def partition_values(df: DataFrame, scheme: Sequence[tuple[str, Transform, str]]) -> DataFrame:
    """``df`` with a column per partition key: (source column, transform, name)."""
    return df.withColumns({name: t.column(df, source) for source, t, name in scheme})


def sort_columns(keys: Sequence[tuple[str, bool, bool]]) -> list[Column]:
    """Sort keys (column, ascending, nulls first) as columns."""
    out = []
    for name, ascending, nulls_first in keys:
        c = F.col(f"`{name}`")
        out.append((c.asc_nulls_first() if nulls_first else c.asc_nulls_last()) if ascending else c.desc_nulls_first() if nulls_first else c.desc_nulls_last())
    return out


#: Widths in bits that count against a sort key's limit.
SORT_BITS = {"boolean": 8, "tinyint": 8, "smallint": 16, "int": 32, "bigint": 64, "float": 32, "double": 64, "date": 32, "timestamp": 64, "timestamp_ntz": 64}


def check_sort_keys(schema: T.StructType, keys: Sequence[tuple[str, Transform]]) -> None:
    """Unique names, identity transforms, at most 256 bits of fixed-width types together."""
    names = [k for k, _ in keys]
    if len({n.lower() for n in names}) != len(names):
        raise ValueError("sort keys must be unique")
    if any(t.name != "identity" for _, t in keys):
        raise ValueError("sort keys allow no transform but identity")
    known = [SORT_BITS.get(schema[n].dataType.simpleString()) for n in names]
    if sum(b for b in known if b) > 256:
        raise ValueError("sort keys are wider than 256 bits")
