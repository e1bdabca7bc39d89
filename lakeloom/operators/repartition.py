"""Range and hash repartitioning, file statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_number(column: str, ranges: Sequence[int]) -> Column:
    """Number of the range (lo, hi] that the column, as a whole number, falls in; nulls go to the first.

    The first range is closed below, values above the last bound go to a range of their own.
    """
    v = F.col(f"`{column}`").cast("long")
    bounds = sorted(ranges)
    out = F.lit(len(bounds))
    for n, hi in reversed(list(enumerate(bounds))):
        out = F.when(v <= F.lit(hi), F.lit(n)).otherwise(out)
    return F.when(v.isNull(), F.lit(0)).otherwise(out)


def range_repartition(df: DataFrame, column: str, ranges: Sequence[int], path: str, records_per_file: int = 4_000_000) -> list[str]:
    """Writes one folder per range, files of at most ``records_per_file`` rows; returns the folders.

    A range is spread by the salted second key over as many tasks as a shuffle has for each range, so one range with
    most rows is not one task.
    """
    n = len(ranges) + 1
    salts = max(4, -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n))
    x = df.withColumn("_range", range_number(column, ranges))
    x.repartition(n * salts, "_range", F.pmod(F.xxhash64(*[f"`{c}`" for c in df.columns if not df.schema[c].dataType.simpleString().startswith("map")]), F.lit(salts))).write.option("maxRecordsPerFile", records_per_file).partitionBy("_range").parquet(path)
    return [f"{path}/_range={k}" for k in range(n)]


def hash_repartition(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    return df.repartition(n, *[f"`{c}`" for c in columns])


def column_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, and per column nulls, least, greatest and text bytes; a single partial aggregation."""
    cols = list(columns) if columns is not None else df.columns
    out = [F.count(F.lit(1)).alias("rows")]
    for c in cols:
        x = F.col(f"`{c}`")
        out += [F.count_if(x.isNull()).alias(f"{c}_nulls"), F.min(x).cast("string").alias(f"{c}_min"), F.max(x).cast("string").alias(f"{c}_max"), F.coalesce(F.sum(F.octet_length(x.cast("string"))), F.lit(0)).alias(f"{c}_bytes")]
    return df.agg(*out)


def file_statistics(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Files, rows and bytes of manifest entries, in total or by columns."""
    g = entries.groupBy(*by) if by else entries.groupBy()
    return g.agg(F.count(F.lit(1)).alias("files"), F.sum("meta_record_count").alias("records"), F.sum("meta_content_length").alias("bytes"), F.sum("meta_source_content_length").alias("source_bytes"))


def merge_statistics(parts: Sequence[DataFrame]) -> DataFrame:
    """Statistics of several deltas as one."""
    x = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return x.agg(*[F.sum(c).alias(c) for c in ("files", "records", "bytes", "source_bytes")])
