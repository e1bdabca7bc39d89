"""Turning equality deletes and key duplicates into position deletes, and applying those."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .merge import same

#: Columns of a position delete.
POSITION = ["file_path", "pos"]


def with_positions(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of Parquet files with their file and row number; only ``columns`` are read."""
    df = spark.read.parquet(*paths)
    chosen = list(columns) if columns is not None else df.columns
    return df.select(*[f"`{c}`" for c in chosen], F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("pos"))


def applicable(delete_seq: Column, data_seq: Column) -> Column:
    """A delete applies to data of an earlier sequence number only."""
    return delete_seq > data_seq


def equality_to_positions(data: DataFrame, deletes: DataFrame, keys: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """(file_path, pos) of data rows that an applicable equality delete equals in ``keys`` and ``partition``.

    Both sides have ``seq``. Of each deleted key only the greatest sequence number matters, so the delete side is
    aggregated first and the join stays an equi-join with one comparison on top.
    """
    on = [*partition, *keys]
    last = deletes.groupBy(*on).agg(F.max("seq").alias("seq"))
    hit = data.alias("d").join(last.alias("x"), same("d", "x", on) & applicable(F.col("x.seq"), F.col("d.seq")), "left_semi")
    return hit.select(*POSITION)


def duplicate_positions(data: DataFrame, keys: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """(file_path, pos) of all but the last record of each key, files ordered by sequence number and path.

    The survivor per key is an aggregate (partial before the shuffle); the others are found by an anti join, which the
    adaptive skew join splits for hot keys, instead of a window that would sort a hot key in one task.
    """
    on = [*partition, *keys]
    last = data.groupBy(*on).agg(F.max(F.struct("seq", "file_path", "pos")).alias("_last"))
    kept = last.select("_last.file_path", "_last.pos")
    return data.select(*POSITION).join(kept, POSITION, "left_anti")


def apply_positions(data: DataFrame, positions: DataFrame) -> DataFrame:
    """Data rows whose (file_path, pos) no position delete names."""
    return data.join(positions.select(*POSITION).distinct(), POSITION, "left_anti").select(*data.columns)


def write_positions(positions: DataFrame, path: str, files: int | None = None) -> None:
    """Position deletes sorted by file and row, as readers expect them."""
    x = positions.select(*POSITION).distinct()
    x = x.repartition(files, "file_path") if files else x.repartition("file_path")
    x.sortWithinPartitions(*POSITION).write.parquet(path)


def snapshot_kind(added_data: int, removed_data: int, added_deletes: int, removed_deletes: int) -> str:
    """NONE, APPEND, REPLACE or DELETE, from the files that a commit adds and removes."""
    if not (added_data or removed_data or added_deletes or removed_deletes):
        return "NONE"
    if removed_data or removed_deletes:
        return "REPLACE" if added_data or added_deletes else "DELETE"
    return "APPEND" if added_data and not added_deletes else "DELETE"


@dataclass
class FileSet:
    """The files of one snapshot: (path, sequence number, partition value) of data, equality and position deletes."""

    data: list[tuple[str, int, str]] = field(default_factory=list)
    equality: list[tuple[str, int, str]] = field(default_factory=list)
    position: list[tuple[str, int, str]] = field(default_factory=list)

    def touched(self, since: int) -> set[str]:
        """Partition values with a file newer than ``since``; all files of those are converted."""
        return {p for files in (self.data, self.equality, self.position) for _, seq, p in files if seq > since}

    def only(self, partitions: set[str]) -> FileSet:
        keep = lambda files: [f for f in files if f[2] in partitions]
        return FileSet(keep(self.data), keep(self.equality), keep(self.position))


def _listed(spark: SparkSession, files: list[tuple[str, int, str]], columns: Sequence[str]) -> DataFrame:
    """Rows of ``files`` with seq and partition; the file list is metadata, one row per file."""
    rows = with_positions(spark, [f for f, _, _ in files], columns)
    facts = spark.createDataFrame(files, "path string, seq long, part string")
    tail = lambda c: F.regexp_replace(c, r"^[a-zA-Z0-9]+:/*", "/")
    return rows.join(facts.withColumn("_t", tail(F.col("path"))), tail(F.col("file_path")) == F.col("_t")).drop("path", "_t")


def convert(spark: SparkSession, files: FileSet, keys: Sequence[str], target: str, since: int = -1, enforce_unique: bool = True) -> tuple[FileSet, str]:
    """Converts the equality deletes of touched partitions to position deletes written to ``target``.

    Existing position deletes are applied first, so rows they removed don't come back; duplicates of a key are then
    removed if ``enforce_unique``. Returns the new snapshot's files and its kind.
    """
    work = files.only(files.touched(since))
    if not work.data:
        return files, "NONE"
    data = _listed(spark, work.data, keys)
    if work.position:
        data = apply_positions(data, spark.read.parquet(*[p for p, _, _ in work.position]))
    found = None
    alive = data
    if work.equality:
        gone = equality_to_positions(data, _listed(spark, work.equality, keys).select("part", *keys, "seq"), keys, ["part"])
        found, alive = gone, apply_positions(data, gone)
    if enforce_unique:
        double = duplicate_positions(alive, keys, ["part"])
        found = double if found is None else found.unionByName(double)
    if found is None:
        return files, "NONE"
    write_positions(found, target)
    seq = max(s for fs in (files.data, files.equality, files.position) for _, s, _ in fs) + 1
    done = {f for f in work.equality}
    new = FileSet(files.data, [f for f in files.equality if f not in done], [*files.position, *[(target, seq, p) for p in sorted({p for _, _, p in work.data})]])
    return new, snapshot_kind(0, 0, 1, len(done))
