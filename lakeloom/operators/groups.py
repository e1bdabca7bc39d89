"""Field-group datasets: column groups that share a merge key, written apart and read as one table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.store import VersionedFolder
from .merge import same


def newest_per_group(rows: DataFrame, key: str, level: str = "__level", position: str = "__position") -> DataFrame:
    """One row per key of a column group: the lowest level wins, then the newest position."""
    w = Window.partitionBy(key).orderBy(F.col(level).asc_nulls_last(), F.col(position).desc_nulls_last())
    return rows.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def merge_groups(groups: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join of column groups on the key. A column of several groups takes the last group that has the row.

    Rows that a group lacks are null in its columns; a null that a later group gives overwrites. A null key is a key.
    """
    out = groups[0].withColumn("__h0", F.lit(True))
    for n, g in enumerate(groups[1:], 1):
        a, b = out.alias("a"), g.withColumn("__h", F.lit(True)).alias("b")
        x = a.join(b, same("a", "b", [key]), "full")
        has_a, has_b = F.col("a.__h0").isNotNull(), F.col("b.__h").isNotNull()
        cols: list[Column] = [F.when(has_b, F.col(f"b.`{key}`")).otherwise(F.col(f"a.`{key}`")).alias(key)]
        for c in [c for c in out.columns if c not in (key, "__h0")]:
            cols.append((F.when(has_b, F.col(f"b.`{c}`")).otherwise(F.col(f"a.`{c}`")) if c in g.columns else F.col(f"a.`{c}`")).alias(c))
        cols += [F.when(has_b, F.col(f"b.`{c}`")).alias(c) for c in g.columns if c not in out.columns]
        out = x.select(*cols, F.when(has_a | has_b, True).alias("__h0"))
    return out.drop("__h0")


def merge_tables(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer merge of two tables in which the right one wins."""
    return merge_groups([left, right], key)


def in_range(key: Column, low: object = None, high: object = None) -> Column:
    """Key ranges include both ends; None is open."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (key >= F.lit(low))
    if high is not None:
        ok = ok & (key <= F.lit(high))
    return ok


@dataclass(frozen=True)
class Shard:
    """Keys from ``low`` to ``high``; ``open_end`` leaves the upper end out (string shards)."""

    low: object
    high: object
    open_end: bool = False

    def column(self, key: Column) -> Column:
        upper = key < F.lit(self.high) if self.open_end else key <= F.lit(self.high)
        return (key >= F.lit(self.low)) & upper

    def meet(self, low: object = None, high: object = None) -> tuple[object, object, bool] | None:
        """The intersection with a key range, or None if it is empty."""
        a = self.low if low is None or low < self.low else low
        b, open_end = (self.high, self.open_end) if high is None or high >= self.high else (high, False)
        return None if a > b or (a == b and open_end) else (a, b, open_end)


def range_shards(low: object, high: object, n: int) -> list[Shard]:
    """``n`` neighbouring shards of [low, high]: whole numbers without common keys, strings half-open but for the last.

    Fewer come out where the range has fewer keys than ``n``.
    """
    if n < 1:
        raise ValueError("at least one shard")
    if isinstance(low, str):
        width = max(len(low), len(high), 4)
        num = lambda s: sum(ord(c) << 16 * (width - 1 - i) for i, c in enumerate(s))
        def text(v: int) -> str:
            signs = [(v >> 16 * (width - 1 - i)) & 0xFFFF for i in range(width)]
            return "".join(chr(0xD7FF if 0xD800 <= s <= 0xDFFF else s) for s in signs).rstrip("\x00")

        a, b = num(low), num(high)
        marks = sorted({low, *(text(a + (b - a) * i // n) for i in range(1, n)), high})
        if len(marks) == 1:
            return [Shard(low, high)]
        return [Shard(x, y, y != high) for x, y in zip(marks, marks[1:], strict=False)]
    out, start = [], low
    for i in range(1, n + 1):
        end = low + (high - low) * i // n
        if end >= start:
            out.append(Shard(start, end))
            start = end + 1
    return out


@dataclass
class FieldGroups:
    """A dataset of column groups in a versioned folder: add schemas, write rows, scan the merged table.

    Every flush writes one file set sorted by key at level 0 of its group; a scan reads only the groups whose columns are
    asked for, and the key range reaches the Parquet footers because files are sorted by key.
    """

    spark: SparkSession
    path: str
    key: str
    schemas: dict[str, T.StructType] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.store = VersionedFolder(self.spark, self.path)

    def add_schema(self, name: str, schema: T.StructType) -> None:
        """Adds a column group; a field of the same name must have the same type everywhere."""
        if self.key not in schema.names:
            raise ValueError(f"group {name} lacks the merge key {self.key}")
        for f in schema.fields:
            for other, s in self.schemas.items():
                if f.name in s.names and s[f.name].dataType != f.dataType:
                    raise ValueError(f"field {f.name} is {s[f.name].dataType.simpleString()} in {other} and {f.dataType.simpleString()} in {name}")
        self.schemas[name] = schema

    def add_fields(self, name: str, fields: Sequence[T.StructField]) -> None:
        self.add_schema(name, T.StructType([*self.schemas.get(name, T.StructType()).fields, *fields]))

    @classmethod
    def from_files(cls, spark: SparkSession, path: str, key: str, source: str, kind: str = "parquet", schema_mode: str = "union") -> FieldGroups:
        """A dataset whose first group is read from files; ``schema_mode`` union or intersect decides on differing columns."""
        reader = spark.read.option("header", True).option("inferSchema", True)
        if kind == "parquet":
            rows = spark.read.option("mergeSchema", schema_mode == "union").parquet(source)
            if schema_mode == "intersect":
                files = [r[0] for r in rows.select(F.input_file_name()).distinct().collect()]  # one row per file
                common = set.intersection(*[set(spark.read.parquet(f).columns) for f in files]) if files else set(rows.columns)
                rows = rows.select(*[c for c in rows.columns if c in common])
        else:
            rows = reader.format(kind).load(source)
        out = cls(spark, path, key)
        out.add_schema("all", rows.schema)
        out.write("all", rows)
        return out

    def _files(self) -> list[dict]:
        v = self.store.latest()
        return [] if v is None else self.store.commit(v)["files"]

    def write(self, group: str, rows: DataFrame, level: int = 0) -> int:
        """Writes rows of a group sorted by key and commits them; returns the position."""
        schema = self.schemas[group]
        at = self.store.stage()
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields if f.name in rows.columns]).repartitionByRange(self.key).sortWithinPartitions(self.key).write.parquet(at)
        while True:
            base, files = self.store.latest(), self._files()
            position = max((f["position"] for f in files), default=0) + 1
            try:
                self.store.publish(at, base, files=[*files, {"group": group, "path": at, "level": level, "position": position}])
                return position
            except Exception as e:
                if type(e).__name__ != "Conflict":
                    raise

    def scan(self, columns: Sequence[str] | None = None, low: object = None, high: object = None, shard: Shard | None = None) -> DataFrame:
        """The merged table: all columns or some, all keys or a range, meeting a shard if one is given."""
        wanted = list(columns) if columns is not None else None
        ordered: list[tuple[int, int, DataFrame]] = []
        for name, schema in self.schemas.items():
            if wanted is not None and not set(wanted) & set(schema.names) - {self.key} and wanted != [self.key]:
                continue
            parts = [f for f in self._files() if f["group"] == name]
            if not parts:
                continue
            rows = None
            for f in parts:
                x = self.spark.read.schema(schema).parquet(f["path"]).withColumn("__level", F.lit(f["level"])).withColumn("__position", F.lit(f["position"]))
                rows = x if rows is None else rows.unionByName(x)
            if wanted is not None:
                rows = rows.select(*[c for c in rows.columns if c in {*wanted, self.key, "__level", "__position"}])
            rows = rows.filter(in_range(F.col(self.key), low, high))
            if shard is not None:
                rows = rows.filter(shard.column(F.col(self.key)))
            one = newest_per_group(rows, self.key).drop("__level", "__position")
            ordered.append((min(f["level"] for f in parts), max(f["position"] for f in parts), one))
        if not ordered:
            return self.spark.createDataFrame([], T.StructType([f for s in self.schemas.values() for f in s.fields if f.name == self.key][:1]))
        # groups of later (level, position) overwrite
        merged = merge_groups([g for _, _, g in sorted(ordered, key=lambda x: x[:2])], self.key)
        return merged if wanted is None else merged.select(*wanted)

    def lookup(self, key: object, columns: Sequence[str] | None = None) -> DataFrame:
        return self.scan(columns, key, key)

    def shards(self, n: int) -> list[Shard]:
        """Shards of the present key range."""
        found = None
        for name in self.schemas:
            for f in self._files():
                if f["group"] == name:
                    x = self.spark.read.schema(self.schemas[name]).parquet(f["path"]).agg(F.min(self.key).alias("a"), F.max(self.key).alias("b"))
                    found = x if found is None else found.unionByName(x)
        if found is None:
            return []
        r = found.agg(F.min("a").alias("a"), F.max("b").alias("b")).first()
        return [] if r["a"] is None else range_shards(r["a"], r["b"], n)

    def export(self, path: str, kind: str = "parquet") -> None:
        self.scan().write.format(kind).save(path)


@dataclass
class LogicalPlan:
    """A list of steps on a dataset that runs when collected."""

    source: FieldGroups
    steps: list[tuple[str, object]] = field(default_factory=list)

    def select(self, *columns: str) -> LogicalPlan:
        return LogicalPlan(self.source, [*self.steps, ("select", columns)])

    def map(self, f: Callable, schema: str) -> LogicalPlan:
        """``f`` takes and gives an iterator of pandas frames."""
        return LogicalPlan(self.source, [*self.steps, ("map", (f, schema))])

    def collect(self) -> DataFrame:
        df = self.source.scan()
        for kind, what in self.steps:
            df = df.select(*what) if kind == "select" else df.mapInPandas(*what)
        return df
