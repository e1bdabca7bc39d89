"""Keyed merge operators: dedupe, upsert, partial upsert, equality delete, ordered replay.

All are DataFrame to DataFrame. Keys compare null-safely (null equals null and differs from the empty string). Empty
inputs give empty results. Rows that tie in every order column are told apart by the remaining columns, so results
don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: Deltas folded before the lineage is cut.
CUT_EVERY = 10


def same(left: str, right: str, keys: Iterable[str]) -> Column:
    """Null-safe equality of ``keys`` between two aliases."""
    return reduce(lambda a, k: a & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")), keys, F.lit(True))


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, T.MapType | T.VariantType | T.CalendarIntervalType)


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in ascending ``order``; nulls in order columns come first.

    One shuffle with a partial aggregation before it, so a key that holds a third of all rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    ties = [c for c in rest if c not in order and _orderable(df.schema[c].dataType)]
    if not keys:
        return df
    best = df.groupBy(*[f"`{k}`" for k in keys]).agg(F.max_by(F.struct(*[f"`{c}`" for c in rest] or [F.lit(0).alias("_")]), F.struct(*[F.col(f"`{c}`") for c in [*order, *ties]] or [F.lit(0)])).alias("__row"))
    return best.select(*[f"`{k}`" for k in keys], *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*[f"`{c}`" for c in df.columns])


@dataclass(frozen=True)
class MergeOrder:
    """A merge-order column: ascending keeps the smallest value, descending the largest.

    ``nulls_win`` decides between null and a value; by default a null loses.
    """

    column: str
    ascending: bool = True
    nulls_win: bool = False


def dedupe_merge_order(df: DataFrame, keys: Sequence[str], orders: Sequence[MergeOrder], seq: Sequence[str]) -> DataFrame:
    """One row per key: the merge order decides, of equals the last in ``seq``. Only rows of ``df`` compete."""
    by = []
    for o in orders:
        c = F.col(f"`{o.column}`")
        if o.ascending:
            by.append(c.asc_nulls_first() if o.nulls_win else c.asc_nulls_last())
        else:
            by.append(c.desc_nulls_first() if o.nulls_win else c.desc_nulls_last())
    by += [F.col(f"`{s}`").desc_nulls_last() for s in seq]
    w = Window.partitionBy(*[f"`{k}`" for k in keys]).orderBy(*by)
    # rank = 1 filters are pushed below the shuffle as a group limit, so a hot key sends one row per task
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def dedupe_event_time(df: DataFrame, keys: Sequence[str], event_time: str, seq: Sequence[str]) -> DataFrame:
    """Without a merge order, the latest event time wins, then ``seq``."""
    return dedupe_last(df, keys, [event_time, *seq])


def dedupe_operations(df: DataFrame, keys: Sequence[str], order: Sequence[str], operation: str = "op") -> DataFrame:
    """Rows with an operation column: the last one of a key stands if it is UPSERT; a DELETE removes the key."""
    return dedupe_last(df, keys, order).filter(F.upper(F.trim(F.col(operation))) != "DELETE")


def merge_keyless(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts, by name; columns a part lacks are null. Also the result when duplicates are kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def upsert(base: DataFrame, increment: DataFrame, keys: Sequence[str], seq: Sequence[str] = (), orders: Sequence[MergeOrder] = ()) -> DataFrame:
    """Base rows whose key is not in the increment, and the increment's row for every key it has.

    ``seq`` and ``orders`` choose among several rows of one key in the increment; base rows never compete.
    """
    inc = dedupe_merge_order(increment, keys, orders, seq) if orders else dedupe_last(increment, keys, seq)
    kept = base.alias("b").join(inc.select(*[f"`{k}`" for k in keys]).alias("i"), same("b", "i", keys), "left_anti")
    return kept.unionByName(inc.select(*[f"`{c}`" for c in inc.columns if c in base.columns or c not in seq]), allowMissingColumns=True)


def upsert_partial(base: DataFrame, increment: DataFrame, keys: Sequence[str], seq: Sequence[str] = (), defaults: dict[str, object] | None = None) -> DataFrame:
    """Columns that the increment lacks keep their old values; nulls that it gives overwrite.

    A new key takes ``defaults`` (else null) in the columns that the increment lacks. The markers, not the values, tell
    whether a side has the key, so a null is never mistaken for a missing row.
    """
    inc = dedupe_last(increment, keys, seq).drop(*[s for s in seq if s not in base.columns])
    b, i = base.withColumn("__has", F.lit(True)).alias("b"), inc.withColumn("__has", F.lit(True)).alias("i")
    x = b.join(i, same("b", "i", keys), "full")
    new, old = F.col("i.__has").isNotNull(), F.col("b.__has").isNotNull()
    cols = []
    for c in [*base.columns, *[c for c in inc.columns if c not in base.columns]]:
        default = F.lit((defaults or {}).get(c))
        if c not in inc.columns:
            cols.append(F.when(old, F.col(f"b.`{c}`")).otherwise(default).alias(c))
        elif c not in base.columns:
            cols.append(F.when(new, F.col(f"i.`{c}`")).alias(c))
        else:
            cols.append(F.when(new, F.col(f"i.`{c}`")).otherwise(F.col(f"b.`{c}`")).alias(c))
    return x.select(*cols)


def equality_delete(base: DataFrame, deletes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``base`` that equal no delete row in ``columns``; nulls are equal. Columns that base lacks are ignored.

    Without any common column nothing is deleted.
    """
    on = [c for c in columns if c in base.columns and c in deletes.columns]
    if not on:
        return base
    d = deletes.select(*[f"`{c}`" for c in on]).distinct()
    return base.alias("b").join(d.alias("d"), same("b", "d", on), "left_anti")


@dataclass(frozen=True)
class Delta:
    """A batch of rows at a stream position: ``kind`` is upsert or delete, ``columns`` what a delete compares."""

    position: int
    kind: str
    rows: DataFrame
    columns: tuple[str, ...] | None = None


def runs(deltas: Iterable[Delta]) -> list[list[Delta]]:
    """Deltas in order of position, grouped into runs of one kind (and, of deletes, of one column list)."""
    ordered = sorted(deltas, key=lambda d: d.position)
    return [list(g) for _, g in groupby(ordered, key=lambda d: (d.kind, d.columns))]


def replay(base: DataFrame | None, deltas: Iterable[Delta], keys: Sequence[str], seq: Sequence[str] = (), orders: Sequence[MergeOrder] = ()) -> DataFrame | None:
    """Applies runs of upserts and deletes in order of position; a delete affects only what stands at that moment.

    A later upsert brings a deleted key back. ``seq`` orders rows inside a delta. The lineage is cut every CUT_EVERY runs.
    """
    state = base
    for n, run in enumerate(runs(deltas), 1):
        if run[0].kind == "delete":
            if state is None:
                continue
            rows = merge_keyless([d.rows for d in run])
            state = equality_delete(state, rows, run[0].columns or keys)
        else:
            rows = merge_keyless([d.rows.withColumn("__pos", F.lit(d.position)) for d in run])
            order = ["__pos", *seq]
            if state is None:
                state = (dedupe_merge_order(rows, keys, orders, order) if orders else dedupe_last(rows, keys, order)).drop("__pos")
            else:
                state = upsert(state, rows, keys, order, orders).drop("__pos")
        if n % CUT_EVERY == 0 and state is not None:
            state = cut(state)
    return state


def replay_by_key(changes: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str = "kind") -> DataFrame:
    """Single-pass replay for deletes on exactly the keys: the last change of a key stands unless it is a delete."""
    return dedupe_operations(changes, keys, order, kind)
