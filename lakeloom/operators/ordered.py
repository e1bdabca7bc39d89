"""Order-dependent operators that stay distributed when one key holds a large share of all rows.

A window over one key runs in one task. Keys above ``piece_rows`` rows are therefore cut along their order into
pieces of about that size; each piece is a window of its own and the pieces are tied together by a small table with
one row per piece. The number of hot keys and of pieces is at most the row count divided by ``piece_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that one task may hold.
PIECE_ROWS = 1_000_000


def _pieces(df: DataFrame, keys: list[str], along: str, piece_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with a column ``__piece`` and, if any key is hot, the table (keys, splits) of the hot ones.

    The split points are fetched once, so that every later use of the plan sees the same pieces.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > piece_rows).collect()
    if not hot:
        return df.withColumn("__piece", F.lit(0)), None
    spark, kinds = df.sparkSession, df.select(*keys).schema
    named = spark.createDataFrame([tuple(r[k] for k in keys) for r in hot], kinds)
    most = max(r["__n"] for r in hot)
    cuts = most // piece_rows + 1
    on = _same("_a", "_b", keys)
    found = (
        df.select(*keys, along).alias("_a").join(F.broadcast(named).alias("_b"), on).groupBy(*[F.col(f"_a.{k}").alias(k) for k in keys])
        .agg(F.percentile_approx(f"_a.{along}", [i / cuts for i in range(1, cuts)] or [0.5], 10 * cuts).alias("__splits"))
    )
    splits = spark.createDataFrame(found.collect(), found.schema)
    cut = (
        df.alias("_a").join(F.broadcast(splits).alias("_b"), on, "left")
        .select("_a.*", F.coalesce(F.size(F.filter("_b.__splits", lambda x: x < F.col(f"_a.{along}"))), F.lit(0)).alias("__piece"))
    )
    # a null order value sorts first, a null comparison filters everything: both are piece 0
    return cut.withColumn("__piece", F.when(F.col("__piece") < 0, 0).otherwise(F.col("__piece"))), splits


def _same(a: str, b: str, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def running_totals(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column | None], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``df`` with a column per entry of ``values``: its sum (of 1 if None) over the rows of the key up to and with this one.

    ``order`` should end in a unique column; its first column is the one along which hot keys are cut. Nulls sort
    first; null values count as 0. An empty input gives an empty result. ``df`` is read once to count its keys and once
    more for the result, so an expensive one should be cut before.
    """
    given = {f"__v{n}": F.lit(1) if v is None else F.coalesce(v, F.lit(0)) for n, v in enumerate(values.values())}
    cut, hot = _pieces(df.withColumns(given), keys, order[0], piece_rows)
    w = Window.partitionBy(*keys, "__piece").orderBy(*[F.col(o).asc_nulls_first() for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.select("*", *[F.sum(v).over(w).alias(name) for name, v in zip(values, given, strict=True)])
    if hot is None:
        return out.drop(*given, "__piece")
    per = cut.alias("_a").join(F.broadcast(hot.select(*keys)).alias("_b"), _same("_a", "_b", keys), "left_semi").groupBy(*keys, "__piece").agg(*[F.sum(v).alias(f"{v}s") for v in given])
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offset = per.select(*keys, "__piece", *[F.coalesce(F.sum(f"{v}s").over(before), F.lit(0)).alias(f"{v}b") for v in given])
    on = _same("_a", "_o", [*keys, "__piece"])
    cols = [F.col(f"_a.{c}") for c in df.columns]
    sums = [(F.col(f"_a.{name}") + F.coalesce(F.col(f"_o.{v}b"), F.lit(0))).alias(name) for name, v in zip(values, given, strict=True)]
    return out.alias("_a").join(F.broadcast(offset).alias("_o"), on, "left").select(*cols, *sums)


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column | None, name: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``running_totals`` of one value."""
    return running_totals(df, keys, order, {name: value}, piece_rows)


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``df`` with its 1-based place inside its key."""
    out = running_total(df, keys, order, None, name, piece_rows)
    return out.withColumn(name, F.col(name).cast("int"))


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``df`` with column ``name``: ``value`` of the row before in the order of its key (null for the first)."""
    cut, hot = _pieces(df, keys, order[0], piece_rows)
    by = [F.col(o).asc_nulls_first() for o in order]
    w = Window.partitionBy(*keys, "__piece").orderBy(*by)
    out = cut.withColumn(name, F.lag(value).over(w))
    if hot is None:
        return out.drop("__piece")
    out = out.withColumn("__first", F.row_number().over(w) == 1)
    last = cut.alias("_a").join(F.broadcast(hot.select(*keys)).alias("_b"), _same("_a", "_b", keys), "left_semi").groupBy(*keys, "__piece").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__last"))
    tie = last.withColumn("__prev", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__piece"))).drop("__last")
    cols = [F.col(f"_a.{c}") for c in df.columns]
    return out.alias("_a").join(F.broadcast(tie).alias("_o"), _same("_a", "_o", [*keys, "__piece"]), "left").select(*cols, F.when(F.col("_a.__first"), F.col("_o.__prev.v")).otherwise(F.col(f"_a.{name}")).alias(name))
