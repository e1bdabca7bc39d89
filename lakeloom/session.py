"""Session helpers: the shared folder of a cluster, guarded broadcasts, table loading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side may be broadcast up to this many rows, counted before the hint is given.
BROADCAST_ROWS = 250_000
#: ... whose texts and nested values take at most so many bytes.
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where it is unset and the master is local, a temporary folder is made once and set as checkpoint folder.
    On a cluster without the setting this raises, as a machine-local folder would lose data.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if told:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(told)
        return told
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lakeloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return own


def ship() -> None:
    """Sends this package to the Python workers, once per context, so that they need no path of their own to it."""
    sc = SparkSession.active().sparkContext
    if getattr(sc, "_lakeloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    own = tempfile.mkdtemp(prefix="lakeloom-code-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    target = os.path.join(own, "lakeloom.zip")  # the driver serves it
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("lakeloom", os.path.relpath(path, here)))
    sc.addPyFile(target)
    sc._lakeloom_shipped = True


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/lakeloom/{purpose}-{uuid.uuid4().hex}"


#: Shuffle files go as soon as the query that made them has ended; what was written no longer needs them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, each query's shuffle files are removed at its end; the session's own setting comes back afterwards."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` with its lineage cut: written to the shared folder as compressed columns and read again.

    A lost executor loses nothing of it. ``replaces`` is an earlier cut that is no longer needed; its files are deleted.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if replaces is not None and (old := getattr(replaces, "_cut_path", None)):
        remove(spark, old)
    for paths in _scratch[-1:]:
        paths.append(path)
    return out


_scratch: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The cuts made inside are deleted at the end, so a step that has published its result leaves nothing else behind."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def bounded_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is small, else unchanged (Spark then shuffles).

    Small is at most ``rows`` rows (BROADCAST_ROWS if None) whose texts, bytes and nested values take at most BROADCAST_BYTES; both
    are measured, on no more than one row beyond the bound.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    sizes = [F.octet_length(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
    sizes += [F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))) for f in df.schema if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    width = F.sum(sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(0).cast("long")))
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), width).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that costs more than reading.

    Only an input of few files is shuffled; a large one has enough partitions and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
