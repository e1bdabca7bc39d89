"""Processing only new or changed deltas since the last successful run of their partition."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import VersionedFolder
from ..session import bounded_broadcast, cut, scratch, shared_path, shuffles_removed
from . import merkle

KEY = ["stream_id", "partition_id", "stream_position"]
STATE = ["manifest_id"]


def last_runs(run_log: DataFrame) -> DataFrame:
    """(stream_id, partition_id, as_of): the latest snapshot read by a run that ended in SUCCESS.

    Run ids, watermarks and end times are not trusted; repeated rows change nothing; a run without ``as_of`` saw nothing.
    """
    good = run_log.filter((F.upper(F.trim("status")) == "SUCCESS") & F.col("as_of").isNotNull())
    return good.groupBy("stream_id", "partition_id").agg(F.max("as_of").alias("as_of"))


def versions(deltas: DataFrame, run_log: DataFrame) -> DataFrame:
    """Per delta with a committed version: ``now`` and ``seen``, the newest manifest today and as of the last good run.

    Of versions committed at one instant the greatest manifest id counts. The aggregation is partial before its shuffle;
    the run side is joined without a hint, so that a hot partition is split by the adaptive skew join.
    """
    runs = last_runs(run_log)
    d = deltas.filter(F.col("committed_at").isNotNull()).select(*KEY, "manifest_id", "committed_at").alias("d")
    on = F.col("d.stream_id").eqNullSafe(F.col("r.stream_id")) & F.col("d.partition_id").eqNullSafe(F.col("r.partition_id"))
    x = d.join(runs.alias("r"), on, "left").select("d.*", "r.as_of")
    v = F.struct("committed_at", F.struct("manifest_id").alias("m"))
    seen = F.when(F.col("committed_at") < F.col("as_of"), v)
    return x.groupBy(*KEY).agg(F.max(v).alias("v"), F.max(seen).alias("s")).select(*KEY, F.col("v.m.manifest_id").alias("now"), F.col("s.m.manifest_id").alias("seen"), F.col("s").isNotNull().alias("was_seen"))


def pending(deltas: DataFrame, run_log: DataFrame, path: str | None = None) -> DataFrame:
    """Deltas to process next: (stream_id, partition_id, stream_position, manifest_id).

    The state that the last successful runs saw is published as a saved version (records and Merkle tree below ``path``,
    a fresh folder if None); the next run compares its tree with the saved one, reads only leaves that differ, and
    publishes its output, tree and records together. Failed, running and paused runs change nothing, so a failure
    neither skips nor repeats a delta. Uncommitted versions are ignored; null keys are keys like others; empty tables
    give no rows.
    """
    spark = deltas.sparkSession
    with scratch(spark):
        both = cut(versions(deltas, run_log))
        run = IncrementalRun(spark, path or shared_path(spark, "incremental"), KEY, STATE, merkle.Shape.for_rows(both.count()))
        run.run(both.filter("was_seen").select(*KEY, F.col("seen").alias("manifest_id")))
        run.run(both.select(*KEY, F.col("now").alias("manifest_id")))
    return run.output().filter(F.col("change") == UPSERTED).drop("change")


UPSERTED, REMOVED = "upserted", "removed"


class IncrementalRun:
    """A repeatable run over a keyed table whose output, records and tree are published together.

    A version holds the records by segments of the hash space, and the tree over them. A run cuts its input once,
    descends the two trees where their digests differ, and reads saved records of segments with a differing leaf only;
    only these segments are written again, the others are taken over by reference. Creating the version's commit file is the
    only visible step: a run that dies before it leaves nothing visible, and the next starts from the same saved tree.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], state: list[str], shape: merkle.Shape | None = None):
        self.spark, self.store, self.keys, self.state, self._shape = spark, VersionedFolder(spark, path), keys, state, shape

    def _info(self) -> tuple[int | None, dict | None]:
        version = self.store.latest()
        return version, None if version is None else self.store.commit(version)

    def _leaf(self, df: DataFrame, shape: merkle.Shape) -> DataFrame:
        return df.withColumn("_leaf", merkle.leaf_of(self.keys, shape))

    def run(self, now: DataFrame, process: Callable[[DataFrame], DataFrame] = lambda changes: changes) -> int:
        """Processes the changes since the last version and publishes; returns the new version.

        ``process`` gets the columns of ``now`` and ``change``: UPSERTED for records that are new or have another state,
        REMOVED for keys that are gone (other columns than keys and state are null). ``now`` should hold keys, state and
        little else, as it is written once before it is compared. Raises ``store.Conflict`` if another run published in
        between. Repeated records count once if they are equal.
        """
        with scratch(self.spark):
            return self._run(now, process)

    def _run(self, now: DataFrame, process: Callable[[DataFrame], DataFrame]) -> int:
        base, info = self._info()
        now = cut(now)
        shape = merkle.Shape(*info["shape"]) if info else self._shape or merkle.Shape.for_rows(now.count())
        at = self.store.stage()
        tree = merkle.tree(now, self.keys, self.state, shape)
        with shuffles_removed(self.spark):
            tree.write.parquet(f"{at}/tree")
        fresh, kept = self._leaf(now, shape), {}
        if info is None:
            changes = now.withColumn("change", F.lit(UPSERTED))
        else:
            tree, saved = self.spark.read.parquet(f"{at}/tree"), self.spark.read.parquet(info["tree"])
            leaves = cut(merkle.differing_leaves(tree, saved, shape))
            touched = {r[0] for r in leaves.select(merkle.segment_of(F.col("node"), shape)).distinct().collect()}  # at most 2 ** segment_bits
            kept = {s: p for s, p in info["segments"].items() if int(s) not in touched}
            paths = [p for s, p in info["segments"].items() if int(s) in touched]
            some = bounded_broadcast(leaves.withColumnRenamed("node", "_node"))
            differing = lambda df: self._leaf(df, shape).join(some, F.col("_leaf") == F.col("_node"), "left_semi").drop("_leaf")
            changes = self._changes(differing(now), differing(self.spark.read.schema(info["schema"]).parquet(*paths)) if paths else None)
            fresh = fresh.filter(merkle.segment_of(F.col("_leaf"), shape).isin(sorted(touched)))
        records = fresh.withColumn("_segment", merkle.segment_of(F.col("_leaf"), shape)).select("_segment", *self.keys, *self.state)
        with shuffles_removed(self.spark):
            process(changes).write.parquet(f"{at}/output")
            records.repartition("_segment").write.partitionBy("_segment").parquet(f"{at}/records")
        new = {n[9:]: f"{at}/records/{n}" for n in self.store.files.list(f"{at}/records") if n.startswith("_segment=")}
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.select(*self.keys, *self.state).schema)
        return self.store.publish(at, base, tree=f"{at}/tree", segments=kept | new, shape=[shape.depth, shape.bits, shape.segment_bits], schema=ddl, rewritten=sorted(new))

    def _changes(self, now: DataFrame, saved: DataFrame | None) -> DataFrame:
        if saved is None:
            return now.withColumn("change", F.lit(UPSERTED))
        on = lambda a, b, cols: reduce(lambda x, c: x & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), cols, F.lit(True))
        new = now.alias("n").join(saved.alias("s"), on("n", "s", [*self.keys, *self.state]), "left_anti")
        gone = saved.alias("s").join(now.select(*self.keys).alias("n"), on("s", "n", self.keys), "left_anti")
        return new.withColumn("change", F.lit(UPSERTED)).unionByName(gone.withColumn("change", F.lit(REMOVED)), allowMissingColumns=True)

    def output(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.store.folder(self.store.latest() if version is None else version)}/output")

    def records(self, version: int | None = None) -> DataFrame:
        """The keys and states of a version, from all its segments."""
        info = self.store.commit(self.store.latest() if version is None else version)
        paths = list(info["segments"].values())
        return self.spark.read.schema(info["schema"]).parquet(*paths) if paths else self.spark.createDataFrame([], info["schema"])
