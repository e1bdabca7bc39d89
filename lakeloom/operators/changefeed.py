"""Applying a feed of inserts, updates and deletes to a bucketed copy-on-write table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import VersionedFolder
from ..session import BROADCAST_ROWS, bounded_broadcast, cut, scratch, shuffles_removed

PARTITION = ["stream_id", "partition_id"]
PLACE = [*PARTITION, "stream_position", "file_index", "record_index"]
KEY = ["pk1", "pk2"]
FIELDS = ["pk1", "pk2", "value"]
SEQ = ["stream_position", "file_index", "record_index"]


#: Kinds that set the row of a key.
SETS = ("append", "upsert")


def last_received(feed: DataFrame) -> DataFrame:
    """One row per place: the one received last (of equal times the greatest change_id), its kind trimmed and in lower case.

    Deliveries repeated any number of times are folded by a partial aggregation before the shuffle.
    """
    rest = ["kind", "delete_columns", *FIELDS]
    # a number leads the grouping, so that sorting compares numbers instead of texts
    x = feed.select(F.xxhash64(*PLACE).alias("place"), *PLACE, F.lower(F.trim("delta_type")).alias("kind"), *rest[1:], "received_at", "change_id")
    last = x.groupBy("place", *PLACE).agg(F.max(F.struct("received_at", "change_id", *rest)).alias("_r"))
    return last.select("place", *PLACE, *[f"_r.{c}" for c in rest], "_r.received_at", "_r.change_id")


def latest_per_place(feed: DataFrame) -> DataFrame:
    """``last_received`` of the places that change something: kinds other than append, upsert and delete change nothing."""
    return last_received(feed).filter(F.col("kind").isin(*SETS, "delete"))


def delete_fields(names: Column) -> Column:
    """The known fields that a delete compares, in a fixed order: null or blank means the key; unknown names are ignored."""
    given = F.transform(F.split(F.lower(names), ","), lambda x: F.trim(x))
    known = F.filter(F.array(*[F.lit(f) for f in FIELDS]), lambda f: F.array_contains(given, f))
    return F.when(names.isNull() | (F.trim(names) == ""), F.lit(",".join(KEY))).otherwise(F.array_join(known, ","))


def bucket_of(buckets: int) -> Column:
    """The hash by which a shuffle on the key is partitioned: rows aggregated by key are in the task of their bucket already."""
    return F.pmod(F.hash(F.xxhash64(*PARTITION, *KEY), *PARTITION, *KEY), F.lit(buckets)).cast("int")


def last_sets(sets: DataFrame) -> DataFrame:
    """The last row that set each key: sort-merge inside the bucket, partially aggregated before the shuffle.

    Of several rows for one place the one received last counts (of equal times the greatest change_id), as in a single batch.
    """
    received = [c for c in ("received_at", "change_id") if c in sets.columns]
    rest = [c for c in sets.columns if c not in {*PARTITION, *KEY, *SEQ, *received}]
    # a number leads the grouping, so that sorting compares numbers instead of texts
    best = sets.withColumn("_key", F.xxhash64(*PARTITION, *KEY)).groupBy("_key", *PARTITION, *KEY).agg(F.max(F.struct(*SEQ, *received, *rest)).alias("_r"))
    return best.select(*PARTITION, *KEY, "_r.*")


def _matches(a: str, b: str, columns: list[str]) -> Column:
    return reduce(lambda x, c: x & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), columns, F.lit(True))


def last_deletes(deletes: DataFrame) -> DataFrame:
    """(PARTITION, fields, FIELDS, ``at``): the last delete per compared values; fields that a delete does not compare are null.

    Written once, so that each field set is a filter of a small table.
    """
    used = lambda c: F.when(F.array_contains(F.split("fields", ","), c), F.col(c)).alias(c)
    x = deletes.filter(F.col("fields") != "").select(*PARTITION, "fields", *[used(c) for c in FIELDS], F.struct(*SEQ).alias("at"))
    return cut(x.groupBy(*PARTITION, "fields", *FIELDS).agg(F.max("at").alias("at")))


def with_alive(rows: DataFrame, last: DataFrame) -> tuple[DataFrame, bool]:
    """``rows`` with ``alive``: false where a later delete equals the row in its fields (null equals null).

    ``last`` is of ``last_deletes``, so each field set is one left join that adds no rows; there are at most 7 field sets.
    Fields, not keys, decide, so this is right for deletes on non-key fields as well. Also returns whether all joins
    could broadcast the deletes, after their number was counted.
    """
    sets = {r["fields"]: r["count"] for r in last.groupBy("fields").count().collect()}  # at most 2 ** 3 - 1 values
    small = sum(sets.values()) <= BROADCAST_ROWS
    rows = rows.withColumn("alive", F.lit(True))
    for fields in sorted(sets):
        on = fields.split(",")
        some = last.filter(F.col("fields") == fields).select(*PARTITION, *on, "at")
        r, d = rows.alias("r"), (F.broadcast(some) if small else some).alias("d")
        later = F.coalesce(F.col("d.at") > F.struct(*[f"r.{c}" for c in SEQ]), F.lit(False))
        rows = r.join(d, _matches("r", "d", [*PARTITION, *on]), "left").select(*[F.col(f"r.{c}") for c in rows.columns if c != "alive"], (F.col("r.alive") & ~later).alias("alive"))
    return rows, small


def final_rows(feed: DataFrame) -> DataFrame:
    """The rows that stand at the end of the whole feed, with the place of the change that set each, without a store."""
    folded = latest_per_place(feed)
    sets = last_sets(folded.filter("kind <> 'delete'").select(*PLACE, *FIELDS))
    deletes = folded.filter("kind = 'delete'").select(*PLACE, *FIELDS, delete_fields(F.col("delete_columns")).alias("fields"))
    return with_alive(sets, last_deletes(deletes))[0].filter("alive").drop("alive")


#: Columns of the log of changes: one row per place and batch.
LOG = ["place", *PLACE, "kind", "fields", *FIELDS, "received_at", "change_id"]
#: Kinds of log rows that take back what an earlier version of the same place did: a set row of a key, a delete.
MOVED, UNDONE = "moved", "undone"


class BucketedTable:
    """Copy-on-write table: the last set row of every key, hashed by key into buckets of files, beside a log of the changes.

    A version's manifest lists the folder of each bucket. ``apply`` rewrites only buckets that a change touches; others
    are taken over by reference. Rows stay stored when a delete hides them (``alive`` false), so that late changes can't
    bring an older value of the key back.

    The log has every change as it was received last in its batch. Of it only folders are searched whose range of
    positions meets that of the batch: there a batch may repeat or correct an applied change. A change older than the applied one is
    dropped; a correction that takes a change away from its key leaves a mark in the log, and the key is set anew from its
    log rows; a corrected delete wakes the rows that it hid. So batches may come in any order and cut.
    Nulls in any column, empty feeds, repeated and late changes are allowed.

    The number of buckets follows from the number of rows and doubles when they have outgrown it.
    """

    #: Folders of the log that are folded to one when there are more.
    FOLD = 16

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, bucket_rows: int = 500_000):
        self.spark, self.store, self._buckets, self.bucket_rows = spark, VersionedFolder(spark, path), buckets, bucket_rows

    def manifest(self) -> dict:
        version = self.store.latest()
        return {"buckets": {}, "log": [], "n": None, "rows": 0} if version is None else self.store.commit(version)

    def _base(self, manifest: dict, buckets=None) -> DataFrame | None:
        """``buckets`` None: all."""
        paths = [p for b, p in manifest["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self._schema()).parquet(*paths) if paths else None

    def _schema(self) -> str:
        return "stream_id string, partition_id string, pk1 string, pk2 int, stream_position long, file_index int, record_index int, value long, received_at timestamp_ntz, change_id long, alive boolean"

    def _bucket_count(self, old: dict, rows: int) -> int:
        """Buckets for so many rows; halves or doubles of the number of shuffle partitions, so that few tasks write to one bucket."""
        if not old["n"] and self._buckets:
            return self._buckets
        need, n = max(8, -(-rows // self.bucket_rows)), old["n"] or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        while not old["n"] and n % 2 == 0 and n // 2 >= need:
            n //= 2
        while need > (2 * n if old["n"] else n):
            n *= 2
        return n

    def apply(self, feed: DataFrame) -> int:
        """Applies a batch of changes in any order and commits; returns the new version. Raises Conflict if another writer committed first."""
        with scratch(self.spark):
            return self._apply(feed)

    def _apply(self, feed: DataFrame) -> int:
        base_version, old = self.store.latest(), self.manifest()
        at = self.store.stage()
        with shuffles_removed(self.spark):
            last_received(feed).withColumn("fields", F.when(F.col("kind") == "delete", delete_fields(F.col("delete_columns")))).select(*LOG).write.parquet(f"{at}/log")
        batch = self.spark.read.parquet(f"{at}/log")
        count, known, lo, hi = batch.agg(F.count(F.lit(1)), F.count("stream_position"), F.min("stream_position"), F.max("stream_position")).first()
        span = [lo, hi] if known == count else [None, None]  # rows without a position may meet anything
        log, rows = [*old["log"], [f"{at}/log", *span]], old["rows"] + count
        n = self._bucket_count(old, rows)
        sets, deletes = batch.filter(F.col("kind").isin(*SETS)), batch.filter("kind = 'delete'")
        moved, woken = None, False
        met = self._met(old, batch, span)
        if met is not None:
            stale = bounded_broadcast(met.filter("NOT newer").select(*PLACE))
            sets, deletes = (x.alias("n").join(stale.alias("s"), _matches("n", "s", PLACE), "left_anti") for x in (sets, deletes))
            newer, was = met.filter("newer"), lambda c: F.col(f"was.{c}")
            other = lambda c, *kinds: ~F.coalesce(c.isin(*kinds), F.lit(False))
            left = newer.filter(was("kind").isin(*SETS) & (other(F.col("kind"), *SETS) | ~(was("pk1").eqNullSafe(F.col("pk1")) & was("pk2").eqNullSafe(F.col("pk2")))))
            undone = newer.filter((was("kind") == "delete") & other(F.col("kind"), "delete"))
            late = met.filter(~F.col("newer") & (F.col("kind") == "delete") & other(was("kind"), "delete"))  # known to be something else since
            mark = lambda df, kind, when: df.select("place", *PLACE, F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("fields"), *[was(c).alias(c) for c in FIELDS], *[(was(c) if when == "was" else F.col(c)).alias(c) for c in ("received_at", "change_id")])
            mark(left, MOVED, "now").unionByName(mark(undone, UNDONE, "now")).unionByName(mark(late, UNDONE, "was")).write.parquet(f"{at}/marks")
            marks = self.spark.read.parquet(f"{at}/marks")
            kinds = {r[0] for r in marks.select("kind").distinct().collect()}  # at most 2
            if kinds:
                log.append([f"{at}/marks", *span])
            if MOVED in kinds:
                moved = cut(marks.filter(F.col("kind") == MOVED).select(*PARTITION, *KEY).distinct())
            woken = not newer.filter(was("kind") == "delete").isEmpty()
        last = last_deletes(self._standing(log))
        touched = self._touched(old, n, sets, deletes, last, moved, woken)
        new = [*PLACE, *FIELDS, "received_at", "change_id"]
        out = sets.select(*new)
        if touched is not None and (part := self._base(old, touched)) is not None:
            part = part.select(*new)
            if moved is not None:
                part = part.alias("r").join(bounded_broadcast(moved).alias("m"), _matches("r", "m", [*PARTITION, *KEY]), "left_anti")
            out = out.unionByName(part)
        if moved is not None:
            out = out.unionByName(self._from_log(log, moved).select(*new))
        out, small = with_alive(last_sets(out), last)
        out = out.withColumn("_bucket", bucket_of(n))
        if not small:  # joins by shuffle have spread the keys anew
            out = out.repartition(n, "_bucket")
        with shuffles_removed(self.spark):
            out.write.partitionBy("_bucket").parquet(f"{at}/rows")
        files = self.store.files
        fresh = {x[8:]: f"{at}/rows/{x}" for x in files.list(f"{at}/rows") if x.startswith("_bucket=")}
        buckets = {b: p for b, p in old["buckets"].items() if touched is not None and int(b) not in touched} | fresh
        if len(log) > self.FOLD:
            x = self._read(log).withColumn("_takes", F.coalesce(F.col("kind").isin("delete", UNDONE), F.lit(False)))
            whole = x.groupBy("place", *PLACE, *KEY, "_takes").agg(F.max(F.struct("received_at", "change_id", "kind", "fields", "value")).alias("_r"))
            whole.select("place", *PLACE, "_r.kind", "_r.fields", *KEY, "_r.value", "_r.received_at", "_r.change_id").select(*LOG).write.parquet(f"{at}/whole-log")
            bounds = [e[1:] for e in log]
            log = [[f"{at}/whole-log", *([None, None] if any(b[0] is None for b in bounds) else [min(b[0] for b in bounds), max(b[1] for b in bounds)])]]
        return self.store.publish(at, base_version, buckets=buckets, log=log, n=n, rows=rows, rewritten=sorted(map(int, fresh)))

    def _read(self, log: list[list]) -> DataFrame:
        return self.spark.read.parquet(*[e[0] for e in log])

    def _met(self, old: dict, batch: DataFrame, span: list) -> DataFrame | None:
        """Changes of the batch whose place was applied before, with ``was`` (the applied version) and whether they are ``newer``.

        Places that may have been met are found by their hashes alone; only the rows of these are read whole.
        """
        apart = lambda e: None not in (e[1], span[0]) and (e[2] < span[0] or span[1] < e[1])
        some = [e for e in old["log"] if not apart(e)]
        if not some:
            return None
        log = self._read(some).filter(~F.coalesce(F.col("kind").isin(MOVED, UNDONE), F.lit(False)))
        hits = cut(batch.select("place").join(log.select("place"), "place", "left_semi"))
        if hits.isEmpty():
            return None
        hits = bounded_broadcast(hits)
        late, seen = batch.join(hits, "place", "left_semi"), log.join(hits, "place", "left_semi")
        was = seen.groupBy("place", *PLACE).agg(F.max(F.struct("received_at", "change_id", "kind", *FIELDS)).alias("was"))
        met = cut(late.alias("n").join(was.alias("w"), _matches("n", "w", ["place", *PLACE])).select("n.*", "w.was").withColumn("newer", F.struct("received_at", "change_id") > F.struct("was.received_at", "was.change_id")))
        return None if met.isEmpty() else met

    def _standing(self, log: list[list]) -> DataFrame:
        """The deletes that stand: of each place the version received last, unless that is taken back."""
        rows = self._read(log).filter(F.col("kind").isin("delete", UNDONE))
        if len(log) == 1:  # one row a place
            return rows.filter("kind = 'delete'")
        rest = ["kind", "fields", *FIELDS]
        last = rows.groupBy("place", *PLACE).agg(F.max(F.struct("received_at", "change_id", *rest)).alias("_r"))
        return last.select(*PLACE, *[f"_r.{c}" for c in rest]).filter("kind = 'delete'")

    def _from_log(self, log: list[list], keys: DataFrame) -> DataFrame:
        """The set rows of some keys in the whole log, each place as it was received last."""
        rows = self._read(log).filter(F.col("kind").isin(*SETS, MOVED)).alias("l").join(bounded_broadcast(keys).alias("k"), _matches("l", "k", [*PARTITION, *KEY]), "left_semi")
        last = rows.groupBy(*PLACE, *KEY).agg(F.max(F.struct("received_at", "change_id", "kind", "value")).alias("_r"))
        return last.select(*PLACE, *KEY, "_r.kind", "_r.value", "_r.received_at", "_r.change_id").filter(F.col("kind") != MOVED)

    def _touched(self, old: dict, n: int, sets: DataFrame, deletes: DataFrame, last: DataFrame, moved: DataFrame | None, woken: bool) -> set[int] | None:
        """Buckets to rewrite (at most their number comes to the driver); None: all, as there are none yet."""
        state = self._base(old)
        if state is None:
            return None
        if n != old["n"]:
            return set(map(int, old["buckets"]))
        routed = sets.select(bucket_of(n).alias("b"))
        if moved is not None:
            routed = routed.union(moved.select(bucket_of(n).alias("b")))
        touched = {r["b"] for r in routed.distinct().collect()}
        rest = self._base(old, set(map(int, old["buckets"])) - touched)
        if rest is None:
            return touched
        changed = with_alive(rest.filter("alive").drop("alive"), last_deletes(deletes.filter("kind = 'delete'")))[0].filter("NOT alive").select(bucket_of(n).alias("b"))
        if woken:
            changed = changed.union(with_alive(rest.filter("NOT alive").drop("alive"), last)[0].filter("alive").select(bucket_of(n).alias("b")))
        return touched | {r["b"] for r in changed.distinct().collect()}

    def expire(self, keep: int = 1) -> int:
        """Deletes the bucket folders that only versions before the last ``keep`` name; returns how many. Readers of those versions lose them."""
        versions = self.store.versions()
        used = {p for v in versions[-keep:] for p in self.store.commit(v)["buckets"].values()}
        gone = {p for v in versions[:-keep] for p in self.store.commit(v)["buckets"].values()} - used
        return sum(self.store.files.delete(p) for p in gone)

    def rows(self) -> DataFrame:
        """The present rows of every partition, with the place of the change that set each."""
        found = self._base(self.manifest())
        empty = self.spark.createDataFrame([], self._schema())
        return (empty if found is None else found).filter("alive").drop("alive")


def received_parts(feed: DataFrame, parts: int) -> list[DataFrame]:
    """``feed`` cut by the time of receipt into batches of about equal size; rows without a time are in the first."""
    cuts = feed.agg(F.percentile_approx("received_at", [k / parts for k in range(1, parts)])).first()[0] or []
    number = sum((F.coalesce(F.col("received_at") > F.lit(c), F.lit(False)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    return [feed.filter(number == k) for k in range(len(set(cuts)) + 1)]
