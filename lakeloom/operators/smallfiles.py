"""Finding and merging swarms of small files, one partition at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import Conflict, VersionedFolder
from ..session import bounded_broadcast, cut, scratch, shuffles_removed
from .ordered import running_totals

PARTITION = ["stream_id", "partition_id"]
DELTA = [*PARTITION, "stream_position"]


def same_object(uri: Column) -> Column:
    """One spelling for all that lead to the same object: white space, scheme, escapes, empty and dot segments."""
    x = F.trim(F.regexp_replace(uri, r"[\s​﻿]+$|^[\s​﻿]+", ""))
    x = F.try_url_decode(F.regexp_replace(x, r"\+", "%2B"))
    x = F.coalesce(x, uri)
    scheme = F.lower(F.regexp_extract(x, r"^([A-Za-z0-9+.-]+)://", 1))
    scheme = F.when(scheme.isin("s3a", "s3n"), "s3").otherwise(scheme)
    rest = F.regexp_replace(F.regexp_replace(x, r"^[A-Za-z0-9+.-]+://", ""), r"/(\./|/)+", "/")
    return F.when(scheme == "", rest).otherwise(F.concat(scheme, F.lit("://"), rest))


def live_listings(deltas: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of the manifest of the newest committed version of their delta, with the delta's namespace.

    Of versions committed at one instant the greatest manifest id counts; a delta without a committed version has none.
    A listing without uri is no file. The uri leaves as two independent 64-bit hashes of its one spelling, so that long texts are not shuffled.
    """
    newest = (
        deltas.filter(F.col("committed_at").isNotNull()).groupBy(*DELTA)
        .agg(F.max(F.struct("committed_at", "manifest_id", "namespace")).alias("_v")).select(*DELTA, "_v.manifest_id", "_v.namespace")
    )
    object_ = same_object(F.col("uri"))
    hashed = entries.filter(F.col("uri").isNotNull()).select("entry_id", "manifest_id", *DELTA, F.xxhash64(object_).alias("object_a"), F.xxhash64(F.lit("again"), object_).alias("object_b"), "meta_content_length", "meta_record_count")
    return hashed.join(newest, [*DELTA, "manifest_id"]).drop("manifest_id")


def live_files(deltas: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per live object, from the live listing with the smallest entry_id."""
    rest = ["namespace", *DELTA, "meta_content_length", "meta_record_count"]
    x = live_listings(deltas, entries).groupBy("object_a", "object_b").agg(F.min(F.struct("entry_id", *rest)).alias("_f"))
    return x.select("_f.*")


def sized_files(deltas: DataFrame, entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Live files with the capacities of their namespace and ``small``: whether a merge may take them.

    A file of unknown length, of a namespace without a target, or of a partition that ever saw an upsert or delete delta
    is not small. Facts of namespaces and partitions are aggregates joined back (broadcast after their size is
    checked), never windows, so a hot partition is nobody's single task.
    """
    keyed = bounded_broadcast(deltas.filter(F.lower(F.trim("delta_type")).isin("upsert", "delete")).select(*PARTITION).distinct().withColumn("_keyed", F.lit(True)))
    limit = bounded_broadcast(targets.groupBy("namespace").agg(F.max("min_file_bytes").alias("min_file_bytes"), F.max("capacity_bytes").alias("capacity_bytes"), F.max("capacity_records").alias("capacity_records")))
    x = live_files(deltas, entries).join(limit, "namespace", "left").join(keyed, PARTITION, "left")
    return x.withColumn("small", F.col("_keyed").isNull() & F.coalesce(F.col("meta_content_length") < F.col("min_file_bytes"), F.lit(False))).drop("_keyed", "min_file_bytes")


def small_files(deltas: DataFrame, entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Files to merge: the small ones of partitions that have at least two. They are cut off before they are counted."""
    small = cut(sized_files(deltas, entries, targets).filter("small").drop("small"))
    many = bounded_broadcast(small.groupBy(*PARTITION).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select(*PARTITION))
    return small.join(many, PARTITION, "left_semi")


def output_numbers(files: DataFrame, keys: list[str], order: list[str], size: str, records: str | None, capacity_size: Column, capacity_records: Column | None = None, name: str = "output_no") -> DataFrame:
    """``files`` with the number of the output of their key that takes them.

    The running sizes and the running records of a key each cut its order wherever they pass a multiple of their
    capacity, and an output lies between two neighbouring cuts of either kind. What comes before a file inside its output
    is therefore below both capacities, and no output holds more than a capacity and its last file. Both running sums
    grow along the order, so the sum of the two numbers of cuts passed is different for every output. Unknown sizes and
    records count as 0; hot keys are numbered in pieces.
    """
    sums = {"_size_to": F.col(size)} | ({"_records_to": F.col(records)} if records else {})
    x = running_totals(files, keys, order, sums)
    passed = lambda to, own, cap: F.floor((F.col(to) - F.coalesce(F.col(own), F.lit(0))) / F.greatest(cap, F.lit(1)))
    number = passed("_size_to", size, capacity_size)
    if records:
        number = number + passed("_records_to", records, capacity_records)
    return x.withColumn(name, number.cast("int")).drop(*sums)


def merge_plan(deltas: DataFrame, entries: DataFrame, targets: DataFrame) -> DataFrame:
    """The rewrite plan: each small file with the number of the output file that takes its records, in order."""
    x = output_numbers(small_files(deltas, entries, targets), PARTITION, ["stream_position", "entry_id"], "meta_content_length", "meta_record_count", F.col("capacity_bytes"), F.col("capacity_records"))
    return x.select("namespace", *PARTITION, "output_no", "entry_id", "stream_position", "meta_content_length", "meta_record_count")


def plan_summary(plan: DataFrame) -> DataFrame:
    """Per partition: small files now, files after the merge, bytes and records to rewrite."""
    return plan.groupBy("namespace", *PARTITION).agg(
        F.count(F.lit(1)).alias("small_files"), F.count_distinct("output_no").alias("output_files"),
        F.sum("meta_content_length").alias("bytes"), F.sum("meta_record_count").alias("records"),
    )


class FileListing:
    """The live files of many partitions as versions of a listing; merges swarms of small files partition by partition.

    A version is a Parquet folder of listed files and Parquet folders of replacements laid over it, named by one small
    commit file. ``merge_small`` finds the partitions with enough small files, writes new listings for these alone
    (which files are replaced, and the number of the output that takes the records of each) and commits them on
    the version it read. If another writer replaced files of the same partitions in between it raises Conflict; other
    commits do not disturb it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, VersionedFolder(spark, path)

    def create(self, files: DataFrame) -> int:
        """``files`` need PARTITION, stream_position, entry_id, meta_content_length, meta_record_count, namespace, ``small`` and the capacities."""
        at = self.store.stage()
        with shuffles_removed(self.spark):
            files.write.parquet(f"{at}/files")
        return self.store.publish(at, None, files=f"{at}/files", replaced=[])

    def _version(self, version: int | None = None) -> tuple[int, dict]:
        v = self.store.latest() if version is None else version
        if v is None:
            raise FileNotFoundError(self.store.path)
        return v, self.store.commit(v)

    def replaced(self, version: int | None = None) -> DataFrame:
        """(namespace, PARTITION, output_no, entry_id, ...): the files that merges have replaced up to a version."""
        paths = self._version(version)[1]["replaced"]
        return self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], _REPLACED)

    def files(self, version: int | None = None) -> DataFrame:
        """The listed files of a version that no merge has replaced."""
        info = self._version(version)[1]
        out = self.spark.read.parquet(info["files"])
        return out.join(self.spark.read.parquet(*info["replaced"]).select("entry_id"), "entry_id", "left_anti") if info["replaced"] else out

    def merge_small(self, min_files: int = 2) -> int | None:
        """Returns the new version, or None where no partition has ``min_files`` small files."""
        base, info = self._version()
        small = self.files(base).filter("small")
        many = bounded_broadcast(small.groupBy(*PARTITION).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_files).select(*PARTITION))
        chosen = small.join(many, PARTITION, "left_semi")
        plan = output_numbers(chosen, PARTITION, ["stream_position", "entry_id"], "meta_content_length", "meta_record_count", F.col("capacity_bytes"), F.col("capacity_records"))
        at = f"{self.store.stage()}/replaced"
        with shuffles_removed(self.spark):
            plan.select(*[f.split()[0] for f in _REPLACED.split(", ")]).write.parquet(at)
        mine = self.spark.read.parquet(at)
        if mine.isEmpty():
            return None
        while True:
            try:
                return self.store.publish(at, base, files=info["files"], replaced=[*info["replaced"], at])
            except Conflict:
                base, now = self._version()
                theirs = [p for p in now["replaced"] if p not in info["replaced"]]
                if theirs and not mine.join(bounded_broadcast(self.spark.read.parquet(*theirs).select(*PARTITION).distinct()), PARTITION, "left_semi").isEmpty():
                    raise Conflict(f"files to merge were replaced by version {base}") from None
                info = now


_REPLACED = "namespace string, stream_id string, partition_id string, output_no int, entry_id long, meta_content_length long, meta_record_count long, capacity_bytes long, capacity_records long"


def compacted_listing(spark: SparkSession, path: str, deltas: DataFrame, entries: DataFrame, targets: DataFrame) -> FileListing:
    """A listing of the live files with its swarms of small files merged.

    Partitions that ever saw an upsert or delete delta, files of unknown length and namespaces without target are listed
    but never merged.
    """
    listing = FileListing(spark, path)
    listing.create(sized_files(deltas, entries, targets))
    listing.merge_small()
    return listing


def _decoded(c: Column) -> Column:
    return F.url_decode(F.regexp_replace(c, r"\+", "%2B"))


class CompactedFolder:
    """A partitioned Parquet table whose versions name manifests of its files; merges small files partition by partition.

    Manifests are Parquet folders (partition folder, path, bytes, records), so a table of millions of files has no list
    of them in one text: a commit names the folders that add files and those that take files away, and is folded to one
    manifest when it names more than ``FOLD`` of them. ``merge_small`` rewrites only partitions with at least
    ``min_files`` files below ``min_bytes``, in waves of about ``WAVE_FILES`` files that overwrite their partitions dynamically in
    the staged folder: a wave that failed is run again and overwrites its own partitions only. The commit is made against
    the version it read: if another writer took away one of the merged files in between, Conflict is raised and nothing
    changes; otherwise it is tried again on top of the other's version. Readers of earlier versions keep their files.
    """

    FOLD = 32
    WAVE_FILES = 50_000
    _MANIFEST = "part string, path string, bytes long, records long"

    def __init__(self, spark: SparkSession, path: str, partition: str, retries: int = 2):
        self.spark, self.partition, self.retries = spark, partition, retries
        self.store = VersionedFolder(spark, path)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(part, path, bytes, records) of the files of a version; an empty table has none."""
        v = self.store.latest() if version is None else version
        return self._listed({"add": [], "gone": []} if v is None else self.store.commit(v))

    def _listed(self, info: dict) -> DataFrame:
        if not info["add"]:
            return self.spark.createDataFrame([], self._MANIFEST)
        out = self.spark.read.schema(self._MANIFEST).parquet(*info["add"])
        return out.join(self.spark.read.schema("path string").parquet(*info["gone"]), "path", "left_anti").select("part", "path", "bytes", "records") if info["gone"] else out

    def read(self, version: int | None = None) -> DataFrame:
        v = self.store.latest() if version is None else version
        if v is None:
            raise FileNotFoundError(self.store.path)
        paths = [r[0] for r in self.manifest(v).select("path").collect()]  # Spark plans a scan from the list of its files
        schema = self.store.commit(v)["schema"]
        return self._rows(paths, schema) if paths else self.spark.createDataFrame([], schema)

    def _rows(self, paths: list[str], schema: str) -> DataFrame:
        """Rows of files; the partition value is read from each path, as all staging folders share one layout."""
        rows = self.spark.read.schema(schema).parquet(*paths)
        value = F.regexp_extract(F.col("_metadata.file_path"), rf"/{self.partition}=([^/]*)/", 1)
        kind = dict(rows.dtypes).get(self.partition, "string")
        # a path is a url, and a partition value inside it is escaped once more
        value = F.when(value == "__HIVE_DEFAULT_PARTITION__", None).otherwise(_decoded(_decoded(value)))
        return rows.withColumn(self.partition, value.cast(kind))

    def _write(self, df: DataFrame, at: str, *below: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition, *below).parquet(at)

    def _describe(self, at: str) -> str:
        """Writes the manifest of the files below ``at``, counted from their footers, and returns its folder."""
        to = f"{at}-manifest"
        if self.store.files.sizes(at):
            url = F.col("_metadata.file_path")
            x = self.spark.read.schema("__none int").parquet(at).groupBy(url.alias("url"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("records"))
            x = x.select(F.regexp_extract(_decoded(F.col("url")), rf"/({self.partition}=[^/]*)/", 1).alias("part"), _decoded(F.col("url")).alias("path"), "bytes", "records")
        else:
            x = self.spark.createDataFrame([], self._MANIFEST)
        x.write.parquet(to)
        return to

    def append(self, df: DataFrame) -> int:
        at = self.store.stage()
        self._write(df, at)
        new, ddl = self._describe(at), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        while True:
            base = self.store.latest()
            info = {"add": [], "gone": []} if base is None else self.store.commit(base)
            try:
                return self._publish(base, info, [new], [], ddl)
            except Conflict:
                continue

    def _publish(self, base: int | None, info: dict, add: list[str], gone: list[str], schema: str) -> int:
        merged = {"add": [*info["add"], *add], "gone": [*info["gone"], *gone]}
        if len(merged["add"]) + len(merged["gone"]) > self.FOLD:
            at = f"{self.store.stage()}-manifest"
            self._listed(merged).write.parquet(at)
            merged = {"add": [at], "gone": []}
        return self.store.publish("", base, **merged, schema=schema)

    def merge_small(self, min_bytes: int, target_bytes: int, min_files: int = 2) -> int | None:
        """Returns the new version, or None if no partition has enough small files. An output holds at most ``target_bytes`` and one file."""
        with scratch(self.spark):
            return self._merge_small(min_bytes, target_bytes, min_files)

    def _merge_small(self, min_bytes: int, target_bytes: int, min_files: int) -> int | None:
        base = self.store.latest()
        if base is None:
            return None
        info = self.store.commit(base)
        small = self._listed(info).filter(F.col("bytes") < min_bytes)
        many = bounded_broadcast(small.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_files).select("part"))
        chosen = cut(small.join(many, "part", "left_semi"))
        total = chosen.count()
        if not total:
            return None
        at, schema, waves = self.store.stage(), info["schema"], -(-total // self.WAVE_FILES)
        plan = cut(output_numbers(chosen, ["part"], ["path"], "bytes", None, F.lit(target_bytes), name="__out").withColumn("wave", F.pmod(F.xxhash64("part"), F.lit(waves)).cast("int")))
        for wave in range(waves):
            for left in range(self.retries, -1, -1):
                try:
                    self._rewrite(plan.filter(F.col("wave") == wave), schema, at)
                    break
                except Exception:
                    if not left:
                        raise
        new = self._describe(at)
        counts = [df.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0] for df in (chosen, self.spark.read.parquet(new))]
        if counts[0] != counts[1]:
            raise RuntimeError(f"{counts[0]} rows to merge, {counts[1]} written")
        gone = f"{at}-gone"
        chosen.select("path").write.parquet(gone)
        while True:
            if not chosen.join(self._listed(info).select("path"), "path", "left_anti").isEmpty():
                raise Conflict(f"files to merge were replaced by version {base}")
            try:
                return self._publish(base, info, [new], [gone], schema)
            except Conflict:
                base = self.store.latest()
                info = self.store.commit(base)

    def _rewrite(self, wave: DataFrame, schema: str, at: str) -> None:
        """One output per (partition, number), each in one task and one file; a row whose file has no number stops the job."""
        paths = [r[0] for r in wave.select("path").collect()]  # about WAVE_FILES, or one partition's
        if not paths:
            return
        bare = lambda c: F.regexp_replace(c, r"^[a-zA-Z0-9]+:/*", "/")
        of = bounded_broadcast(wave.select(bare(F.col("path")).alias("__path"), "__out"))
        rows = self._rows(paths, schema).withColumn("__path", bare(_decoded(F.col("_metadata.file_path"))))
        known = rows.join(of, "__path", "left").withColumn("__out", F.coalesce("__out", F.raise_error(F.concat(F.lit("no output for "), "__path"))))
        n = wave.select("part", "__out").distinct().count()
        self._write(known.drop("__path").repartitionByRange(n, self.partition, "__out"), at, "__out")
