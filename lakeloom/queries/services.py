"""Queries of catalog services, formats, schema rules and field groups: small results that show what each step did.

Rows are (step, value) in most cases, so that one query walks through the life of an object; the tables that they write
are whole given tables.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog as C
from ..functions import expressions as E
from ..functions.transforms import Transform, check_sort_keys, hash_bucket, hash_group, misplaced, sort_columns, table_format_hash
from ..operators import evolution, groups, positions, repartition
from ..operators.evolution import Field, Schema, Update
from ..plans.log import Transaction, janitor, now_ns
from ..plans.store import Conflict, Files
from ..session import shared_path, table
from ..sources import formats
from ..streaming.sinks import Monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def values(*rows: tuple[str, object]) -> str:
    """SQL of literal (step, value) rows."""
    return "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{v}')" for s, v in rows) + ") t(step, value)"


def steps(spark: SparkSession, rows: list[tuple[str, object]]) -> DataFrame:
    return spark.createDataFrame([(s, str(v)) for s, v in rows], "step string, value string")


def refused(f: Callable, kind: type | tuple = Exception) -> str:
    """The name of the error that a call raises, or ``no``."""
    try:
        f()
    except kind as e:
        return type(e).__name__
    return "no"


def _catalog(spark: SparkSession) -> C.Catalog:
    return C.Catalog(spark, shared_path(spark, "catalog"))


@query(values(("default", "b"), ("again", "Exists"), ("popped", "NotFound"), ("loaded", "a,b"), ("cleared", "NotFound")))
def catalog_registry(spark: SparkSession, d: str) -> DataFrame:
    """Registered catalogs by name: a default, a second put that is refused, pop, saving and loading of the registry, clearing."""
    before, default = dict(C._catalogs), list(C._default)
    try:
        C.clear_catalogs()
        C.init(spark, {"a": shared_path(spark, "a"), "b": shared_path(spark, "b")}, "b")
        out = [("default", C.get_catalog().name), ("again", refused(lambda: C.put_catalog("a", C.get_catalog("b"), fail_if_exists=True)))]
        saved = shared_path(spark, "registry").removeprefix("file:") + ".json"
        os.makedirs(os.path.dirname(saved), exist_ok=True)
        C.save_catalogs(saved)
        C.pop_catalog("a")
        out.append(("popped", refused(lambda: C.get_catalog("a"))))
        C.load_catalogs(spark, saved)
        out.append(("loaded", ",".join(sorted(C._catalogs))))
        C.clear_catalogs()
        return steps(spark, [*out, ("cleared", refused(lambda: C.get_catalog("b")))])
    finally:
        C._catalogs.clear()
        C._catalogs.update(before)
        C._default[:] = default


@query(values(("created", "true"), ("again", "Exists"), ("renamed", "false,true"), ("properties", "x=1,y=2"), ("listed", "1"), ("default", "DEFAULT"), ("dropped", "false"), ("dropped again", "NotFound")))
def namespace_ddl(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark)
    c.create_namespace("a", {"x": 1})
    out = [("created", str(c.namespace_exists("a")).lower()), ("again", refused(lambda: c.create_namespace("a")))]
    c.alter_namespace("a", {"y": 2}, "b")
    out += [("renamed", f"{c.namespace_exists('a')},{c.namespace_exists('b')}".lower()), ("properties", ",".join(f"{k}={v}" for k, v in sorted(c.get_namespace("b")["properties"].items()))), ("listed", c.list_namespaces().count()), ("default", c.default_namespace())]
    c.drop_namespace("b")
    return steps(spark, [*out, ("dropped", str(c.namespace_exists("b")).lower()), ("dropped again", refused(lambda: c.drop_namespace("b")))])


@query("""SELECT 'rows' AS step, CAST(count(*) AS VARCHAR) AS value FROM nation UNION ALL SELECT 'after truncate', '0' UNION ALL SELECT 'before truncate', CAST(count(*) AS VARCHAR) FROM nation UNION ALL
SELECT * FROM (VALUES ('latest', '2'), ('deprecated', '1'), ('renamed', 'false,true'), ('version gone', 'NotFound'), ('description', 'of nations'), ('tables', '2'), ('dropped', 'false'), ('unknown property', 'ValueError'), ('unknown sort key', 'ValueError'))""")
def table_ddl(spark: SparkSession, d: str) -> DataFrame:
    """Versions, lifecycles, renames, truncation with time travel, and refused definitions of a table of all nations."""
    c, n = _catalog(spark), table(spark, d, "nation")
    s = Schema.infer(n)
    c.write(n, "t", "n")
    out = [("rows", c.read("t", "n").count())]
    moment = now_ns()
    c.truncate_table("t", "n")
    c.refresh_table("t", "n")
    out += [("after truncate", c.read("t", "n").count()), ("before truncate", c.read("t", "n", as_of=moment).count())]
    c.create_table("t", "n", version="2", schema=s)
    out.append(("latest", c.get_table("t", "n").version))
    c.alter_table("t", "n", "2", lifecycle="DEPRECATED")
    c.alter_table("t", "n", "1", description="of nations")
    out += [("deprecated", c.get_table("t", "n").version), ("description", c.get_table("t", "n").data["description"])]
    c.rename_table("t", "u", "n")
    out += [("renamed", f"{c.table_exists('t', 'n')},{c.table_exists('u', 'n')}".lower()), ("tables", c.list_tables("n").count())]
    c.drop_table("u", "n", "1")
    out.append(("version gone", refused(lambda: c.get_table("u", "n"))))
    c.drop_table("u", "n")
    bad = lambda **o: refused(lambda: c.create_table("bad", "n", schema=s, **o))
    return steps(spark, [*out, ("dropped", str(c.table_exists("u", "n")).lower()), ("unknown property", bad(properties={"nope": 1})), ("unknown sort key", bad(sort_keys=[("nope", True, True)]))])


@query("SELECT * FROM (VALUES ('namespace', 'lake://a'), ('table', 'lake://a/nation'), ('table', 'lake://a/region'), ('version', 'lake://a/nation/1'), ('version', 'lake://a/region/1')) t(kind, url)")
def url_listing(spark: SparkSession, d: str) -> DataFrame:
    """Objects by url at three depths, put by url before."""
    c = _catalog(spark)
    c.put("lake://a")
    for name in ("nation", "region"):
        c.put(f"lake://a/{name}", schema=Schema.infer(table(spark, d, name)))
    assert c.get("lake://a/nation").version == "1"
    return c.list("lake://*").unionByName(c.list("lake://a/*")).unionByName(c.list("lake://a/*/*"))


@query("SELECT 'supplier' AS name, count(*) AS n, sum(s_suppkey) AS keys FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT 'nation', count(*), sum(n_nationkey) FROM nation")
def cross_catalog_copy(spark: SparkSession, d: str) -> DataFrame:
    """Two tables, one of them with keys and deletes, copied with their files to another catalog and counted there."""
    a, b, s = _catalog(spark), _catalog(spark), table(spark, d, "supplier")
    a.write(s, "supplier", "x", merge_keys=["s_suppkey"], compact=False)
    a.write(s.filter("s_nationkey = 3").select("s_suppkey"), "supplier", "x", mode="delete", compact=False)
    a.write(table(spark, d, "nation"), "nation", "x")
    a.copy("lake://x/*", b, "y")
    one = lambda name, key: b.read(name, "y").agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys")).select(F.lit(name).alias("name"), "n", "keys")
    return one("supplier", "s_suppkey").unionByName(one("nation", "n_nationkey"))


@query("SELECT c_custkey, upper(c_name) AS c_name FROM customer WHERE c_nationkey < 5")
def copy_with_transforms(spark: SparkSession, d: str) -> DataFrame:
    """Files copied to another format through user steps."""
    at = shared_path(spark, "copied")
    formats.copy_with(spark, f"{d}/customer.parquet", at, [lambda x: x.filter("c_nationkey < 5"), lambda x: x.select("c_custkey", F.upper("c_name").alias("c_name"))], formats.PARQUET, formats.ORC)
    return formats.read(spark, at, formats.ORC)


@query("SELECT CASE WHEN n_regionkey = 1 THEN 'second' ELSE 'first' END AS source, count(*) AS n, min(n_nationkey) AS least, max(n_nationkey) AS greatest FROM nation GROUP BY ALL")
def keyed_read_sources(spark: SparkSession, d: str) -> DataFrame:
    """A keyed table merged on read: each row comes with the file that it was merged from last, in order of position."""
    c, n = _catalog(spark), table(spark, d, "nation")
    c.write(n, "nation", merge_keys=["n_nationkey"], compact=False)
    first = c.read("nation", read_as="files")
    c.write(n.filter("n_regionkey = 1"), "nation", mode="merge", compact=False)
    x = c.read("nation", columns=["n_nationkey"], file_path_column="file", ordered=True)
    old = [f.rsplit("/", 1)[1] for f in first]
    return x.groupBy(F.when(F.element_at(F.split("file", "/"), -1).isin(old), "first").otherwise("second").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.min("n_nationkey").alias("least"), F.max("n_nationkey").alias("greatest"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 1100 AND o_custkey > 10")
def pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    """A filter on a table of many files: those whose bounds rule it out are not planned."""
    c, o = _catalog(spark), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c.write(o.repartitionByRange(16, "o_orderkey"), "orders")
    p = E.Reference("o_orderkey").between(1000, 1100) & E.Reference("o_custkey").gt(10)
    planned, all_files = len(c.read("orders", read_as="files", row_filter=p)), len(c.read("orders", read_as="files"))
    assert planned < all_files or all_files == 1, (planned, all_files)
    return c.read("orders", row_filter=p)


@query(values(("rows", 5), ("files", 1)))
def limited_scan(spark: SparkSession, d: str) -> DataFrame:
    """A limit reads no more files than it needs."""
    c = _catalog(spark)
    c.write(table(spark, d, "orders").select("o_orderkey").repartition(8), "orders")
    x = c.read("orders", limit=5)
    return steps(spark, [("rows", x.count()), ("files", len(x.inputFiles()))])


@query("SELECT count(*) AS files, (SELECT count(*) FROM nation) AS records FROM (VALUES (1), (2)) t(a)")
def schemaless_table(spark: SparkSession, d: str) -> DataFrame:
    """A table without schema keeps files and reads as a manifest, behind which the data are read again."""
    c, n = _catalog(spark), table(spark, d, "nation")
    c.create_table("t")
    c.write(n.filter("n_nationkey < 10").coalesce(1), "t", mode="append")
    c.write(n.filter("n_nationkey >= 10").coalesce(1), "t", mode="append", content_type=formats.JSON)
    m = c.read("t")
    return m.agg(F.count(F.lit(1)).alias("files")).select("files", F.lit(formats.from_manifest(spark, m).count()).alias("records"))


@query("SELECT p_partkey, CAST(round_even(p_retailprice / 3, 1) AS DOUBLE) AS third FROM part")
def csv_decimal_rounding(spark: SparkSession, d: str) -> DataFrame:
    """Decimals with more digits than the field are rounded half to even when text is read."""
    at = shared_path(spark, "csv")
    x = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 3).cast("string").alias("third"))
    formats.write(x, at, formats.CSV)
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("third", T.DecimalType(12, 1))])
    return formats.read(spark, at, formats.CSV, schema=schema).select("p_partkey", F.col("third").cast("double").alias("third"))


@query("SELECT p_partkey, p_size > 25 AS large, CASE WHEN p_size <= 40 THEN p_size END AS size FROM part")
def csv_reader_options(spark: SparkSession, d: str) -> DataFrame:
    """Delimited text with its own separator, signs for true and false and for null, no cell over several lines."""
    at = shared_path(spark, "csv")
    x = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, "Y").otherwise("N").alias("large"), F.when(F.col("p_size") <= 40, F.col("p_size").cast("string")).otherwise("?").alias("size"))
    x.write.option("header", False).option("sep", "~").csv(at)
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("large", T.BooleanType()), T.StructField("size", T.IntegerType())])
    return formats.read(spark, at, formats.CSV, schema=schema, header=False, delimiter="~", null_as="?", booleans=("Y", "N"), line_per_row=True)


@query("SELECT * FROM part")
def format_avro(spark: SparkSession, d: str) -> DataFrame:
    at, x = shared_path(spark, "avro"), table(spark, d, "part")
    formats.write(x, at, formats.AVRO, records_per_file=500)
    return formats.read(spark, at, formats.AVRO).select(*x.columns)


@query("SELECT s_suppkey, s_name FROM supplier")
def format_unescaped_tsv(spark: SparkSession, d: str) -> DataFrame:
    at, x = shared_path(spark, "tsv"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    formats.write(x, at, formats.RAW_TSV)
    return formats.read(spark, at, formats.RAW_TSV, schema=x.schema)


@query(values(("a.parquet", "application/parquet"), ("b/c.CSV.gz", "text/csv gzip"), ("s3://x/y.jsonl?v=1", "application/json"), ("z.avro", "application/avro"), ("no ending", "application/octet-stream")))
def content_types(spark: SparkSession, d: str) -> DataFrame:
    out = [(u, " ".join(x for x in formats.content_type(u) if x)) for u in ("a.parquet", "b/c.CSV.gz", "s3://x/y.jsonl?v=1", "z.avro", "no ending")]
    return steps(spark, out)


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def read_urls(spark: SparkSession, d: str) -> DataFrame:
    """Files of two formats read as one table."""
    at, r = shared_path(spark, "urls"), table(spark, d, "region").select("r_regionkey", "r_name")
    one = [f for f, _ in formats.write(r, f"{at}/a")]
    two = [f for f, _ in formats.write(r.withColumn("r_regionkey", (F.col("r_regionkey") + 100).cast(r.schema[0].dataType)), f"{at}/b", formats.ORC)]
    return formats.read_urls(spark, [*one, *two])


@query("SELECT 'arrow' AS source, count(*) AS n FROM region UNION ALL SELECT 'pandas', count(*) FROM region UNION ALL SELECT 'numpy', count(*) FROM region")
def local_data(spark: SparkSession, d: str) -> DataFrame:
    """Arrow, pandas and NumPy data written to tables and read back as such."""
    c, r, out = _catalog(spark), table(spark, d, "region"), []
    for kind in ("arrow", "pandas", "numpy"):
        c.write({"arrow": r.toArrow, "pandas": r.toPandas, "numpy": lambda: r.select("r_regionkey").toPandas().to_numpy()}[kind](), kind)
        out.append((kind, len(c.read(kind, read_as=kind))))
    return spark.createDataFrame(out, "source string, n long")


@query(values(("content type", "ValueError"), ("reader", "ReaderIncompatible"), ("append with keys", "ValueError"), ("merge without keys", "ValueError"), ("create again", "Exists"), ("append to nothing", "NotFound")))
def write_gates(spark: SparkSession, d: str) -> DataFrame:
    """Writes that are refused."""
    c, r = _catalog(spark), table(spark, d, "region")
    c.write(r, "plain")
    c.write(r, "keyed", merge_keys=["r_regionkey"])
    odd = spark.sql("SELECT 1 AS k, INTERVAL '1' DAY AS i")
    return steps(spark, [
        ("content type", refused(lambda: c.write(r, "plain", mode="append", content_type=formats.CSV))), ("reader", refused(lambda: c.write(odd, "odd"))), ("append with keys", refused(lambda: c.write(r, "keyed", mode="append"))),
        ("merge without keys", refused(lambda: c.write(r, "plain", mode="merge"))), ("create again", refused(lambda: c.write(r, "plain", mode="create"))), ("append to nothing", refused(lambda: c.write(r, "none", mode="append"))),
    ])


@query("SELECT 4 AS groups, 0 AS misplaced, count(*) AS n FROM customer")
def hash_groups(spark: SparkSession, d: str) -> DataFrame:
    """Hash buckets in groups; a check of the bucketing finds no row elsewhere, also after a hash repartition."""
    x = repartition.hash_repartition(table(spark, d, "customer"), ["c_custkey"], 6).withColumn("b", hash_bucket(["c_custkey"], 12))
    wrong = misplaced(x, ["c_custkey"], 12, "b").count()
    return x.agg(F.count_distinct(hash_group(F.col("b"), 4)).cast("int").alias("groups"), F.count(F.lit(1)).alias("n")).select("groups", F.lit(wrong).cast("int").alias("misplaced"), "n")


@query(values(("twice", "ValueError"), ("transformed", "ValueError"), ("too wide", "ValueError"), ("fine", "no")))
def sort_key_checks(spark: SparkSession, d: str) -> DataFrame:
    wide = T.StructType([T.StructField(f"c{k}", T.LongType()) for k in range(5)])
    same = Transform("identity")
    check = lambda keys: refused(lambda: check_sort_keys(wide, keys))
    return steps(spark, [("twice", check([("c0", same), ("c0", same)])), ("transformed", check([("c0", Transform("bucket", 4))])), ("too wide", check([(f"c{k}", same) for k in range(5)])), ("fine", check([("c0", same), ("c1", same)]))])


@query("SELECT CAST(row_number() OVER (ORDER BY lang NULLS FIRST, doc_id DESC) AS INT) AS place, doc_id FROM documents")
def sorted_with_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Sort keys with their own place for nulls; the order is kept in a written file and numbered from it."""
    at = shared_path(spark, "sorted")
    table(spark, d, "documents").select("doc_id", "lang").repartition(1).sortWithinPartitions(*sort_columns([("lang", True, True), ("doc_id", False, False)])).write.parquet(at)
    return spark.read.parquet(at).select((F.col("_metadata.row_index") + 1).cast("int").alias("place"), "doc_id")


@query("SELECT 'kept' AS step, '15' AS value UNION ALL SELECT 'rewritten', '1' UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM customer UNION ALL SELECT 'changed', '1'")
def compaction_by_reference(spark: SparkSession, d: str) -> DataFrame:
    """One changed key: fifteen of sixteen buckets are taken over by reference."""
    c, x = _catalog(spark), table(spark, d, "customer").select("c_custkey", "c_name")
    c.write(x, "t", merge_keys=["c_custkey"], properties={"default_compaction_hash_bucket_count": 16})
    c.write(x.orderBy("c_custkey").limit(1).withColumn("c_name", F.lit("changed")), "t", mode="merge", compact=False)
    done = c.compact("t")
    r = c.read("t")
    return steps(spark, [("kept", done["kept_files"]), ("rewritten", done["rewritten_files"]), ("rows", r.count()), ("changed", r.filter("c_name = 'changed'").count())])


@query("SELECT 'before' AS step, '2' AS value UNION ALL SELECT 'after', '1' UNION ALL SELECT 'input', CAST(3 * count(*) AS VARCHAR) FROM region UNION ALL SELECT 'watermark', '3' UNION ALL SELECT 'rows', CAST(3 * count(*) AS VARCHAR) FROM region")
def compaction_trigger(spark: SparkSession, d: str) -> DataFrame:
    """Appends are compacted when there are as many deltas as the table's property says; the round says what it did."""
    c, r = _catalog(spark), table(spark, d, "region")
    c.write(r, "t", properties={"appended_delta_count_compaction_trigger": 3})
    c.write(r, "t", mode="append")
    deltas = lambda: c.manifest("t").select("stream_position").distinct().count()
    out = [("before", deltas())]
    c.write(r, "t", mode="append")
    info = c.get_table("t").data
    done = info["streams"][info["stream"]]["round"]
    return steps(spark, [*out, ("after", deltas()), ("input", done["input_records"]), ("watermark", done["watermark"]), ("rows", c.read("t").count())])


@query(values(("unseen", "false"), ("paused write", "RuntimeError"), ("status", "SUCCESS"), ("seen", "true"), ("read back", "hand made"), ("read-only past", "PermissionError"), ("before", "false")))
def transaction_control(spark: SparkSession, d: str) -> DataFrame:
    """A transaction by hand: start, steps that nobody sees, pause, resume, seal; then read by its id; the past is read-only."""
    c = _catalog(spark)
    before = now_ns()
    t = Transaction(c.log, "hand made")
    t.put(["namespaces", "n1"], {"name": "n", "properties": {}})
    out = [("unseen", str(c.namespace_exists("n")).lower())]
    t.pause()
    out.append(("paused write", refused(lambda: t.put(["namespaces", "n2"], {"name": "m", "properties": {}}))))
    t.resume()
    t.seal()
    out += [("status", t.status), ("seen", str(c.namespace_exists("n")).lower()), ("read back", c.read_transaction(t.id)["message"])]
    past = Transaction(c.log, "", before)
    return steps(spark, [*out, ("read-only past", refused(lambda: past.put(["x"], 1))), ("before", str(past.get("namespaces", "n1") is not None).lower())])


@query(values(("second writer", "Conflict"), ("other table", "no"), ("rows", 5)))
def transaction_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Two transactions on one snapshot: those that touch the same object conflict, others are both committed."""
    c, r = _catalog(spark), table(spark, d, "region")
    c.write(r, "t")
    c.write(r, "u")
    a, b, o = (Transaction(c.log, m) for m in ("a", "b", "o"))
    path, other = c.get_table("t").path, c.get_table("u").path
    a.put([*path, "description"], "a")
    b.put([*path, "description"], "b")
    o.put([*other, "description"], "o")
    a.seal()
    return steps(spark, [("second writer", refused(b.seal, Conflict)), ("other table", refused(o.seal)), ("rows", c.read("t").count())])


@query(values(("failed", 1), ("folders", 1), ("staged left", "false"), ("again", 0)))
def janitor_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """A transaction that its writer left: failed after the timeout, its staged files deleted."""
    c = _catalog(spark)
    t, at = Transaction(c.log, "left behind"), shared_path(spark, "staged")
    t.stage(at)
    table(spark, d, "region").write.parquet(at)
    time.sleep(0.01)
    done = janitor(c.log, 0)
    return steps(spark, [("failed", done["failed"]), ("folders", done["folders"]), ("staged left", str(Files(spark).exists(at)).lower()), ("again", janitor(c.log, 0)["failed"])])


@query(values(("touched", "b"), ("kinds", "NONE,APPEND,REPLACE,DELETE,DELETE"), ("nothing new", "NONE")))
def converter_since(spark: SparkSession, d: str) -> DataFrame:
    """Only partitions with files newer than a sequence number are converted; kinds of snapshots by what a commit adds and removes."""
    files = positions.FileSet([("f1", 1, "a"), ("f2", 5, "b")], [("e1", 2, "a")])
    kinds = [positions.snapshot_kind(*x) for x in ((0, 0, 0, 0), (1, 0, 0, 0), (1, 1, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0))]
    return steps(spark, [("touched", ",".join(sorted(files.touched(4)))), ("kinds", ",".join(kinds)), ("nothing new", positions.convert(spark, files, ["k"], "x", since=9)[1])])


@query(values(("acted", 2), ("errors", 2), ("versions", "1,2")))
def monitor_actions(spark: SparkSession, d: str) -> DataFrame:
    """A monitor acts once on every new version; an error beside the action does not stop it."""
    seen, feed = [], iter([1, 1, 2])
    m = Monitor(lambda: next(feed, 2), seen.append, before=lambda v: 1 / 0)
    acted = m.run(0.001, 0.05)
    return steps(spark, [("acted", acted), ("errors", len(m.errors)), ("versions", ",".join(map(str, seen)))])


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 7")
def group_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One key of a dataset of two column groups."""
    x = table(spark, d, "customer")
    g = groups.FieldGroups(spark, shared_path(spark, "groups"), "c_custkey")
    for name, cols in (("names", ["c_custkey", "c_name"]), ("nations", ["c_custkey", "c_nationkey"])):
        g.add_schema(name, x.select(*cols).schema)
        g.write(name, x.select(*cols))
    return g.lookup(7)


@query("SELECT 'parquet' AS kind, count(*) AS n, sum(s_suppkey) AS keys FROM supplier UNION ALL SELECT 'json', count(*), sum(s_suppkey) FROM supplier UNION ALL SELECT 'csv', count(*), sum(s_suppkey) FROM supplier")
def group_files(spark: SparkSession, d: str) -> DataFrame:
    """Datasets begun from Parquet, JSON and CSV files, exported and read again."""
    out, s = None, table(spark, d, "supplier").select("s_suppkey", "s_name")
    for kind in ("parquet", "json", "csv"):
        at = shared_path(spark, "source")
        s.write.format(kind).option("header", True).save(at)
        to = shared_path(spark, "export")
        groups.FieldGroups.from_files(spark, shared_path(spark, "groups"), "s_suppkey", at, kind).export(to)
        x = spark.read.parquet(to).agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("keys")).select(F.lit(kind).alias("kind"), "n", "keys")
        out = x if out is None else out.unionByName(x)
    return out


@query("SELECT s_suppkey, s_suppkey * 2 AS twice FROM supplier")
def group_plan(spark: SparkSession, d: str) -> DataFrame:
    """A plan of a selection and a step of the user's own that runs when collected."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    g = groups.FieldGroups(spark, shared_path(spark, "groups"), "s_suppkey")
    g.add_schema("all", s.schema)
    g.write("all", s)

    def double(parts):
        for p in parts:
            yield pd.DataFrame({"s_suppkey": p["s_suppkey"], "twice": p["s_suppkey"] * 2})

    return groups.LogicalPlan(g).select("s_suppkey").map(double, "s_suppkey long, twice long").collect()


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders WHERE o_orderkey BETWEEN 100 AND 5000")
def shard_range(spark: SparkSession, d: str) -> DataFrame:
    """A key range read shard by shard: each shard meets the range, and together they give every row of it once."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    g = groups.FieldGroups(spark, shared_path(spark, "groups"), "o_orderkey")
    g.add_schema("all", o.schema)
    g.write("all", o)
    parts = [g.scan(["o_orderkey"], 100, 5000, shard=s) for s in g.shards(3) if s.meet(100, 5000)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys"))


@query("SELECT * FROM (VALUES ('int', 2017239379), ('text', 1210000089), ('date', -653330422), ('time', -2047944441), ('bytes', -188683207)) t(kind, hash)")
def murmur3_known_answers(spark: SparkSession, d: str) -> DataFrame:
    """The published test values of the table format's bucket hash."""
    x = spark.sql("SELECT 34 AS i, 'iceberg' AS s, DATE'2017-11-16' AS d, TIMESTAMP_NTZ'2017-11-16 22:31:08' AS t, X'00010203' AS b")
    h = {k: table_format_hash(c, x.schema[c].dataType) for k, c in (("int", "i"), ("text", "s"), ("date", "d"), ("time", "t"), ("bytes", "b"))}
    return x.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("hash")) for k, v in h.items()])).alias("r")).select("r.*")


_M = "4294967296::UBIGINT"
_rot = lambda x, r: f"((({x}) * {2**r}::UBIGINT) % {_M} + ({x}) // {2 ** (32 - r)}::UBIGINT)"


@query(f"""WITH a AS (SELECT c_custkey, (c_custkey::UBIGINT * 3432918353::UBIGINT) % {_M} AS k FROM customer), b AS (SELECT c_custkey, ({_rot("k", 15)} * 461845907::UBIGINT) % {_M} AS h FROM a),
c AS (SELECT c_custkey, ({_rot("h", 13)} * 5 + 3864292196::UBIGINT) % {_M} AS h FROM b), e AS (SELECT c_custkey, xor(({_rot("h", 13)} * 5 + 3864292196::UBIGINT) % {_M}, 8::UBIGINT) AS h FROM c),
f AS (SELECT c_custkey, (xor(h, h // 65536::UBIGINT) * 2246822507::UBIGINT) % {_M} AS h FROM e), g AS (SELECT c_custkey, (xor(h, h // 8192::UBIGINT) * 3266489909::UBIGINT) % {_M} AS h FROM f)
SELECT c_custkey, CAST((xor(h, h // 65536::UBIGINT) % 2147483648::UBIGINT) % 16 AS INT) AS value FROM g""")
def transform_bucket_table_format_key(spark: SparkSession, d: str) -> DataFrame:
    """The table format's bucket of a whole-number key, against the hash written in SQL arithmetic."""
    x = table(spark, d, "customer")
    return x.select("c_custkey", Transform("bucket", 16, "table_format").column(x, "c_custkey").alias("value"))


@query(values(("unknown", "NotImplementedError"), ("no width", "ValueError"), ("hour of text", "TypeError"), ("truncated double", "TypeError")))
def transform_checks(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part")
    bad = lambda t, c: refused(lambda: t.column(x, c))
    return steps(spark, [("unknown", bad(Transform("unknown"), "p_name")), ("no width", bad(Transform("truncate"), "p_name")), ("hour of text", bad(Transform("hour"), "p_name")), ("truncated double", bad(Transform("truncate", 3), "p_retailprice"))])


@query(values(
    ("add required", "SchemaError"), ("add with default", "no"), ("add twice", "SchemaError"), ("remove", "SchemaError"), ("remove allowed", "no"), ("remove key", "SchemaError"), ("rename taken", "SchemaError"), ("widen", "no"), ("narrow", "SchemaError"), ("key type", "SchemaError"),
    ("required without defaults", "SchemaError"), ("none to validate", "SchemaError"), ("validate to coerce", "no"), ("conflicting", "SchemaError"), ("disabled", "SchemaError"), ("id not used again", 4),
))
def schema_update_rules(spark: SparkSession, d: str) -> DataFrame:
    """Updates that a schema allows and refuses."""
    s = Schema.of([Field("k", "int", merge_key=True), Field("v", "int"), Field("w", "string", consistency=evolution.VALIDATE)])
    up = lambda *u, **o: refused(lambda: evolution.apply_updates(s, [Update(*x) for x in u], **o), evolution.SchemaError)
    shrunk = evolution.apply_updates(s, [Update("remove", "v")], allow_incompatible=True)
    added = evolution.apply_updates(shrunk, [Update("add", "v", Field("v", "int"))])
    return steps(spark, [
        ("add required", up(("add", "x", Field("x", "int", nullable=False)))), ("add with default", up(("add", "x", Field("x", "int", nullable=False, past_default=1)))), ("add twice", up(("add", "v", "int"))), ("remove", up(("remove", "v"))),
        ("remove allowed", up(("remove", "v"), allow_incompatible=True)), ("remove key", up(("remove", "k"), allow_incompatible=True)), ("rename taken", up(("rename", "v", "w"))), ("widen", up(("type", "v", "bigint"))), ("narrow", up(("type", "v", "smallint"))),
        ("key type", up(("type", "k", "bigint"))), ("required without defaults", up(("nullable", "v", False))), ("none to validate", up(("consistency", "v", evolution.VALIDATE))), ("validate to coerce", up(("consistency", "w", evolution.COERCE))),
        ("conflicting", up(("add", "x", "int"), ("remove", "x"))), ("disabled", up(("add", "x", "int"), mode=evolution.DISABLED)), ("id not used again", added.find("v").id - s.find("k").id + 1),
    ])


@query("SELECT n_regionkey, n_nationkey, n_name, upper(n_name) AS extra FROM nation")
def schema_order_and_extras(spark: SparkSession, d: str) -> DataFrame:
    """Columns come out in the order of the schema, those that it lacks last."""
    n = table(spark, d, "nation")
    s = Schema.of([Field("n_regionkey", n.schema["n_regionkey"].dataType.simpleString()), Field("n_nationkey", n.schema["n_nationkey"].dataType.simpleString()), Field("n_name", "string")])
    out = evolution.coerce_write(n.select(F.upper("n_name").alias("extra"), "n_name", "n_nationkey", "n_regionkey"), s)[0]
    assert out.columns == ["n_regionkey", "n_nationkey", "n_name", "extra"]
    return out


@query(values(("validated", "SchemaError"), ("same type", "no"), ("wider is readable", "true"), ("narrower is not", "false"), ("text to number is not", "false")))
def schema_validation(spark: SparkSession, d: str) -> DataFrame:
    """A validated field takes its own type only; which types are readable as which."""
    s = Schema.of([Field("n_nationkey", "bigint", consistency=evolution.VALIDATE)])
    n = table(spark, d, "nation").select("n_nationkey")
    can = lambda a, b: str(evolution.compatible(evolution._simple(a), evolution._simple(b))).lower()
    return steps(spark, [
        ("validated", refused(lambda: evolution.coerce_write(n.select(F.col("n_nationkey").cast("string")), s))), ("same type", refused(lambda: evolution.coerce_write(n.select(F.col("n_nationkey").cast("bigint")), s))),
        ("wider is readable", can("int", "bigint")), ("narrower is not", can("bigint", "int")), ("text to number is not", can("string", "int")),
    ])


@query("SELECT count(*) AS n, count(*) FILTER (WHERE cold) AS cold FROM (SELECT s_acctbal < 0 AS cold FROM supplier)")
def user_steps(spark: SparkSession, d: str) -> DataFrame:
    """A user's function over Arrow batches of a table."""
    c, s = _catalog(spark), table(spark, d, "supplier")
    c.write(s, "supplier")

    def mark(parts):
        for p in parts:
            yield pd.DataFrame({"cold": p["s_acctbal"] < 0})

    x = c.read("supplier", columns=["s_acctbal"]).mapInPandas(mark, "cold boolean")
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if("cold").alias("cold"))


def _format_header(spark: SparkSession, root: str) -> dict:
    return json.loads(Files(spark).read(f"{root}/catalog.json"))


@query(values(("format", 1), ("since", "true")))
def catalog_version_file(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark)
    h = _format_header(spark, c.root)
    return steps(spark, [("format", h["format"]), ("since", str(h["since"] < time.time_ns()).lower())])
