"""Queries of the table engine's own operators, each with SQL that gives the same rows.

Merge scenarios derive an increment from a table by an expression over all of its rows, so every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog
from ..functions import expressions as E
from ..functions.transforms import Transform, hash_bucket, key_digest
from ..operators import evolution, groups, merge, positions, repartition
from ..session import shared_path, table
from ..sources import formats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# keyed merge operators


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return merge.dedupe_last(x, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


_ORDERED = """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice {}, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""


@query(_ORDERED.format("ASC"))
def dedupe_merge_order_asc(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return merge.dedupe_merge_order(x, ["o_custkey"], [merge.MergeOrder("o_totalprice", True)], ["o_orderkey"])


@query(_ORDERED.format("DESC"))
def dedupe_merge_order_desc(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return merge.dedupe_merge_order(x, ["o_custkey"], [merge.MergeOrder("o_totalprice", False)], ["o_orderkey"])


@query("SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def dedupe_event_time(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return merge.dedupe_event_time(x, ["user_id"], "ts", ["event_id"])


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'purchase'""")
def dedupe_operation_column(spark: SparkSession, d: str) -> DataFrame:
    """The purchase event of a user counts as a delete of what came before."""
    x = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type").withColumn("op", F.when(F.col("event_type") == "purchase", "DELETE").otherwise("UPSERT"))
    return merge.dedupe_operations(x, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""WITH inc AS (SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_custkey % 7 = 3
  UNION ALL SELECT o_orderkey + 100000000, o_custkey, 'N', o_totalprice FROM orders WHERE o_custkey % 11 = 5)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders o WHERE NOT EXISTS (SELECT 1 FROM inc i WHERE i.o_orderkey = o.o_orderkey) UNION ALL SELECT * FROM inc""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    changed = o.filter(F.col("o_custkey") % 7 == 3).select("o_orderkey", "o_custkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    new = o.filter(F.col("o_custkey") % 11 == 5).select((F.col("o_orderkey") + 100_000_000).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), "o_totalprice")
    return merge.upsert(o, changed.unionByName(new), ["o_orderkey"])


@query("""SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN 0.5 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT c_custkey + 100000000, NULL, NULL, 1.5, NULL FROM customer WHERE c_nationkey = 4""")
def upsert_partial(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    inc = c.filter("c_nationkey = 3").select("c_custkey", F.lit(0.5).alias("c_acctbal")).unionByName(c.filter("c_nationkey = 4").select((F.col("c_custkey") + 100_000_000).alias("c_custkey"), F.lit(1.5).alias("c_acctbal")))
    return merge.upsert_partial(c, inc, ["c_custkey"])


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def upsert_explicit_null(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return merge.upsert_partial(c, c.filter("c_nationkey = 3").select("c_custkey", F.lit(None).cast("double").alias("c_acctbal")), ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')")
def delete_equality(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return merge.equality_delete(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), gone, ["l_orderkey"])


@query("""WITH b AS (SELECT doc_id, source, nullif(lang, 'en') AS lang FROM documents), x AS (SELECT DISTINCT source, lang FROM b WHERE doc_id % 5 = 0 AND (lang IS NULL OR lang = 'de'))
SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.source IS NOT DISTINCT FROM b.source AND x.lang IS NOT DISTINCT FROM b.lang)""")
def delete_composite_null_safe(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "documents").select("doc_id", "source", F.nullif("lang", F.lit("en")).alias("lang"))
    gone = b.filter((F.col("doc_id") % 5 == 0) & (F.col("lang").isNull() | (F.col("lang") == "de")))
    return merge.equality_delete(b, gone, ["source", "lang"])


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1)")
def delete_non_key_column(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return merge.equality_delete(p, p.filter("p_size = 1").select("p_brand"), ["p_brand"])


@query("""WITH u1 AS (SELECT o_orderkey, o_orderpriority FROM orders), d2 AS (SELECT * FROM u1 WHERE o_orderpriority NOT LIKE '1%'),
u3 AS (SELECT * FROM d2 WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'again' FROM orders WHERE o_orderkey % 3 = 0), d4 AS (SELECT * FROM u3 WHERE o_orderkey % 2 <> 0)
SELECT * FROM d4 WHERE o_orderkey % 9 <> 0 UNION ALL SELECT o_orderkey, 'last' FROM orders WHERE o_orderkey % 9 = 0""")
def replay_upsert_delete(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    mod = lambda n: F.col("o_orderkey") % n == 0
    deltas = [
        merge.Delta(1, "upsert", o), merge.Delta(2, "delete", o.filter("o_orderpriority LIKE '1%'").select("o_orderpriority"), ("o_orderpriority",)),
        merge.Delta(3, "upsert", o.filter(mod(3)).withColumn("o_orderpriority", F.lit("again"))), merge.Delta(4, "delete", o.filter(mod(2)).select("o_orderkey"), ("o_orderkey",)),
        merge.Delta(5, "upsert", o.filter(mod(9)).withColumn("o_orderpriority", F.lit("last"))),
    ]
    return merge.replay(None, deltas, ["o_orderkey"])


@query("""WITH c AS (SELECT l_partkey AS k, l_orderkey AS p, l_linenumber AS r, l_quantity AS v, l_returnflag = 'R' AS del FROM lineitem),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC, r DESC, v DESC) AS rn FROM c) SELECT k, p, r, v FROM l WHERE rn = 1 AND NOT del""")
def replay_by_key(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_orderkey").alias("p"), F.col("l_linenumber").alias("r"), F.col("l_quantity").alias("v"), F.when(F.col("l_returnflag") == "R", "DELETE").otherwise("UPSERT").alias("kind"))
    return merge.replay_by_key(x, ["k"], ["p", "r", "v"]).select("k", "p", "r", "v")


@query("SELECT * FROM region UNION ALL SELECT * FROM region")
def merge_keyless(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_keyless([table(spark, d, "region"), table(spark, d, "region")])


@query("SELECT r_regionkey, r_name, NULL AS note FROM region UNION ALL SELECT n_regionkey, NULL, n_name FROM nation")
def union_by_name_evolved(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_name").alias("note"))
    return merge.merge_keyless([table(spark, d, "region"), n])


_HORNER = "0"
for _k in range(4):
    _HORNER = f"((({_HORNER}) * {2**40 % 13} + CAST('0x' || substr(h, {1 + 10 * _k}, 10) AS BIGINT)) % 13)"


@query(f"SELECT b AS bucket, count(*) AS n FROM (SELECT CAST({_HORNER} AS INT) AS b FROM (SELECT sha1(CAST(c_custkey AS VARCHAR) || 'L6kl7u5f' || coalesce(c_mktsegment, '')) AS h FROM customer)) GROUP BY b")
def pk_sha1_bucket(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer").select(hash_bucket(["c_custkey", "c_mktsegment"], 13).alias("bucket"))
    return x.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, sha1(CAST(c_custkey AS VARCHAR) || 'L6kl7u5f' || c_name) AS digest FROM customer")
def pk_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", key_digest(["c_custkey", "c_name"]).alias("digest"))


# position deletes


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """Orders as if each status were one data file written at the sequence number of its rank."""
    seq = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return table(spark, d, "orders").select("o_custkey", seq.alias("seq"), F.col("o_orderstatus").alias("file_path"), F.col("o_orderkey").alias("pos"))


_NUMBERED = "SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS seq, o_orderstatus AS file_path, o_orderkey AS pos FROM orders"
_DUPES = f"""WITH n AS ({_NUMBERED}), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY seq DESC, file_path DESC, pos DESC) AS rn FROM n)"""


@query(f"WITH n AS ({_NUMBERED}), x AS (SELECT c_custkey, 2 AS seq FROM customer WHERE c_nationkey = 5 UNION ALL SELECT c_custkey, 3 FROM customer WHERE c_nationkey = 6) SELECT file_path, pos FROM n WHERE EXISTS (SELECT 1 FROM x WHERE x.c_custkey = n.o_custkey AND x.seq > n.seq)")
def position_deletes_from_equality(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    gone = c.filter("c_nationkey IN (5, 6)").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_nationkey") == 5, 2).otherwise(3).alias("seq"))
    return positions.equality_to_positions(_numbered(spark, d), gone, ["o_custkey"])


@query(f"WITH n AS ({_NUMBERED}) SELECT n.seq AS data_seq, count(*) AS n FROM n JOIN (SELECT unnest([1, 2, 3]) AS s) x ON x.s > n.seq GROUP BY n.seq")
def delete_sequence_applicability(spark: SparkSession, d: str) -> DataFrame:
    """How many delete sequence numbers of 1 to 3 apply to the rows of each data sequence number."""
    x = _numbered(spark, d).withColumn("x", F.explode(F.array(*[F.lit(s) for s in (1, 2, 3)])))
    return x.filter(positions.applicable(F.col("x"), F.col("seq"))).groupBy(F.col("seq").alias("data_seq")).agg(F.count(F.lit(1)).alias("n"))


@query(_DUPES + "SELECT file_path, pos FROM r WHERE rn > 1")
def pk_uniqueness_positions(spark: SparkSession, d: str) -> DataFrame:
    return positions.duplicate_positions(_numbered(spark, d), ["o_custkey"])


@query(_DUPES + "SELECT o_custkey, seq, file_path, pos FROM r WHERE rn = 1")
def apply_position_deletes(spark: SparkSession, d: str) -> DataFrame:
    n = _numbered(spark, d)
    return positions.apply_positions(n, positions.duplicate_positions(n, ["o_custkey"]))


# field groups


@query("""WITH a AS (SELECT doc_id, lang, source FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 2 = 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, lang, source, n_chars FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def field_group_merge(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    return groups.merge_groups([x.filter("doc_id % 3 <> 0").select("doc_id", "lang", "source"), x.filter("doc_id % 2 = 0").select("doc_id", "n_chars")], "doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'late' ELSE lang END AS lang, source, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS n_chars FROM documents""")
def field_group_overlap(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    return groups.merge_groups([x.select("doc_id", "lang", "source"), x.filter("doc_id % 2 = 0").select("doc_id", F.lit("late").alias("lang"), "n_chars")], "doc_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1")
def field_group_levels(spark: SparkSession, d: str) -> DataFrame:
    """The line number stands for the level: the lowest wins, of equals the newest."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return groups.newest_per_group(x, "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 1000 AND 2000")
def key_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(groups.in_range(F.col("o_orderkey"), 1000, 2000))


@query("SELECT * FROM orders WHERE o_orderkey = 1234")
def key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One key of a dataset whose files are sorted by key, so that the footers leave other files out."""
    o = table(spark, d, "orders")
    g = groups.FieldGroups(spark, shared_path(spark, "groups"), "o_orderkey")
    g.add_schema("all", o.schema)
    g.write("all", o)
    return g.lookup(1234)


@query("SELECT shard, count(*) AS n FROM (SELECT CASE WHEN o_custkey <= 1 + 99 * 1 // 4 THEN 0 WHEN o_custkey <= 1 + 99 * 2 // 4 THEN 1 WHEN o_custkey <= 1 + 99 * 3 // 4 THEN 2 ELSE 3 END AS shard FROM orders WHERE o_custkey BETWEEN 1 AND 100) GROUP BY shard")
def range_shards(spark: SparkSession, d: str) -> DataFrame:
    shards = groups.range_shards(1, 100, 4)
    number = F.coalesce(*[F.when(s.column(F.col("o_custkey")), F.lit(n)) for n, s in enumerate(shards)])
    return table(spark, d, "orders").select(number.alias("shard")).filter("shard IS NOT NULL").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT min(o_custkey) AS a, max(o_custkey) - min(o_custkey) AS w FROM orders)
SELECT shard, count(*) AS n FROM (SELECT CASE WHEN o_custkey IS NULL THEN NULL WHEN o_custkey <= a + w * 1 // 4 THEN 0 WHEN o_custkey <= a + w * 2 // 4 THEN 1 WHEN o_custkey <= a + w * 3 // 4 THEN 2 ELSE 3 END AS shard FROM orders, r) GROUP BY shard""")
def range_shards_all(spark: SparkSession, d: str) -> DataFrame:
    """Shards of the whole present key range, so every row is counted; rows without a key are in no shard and counted apart."""
    o = table(spark, d, "orders").select("o_custkey")
    low, high = o.agg(F.min("o_custkey"), F.max("o_custkey")).first()
    shards = [] if low is None else groups.range_shards(low, high, 4)
    number = F.coalesce(F.lit(None).cast("int"), *[F.when(s.column(F.col("o_custkey")), F.lit(n)) for n, s in enumerate(shards)])
    return o.select(number.alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN 'new' ELSE c_mktsegment END AS c_mktsegment, c_name FROM customer")
def table_merge_right_wins(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return groups.merge_tables(c.select("c_custkey", "c_mktsegment", "c_name"), c.filter("c_nationkey < 10").select("c_custkey", F.lit("new").alias("c_mktsegment")), "c_custkey")


def _customer_groups(spark: SparkSession, d: str) -> groups.FieldGroups:
    x = table(spark, d, "customer")
    g = groups.FieldGroups(spark, shared_path(spark, "groups"), "c_custkey")
    for name, cols in (("names", ["c_custkey", "c_name"]), ("money", ["c_custkey", "c_acctbal", "c_nationkey"])):
        g.add_schema(name, x.select(*cols).schema)
        g.write(name, x.select(*cols))
    return g


@query()
def field_group_dataset(spark: SparkSession, d: str) -> DataFrame:
    """A dataset written group by group to the shared folder and scanned for two columns and a key range."""
    g = _customer_groups(spark, d)
    return g.scan(["c_custkey", "c_name", "c_acctbal"], low=10, high=500)


@query("SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer")
def field_group_dataset_all(spark: SparkSession, d: str) -> DataFrame:
    """The same dataset merged whole: all keys and all columns of all groups."""
    return _customer_groups(spark, d).scan(["c_custkey", "c_name", "c_acctbal", "c_nationkey"])


ORACLES["field_group_dataset"] = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey BETWEEN 10 AND 500"


# repartitioning and statistics


@query("SELECT range_no, count(*) AS n, sum(l_quantity) AS quantity FROM (SELECT *, CASE WHEN l_quantity IS NULL OR CAST(trunc(l_quantity) AS BIGINT) <= 10 THEN 0 WHEN CAST(trunc(l_quantity) AS BIGINT) <= 25 THEN 1 WHEN CAST(trunc(l_quantity) AS BIGINT) <= 40 THEN 2 ELSE 3 END AS range_no FROM lineitem) GROUP BY range_no")
def range_repartition(spark: SparkSession, d: str) -> DataFrame:
    """Rows written to one folder per range of the quantity and read back by folder."""
    at = shared_path(spark, "ranges")
    repartition.range_repartition(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", [10, 25, 40], at)
    return spark.read.parquet(at).groupBy(F.col("_range").alias("range_no")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE lang IS NULL) AS lang_nulls, min(lang) AS lang_min, max(lang) AS lang_max, CAST(coalesce(sum(strlen(lang)), 0) AS BIGINT) AS lang_bytes,
  count(*) FILTER (WHERE n_chars IS NULL) AS n_chars_nulls, CAST(min(n_chars) AS VARCHAR) AS n_chars_min, CAST(max(n_chars) AS VARCHAR) AS n_chars_max, CAST(sum(strlen(CAST(n_chars AS VARCHAR))) AS BIGINT) AS n_chars_bytes FROM documents""")
def column_statistics(spark: SparkSession, d: str) -> DataFrame:
    return repartition.column_statistics(table(spark, d, "documents").select("lang", "n_chars"))


@query("""SELECT stream_id, count(*) AS files, CAST(sum(meta_record_count) AS BIGINT) AS records, CAST(sum(meta_content_length) AS BIGINT) AS bytes, CAST(sum(meta_source_content_length) AS BIGINT) AS source_bytes FROM manifest_entries GROUP BY stream_id""")
def manifest_stats(spark: SparkSession, d: str) -> DataFrame:
    return repartition.file_statistics(table(spark, d, "manifest_entries"), ["stream_id"])


# predicates

_P = E.Reference("p_size")
_FILTERS: dict[str, tuple[E.Predicate, str]] = {
    "eq": (_P.eq(7), "p_size = 7"), "ne": (_P.ne(7), "p_size <> 7"), "gt": (_P.gt(40), "p_size > 40"), "lt": (_P.lt(5), "p_size < 5"), "ge": (_P.ge(45), "p_size >= 45"), "le": (_P.le(3), "p_size <= 3"),
    "and": (_P.gt(10) & E.Reference("p_retailprice").lt(1000.0), "p_size > 10 AND p_retailprice < 1000"), "or": (_P.lt(3) | _P.gt(48), "p_size < 3 OR p_size > 48"), "not": (~_P.le(45), "NOT p_size <= 45"),
    "in": (_P.isin([1, 5, 9]), "p_size IN (1, 5, 9)"), "in_empty": (_P.isin([]), "false"), "between": (_P.between(10, 12), "p_size BETWEEN 10 AND 12"), "like": (E.Reference("p_name").like("%a%e%"), "p_name LIKE '%a%e%'"), "is_null": (E.Reference("p_brand").is_null(), "p_brand IS NULL"),
}


def _filter(p: E.Predicate) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: table(spark, d, "part").filter(E.to_column(p)).select("p_partkey", "p_name", "p_size")


for _name, (_p, _sql) in _FILTERS.items():
    QUERIES[f"filter_{_name}"] = _filter(_p)
    ORACLES[f"filter_{_name}"] = f"SELECT p_partkey, p_name, p_size FROM part WHERE {_sql}"


# transforms

_TRANSFORMS: dict[str, tuple[str, str, str, Transform, str]] = {
    "identity": ("orders", "o_orderkey", "o_orderstatus", Transform("identity"), "o_orderstatus"), "truncate_str": ("part", "p_partkey", "p_name", Transform("truncate", 4), "substr(p_name, 1, 4)"),
    "truncate_int": ("part", "p_partkey", "p_size", Transform("truncate", 10), "CAST(p_size - ((p_size % 10) + 10) % 10 AS INT)"), "year": ("orders", "o_orderkey", "o_orderdate", Transform("year"), "CAST(year(o_orderdate) - 1970 AS INT)"),
    "month": ("orders", "o_orderkey", "o_orderdate", Transform("month"), "CAST((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS INT)"), "day": ("orders", "o_orderkey", "o_orderdate", Transform("day"), "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT)"),
    "hour": ("events", "event_id", "ts", Transform("hour"), "CAST(epoch(date_trunc('hour', ts)) // 3600 AS INT)"), "void": ("nation", "n_nationkey", "n_name", Transform("void"), "CAST(NULL AS VARCHAR)"),
    "bucket": ("customer", "c_custkey", "c_name", Transform("bucket", 13), ""), "bucket_table_format": ("customer", "c_custkey", "c_name", Transform("bucket", 16, "table_format"), ""),
}


def _transform(name: str, key: str, column: str, t: Transform) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        x = table(spark, d, name)
        return x.select(key, t.column(x, column).alias("value"))

    return run


for _name, (_table, _key, _column, _t, _sql) in _TRANSFORMS.items():
    QUERIES[f"transform_{_name}"] = _transform(_table, _key, _column, _t)
    if _sql:
        ORACLES[f"transform_{_name}"] = f"SELECT {_key}, {_sql} AS value FROM {_table}"
ORACLES["transform_bucket"] = f"SELECT c_custkey, CAST({_HORNER} AS INT) AS value FROM (SELECT c_custkey, sha1(c_name) AS h FROM customer)"


# schema evolution


@query("SELECT n_nationkey, n_name, n_regionkey, 'unknown' AS n_comment FROM nation")
def schema_past_default(spark: SparkSession, d: str) -> DataFrame:
    """Rows written before a field was added show its past default."""
    n = table(spark, d, "nation")
    old = evolution.Schema.infer(n)
    new = evolution.apply_updates(old, [evolution.Update("add", "n_comment", evolution.Field("n_comment", "string", past_default="unknown"))])
    return evolution.coerce_read(n, old, new)


@query("SELECT r_regionkey, r_name, 7 AS r_rank FROM region")
def schema_future_default(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region")
    schema = evolution.Schema.of([evolution.Field("r_regionkey", "int"), evolution.Field("r_name", "string"), evolution.Field("r_rank", "int", future_default=7)])
    return evolution.coerce_write(r, schema)[0]


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part")
def schema_promote_int_to_double(spark: SparkSession, d: str) -> DataFrame:
    """A field that got doubles is read as double from older files too."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    old = evolution.Schema.infer(p)
    _, new = evolution.coerce_write(p.withColumn("p_size", F.col("p_size") + F.lit(0.5)), old)
    return evolution.coerce_read(p, old, new)


@query("SELECT s_suppkey, s_name, upper(s_name) AS s_upper FROM supplier")
def schema_add_column(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return evolution.coerce_write(s.withColumn("s_upper", F.upper("s_name")), evolution.Schema.infer(s))[0]


@query("SELECT s_suppkey AS supplier_id, s_name FROM supplier")
def schema_rename_by_id(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    old = evolution.Schema.infer(s)
    return evolution.coerce_read(s, old, evolution.apply_updates(old, [evolution.Update("rename", "s_suppkey", "supplier_id")]))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part")
def schema_coerce(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))
    schema = evolution.Schema.of([evolution.Field("p_partkey", "bigint"), evolution.Field("p_size", "bigint", consistency=evolution.COERCE)])
    return evolution.coerce_write(p, schema)[0]


# tables


def _catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, shared_path(spark, "catalog"))


@query("SELECT CASE WHEN n_regionkey = 1 THEN 'changed' ELSE n_name END AS n_name, n_nationkey, n_regionkey FROM nation WHERE n_regionkey <> 2")
def table_merge_and_delete(spark: SparkSession, d: str) -> DataFrame:
    """A keyed table: created, merged into, deleted from, and read back."""
    c, n = _catalog(spark), table(spark, d, "nation")
    c.write(n, "nation", merge_keys=["n_nationkey"])
    c.write(n.filter("n_regionkey = 1").withColumn("n_name", F.lit("changed")), "nation", mode="merge")
    c.write(n.filter("n_regionkey = 2").select("n_nationkey"), "nation", mode="delete")
    return c.read("nation")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def table_merge_on_read(spark: SparkSession, d: str) -> DataFrame:
    """The same without compaction: a partial upsert and a delete on a non-key field merged on read."""
    c, o = _catalog(spark), table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    c.write(o, "orders", merge_keys=["o_orderkey"], compact=False)
    c.write(o.filter("o_orderstatus = 'O'").select("o_orderkey", F.lit(0.0).alias("o_totalprice")), "orders", mode="merge", compact=False)
    c.write(spark.createDataFrame([("F",)], "o_orderstatus string"), "orders", mode="delete", delete_columns=["o_orderstatus"], compact=False)
    return c.read("orders")


@query("SELECT * FROM region UNION ALL SELECT r_regionkey + 10, r_name FROM region UNION ALL SELECT r_regionkey + 20, r_name FROM region UNION ALL SELECT r_regionkey + 30, r_name FROM region")
def table_append_modes(spark: SparkSession, d: str) -> DataFrame:
    c, r = _catalog(spark), table(spark, d, "region")
    for n, mode in enumerate(("create", "append", "add", "chrono")):
        c.write(r.withColumn("r_regionkey", (F.col("r_regionkey") + 10 * n).cast(r.schema["r_regionkey"].dataType)), "region", mode=mode)
    return c.read("region")


@query("SELECT * FROM region")
def time_travel_as_of(spark: SparkSession, d: str) -> DataFrame:
    c, r = _catalog(spark), table(spark, d, "region")
    c.write(r, "region")
    from ..plans.log import now_ns

    moment = now_ns()
    c.write(r, "region", mode="append")
    return c.read("region", as_of=moment)


@query("SELECT n_nationkey, n_name, n_regionkey, 'now' AS at FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'before' FROM nation")
def replace_then_as_of(spark: SparkSession, d: str) -> DataFrame:
    from ..plans.log import now_ns

    c, n = _catalog(spark), table(spark, d, "nation")
    c.write(n, "nation")
    moment = now_ns()
    c.write(n.filter("n_regionkey = 0"), "nation", mode="replace")
    return c.read("nation").withColumn("at", F.lit("now")).unionByName(c.read("nation", as_of=moment).withColumn("at", F.lit("before")))


@query("SELECT * FROM (VALUES ('append default.region', 'SUCCESS'), ('auto default.region', 'SUCCESS')) t(commit_message, status)")
def txn_history_topk(spark: SparkSession, d: str) -> DataFrame:
    c, r = _catalog(spark), table(spark, d, "region")
    c.write(r, "region", "default")
    c.write(r, "region", "default", mode="append")
    return c.transactions(limit=2).select("commit_message", "status")


@query("SELECT 'region.parquet' AS file, count(*) AS n FROM region UNION ALL SELECT 'nation.parquet', count(*) FROM nation")
def scan_projection_file_path(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("region", "nation"):
        x = formats.with_file_path(table(spark, d, name)).groupBy(F.regexp_extract("file_path", r"([a-z_]+\.parquet)", 1).alias("file")).agg(F.count(F.lit(1)).alias("n"))
        out = x if out is None else out.unionByName(x)
    return out


@query("SELECT stream_id, count(*) AS entries, count(DISTINCT uri) AS uris FROM manifest_entries GROUP BY stream_id")
def schemaless_manifest_read(spark: SparkSession, d: str) -> DataFrame:
    """A table without schema reads as a manifest; the data are read through it."""
    c = _catalog(spark)
    c.create_table("entries")
    c.write(table(spark, d, "manifest_entries").select("stream_id", "uri"), "entries", mode="append")
    return formats.from_manifest(spark, c.read("entries")).groupBy("stream_id").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("uri").alias("uris"))


def _round_trip(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        at = shared_path(spark, "format")
        x = table(spark, d, "part")
        formats.write(x, at, kind, records_per_file=500)
        schema = x.schema if kind != formats.FEATHER else None
        return formats.read(spark, at, kind, schema=T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]) if schema else None).select(*x.columns)

    return run


for _kind in (formats.PARQUET, formats.ORC, formats.JSON, formats.CSV, formats.TSV, formats.PSV, formats.FEATHER):
    QUERIES[f"format_{_kind.split('/')[1]}"] = _round_trip(_kind)
    ORACLES[f"format_{_kind.split('/')[1]}"] = "SELECT * FROM part"


@query("SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS lifetime FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def join_group_sum(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("lifetime"))


@query("SELECT CAST(o_orderkey % 4 + 1 AS BIGINT) AS stream_position, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders WHERE o_orderkey % 4 IN (1, 2) GROUP BY ALL")
def incremental_window(spark: SparkSession, d: str) -> DataFrame:
    """The deltas of a table in the window (watermark, last position]."""
    c, o = _catalog(spark), table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    for k in range(4):
        c.write(o.filter(F.col("o_orderkey") % 4 == k), "orders", mode="append" if k else "create")
    return c.read_window("orders", 1, 3).groupBy("stream_position").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY l_returnflag")
def table_range_repartition(spark: SparkSession, d: str) -> DataFrame:
    """A table rewritten as one delta per range of the quantity holds the same rows."""
    c = _catalog(spark)
    c.write(table(spark, d, "lineitem"), "lineitem")
    c.repartition("lineitem", "l_quantity", [10, 25, 40])
    return c.read("lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey <> 3")
def table_rebase(spark: SparkSession, d: str) -> DataFrame:
    """A keyed table rebuilt from another one, with its deletes."""
    c, s = _catalog(spark), table(spark, d, "supplier")
    c.write(s, "source", merge_keys=["s_suppkey"], compact=False)
    c.write(s.filter("s_nationkey = 3").select("s_suppkey"), "source", mode="delete", compact=False)
    c.write(s, "target", merge_keys=["s_suppkey"])
    c.rebase("target", "source")
    return c.read("target")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 5 <> 0")
def converter_session(spark: SparkSession, d: str) -> DataFrame:
    """Data and equality deletes as files, converted to position deletes, which are then applied."""
    at, o = shared_path(spark, "convert"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    data = [(f, 1, "all") for f, _ in formats.write(o, f"{at}/data")]
    gone = [(f, 2, "all") for f, _ in formats.write(o.filter("o_custkey % 5 = 0").select("o_orderkey"), f"{at}/equality")]
    new, _ = positions.convert(spark, positions.FileSet(data, gone), ["o_orderkey"], f"{at}/positions")
    rows = positions.with_positions(spark, [f for f, _, _ in new.data])
    return positions.apply_positions(rows, spark.read.parquet(*[f for f, _, _ in new.position])).select("o_orderkey", "o_custkey")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All events as a stream of four batches in order of time, merged into a keyed table.

    The event time decides between events of a user in one batch (of equal times the later row), a later batch wins.
    """
    from ..streaming.sinks import upsert_stream

    at, x = shared_path(spark, "stream"), table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    cuts = x.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.25, 0.5, 0.75])).first()[0] or []
    number = sum((F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) > F.lit(v), F.lit(False)).cast("int") for v in sorted(set(cuts))), F.lit(0))
    for k in range(len(set(cuts)) + 1):
        x.filter(number == k).coalesce(1).sortWithinPartitions("ts", "event_id").write.mode("append").parquet(f"{at}/source")
    c = _catalog(spark)
    kind = x.schema["ts"].dataType.simpleString()
    c.create_table("latest", schema=evolution.Schema.of([evolution.Field("user_id", "bigint", merge_key=True), evolution.Field("event_id", "bigint"), evolution.Field("event_type", "string"), evolution.Field("ts", kind, event_time=True)]))
    source = spark.readStream.schema(f"user_id bigint, event_id bigint, event_type string, ts {kind}").option("maxFilesPerTrigger", 1).parquet(f"{at}/source")
    upsert_stream(source, c, "latest", f"{at}/checkpoint").awaitTermination()
    return c.read("latest", columns=["user_id", "event_id", "event_type"])


@query("SELECT 'ADD' AS delta_type, 2 AS files, 2 * count(*) AS records FROM region")
def delta_statistics(spark: SparkSession, d: str) -> DataFrame:
    c, r = _catalog(spark), table(spark, d, "region").coalesce(1)
    c.create_table("region", schema=evolution.Schema.infer(r))
    for _ in range(2):
        c.write(r, "region", mode="add")
    return c.statistics("region").select("delta_type", F.col("files").cast("int").alias("files"), F.col("records").cast("long").alias("records"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def partition_pruned_read(spark: SparkSession, d: str) -> DataFrame:
    """A table partitioned by nation of which only one nation's files are planned."""
    c, x = _catalog(spark), table(spark, d, "customer")
    c.write(x, "customer", schema=evolution.Schema.infer(x), partition_by=[("c_nationkey", Transform("identity"), "nation")])
    return c.read("customer", columns=["c_custkey", "c_name"], partition_filter={"nation": [7]})


@query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def sql_over_views(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots registered as views and joined in Spark SQL."""
    c = _catalog(spark)
    with c.transaction("two tables"):
        for name in ("nation", "region"):
            c.write(table(spark, d, name), name)
    n, r = c.view("nation", name="snapshot_nation"), c.view("region", name="snapshot_region")
    return spark.sql(f"SELECT n_name AS name, r_name AS region FROM {n} JOIN {r} ON n_regionkey = r_regionkey")
