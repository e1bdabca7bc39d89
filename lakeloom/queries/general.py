"""Queries of the general training-data problems 3, 4, 5 and 7, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changefeed, drift, incremental, smallfiles
from ..plans.store import Conflict
from ..session import shared_path, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.pending(table(spark, d, "deltas"), table(spark, d, "run_log")).select("stream_id", "partition_id", "stream_position")


def p3_by_stream(spark: SparkSession, d: str) -> DataFrame:
    """Pending deltas and their partitions per stream."""
    found = p3_found(spark, d)
    per = found.groupBy("stream_id", "partition_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("stream_id").agg(F.sum("n").alias("pending"), F.count(F.lit(1)).alias("partitions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The feed applied to a new bucketed table in three batches as it was received, read back through its manifest.

    The later batches repeat and correct rows of the earlier ones and rewrite the buckets that they touch.
    """
    store = changefeed.BucketedTable(spark, shared_path(spark, "change-feed"))
    for batch in changefeed.received_parts(table(spark, d, "change_feed"), 3):
        store.apply(batch)
        store.expire()
    return store.rows().select("stream_id", "partition_id", "stream_position", "file_index", "record_index")


def p4_batches(spark: SparkSession, d: str) -> DataFrame:
    """The feed applied in four batches that are out of order in every respect: rows fall into them by the hash of their id."""
    feed = table(spark, d, "change_feed")
    store = changefeed.BucketedTable(spark, shared_path(spark, "change-feed"))
    for k in range(4):
        store.apply(feed.filter(F.pmod(F.xxhash64("change_id"), F.lit(4)) == k))
    return store.rows().select("stream_id", "partition_id", "pk1", "pk2", "value")


def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    """The present rows by plain relational steps, without a store."""
    return changefeed.final_rows(table(spark, d, "change_feed")).select("stream_id", "partition_id", "pk1", "pk2", "value")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    x = drift.drift(table(spark, d, "raw_files"), table(spark, d, "manifest_entries"), table(spark, d, "schema_fields"))
    return x.select("stream_id", "stream_position", "field_id", "change_kind")


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of every file under its field's newest name and type, with failed casts marked."""
    return drift.consistent_cells(table(spark, d, "raw_files"), table(spark, d, "manifest_entries"), table(spark, d, "schema_fields")).drop("uri")


def _p7(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "deltas"), table(spark, d, "manifest_entries"), table(spark, d, "compaction_targets")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The files that a partition-local merge of the versioned listing replaces."""
    return smallfiles.compacted_listing(spark, shared_path(spark, "listing"), *_p7(spark, d)).replaced().select("entry_id")


def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    return smallfiles.plan_summary(smallfiles.merge_plan(*_p7(spark, d)))


def p7_overfull(spark: SparkSession, d: str) -> DataFrame:
    """Outputs whose files without the last one reach a capacity; there must be none."""
    plan = smallfiles.compacted_listing(spark, shared_path(spark, "listing"), *_p7(spark, d)).replaced()
    x = plan.groupBy("namespace", *smallfiles.PARTITION, "output_no").agg(
        F.sum("meta_content_length").alias("bytes"), F.max("meta_content_length").alias("b"), F.sum("meta_record_count").alias("records"), F.max("meta_record_count").alias("r"), F.max("capacity_bytes").alias("cb"), F.max("capacity_records").alias("cr"),
    )
    return x.filter("bytes - b >= cb OR records - r >= cr").select("namespace", *smallfiles.PARTITION, "output_no", "bytes", "records")


def p7_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Listings written as a folder of many small files per format, merged for good, and counted by format.

    The rows arrive in five appends. A second writer that merges the same files from the same version is refused.
    """
    at, e = shared_path(spark, "folder"), table(spark, d, "manifest_entries").select("entry_id", "meta_record_count", F.coalesce(F.lower(F.regexp_extract("meta_content_type", "^[^;]*", 0)), F.lit("none")).alias("format"))
    one, two = (smallfiles.CompactedFolder(spark, at, "format") for _ in range(2))
    for k in range(5):
        one.append(e.filter(F.pmod("entry_id", F.lit(5)) == k))
    stage, refused = two.store.stage, False

    def other_first() -> str:
        two.store.stage = stage
        one.merge_small(1 << 27, 1 << 27)
        return stage()

    two.store.stage = other_first
    try:
        two.merge_small(1 << 27, 1 << 27)
    except Conflict:
        refused = True
    rows = one.read().groupBy("format").agg(F.count(F.lit(1)).alias("entries"), F.sum("meta_record_count").alias("records"))
    most = one.manifest().groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return rows.select("format", "entries", "records", F.lit(len(one.store.versions())).alias("versions"), F.lit(refused).alias("refused"), F.lit(most).cast("int").alias("most_files"))


QUERIES = {f.__name__: f for f in (p3_found, p3_by_stream, p4_found, p4_batches, p4_rows, p5_found, p5_table, p7_found, p7_plan, p7_overfull, p7_rewrite)}

_PENDING = """
WITH runs AS (SELECT stream_id, partition_id, max(as_of) AS as_of FROM run_log WHERE upper(trim(status)) = 'SUCCESS' GROUP BY ALL),
v AS (SELECT d.stream_id, d.partition_id, d.stream_position, d.manifest_id, d.committed_at, r.as_of
  FROM deltas d LEFT JOIN runs r ON d.stream_id IS NOT DISTINCT FROM r.stream_id AND d.partition_id IS NOT DISTINCT FROM r.partition_id
  WHERE d.committed_at IS NOT NULL),
s AS (SELECT stream_id, partition_id, stream_position, max({'c': committed_at, 'm': manifest_id}).m AS n,
  max({'c': committed_at, 'm': manifest_id}) FILTER (WHERE committed_at < as_of).m AS o FROM v GROUP BY ALL),
pending AS (SELECT stream_id, partition_id, stream_position FROM s WHERE n IS DISTINCT FROM o)
"""

_FEED = """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY stream_id, partition_id, stream_position, file_index, record_index ORDER BY received_at DESC, change_id DESC) AS rn FROM change_feed),
c AS (SELECT *, lower(trim(delta_type)) AS kind, {'a': stream_position, 'b': file_index, 'c': record_index} AS seq FROM f WHERE rn = 1),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, partition_id, pk1, pk2 ORDER BY seq DESC) AS kn FROM c WHERE kind IN ('append', 'upsert')) WHERE kn = 1),
d AS (SELECT *, string_split(replace(lower(coalesce(nullif(trim(delete_columns), ''), 'pk1,pk2')), ' ', ''), ',') AS cols FROM c WHERE kind = 'delete'),
final AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.stream_id = k.stream_id AND d.partition_id = k.partition_id AND d.seq > k.seq
  AND (NOT list_contains(d.cols, 'pk1') OR d.pk1 IS NOT DISTINCT FROM k.pk1) AND (NOT list_contains(d.cols, 'pk2') OR d.pk2 IS NOT DISTINCT FROM k.pk2)
  AND (NOT list_contains(d.cols, 'value') OR d.value IS NOT DISTINCT FROM k.value)))
"""

_SMALL = """
WITH n AS (SELECT stream_id, partition_id, stream_position, max({'c': committed_at, 'm': manifest_id, 'n': namespace}) AS v FROM deltas WHERE committed_at IS NOT NULL GROUP BY ALL),
l AS (SELECT e.*, n.v.n AS namespace, replace(replace(replace(regexp_replace(regexp_replace(trim(e.uri), '^[sS]3[aA]?://', ''), '/(\\./|/)+', '/', 'g'), '%3D', '='), '%3d', '='), ' ', '') AS obj
  FROM manifest_entries e JOIN n ON e.stream_id = n.stream_id AND e.partition_id = n.partition_id AND e.stream_position = n.stream_position AND e.manifest_id = n.v.m),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY entry_id) AS rn FROM l) WHERE rn = 1),
s AS (SELECT o.*, t.capacity_bytes, t.capacity_records FROM o JOIN compaction_targets t ON o.namespace = t.namespace
  WHERE o.meta_content_length < t.min_file_bytes AND NOT EXISTS (SELECT 1 FROM deltas d WHERE d.stream_id = o.stream_id AND d.partition_id = o.partition_id AND lower(trim(d.delta_type)) IN ('upsert', 'delete'))),
found AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY stream_id, partition_id) AS n FROM s) WHERE n >= 2)
"""

_DRIFT = """
WITH f AS (SELECT uri, stream_id, stream_position, ltrim(ltrim(content, chr(65279)), chr(10) || chr(13) || ' ') AS c FROM raw_files),
l AS (SELECT *, list_filter(string_split_regex(c, '\\r\\n|\\r|\\n'), lambda x: trim(x) <> '') AS lines FROM f WHERE c <> ''),
n AS (SELECT uri, stream_id, stream_position, list_sort(list_distinct(list_transform(CASE WHEN c LIKE '{%' THEN flatten(list_transform(lines, lambda x: json_keys(x)))
  ELSE string_split_regex(lines[1], '[\\t|,;]') END, lambda k: lower(trim(k))))) AS names FROM l),
s AS (SELECT stream_id, schema_id, list_sort(list_distinct(list(lower(trim(field_name))))) AS names, list_sort(list_distinct(list({'i': field_id, 'n': lower(trim(field_name)), 't': lower(trim(field_type))}))) AS fields FROM schema_fields GROUP BY ALL),
m AS (SELECT uri, arg_min(meta_schema_id, entry_id) AS told FROM manifest_entries WHERE meta_schema_id IS NOT NULL GROUP BY uri),
c AS (SELECT n.uri, n.stream_id, n.stream_position, s.fields, row_number() OVER (PARTITION BY n.uri ORDER BY s.schema_id IS NOT DISTINCT FROM m.told DESC, s.schema_id) AS rn
  FROM n LEFT JOIN m ON n.uri = m.uri JOIN s ON s.stream_id = n.stream_id AND s.names = n.names),
p AS (SELECT stream_id, stream_position, fields, lag(fields) OVER (PARTITION BY stream_id ORDER BY stream_position) AS was FROM c WHERE rn = 1),
i AS (SELECT stream_id, stream_position, fields, was, unnest(list_distinct(list_concat(list_transform(fields, lambda x: x.i), list_transform(was, lambda x: x.i)))) AS field_id FROM p WHERE was IS NOT NULL),
b AS (SELECT stream_id, stream_position, field_id, list_filter(was, lambda x: x.i = field_id)[1] AS o, list_filter(fields, lambda x: x.i = field_id)[1] AS w FROM i),
d AS (SELECT stream_id, stream_position, field_id, unnest([CASE WHEN o IS NULL THEN 'added' END, CASE WHEN w IS NULL THEN 'removed' END, CASE WHEN o.n <> w.n THEN 'renamed' END, CASE WHEN o.t <> w.t THEN 'retyped' END]) AS change_kind FROM b)
SELECT * FROM d WHERE change_kind IS NOT NULL"""

ORACLES = {
    "p5_found": _DRIFT,
    "p3_found": _PENDING + "SELECT * FROM pending",
    "p3_by_stream": _PENDING + "SELECT stream_id, count(*) AS pending, count(DISTINCT partition_id) AS partitions FROM pending GROUP BY stream_id",
    "p4_found": _FEED + "SELECT stream_id, partition_id, stream_position, file_index, record_index FROM final",
    "p4_batches": _FEED + "SELECT stream_id, partition_id, pk1, pk2, value FROM final",
    "p4_rows": _FEED + "SELECT stream_id, partition_id, pk1, pk2, value FROM final",
    "p7_found": _SMALL + "SELECT entry_id FROM found",
    # written apart from the operator: an output begins where the files before reach a further multiple of a capacity
    "p7_plan": _SMALL + """, r AS (SELECT *, coalesce(meta_record_count, 0) AS rc, row_number() OVER w AS place, coalesce(sum(meta_content_length) OVER b, 0) AS b0, coalesce(sum(coalesce(meta_record_count, 0)) OVER b, 0) AS r0
  FROM found WINDOW w AS (PARTITION BY stream_id, partition_id ORDER BY stream_position, entry_id), b AS (PARTITION BY stream_id, partition_id ORDER BY stream_position, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, place = 1 OR (b0 // capacity_bytes) <> lag(b0 // capacity_bytes) OVER w OR (r0 // capacity_records) <> lag(r0 // capacity_records) OVER w AS begins FROM r WINDOW w AS (PARTITION BY stream_id, partition_id ORDER BY stream_position, entry_id))
SELECT namespace, stream_id, partition_id, count(*) AS small_files, count(*) FILTER (WHERE begins) AS output_files, CAST(sum(meta_content_length) AS BIGINT) AS bytes, CAST(sum(meta_record_count) AS BIGINT) AS records FROM g GROUP BY ALL""",
    "p7_overfull": "SELECT CAST(NULL AS VARCHAR) AS namespace, CAST(NULL AS VARCHAR) AS stream_id, CAST(NULL AS VARCHAR) AS partition_id, CAST(NULL AS INT) AS output_no, CAST(NULL AS BIGINT) AS bytes, CAST(NULL AS BIGINT) AS records WHERE false",
    "p7_rewrite": """SELECT coalesce(lower(regexp_extract(meta_content_type, '^[^;]*')), 'none') AS format, count(*) AS entries, CAST(sum(meta_record_count) AS BIGINT) AS records, 6 AS versions, true AS refused, 1 AS most_files FROM manifest_entries GROUP BY ALL""",
}
