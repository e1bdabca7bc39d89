"""Queries of the problems tagged llm (1, 2, 6, 8, 9, 10), over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from . import conversations, leakage, packing, private, quality, tokens


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "messages")).select("group_id", "root_msg_id", "turn", "msg_id")


def p1_turns(spark: SparkSession, d: str) -> DataFrame:
    """The conversations with roles, sender names and texts."""
    return conversations.transcripts(table(spark, d, "messages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return private.found_spans(table(spark, d, "messages")).select("row_id", "field_name", "kind", "start_pos")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return private.redacted(table(spark, d, "messages").select("row_id", "message", "sender_ph"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "deltas"), table(spark, d, "compaction_targets")).drop("capacity_bytes", "capacity_records")


def p6_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every newest committed delta with the sums and the number of its pieces, and whether all its containers keep their capacities."""
    x = packing.pack(table(spark, d, "deltas"), table(spark, d, "compaction_targets"))
    full = x.groupBy("namespace", "container_id").agg((F.coalesce(F.sum("piece_bytes") <= F.max("capacity_bytes"), F.lit(True)) & F.coalesce(F.sum("piece_records") <= F.max("capacity_records"), F.lit(True))).alias("kept"))
    on = (F.col("x.namespace") == F.col("f.namespace")) & F.col("x.container_id").eqNullSafe(F.col("f.container_id"))
    each = x.alias("x").join(full.alias("f"), on, "left").groupBy(*[F.col(f"x.{k}") for k in packing.KEY])
    return each.agg(F.count(F.lit(1)).alias("pieces"), F.sum("piece_bytes").alias("bytes"), F.sum("piece_records").alias("records"), F.min("kept").alias("kept"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.pack(table(spark, d, "deltas"), table(spark, d, "compaction_targets")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", tokens.token_ids(F.col("text")).alias("ids"))


def p8_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per source, and characters per token."""
    x = spread(table(spark, d, "documents").select("source", "n_chars", "text")).select("source", "n_chars", F.size(tokens.token_ids(F.col("text"))).alias("n"))
    return x.groupBy("source").agg(F.sum("n").alias("tokens"), F.sum("n_chars").alias("chars"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.kinds(table(spark, d, "documents")).filter("kind <> 'prose'").select("doc_id", "kind")


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    """Word count, mean word length, symbol ratio, share of lines that end in punctuation, share of common words."""
    x = quality.statistics(table(spark, d, "documents"))
    return x.select("doc_id", F.col("n_words").cast("long").alias("n_words"), *[F.round(c, 6).alias(c) for c in ("mean_word", "symbol_ratio", "punct_line_share", "common_share")])


QUERIES = {f.__name__: f for f in (p1_found, p1_turns, p2_found, p2_redacted, p6_containers, p6_whole, p6_fill, p8_ids, p8_sizes, p9_found, p10_found, p10_stats)}

_V = "[^\\s\\p{Z}\\p{Cc}\\p{Cf}" + conversations.BLANKS + "]"
_EDGE = "[\\s\\p{Z}\\p{Cc}\\p{Cf}" + conversations.BLANKS + "]+"
_TURNS = f"""
WITH RECURSIVE f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, msg_id ORDER BY ingested_at DESC NULLS LAST, row_id DESC) AS rn FROM messages WHERE group_id IS NOT NULL AND msg_id IS NOT NULL) WHERE rn = 1),
m AS (SELECT group_id, msg_id, row_id, sent_at, sender_name, message, try_cast(nullif(regexp_extract(reply_to, '^[\\s\\p{{Z}}]*#?[\\s\\p{{Z}}]*\\+?([0-9]+)(?:\\.0*)?[\\s\\p{{Z}}]*$', 1), '') AS BIGINT) AS parent,
  nullif(regexp_replace(regexp_replace(lower(sender_name), '^{_EDGE}', ''), '{_EDGE}$', ''), '') AS sender, coalesce(regexp_matches(message, '{_V}'), false) AS has_text FROM f),
tree AS (SELECT *, msg_id AS root, false AS early FROM m WHERE parent IS NULL
  UNION ALL SELECT c.*, t.root, coalesce(c.sent_at < t.sent_at, false) FROM tree t JOIN m c ON c.group_id = t.group_id AND c.parent = t.msg_id),
k AS (SELECT group_id, root, max(sender) FILTER (WHERE msg_id = root) AS opener FROM tree GROUP BY ALL HAVING NOT bool_or(sender IS NULL OR early) AND count(DISTINCT sender) FILTER (WHERE has_text) >= 2),
turns AS (SELECT t.group_id, t.root AS root_msg_id, CAST(row_number() OVER (PARTITION BY t.group_id, t.root ORDER BY t.sent_at NULLS FIRST, t.msg_id) AS INT) AS turn, t.msg_id,
  CASE WHEN t.sender = k.opener THEN 'opener' ELSE 'responder' END AS role, t.sender_name, t.message FROM tree t JOIN k ON t.group_id = k.group_id AND t.root = k.root WHERE t.has_text)
"""
_COMMON = ", ".join(f"'{w}'" for w in quality.COMMON)

ORACLES = {
    "p6_whole": """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY stream_id, partition_id, stream_position ORDER BY committed_at DESC, manifest_id DESC) AS rn FROM deltas WHERE committed_at IS NOT NULL),
n AS (SELECT d.stream_id, d.partition_id, d.stream_position, greatest(coalesce(d.content_length, 0), 0) AS bytes, greatest(coalesce(d.record_count, 0), 0) AS records, t.capacity_bytes AS cb, t.capacity_records AS cr FROM d LEFT JOIN compaction_targets t ON d.namespace = t.namespace WHERE rn = 1)
SELECT stream_id, partition_id, stream_position, CAST(coalesce(greatest(1, ceil(bytes / cb), ceil(records / cr)), 1) AS BIGINT) AS pieces, bytes, records, true AS kept FROM n""",
    "p1_found": _TURNS + "SELECT group_id, root_msg_id, turn, msg_id FROM turns",
    "p1_turns": _TURNS + "SELECT * FROM turns",
    "p9_found": """
WITH iw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM eval_items WHERE text IS NOT NULL),
i AS (SELECT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS p FROM (SELECT item_id, w, least(len(w), 12) AS n, unnest(range(1, len(w) - least(len(w), 12) + 2)) AS s FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, n, array_to_string(w[s : s + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM i) WHERE len(w) >= n))
SELECT DISTINCT d.doc_id, i.item_id FROM d JOIN i ON d.n = i.n AND d.p = i.p""",
    "p10_stats": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, list_filter(string_split_regex(lower(t), '[^\\p{{L}}\\p{{M}}]+'), lambda w: w <> '') AS words, list_filter(string_split_regex(t, '[\\s\\x0b\\p{{Z}}]+'), lambda w: w <> '') AS tokens,
  len(regexp_extract_all(t, '[^\\s\\x0b\\p{{Z}}]')) AS n, len(regexp_extract_all(t, '[^\\s\\x0b\\p{{Z}}\\p{{L}}\\p{{M}}\\p{{N}}]')) AS symbols,
  list_filter(string_split_regex(t, '\\r\\n|[\\n\\r\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda s: regexp_matches(s, '[^\\s\\p{{Z}}\\p{{Cf}}]')) AS lines FROM t)
SELECT doc_id, len(words) AS n_words, round(coalesce(n / nullif(len(tokens), 0), 0), 6) AS mean_word, round(coalesce(symbols / nullif(n, 0), 0), 6) AS symbol_ratio,
  round(coalesce(len(list_filter(lines, lambda s: regexp_matches(s, '[.!?…:;。！？؟।]["''”’»)\\]]*\\s*$'))) / nullif(len(lines), 0), 0), 6) AS punct_line_share,
  round(coalesce(len(list_filter(words, lambda w: w IN ({_COMMON}))) / nullif(len(words), 0), 0), 6) AS common_share FROM x""",
}
