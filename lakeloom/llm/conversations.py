"""Rebuilding conversations from message rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import row_numbers
from ..session import cut

#: Signs that show nothing, besides white space, separators, control and format characters.
BLANKS = r"⠀ㅤᅟᅠﾠ͏︀-️"
#: Any visible character.
VISIBLE = rf"[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}{BLANKS}]"
MESSAGE = ["group_id", "msg_id"]


def has_text(text: Column) -> Column:
    """False for null, empty, white space and invisible characters."""
    return F.coalesce(text.rlike(VISIBLE), F.lit(False))


def sender_key(name: Column) -> Column:
    """The name trimmed and without case; null if it is null or blank."""
    edge = rf"[\s\p{{Z}}\p{{Cc}}\p{{Cf}}{BLANKS}]+"
    bare = F.lower(F.regexp_replace(name, f"^{edge}|{edge}$", ""))
    return F.when(bare != "", bare)


def reply_number(reply_to: Column) -> Column:
    """``reply_to`` read as a number: leading zeros, a hash sign, a zero fraction and white space are allowed; else null."""
    digits = F.regexp_extract(reply_to, r"^[\s\p{Z}]*#?[\s\p{Z}]*\+?([0-9]+)(?:\.0*)?[\s\p{Z}]*$", 1)
    return F.when(digits != "", digits.try_cast("long"))


def fold(messages: DataFrame) -> DataFrame:
    """One row per message: its versions (first delivery, edits, retries, deletions to a blank text) folded to the last.

    The version with the latest ``ingested_at`` counts, of equal ones that with the greatest ``row_id``; a last version
    without text is a deletion: the message stays a link of its chain but takes no turn. Only what decides is shuffled,
    not the texts. Rows without group or message id can't be addressed and are dropped.
    """
    x = messages.filter(F.col("group_id").isNotNull() & F.col("msg_id").isNotNull()).select(
        *MESSAGE, "ingested_at", "row_id", "sent_at", reply_number(F.col("reply_to")).alias("parent"), sender_key(F.col("sender_name")).alias("sender"), has_text(F.col("message")).alias("has_text")
    )
    last = x.groupBy(*MESSAGE).agg(F.max(F.struct("ingested_at", "row_id", "sent_at", "parent", "sender", "has_text")).alias("_m"))
    return last.select(*MESSAGE, "_m.row_id", "_m.sent_at", "_m.parent", "_m.sender", "_m.has_text")


def roots(folded: DataFrame) -> DataFrame:
    """``folded`` with ``root`` (null: the chain meets a missing message or never ends) and ``early`` (sent before its parent).

    Pointer doubling: after k rounds every chain of up to 2 ** k replies is followed, so a chain of a million replies
    takes 20 joins. A round that ends no chain proves that the rest are cycles. Joins are on (group, message), so a hot
    group spreads over all tasks; many replies to one message are split by the adaptive skew join.
    """
    p = folded.select(F.col("group_id").alias("_g"), F.col("msg_id").alias("_id"), F.col("sent_at").alias("_sent"), F.col("parent").alias("_up"))
    first = folded.join(p, (folded["group_id"] == p["_g"]) & (folded["parent"] == p["_id"]), "left")
    state = first.select(
        *folded.columns,
        F.when(F.col("parent").isNull(), F.col("msg_id")).when(F.col("_id").isNotNull() & F.col("_up").isNull(), F.col("_id")).alias("root"),
        F.when(F.col("_id").isNotNull(), F.col("_up")).alias("ptr"),  # null: the chain has ended, at a root or a missing message
        F.coalesce(F.col("sent_at") < F.col("_sent"), F.lit(False)).alias("early"),
    )
    state = cut(state)
    # rows that are settled stay where they were written; a round writes only those that were open before it
    settled, open_ = [state.filter("ptr IS NULL")], state.filter("ptr IS NOT NULL")
    left = open_.count()
    while left:
        known = reduce(DataFrame.unionByName, [*settled, open_])
        t = known.select(F.col("group_id").alias("_g"), F.col("msg_id").alias("_id"), F.col("root").alias("_root"), F.col("ptr").alias("_ptr"))
        moved = open_.join(t, (open_["group_id"] == t["_g"]) & (open_["ptr"] == t["_id"]), "left")
        moved = cut(moved.select(*[c for c in state.columns if c not in ("root", "ptr", "early")], F.col("_root").alias("root"), F.col("_ptr").alias("ptr"), "early"))
        settled.append(moved.filter("ptr IS NULL"))
        open_ = moved.filter("ptr IS NOT NULL")
        now = open_.count()
        if now == left:
            break  # only cycles are left
        left = now
    # what is still open never ends and has no root
    return reduce(DataFrame.unionByName, [*settled, open_.withColumn("root", F.lit(None).cast(state.schema["root"].dataType))]).drop("ptr")


def conversations(messages: DataFrame, piece_rows: int = 1_000_000) -> DataFrame:
    """Turns of the kept conversations: (group_id, root_msg_id, turn, msg_id, role, row_id).

    Left out are conversations with a message without sender, a reply sent before the message it answers, or texts of
    fewer than two senders. ``role`` is opener for the root's sender, else responder. A third of all rows in one
    conversation is numbered in pieces; conversation facts are partial aggregates (least and greatest sender instead of
    sets). Nulls: a null ``sent_at`` sorts first and is never early. Empty input gives an empty result.
    """
    whole = roots(fold(messages)).filter("root IS NOT NULL")
    facts = whole.groupBy("group_id", "root").agg(
        F.max(F.col("sender").isNull() | F.col("early")).alias("bad"),
        F.min(F.when(F.col("has_text"), F.col("sender"))).alias("least"), F.max(F.when(F.col("has_text"), F.col("sender"))).alias("greatest"),
        F.max(F.when(F.col("msg_id") == F.col("root"), F.col("sender"))).alias("opener"),
    )
    kept = facts.filter(~F.col("bad") & (F.col("least") < F.col("greatest"))).select("group_id", "root", "opener")
    turns = whole.filter("has_text").join(kept, ["group_id", "root"])
    role = F.when(F.col("sender") == F.col("opener"), "opener").otherwise("responder")
    out = turns.select("group_id", F.col("root").alias("root_msg_id"), "msg_id", "sent_at", "row_id", role.alias("role"))
    return row_numbers(out, ["group_id", "root_msg_id"], ["sent_at", "msg_id"], "turn", piece_rows).select("group_id", "root_msg_id", "turn", "msg_id", "role", "row_id")


def transcripts(messages: DataFrame) -> DataFrame:
    """The turns with their sender names and texts, joined back by row id only for kept turns."""
    t = conversations(messages)
    return t.join(messages.select("row_id", "sender_name", "message"), "row_id").drop("row_id")
