"""Evaluation passages in training documents: size-partitioned MinHash containment search with exact verification.

The searched sets are not whole items, which can be long and leak in part, but the smallest leaking passages: every
window of 12 words of an item, or the whole item if it is shorter. These query sets are partitioned by size. The sketch
of a passage is the MinHash of its word shingles, that is one shingle hash; a document contains a passage only if its
own shingles contain that hash, so containment 1.0 has recall 1 by construction, however long the document is.
Candidates are then verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast, cut, spread

#: Words in a row that give an item away, and words of a shingle.
PASSAGE, SHINGLE = 12, 5
#: Words of a document that one row of the search holds; a long document is many rows.
BLOCK = 512


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; everything else separates. Null gives null."""
    found = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.lower(w))


def _shingles(w: Column, k: int) -> Column:
    n = F.size(w) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.array().cast("array<long>"))


def passages(items: DataFrame) -> DataFrame:
    """(item_id, size, width, sketch, at, passage): every query set with its MinHash and the place of the minimum in it.

    Items without words have none. Equal items and overlapping items stay apart.
    """
    x = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(PASSAGE))
    wins = x.select("item_id", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("passage"))
    out = None
    for width in range(1, SHINGLE + 1):  # a passage shorter than a shingle is one shingle of its own width
        part = wins.filter(F.col("size") == width) if width < SHINGLE else wins.filter(F.col("size") >= SHINGLE)
        h = part.withColumn("_h", _shingles(F.col("passage"), width))
        one = h.select("item_id", "size", F.lit(width).alias("width"), F.array_min("_h").alias("sketch"), F.array_position("_h", F.array_min("_h")).cast("int").alias("at"), "passage")
        out = one if out is None else out.unionByName(one)
    return out


def _blocks(documents: DataFrame) -> DataFrame:
    """(doc_id, s, own, w): words of a document in blocks with enough overlap for any passage, so one huge document spreads over rows."""
    d = documents.select("doc_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(BLOCK))
    first = lambda s: F.greatest(s - PASSAGE, F.lit(0))
    # each block is made by the explosion itself: as an expression below it would be cut out again for every shingle
    block = F.transform(starts, lambda s: F.struct(s.alias("s"), (s - first(s)).alias("own"), F.slice("w", first(s) + 1, s - first(s) + BLOCK + PASSAGE).alias("w")))
    return d.select("doc_id", F.explode(block).alias("_b")).select("doc_id", "_b.s", "_b.own", "_b.w")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that give an item away, once per pair.

    First only numbers go about: the shingles of each block, with their places, against the sketches (broadcast after
    their size is checked, else joined by shuffle on the hash). The words of the few blocks that were hit are then
    fetched to verify them. Documents with null or empty texts, and items without words, give nothing. Repeated
    documents and items are each reported.
    """
    q = cut(passages(items))
    widths = sorted(r["width"] for r in q.select("width").distinct().collect())  # at most SHINGLE values
    if not widths:
        return documents.select("doc_id").join(items.select("item_id"), F.lit(False)).distinct()
    docs = documents.select("doc_id", "text")
    side = bounded_broadcast(q.select(F.col("sketch").alias("h")).distinct())  # one number is the fastest key; widths are compared with the words
    of_width = F.array(*[F.struct(F.lit(k).alias("width"), _shingles(F.col("w"), k).alias("hs")) for k in widths])
    hashed = _blocks(spread(docs)).select("doc_id", "s", "own", F.explode(of_width).alias("_w")).select("doc_id", "s", "own", "_w.width", F.posexplode("_w.hs").alias("pos", "h"))
    # the first ``own`` words belong to the block before, those after BLOCK to the next
    hashed = hashed.filter((F.col("pos") >= F.col("own")) & (F.col("pos") < F.col("own") + BLOCK)).drop("own")
    hits = hashed.join(side, "h", "left_semi")
    hits = cut(hits)
    named = bounded_broadcast(hits.select("doc_id").distinct()).alias("k")
    # written, as the filter on the number of words would else be moved before this join and split every text again
    some = cut(docs.alias("d").join(named, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi"))
    at = _blocks(some).alias("b").join(bounded_broadcast(hits).alias("t"), F.col("b.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("b.s") == F.col("t.s"))).select("b.doc_id", "b.w", "t.pos", "t.h", "t.width")
    side = bounded_broadcast(q.select("item_id", "size", "sketch", "at", "passage", F.col("width").alias("_width")))
    begin = F.col("pos") - F.col("at") + 2  # 1-based place of the passage
    found = at.join(side, (F.col("h") == F.col("sketch")) & (F.col("width") == F.col("_width")))
    return found.filter((begin >= 1) & (F.slice("w", F.greatest(begin, F.lit(1)), F.col("size")) == F.col("passage"))).select("doc_id", "item_id").distinct()
