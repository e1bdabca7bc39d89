"""Per-document statistics that tell prose from lists, tables and junk, and a classifier on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship, spread
from . import textstats
from .boosting import Boosted, train
from .holdout import EXAMPLES

#: Common words of several languages.
COMMON = (
    "the a an of and to in is that was it for on are with as be by this were had at which from no not after before but only so then when what we our all or has have one will "
    "into than its can may never most there each every you they he she his her their would could should do does did been about if more some any who how "
    "der die das und nicht ist den dem des mit dass war waren eine ein einen wurde zu im auf für von sich auch wir wenn nur noch "
    "le la les de des et une un est que qui pour pas dans il a été ne ce sur au aux du en avec nous plus "
    "el los las y no se por con una para fue ya hay su lo del al sin como "
    "nie jest się na w z do i że ma został przez po ale za co jak od są oraz "
    "il di che non per sono della um uma não com os as em o e het een van niet"
).split()
CLASSES = ["prose", "list", "table", "junk"]
#: At most so many weakly labelled rows train the model (chosen by the hash of the document id).
TRAIN_ROWS = 6_000
NAMES = [
    "n_lines", "n_words", "mean_word", "longest_token", "symbol_ratio", "digit_ratio", "letter_ratio", "upper_ratio", "cjk_ratio", "broken_ratio", "punct_line_share", "common_share",
    "bullet_share", "table_share", "line_words", "sentence_rate", "distinct_share", "vowelless_share", "repeated_line_share", "sentences_per_line",
]


def statistics(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the columns of NAMES and ``has_text`` for every document; null and blank texts have zeros. Whole texts, map-only.

    Arrow batches go through one pass over their signs (``textstats``): expressions of the JVM would search every text
    fifteen times, which takes five times as long.
    """
    ship()
    kept = documents.select(*keep).schema
    schema = T.StructType([*kept.fields, *[T.StructField(n, T.DoubleType(), False) for n in NAMES], T.StructField("has_text", T.BooleanType(), False)])
    common = frozenset(COMMON)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = textstats.seen_words(common)
        for batch in batches:
            rows = textstats.statistics([t or "" for t in batch.column(len(keep)).to_pylist()], common, seen)
            numbers = zip(*rows, strict=True) if rows else [[] for _ in range(len(NAMES) + 1)]
            arrays = [pa.array(c, pa.bool_() if k == len(NAMES) else pa.float64()) for k, c in enumerate(numbers)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], *arrays], names=schema.names)

    return documents.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def weak_label(has_text: Column | None = None) -> Column:
    """A label where the statistics leave little doubt, else null; made from structure, not from the vocabulary of a corpus."""
    c = F.col
    bullets = (c("bullet_share") >= 0.75) & (c("n_lines") >= 4)
    grid = (c("table_share") >= 0.75) & (c("n_lines") >= 4) & (c("line_words") <= 40) & (c("common_share") < 0.3) & (c("sentence_rate") < 0.03)
    even = (c("punct_line_share") >= 0.85) | (c("punct_line_share") <= 0.15)
    worded = (c("letter_ratio") > 0.6) & (c("vowelless_share") < 0.2) & (c("broken_ratio") < 0.02) & (c("mean_word") < 16)
    items = (c("n_lines") >= 5) & (c("line_words") <= 12) & even & (c("table_share") < 0.75) & worded & (c("repeated_line_share") < 0.5) & (c("common_share") < 0.35)
    spoken = (c("common_share") >= 0.15) | (c("cjk_ratio") >= 0.35)
    prose = spoken & c("sentence_rate").between(0.02, 0.2) & (c("bullet_share") < 0.4) & (c("table_share") < 0.9) & (c("distinct_share") > 0.08) & ((c("punct_line_share") < 0.85) | (c("line_words") > 14) | (c("n_lines") < 5))
    noise = (c("letter_ratio") < 0.25) & (c("table_share") < 0.75) | (c("broken_ratio") > 0.08) | (c("mean_word") > 30) & (c("table_share") < 0.75)
    empty_talk = (c("common_share") < 0.05) & (c("cjk_ratio") < 0.2) & (c("n_lines") <= 2) & (c("n_words") >= 10) & ((c("vowelless_share") > 0.15) | (c("distinct_share") < 0.6))
    return (
        F.when(~c("has_text"), None).when(bullets & ~noise, "list").when(grid & ~noise, "table").when(noise | empty_talk, "junk")
        .when(items & ~prose, "list").when(prose, "prose")
    )


def fit(stats: DataFrame, train_rows: int = TRAIN_ROWS) -> Boosted:
    """Trains on at most ``train_rows`` weakly labelled rows and calibrates on the hand-checked holdout.

    The rows with the least hashes of their ids are taken, so equal data give an equal model; only statistics, never
    texts, come to the driver. A class without weak labels can't be predicted.
    """
    weak = stats.withColumn("_y", weak_label()).filter(F.col("_y").isNotNull())
    got = weak.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select("_y", *NAMES).toPandas()
    model = train(got[NAMES].to_numpy(float), list(got["_y"]), CLASSES)
    held = stats.sparkSession.createDataFrame([(n, k, s) for n, (k, s) in enumerate(EXAMPLES)], "doc_id long, y string, text string")
    h = statistics(held, keep=("doc_id", "y")).toPandas()
    model.calibrate(h[NAMES].to_numpy(float), list(h["y"]))
    return model


def predict(stats: DataFrame, model: Boosted) -> DataFrame:
    """doc_id, kind and the calibrated probability of each class, for documents with text; Arrow batches of numbers only."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            p = model.probabilities(part[NAMES].to_numpy(float))
            out = pd.DataFrame({"doc_id": part["doc_id"], "kind": np.array(CLASSES, dtype=object)[p.argmax(axis=1)]})
            for k, c in enumerate(CLASSES):
                out[f"p_{c}"] = p[:, k]
            yield out

    ship()
    schema = "doc_id string, kind string, " + ", ".join(f"p_{c} double" for c in CLASSES)
    # ids go through pandas as text: beside a null they would become floats and lose digits
    found = stats.filter("has_text").select(F.col("doc_id").cast("string").alias("doc_id"), *NAMES).mapInPandas(run, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def kinds(documents: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, kind, probabilities) of every document with text.

    The statistics are written once, so that neither the training filter nor the prediction computes them again.
    """
    stats = cut(statistics(spread(documents.select("doc_id", "text"))))
    return predict(stats, fit(stats, train_rows))
