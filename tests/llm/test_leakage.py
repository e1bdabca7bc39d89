"""Leaks against a brute-force search."""

import random
import re

import pytest

from lakeloom import session
from lakeloom.llm import leakage as L

ITEMS = "item_id long, text string, task string"
DOCS = "doc_id long, text string, item_id long"


def words(s):
    return [w.lower() for w in re.split(r"[^\w]|_", s or "") if w]


def brute(docs, items):
    out = set()
    for d, t, *_ in docs:
        w = words(t)
        for i, s, *_ in items:
            q = words(s)
            n = min(len(q), 12)
            grams = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if q else set()
            if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                out.add((d, i))
    return sorted(out)


@pytest.mark.parametrize(("block", "broadcast"), [(16, 250_000), (512, 250_000), (64, 0)])
def test_against_brute_force(spark, rows, monkeypatch, block, broadcast):
    """Also with nothing small enough for a broadcast."""
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(session, "BROADCAST_ROWS", broadcast)
    rng = random.Random(2)
    vocabulary = [f"w{n}" for n in range(60)]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 11, 12, 13, 30]))), "t") for n in range(40)]
    items += [(100, None, "t"), (101, "", "t"), (102, "...", "t"), (103, items[5][1], "copy")]
    docs = []
    for n in range(60):
        w = [rng.choice(["x", "y", "z"] + vocabulary[:3]) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            q = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(q) - 12))
            part = q[a : a + rng.choice([5, 11, 12, 13, 40])]
            at = rng.randint(0, len(w))
            w[at:at] = part
        docs.append((n, rng.choice([" ", ", ", "_", " — "]).join(w).upper() if n % 2 else "\n".join(w), 7))
    docs += [(900, None, 1), (901, "", 1), (902, docs[3][1], 1)]
    got = sorted(rows(L.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))))
    want = brute(docs, items)
    assert got == want and len(want) > 30


def test_empty(spark):
    d, i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert L.leaks(d, i).columns == ["doc_id", "item_id"] and L.leaks(d, i).count() == 0
    assert L.leaks(spark.createDataFrame([(1, "a b", 1)], DOCS), i).count() == 0
