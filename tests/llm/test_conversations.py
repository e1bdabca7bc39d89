"""Conversations against a plain Python model."""

import datetime as dt
import random

import pytest

from lakeloom.llm import conversations as C

SCHEMA = "row_id long, group_id string, msg_id long, sender_name string, message string, reply_to string, sent_at timestamp_ntz, ingested_at timestamp_ntz, turn string"
T0 = dt.datetime(2024, 1, 1)


def at(m):
    return T0 + dt.timedelta(minutes=m)


def model(rows):
    last = {}
    for r in rows:
        if r[1] is None or r[2] is None:
            continue
        k = (r[1], r[2])
        if k not in last or (r[7], r[0]) > (last[k][7], last[k][0]):
            last[k] = r
    number = lambda s: int(float(s.strip().lstrip("#"))) if s and s.strip().lstrip("#").replace(".0", "").isdigit() else None
    name = lambda s: (s or "").strip().lower() or None
    text = lambda s: bool((s or "").replace("​", "").strip())

    def root(k):
        seen = set()
        while k in last and k not in seen:
            seen.add(k)
            p = number(last[k][5])
            if p is None:
                return k
            k = (k[0], p)
        return None

    conv = {}
    for k in last:
        if (r := root(k)) is not None:
            conv.setdefault(r, []).append(k)
    out = []
    for r, ks in conv.items():
        bad = any(name(last[k][3]) is None for k in ks)
        for k in ks:
            p = number(last[k][5])
            bad |= p is not None and last[k][6] < last[k[0], p][6]
        said = [k for k in ks if text(last[k][4])]
        if bad or len({name(last[k][3]) for k in said}) < 2:
            continue
        for n, k in enumerate(sorted(said, key=lambda k: (last[k][6], k[1])), 1):
            out.append((r[0], r[1], n, k[1], "opener" if name(last[k][3]) == name(last[r][3]) else "responder"))
    return sorted(out)


def got(df, **k):
    return sorted(tuple(r) for r in C.conversations(df, **k).select("group_id", "root_msg_id", "turn", "msg_id", "role").collect())


@pytest.mark.parametrize("seed", range(3))
def test_against_model(spark, seed):
    rng = random.Random(seed)
    rows = []
    for n in range(300):
        g, m = rng.choice(["hot", "hot", "b", "c"]), rng.randint(1, 60)
        parent = rng.choice([None, "", "nan", *[f(m - rng.randint(-1, 6)) for f in (str, "{:010d}".format, " {} ".format, "#{}".format, "{}.0".format)]])
        rows.append((n, g, m, rng.choice(["Ann", " ann", "Bob", "Cy", "Cy"] + ([None, " "] if rng.random() < 0.1 else [])), rng.choice(["hi", "ok", "", "​ ", None, "x"]), parent, at(m * 3 + rng.choice([0, 0, 0, -20])), at(m * 3 + rng.choice([0, 1, 500])), "clash"))
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == model(rows)
    assert got(df, piece_rows=5) == model(rows)


def test_long_chain_and_cycles(spark):
    chain = [(n, "g", n, "ab"[n % 2], "t", str(n - 1) if n > 1 else None, at(n), at(n), "") for n in range(1, 200)]
    ring = [(1000 + n, "g", 1000 + n, "ab"[n % 2], "t", str(1000 + (n + 1) % 7), at(n), at(n), "") for n in range(7)]
    tail = [(2000, "g", 2000, "a", "t", "1000", at(1), at(1), ""), (2001, "g", 2001, "a", "t", "2001", at(1), at(1), ""), (2002, "g", 2002, "b", "t", "77777", at(1), at(1), ""), (2003, "g", 2003, "b", "t", "2002", at(1), at(1), "")]
    assert [r[3] for r in got(spark.createDataFrame(chain + ring + tail, SCHEMA))] == list(range(1, 200))


def test_edits_deletions_and_ties(spark):
    rows = [
        (1, "g", 1, "a", "first", None, at(1), at(1), ""), (2, "g", 1, "a", "edited", None, at(1), at(5), ""), (3, "g", 2, "b", "gone", "1", at(2), at(2), ""), (4, "g", 2, "b", "⠀﻿", "1", at(2), at(9), ""),
        (5, "g", 3, "c", "kept", "2", at(3), at(3), ""), (6, "g", 3, "c", "later row of one instant", "2", at(3), at(3), ""), (7, None, 4, "a", "x", None, at(1), at(1), ""), (8, "g", None, "a", "x", None, at(1), at(1), ""), (9, "h", 1, None, None, None, None, None, ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["turn"], r["sender_name"], r["message"]) for r in C.transcripts(df).collect()) == [(1, "a", "edited"), (2, "c", "later row of one instant")]


def test_empty(spark):
    assert C.conversations(spark.createDataFrame([], SCHEMA)).count() == 0
