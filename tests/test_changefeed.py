"""The bucketed table against a plain replay, in one batch and in several."""

import datetime as dt
import random

import pytest

from lakeloom.operators import changefeed
from lakeloom.operators.changefeed import BucketedTable

SCHEMA = "change_id long, stream_id string, partition_id string, stream_position long, file_index int, record_index int, delta_type string, delete_columns string, pk1 string, pk2 int, value long, received_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def feed(seed, n=260):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        delete = rng.random() < 0.2
        kind = rng.choice(["delete", " DELETE"]) if delete else rng.choice(["append", "Upsert ", "UPSERT"])
        on = rng.choice([None, "pk1,pk2", "pk2, pk1", "value", "pk1", "pk1,value", "nonsense"]) if delete else None
        key = ("hot", 1) if rng.random() < 0.3 else (rng.choice([None, "", "a", "b"]), rng.choice([None, 1, 2]))
        out.append([i, rng.choice(["s", "t"]), "p", i // 10, i % 2, i, kind, on, *key, rng.choice([None, 1, 2, 3]), T0 + dt.timedelta(seconds=i)])
    again = [[1000 + r[0], *r[1:-1], r[-1] + dt.timedelta(days=1)] for r in rng.sample(out, 30)]
    mended = [[2000 + r[0], *r[1:8], "mended", 7, 9, r[-1] + dt.timedelta(days=2)] for r in rng.sample(out, 10)]
    return out, again, mended


def model(rows):
    last = {}
    for r in rows:
        p = tuple(r[1:6])
        if p not in last or (r[11], r[0]) > (last[p][11], last[p][0]):
            last[p] = r
    state = {}
    for p in sorted(last, key=lambda p: p[2:]):
        r = last[p]
        kind, part = (r[6] or "").strip().lower(), (r[1], r[2])
        if kind not in ("append", "upsert", "delete"):
            continue
        if kind != "delete":
            state[part, r[8], r[9]] = (p, r[10])
        else:
            on = [c.strip() for c in (r[7] or "pk1,pk2").split(",")]
            on = [c for c in on if c in ("pk1", "pk2", "value")]
            want = {"pk1": r[8], "pk2": r[9], "value": r[10]}
            if on:
                state = {k: v for k, v in state.items() if not (k[0] == part and all({"pk1": k[1], "pk2": k[2], "value": v[1]}[c] == want[c] for c in on))}
    return sorted(p for p, _ in state.values())


def places(df):
    return sorted(tuple(r) for r in df.select("stream_id", "partition_id", "stream_position", "file_index", "record_index").collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_whole_feed(spark, tmp_path, seed):
    out, again, mended = feed(seed)
    df = spark.createDataFrame(out + again + mended, SCHEMA)
    want = model(out + again + mended)
    assert places(changefeed.final_rows(df)) == want
    t = BucketedTable(spark, str(tmp_path), 4)
    t.apply(df)
    assert places(t.rows()) == want


def test_batches_out_of_order_and_repeated(spark, tmp_path):
    out, again, _ = feed(4)
    rng = random.Random(4)
    rows = out + again
    rng.shuffle(rows)
    t = BucketedTable(spark, str(tmp_path), 4)
    for k in range(3):
        t.apply(spark.createDataFrame(rows[k::3], SCHEMA))
    t.apply(spark.createDataFrame(rows[:40], SCHEMA))
    assert places(t.rows()) == model(rows)


def values(df):
    return sorted((tuple(r) for r in df.select("stream_id", "partition_id", "stream_position", "file_index", "record_index", "pk1", "pk2", "value").collect()), key=repr)


@pytest.mark.parametrize("order", [1, -1])
def test_corrected_values_across_batches(spark, tmp_path, order):
    first = [[i, "s", "p", i, 0, 0, "upsert", None, "k", i, 5, T0] for i in range(8)] + [[8, "s", "p", 8, 0, 0, "delete", "value", None, None, 2, T0]]
    later = T0 + dt.timedelta(days=1)
    mended = [[20, *first[0][1:10], 1, later], [21, *first[1][1:10], None, later], [22, *first[2][1:10], 9, later], [23, *first[3][1:10], 2, later], [24, *first[4][1:10], 3, T0]]
    t = BucketedTable(spark, str(tmp_path), 4)
    for batch in [first, mended][::order]:
        t.apply(spark.createDataFrame(batch, SCHEMA))
    whole = changefeed.final_rows(spark.createDataFrame(first + mended, SCHEMA))
    assert values(t.rows()) == values(whole)
    assert {r["pk2"]: r["value"] for r in t.rows().collect()} == {0: 1, 1: None, 2: 9, 4: 3, 5: 5, 6: 5, 7: 5}


def test_untouched_buckets_are_kept_by_reference(spark, tmp_path):
    rows = [[i, "s", "p", i, 0, 0, "upsert", None, f"k{i}", i, i, T0] for i in range(40)]
    t = BucketedTable(spark, str(tmp_path), 8)
    t.apply(spark.createDataFrame(rows, SCHEMA))
    before = t.manifest()["buckets"]
    t.apply(spark.createDataFrame([[99, "s", "p", 99, 0, 0, "upsert", None, "k3", 3, 5, T0]], SCHEMA))
    after = t.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and t.rows().count() == 40


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_corrections_across_batches_in_any_order(spark, tmp_path, seed):
    """Corrections move rows to other keys, turn sets into deletes and deletes into sets, and arrive before or after what they correct."""
    out, again, mended = feed(seed)
    rng = random.Random(seed)
    turned = [[3000 + r[0], *r[1:6], "delete", rng.choice([None, "value", "pk1"]), *r[8:11], r[-1] + dt.timedelta(days=3)] for r in rng.sample(out, 12)]
    turned += [[4000 + r[0], *r[1:6], "upsert", None, *r[8:11], r[-1] + dt.timedelta(days=4)] for r in out if "elete" in r[6].lower() and rng.random() < 0.4]
    turned += [[5000 + r[0], *r[1:6], rng.choice(["unknown", None]), None, *r[8:11], r[-1] + dt.timedelta(days=rng.choice([-1, 5]))] for r in rng.sample(out, 8)]
    rows = out + again + mended + turned
    rng.shuffle(rows)
    t = BucketedTable(spark, str(tmp_path), 4)
    t.FOLD = 3  # the log and the deletes are folded in between
    for k in range(4):
        t.apply(spark.createDataFrame(rows[k::4], SCHEMA))
    assert places(t.rows()) == model(rows)
    t.expire()
    assert places(t.rows()) == model(rows)


def test_a_moved_correction_sets_the_key_anew(spark, tmp_path):
    rows = [[1, "s", "p", 1, 0, 0, "upsert", None, "a", 1, 1, T0], [2, "s", "p", 2, 0, 0, "upsert", None, "a", 1, 2, T0]]
    t = BucketedTable(spark, str(tmp_path), 2)
    t.apply(spark.createDataFrame(rows, SCHEMA))
    t.apply(spark.createDataFrame([[3, *rows[1][1:8], "b", 1, 2, T0 + dt.timedelta(1)]], SCHEMA))
    assert sorted((r["pk1"], r["value"]) for r in t.rows().collect()) == [("a", 1), ("b", 2)]
    t.apply(spark.createDataFrame(rows, SCHEMA))  # repeated late: older than the correction
    assert sorted((r["pk1"], r["value"]) for r in t.rows().collect()) == [("a", 1), ("b", 2)]


def test_buckets_double_when_outgrown(spark, tmp_path):
    rows = [[i, "s", "p", i, 0, 0, "upsert", None, f"k{i}", i, i, T0] for i in range(60)]
    t = BucketedTable(spark, str(tmp_path), 2, bucket_rows=5)
    for k in range(0, 60, 20):
        t.apply(spark.createDataFrame(rows[k : k + 20], SCHEMA))
    assert t.manifest()["n"] == 8 and t.rows().count() == 60


def test_replay_of_upserts_and_deletes(spark, tmp_path):
    """Upserts, a delete without effect, deletes by value, upserts again and a delete of several values, as five batches."""
    up = lambda n, rows: [[n * 10 + i, "s", "p", n, 0, i, "upsert", None, str(k), k, v, T0] for i, (k, v) in enumerate(rows)]
    down = lambda n, values: [[n * 10 + i, "s", "p", n, 0, i, "delete", "value", None, None, v, T0] for i, v in enumerate(values)]
    batches = [up(0, [(k, 100 + k) for k in range(6)]), up(1, [(k, k) for k in range(6)]), down(2, [-1]), down(3, [1]), up(4, [(2, 20), (3, 30), (6, 60), (7, 70)]), down(5, [60, 30, 20])]
    t = BucketedTable(spark, str(tmp_path), 4)
    for b in batches:
        t.apply(spark.createDataFrame(b, SCHEMA))
    assert sorted((r["pk2"], r["value"]) for r in t.rows().collect()) == [(0, 0), (4, 4), (5, 5), (7, 70)]


def test_empty_feed(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path), 2)
    assert t.rows().count() == 0
    t.apply(spark.createDataFrame([], SCHEMA))
    assert t.rows().count() == 0
