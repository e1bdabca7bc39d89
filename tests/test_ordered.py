"""Numbering and neighbours give the same with and without pieces."""

import random

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import ordered


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    hot = [("hot", rng.choice([None, *range(40)]), n, rng.choice([None, 1, 5])) for n in range(400)]
    return spark.createDataFrame(hot + [(k, rng.randint(0, 9), 1000 + n, 2) for n, k in enumerate(["a", "b", None] * 7)], "k string, o int, id int, v int").cache()


@pytest.mark.parametrize("piece", [7, 50, 10_000])
def test_numbers_sums_and_neighbours(data, rows, piece):
    want: dict = {}
    for k, o, i, v in sorted((tuple(r) for r in data.collect()), key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        want.setdefault(k, []).append((o, i, v))
    number = {i: n for v in want.values() for n, (_, i, _) in enumerate(v, 1)}
    assert {r["id"]: r["n"] for r in ordered.row_numbers(data, ["k"], ["o", "id"], "n", piece).collect()} == number
    total = {}
    for v in want.values():
        s = 0
        for _, i, x in v:
            s += x or 0
            total[i] = s
    assert {r["id"]: r["s"] for r in ordered.running_total(data, ["k"], ["o", "id"], F.col("v"), "s", piece).collect()} == total
    before = {i: (v[n - 1][1] if n else None) for v in want.values() for n, (_, i, _) in enumerate(v)}
    assert {r["id"]: r["p"] for r in ordered.previous(data, ["k"], ["o", "id"], "id", "p", piece).collect()} == before


def test_empty(spark):
    df = spark.createDataFrame([], "k string, o int")
    assert ordered.row_numbers(df, ["k"], ["o"], "n").count() == 0
