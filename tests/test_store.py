"""Exclusive creation of commit files."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from lakeloom.plans import store
from lakeloom.plans.store import Files


def test_one_of_many_writers_wins(spark, tmp_path):
    files = Files(spark)
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda n: files.create(f"{tmp_path}/c/1.json", f"{n}" * 50), range(24)))
    assert sum(won) == 1 and files.read(f"{tmp_path}/c/1.json") == f"{won.index(True)}" * 50 and files.list(f"{tmp_path}/c") == ["1.json"]


def test_stores_without_exclusive_creation_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "EXCLUSIVE", frozenset({"hdfs"}))
    with pytest.raises(NotImplementedError):
        Files(spark).create(f"{tmp_path}/1.json", "x")
