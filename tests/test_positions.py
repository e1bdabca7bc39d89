"""Position deletes on real files."""

from lakeloom.operators import positions as P


def write(spark, path, rows):
    spark.createDataFrame(rows, "k int, p string, v int").coalesce(1).write.parquet(path)
    return path


def test_convert_and_read_back(spark, rows, tmp_path):
    f = {n: write(spark, f"{tmp_path}/{n}", r) for n, r in {"d1": [(1, "x", 1), (2, "x", 1), (None, "x", 1)], "d2": [(2, "x", 2), (3, "x", 2)], "d3": [(3, "x", 3), (3, "x", 4)], "other": [(1, "x", 9)]}.items()}
    eq = f"{tmp_path}/eq"
    spark.createDataFrame([(1,), (3,), (None,)], "k int").coalesce(1).write.parquet(eq)
    files = P.FileSet([(_one(f["d1"]), 1, "a"), (_one(f["d2"]), 2, "a"), (_one(f["d3"]), 3, "a"), (_one(f["other"]), 1, "b")], [(_one(eq), 3, "a")])
    new, kind = P.convert(spark, files, ["k"], f"{tmp_path}/pos", since=1)
    assert kind == "REPLACE" and new.equality == [] and len(new.position) == 1
    data = P.with_positions(spark, [p for p, _, part in new.data if part == "a"])
    # the delete at sequence 3 reaches files 1 and 2; of key 3 in file 3 the last record stays, of key 2 the newer file's
    assert rows(P.apply_positions(data, spark.read.parquet(f"{tmp_path}/pos")).select("k", "v")) == [(2, 2), (3, 4)]


def _one(path):
    import glob

    return "file://" + glob.glob(f"{path}/*.parquet")[0]


def test_nothing_to_do(spark, tmp_path):
    assert P.convert(spark, P.FileSet(), ["k"], f"{tmp_path}/none") == (P.FileSet(), "NONE")


def test_duplicates_in_one_partition_only(spark, rows):
    data = spark.createDataFrame([("a", 1, 1, "f", 0), ("b", 1, 1, "g", 0), ("a", 1, 1, "f", 1), ("a", None, 1, "f", 2), ("a", None, 2, "h", 0)], "part string, k int, seq int, file_path string, pos long")
    assert rows(P.duplicate_positions(data, ["k"], ["part"])) == [("f", 0), ("f", 2)]


def test_snapshot_kinds():
    assert [P.snapshot_kind(*x) for x in ((0, 0, 0, 0), (1, 0, 0, 0), (1, 1, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0))] == ["NONE", "APPEND", "REPLACE", "DELETE", "DELETE"]
