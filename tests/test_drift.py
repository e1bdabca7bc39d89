"""Path-value maps, schema matching, drift report and projection."""

from lakeloom.operators import drift

FILES = "uri string, stream_id string, stream_position long, content string"
ENTRIES = "entry_id long, uri string, meta_schema_id int, meta_content_type string, extra string"
FIELDS = "stream_id string, schema_id int, field_id int, field_name string, field_type string"


def test_path_value_rows():
    rows = dict(drift.path_value_rows('\ufeffA,b\r\n1,"x, ""y"""\r\n\\N,\r\n\r\n2.5,2024-01-01\r\n', "text/csv"))
    assert rows[0] == {"a": (None, "null"), "b": (None, "null")}
    assert rows[1] == {"a": ("1", "long"), "b": ('x, "y"', "string")}
    assert rows[2] == {"a": (None, "null"), "b": (None, "null")} and rows[3] == {"a": ("2.5", "double"), "b": ("2024-01-01", "date")}
    rows = dict(drift.path_value_rows('{"A": true, "c": {"d": [1]}}\n{bad\n{"A": null}', "text/csv"))
    assert rows[1] == {"a": ("True", "boolean"), "c.d": ("[1]", "list")} and rows[2][""][1] == "damaged" and rows[3] == {"a": (None, "null")}
    assert list(drift.path_value_rows(None, None)) == [] and list(drift.path_value_rows(" \n", "text/csv")) == []
    assert dict(drift.path_value_rows('a\tb\npier "7"\tx', "application/x-amzn-unescaped-tsv"))[1]["a"] == ('pier "7"', "string")


def tables(spark):
    files = spark.createDataFrame(
        [("u1", "s", 1, "id,name\n1,x\n"), ("u2", "s", 5, 'ID|label\n2|y\n'), ("u3", "s", 9, '{"label": "z", "id": 3}\n{"id": 4.5}\n'), ("u4", "s", 12, "id\tlabel\textra\n5\tw\tnot a number\n"), ("u5", "s", 13, ""), ("u6", "t", 1, "q\n1\n"), ("u7", None, 1, None), ("u8", "big", 2**62 + 1, "a\n1\n"), ("u9", "big", None, "a\n1\n")], FILES,
    )
    entries = spark.createDataFrame([(1, "u1", 0, "text/csv", None), (2, "u2", 0, "text/psv", None), (3, "u3", 2, "text/csv", None), (4, "u4", None, None, None), (5, "u4", None, None, None), (6, "u6", 7, None, None)], ENTRIES)
    f = lambda sid, *fs: [("s", sid, i, n, t) for i, n, t in fs]
    fields = spark.createDataFrame([*f(0, (1, "id", "int"), (2, "name", "string")), *f(1, (1, "id", "int"), (2, "Label", "string")), *f(1, (1, "id", "int")), *f(2, (1, "id", "double"), (2, "label", "string")), *f(3, (1, "id", "double"), (2, "label", "string"), (4, "extra", "int"))], FIELDS)
    return files, entries, fields


def test_drift(spark, rows):
    files, entries, fields = tables(spark)
    assert rows(drift.drift(files, entries, fields).select("stream_position", "field_id", "change_kind")) == [(12, 4, "added"), (5, 2, "renamed"), (9, 1, "retyped")]


def test_cells_and_failed_casts(spark, rows):
    files, entries, fields = tables(spark)
    cells = drift.consistent_cells(files, entries, fields)
    assert rows(cells.filter("cast_failed").select("uri", "name")) == [("u4", "extra")]
    wide = drift.stream_table(cells, "s", fields)
    assert wide.columns == ["stream_position", "row_no", "id", "label", "extra"]
    assert rows(wide) == [(1, 1, 1.0, "x", None), (12, 1, 5.0, "w", None), (5, 1, 2.0, "y", None), (9, 1, 3.0, "z", None), (9, 2, 4.5, None, None)]


def test_files_of_no_schema_keep_their_rows(spark, rows):
    files, entries, fields = tables(spark)
    more = spark.createDataFrame([("v1", "s", 20, '{"id": 6}\n'), ("v2", "s", 21, "id,label,odd\n7,q, w \n"), ("v3", "s", 22, "ID,odd\n8,e\n"), ("v4", None, 23, "z\n9\n")], FILES)
    told = spark.createDataFrame([(11, "v1", 2, None, None), (12, "v2", 2, None, None)], ENTRIES)
    cells = drift.consistent_cells(files.union(more), entries.union(told), fields)
    got = rows(cells.filter("uri like 'v%'").select("uri", "row_no", "field_id", "name", "value", "cast_failed"))
    assert got == [("v1", 1, 1, "id", "6.0", False), ("v2", 1, 1, "id", "7.0", False), ("v2", 1, 2, "label", "q", False), ("v2", 1, None, "odd", " w ", False), ("v3", 1, 1, "id", "8.0", False), ("v3", 1, None, "odd", "e", False), ("v4", 1, None, "z", "9", False)]
    assert rows(cells.filter("uri = 'u8'").select("name", "value")) == [("a", "1")]
    assert rows(drift.stream_table(cells, "s", fields).filter("stream_position >= 20").select("stream_position", "id", "label")) == [(20, 6.0, None), (21, 7.0, "q"), (22, 8.0, None)]


def test_damaged_and_surplus_cells_keep_their_text(spark, rows, monkeypatch):
    long = "x" * 140_000
    assert dict(drift.path_value_rows(f"a,b\n1,{long}\n2,y\n", "text/csv")) == {0: {"a": (None, "null"), "b": (None, "null")}, 1: {"a": ("1", "long"), "b": (long, "string")}, 2: {"a": ("2", "long"), "b": ("y", "string")}}
    assert dict(drift.path_value_rows("a,,A\n1,2,3,4,,5\n", "text/csv"))[1] == {"a": ("3", "long"), "": ('["1", "2", "4", "5"]', "surplus")}
    with monkeypatch.context() as m:
        m.setattr(drift.sys, "maxsize", 10)
        got = list(drift.path_value_rows('a,b\n1,x\n2,"too long\na cell"\n3,y\n', "text/csv"))
    assert [n for n, _ in got] == [0, 1, 2, 3] and got[2][1][""][1] == "damaged" and got[2][1][""][0].startswith('2,"too long')
    files, entries, fields = tables(spark)
    more = spark.createDataFrame([("w1", "s", 30, '{"id": 1, "label": "k"}\n{"id": 2, "lab\n{}\n'), ("w2", "s", 31, "id,label\n3,m,n,o\n"), ("w3", "s", 32, f"id,label\n4,{long}\n5,p\n")], FILES)
    cells = drift.consistent_cells(files.union(more), entries, fields)
    assert rows(cells.filter("uri like 'w%' and (cast_failed or field_id is null)").select("uri", "row_no", "field_id", "name", "value", "cast_failed")) == [("w1", 2, None, "", '{"id": 2, "lab', True), ("w2", 1, None, "", '["n", "o"]', True)]
    assert rows(cells.filter("uri = 'w1'").groupBy("row_no").count()) == [(1, 2), (2, 1), (3, 2)]
    assert rows(cells.filter("uri = 'w3' and name = 'label'").selectExpr("row_no", "length(value)")) == [(1, 140_000), (2, 1)]


def test_long_positions_survive_beside_nulls(spark):
    files, _, _ = tables(spark)
    assert {r["stream_position"] for r in drift.load_rows(files.coalesce(1)).filter("stream_id = 'big'").collect()} == {2**62 + 1, None}


def test_empty(spark):
    files, entries, fields = (df.limit(0) for df in tables(spark))
    assert drift.drift(files, entries, fields).count() == 0
