"""Reading files whose schema drifts: path-value maps, path-type statistics, schema matching, drift report, projection."""

from __future__ import annotations

import csv
import io
import json
import re
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from .ordered import previous

ROW = "uri string, stream_id string, stream_position string, row_no int, fields map<string,struct<value:string,raw:string>>"
SEPARATORS = ("\t", "|", ",", ";")
NULL_MARKS = {"", "\\N"}
DATE, STAMP, WHOLE, REAL = (re.compile(p) for p in (r"\d{4}-\d\d-\d\d", r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?Z?", r"[+-]?\d+", r"[+-]?(\d+\.\d*|\.\d+|\d+[eE][+-]?\d+|\d+\.\d*[eE][+-]?\d+)"))


def raw_type(value: object) -> str:
    """The type that a value shows by itself: null, boolean, long, double, date, timestamp, list, map or string."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "long"
    if isinstance(value, float):
        return "double"
    if isinstance(value, list):
        return "list"
    if isinstance(value, dict):
        return "map"
    text = str(value).strip()
    for kind, fits in (("timestamp", STAMP.fullmatch), ("date", DATE.fullmatch), ("long", WHOLE.fullmatch), ("double", REAL.fullmatch)):
        if fits(text):
            return kind
    return "boolean" if text.lower() in ("true", "false") else "string"


def _flat(prefix: str, value: object, into: dict) -> None:
    if isinstance(value, dict) and value:
        for k, v in value.items():
            _flat(f"{prefix}.{k}" if prefix else str(k), v, into)
    else:
        text = json.dumps(value) if isinstance(value, list | dict) else None if value is None else str(value)
        into[prefix.strip().lower()] = (text, raw_type(value))


def path_value_rows(content: str | None, kind: str | None):
    """The rows of one file as {path: (value, raw type)}; row 0 names the paths of a delimited file's header.

    The content decides: JSON lines if the first sign is a brace, else delimited text whose separator is the one that the
    header holds most often (the declared type breaks ties). Marks of byte order, line ends of all kinds and blank lines
    are passed over; empty values and \\N are null. What has no path stands under "": a damaged line gives the row
    {"": (line, "damaged")} under its own number, and cells without a name of their own (beyond the header, below a blank
    name or one that a later column repeats) are listed as JSON: (list, "surplus").
    """
    text = (content or "").replace("\x00", "").lstrip("\ufeff\u200b \r\n")
    if not text.strip():
        return
    if text[0] == "{":
        for n, line in enumerate(re.split(r"\r\n|\r|\n", text), 1):
            if line.strip():
                row: dict = {}
                try:
                    value = json.loads(line.strip().lstrip("\ufeff"))
                    if value != {}:
                        _flat("", value, row)
                except ValueError:
                    row = {"": (line, "damaged")}
                yield n, row
        return
    head = re.split(r"\r\n|\r|\n", text, maxsplit=1)[0]
    told = "\t" if kind and "tsv" in kind.lower() else "|" if kind and "psv" in kind.lower() else ","
    sep = max(SEPARATORS, key=lambda s: (head.count(s), s == told))
    plain = bool(kind) and "unescaped" in kind.lower()
    csv.field_size_limit(sys.maxsize)
    read: list[str] = []  # the lines of the present row

    def source():
        for line in io.StringIO(text, newline=""):
            read.append(line)
            yield line

    lines = csv.reader(source(), delimiter=sep, quoting=csv.QUOTE_NONE if plain else csv.QUOTE_MINIMAL)
    names: list[str] | None = None
    own: list[bool] = []
    n = 0
    while True:
        read.clear()
        try:
            cells = next(lines)
        except StopIteration:
            return
        except csv.Error:
            n += 1
            yield n, {"": ("".join(read), "damaged")}
            continue
        if not any(c.strip() for c in cells):
            continue
        if names is None:
            names = [c.strip().strip("\ufeff\u200b").strip('"').lower() for c in cells]
            last = {x: k for k, x in enumerate(names)}
            own = [bool(x) and last[x] == k for k, x in enumerate(names)]
            yield 0, {x: (None, "null") for x in names if x}
            continue
        n += 1
        values = [None if c in NULL_MARKS else c for c in cells]
        row = {x: (v, raw_type(v)) for x, v in zip(names, values + [None] * (len(names) - len(values)), strict=False) if x}
        surplus = [v for k, v in enumerate(values) if v is not None and not (k < len(own) and own[k])]
        if surplus:
            row[""] = (json.dumps(surplus, ensure_ascii=False), "surplus")
        yield n, row


def load_rows(files: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Every row of every file as a path-value map: (uri, stream_id, stream_position, row_no, fields)."""
    ship()
    kinds = files.withColumn("_kind", F.lit(None).cast("string")) if types is None else files.join(types.select("uri", F.col("meta_content_type").alias("_kind")), "uri", "left")

    def rows(parts):
        for part in parts:
            out = []
            for uri, stream, pos, content, kind in part.itertuples(index=False):
                for n, row in path_value_rows(content, kind):
                    out.append((uri, stream, pos, n, {k: {"value": v, "raw": t} for k, (v, t) in row.items()}))
                    if len(out) >= 5_000:
                        yield pd.DataFrame(out, columns=["uri", "stream_id", "stream_position", "row_no", "fields"])
                        out = []
            if out:
                yield pd.DataFrame(out, columns=["uri", "stream_id", "stream_position", "row_no", "fields"])

    # positions go through pandas as text: beside a null they would become floats and lose digits
    out = kinds.select("uri", "stream_id", F.col("stream_position").cast("string").alias("stream_position"), "content", "_kind").mapInPandas(rows, ROW)
    return out.withColumn("stream_position", F.col("stream_position").cast("long"))


def path_statistics(rows: DataFrame) -> DataFrame:
    """Per file and path: how many rows have it, how many null, and how many of each raw type (partially aggregated)."""
    x = rows.select("uri", "stream_id", "stream_position", F.explode("fields").alias("path", "cell")).filter(F.col("path") != "")
    n = lambda kind: F.count_if(F.col("cell.raw") == kind).alias(f"n_{kind}")
    kinds = ("null", "boolean", "long", "double", "date", "timestamp", "list", "map", "string")
    return x.groupBy("uri", "stream_id", "stream_position", "path").agg(F.count(F.lit(1)).alias("n_rows"), *[n(k) for k in kinds])


def schemas(schema_fields: DataFrame) -> DataFrame:
    """(stream_id, schema_id, names, fields): one row per schema; repeated rows count once."""
    f = schema_fields.select("stream_id", "schema_id", "field_id", F.lower(F.trim("field_name")).alias("name"), F.lower(F.trim("field_type")).alias("type")).distinct()
    one = f.groupBy("stream_id", "schema_id").agg(F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set(F.struct("field_id", "name", "type"))).alias("fields"))
    return one


def told_of(manifest_entries: DataFrame) -> DataFrame:
    """(uri, told, meta_content_type): the schema id and content type given for each uri by the smallest entries that have them."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("entry_id")))
    return manifest_entries.groupBy("uri").agg(first("meta_schema_id").alias("told"), first("meta_content_type").alias("meta_content_type"))


def file_schemas(files: DataFrame, manifest_entries: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """(uri, stream_id, stream_position, schema_id, fields): the schema of each file.

    It is that of ``meta_schema_id`` if the names agree with the content's, else the stream's schema whose names do; of
    several such the one whose types fit the path statistics best, then the least id. Files without one are left out.
    Of several listings of a uri, a schema id given by the smallest entry counts.
    """
    listed = told_of(manifest_entries)
    stats = path_statistics(load_rows(files, listed))
    per = stats.groupBy("uri", "stream_id", "stream_position").agg(F.array_sort(F.collect_set("path")).alias("names"), F.collect_list(F.struct("path", *[c for c in stats.columns if c.startswith("n_")])).alias("stats"))
    told = per.join(listed.select("uri", "told"), "uri", "left")
    s = schemas(schema_fields)
    cand = told.join(s, ["stream_id", "names"])  # a file has few candidate schemas
    # bad: values that a candidate's types can't hold
    bad = F.aggregate(
        F.col("fields"), F.lit(0).cast("long"),
        lambda acc, f: acc + F.coalesce(F.aggregate(F.filter("stats", lambda x: x["path"] == f["name"]), F.lit(0).cast("long"), lambda a, x: a + _misfits(f["type"], x)), F.lit(0).cast("long")),
    )
    rank = F.struct((F.col("schema_id") == F.col("told")).cast("int").alias("as_told"), (-bad).alias("fit"), (-F.col("schema_id")).alias("id"))
    ranked = cand.withColumn("_rank", F.when(F.col("told").isNull(), rank.withField("as_told", F.lit(0))).otherwise(rank))
    best = ranked.groupBy("uri", "stream_id", "stream_position").agg(F.max_by(F.struct("schema_id", "fields"), "_rank").alias("_s"))
    return best.select("uri", "stream_id", "stream_position", "_s.schema_id", "_s.fields")


def _misfits(declared: Column, x: Column) -> Column:
    others = lambda *ok: sum((x[f"n_{k}"] for k in ("boolean", "long", "double", "date", "timestamp", "list", "map", "string") if k not in ok), F.lit(0).cast("long"))
    return (
        F.when(declared == "boolean", others("boolean")).when(declared.isin("int", "bigint"), others("long")).when(declared == "double", others("double", "long"))
        .when(declared == "date", others("date")).when(declared == "timestamp", others("timestamp")).when(declared == "string_list", others("list", "string"))
        .otherwise(x["n_list"] + x["n_map"] + F.when(x["n_string"] == 0, x["n_long"] + x["n_double"] + x["n_date"] + x["n_timestamp"] + x["n_boolean"]).otherwise(0))
    )


def _of_id(fields: str) -> Column:
    return F.get(F.filter(fields, lambda f: f["field_id"] == F.col("field_id")), F.lit(0))


def drift(files: DataFrame, manifest_entries: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """(stream_id, stream_position, field_id, change_kind, was, now): each difference of a file from the one before it.

    The order of one stream is cut into pieces where a stream holds very many files. Fields are matched by id, names
    compared without case; a field renamed and retyped at once gives both rows; the first file of a stream gives none.
    """
    typed = cut(file_schemas(files, manifest_entries, schema_fields))  # read twice below, and files are parsed for it
    prev = previous(typed, ["stream_id"], ["stream_position", "uri"], "fields", "was")
    x = prev.filter(F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("fields")))
    ids = F.array_distinct(F.concat(F.transform("was", lambda f: f["field_id"]), F.transform("fields", lambda f: f["field_id"])))
    one = x.select("stream_id", "stream_position", "was", "fields", F.explode(ids).alias("field_id"))
    pair = one.select("stream_id", "stream_position", "field_id", _of_id("was").alias("a"), _of_id("fields").alias("b"))
    kinds = F.array_compact(F.array(
        F.when(F.col("a").isNull(), "added"), F.when(F.col("b").isNull(), "removed"),
        F.when(F.col("a.name") != F.col("b.name"), "renamed"), F.when(F.col("a.type") != F.col("b.type"), "retyped"),
    ))
    return pair.select("stream_id", "stream_position", "field_id", F.explode(kinds).alias("change_kind"), F.concat_ws(" ", "a.name", "a.type").alias("was"), F.concat_ws(" ", "b.name", "b.type").alias("now"))


#: Spark types of the declared ones.
TYPES = {"int": "int", "bigint": "bigint", "double": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz"}


def _lookups(files: DataFrame, manifest_entries: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """(uri, exact, near): the fields of each file's schema; for files without one those that its paths may be by name.

    These are the fields of the schema that ``meta_schema_id`` tells, then the names that belong to a single field in all
    schemas of the stream.
    """
    s = schemas(schema_fields)
    told = s.select("stream_id", F.col("schema_id").alias("told"), F.col("fields").alias("_told"))
    single = s.select("stream_id", F.explode("fields").alias("f")).groupBy("stream_id", "f.name").agg(F.min("f.field_id").alias("field_id"), F.max("f.field_id").alias("_other"), F.min("f.type").alias("type")).filter("field_id = _other")
    single = single.groupBy("stream_id").agg(F.collect_list(F.struct("field_id", "name", "type")).alias("_single"))
    of = file_schemas(files, manifest_entries, schema_fields).select("uri", F.col("fields").alias("exact"))
    x = files.select("uri", "stream_id").join(told_of(manifest_entries).select("uri", "told"), "uri", "left").join(told, ["stream_id", "told"], "left").join(single, "stream_id", "left").join(of, "uri", "left")
    none = F.array().cast(s.schema["fields"].dataType)
    a, b = F.coalesce("_told", none), F.coalesce("_single", none)
    return x.select("uri", "exact", F.concat(a, F.filter(b, lambda f: ~F.array_contains(F.transform(a, lambda t: t["name"]), f["name"]))).alias("near"))


def consistent_cells(files: DataFrame, manifest_entries: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """All rows of all streams in one long table: (stream_id, stream_position, uri, row_no, field_id, name, type, value, cast_failed).

    Every cell is cast to the newest type of its field (the schema with the greatest id that has it); ``name`` is the
    newest name. A value that can't be cast comes out as null with ``cast_failed`` true, so nothing is lost silently.
    In a file whose names are those of no schema each path is matched by name alone; a path that no field fits comes out
    under its own name and as it is, with null ``field_id`` and ``type``. So do damaged rows and surplus cells, under an
    empty name and with ``cast_failed`` true; a damaged row has no other cells.
    """
    rows = load_rows(files, told_of(manifest_entries).select("uri", "meta_content_type")).filter("row_no > 0")
    f = schema_fields.select("stream_id", "field_id", "schema_id", F.lower(F.trim("field_name")).alias("name"), F.lower(F.trim("field_type")).alias("type"))
    newest = f.groupBy("stream_id", "field_id").agg(F.max_by(F.struct("name", "type"), "schema_id").alias("_n")).select("stream_id", "field_id", F.col("_n.name").alias("newest_name"), F.col("_n.type").alias("newest_type"))
    x = rows.join(_lookups(files, manifest_entries, schema_fields), "uri", "left")
    damaged = F.coalesce(F.try_element_at("fields", F.lit(""))["raw"] == "damaged", F.lit(False))
    x = x.withColumn("_of", F.coalesce(F.when(damaged, F.array().cast(x.schema["near"].dataType)), "exact", F.filter("near", lambda f: F.map_contains_key("fields", f["name"]))))
    matched = F.transform("_of", lambda f: F.struct(f["field_id"].alias("field_id"), f["name"].alias("path"), F.try_element_at("fields", f["name"]).alias("cell")))
    others = F.filter(F.map_entries("fields"), lambda e: ~F.array_contains(F.transform("_of", lambda f: f["name"]), e["key"]))
    unmatched = F.transform(others, lambda e: F.struct(F.lit(None).cast("int").alias("field_id"), e["key"].alias("path"), e["value"].alias("cell")))
    cells = x.select("stream_id", "stream_position", "uri", "row_no", F.explode(F.concat(matched, unmatched)).alias("c")).select("stream_id", "stream_position", "uri", "row_no", "c.*")
    x = cells.join(newest, ["stream_id", "field_id"], "left")
    text = F.trim(F.col("cell.value"))
    value = text
    for kind, spark in TYPES.items():
        value = F.when(F.col("newest_type") == kind, text.try_cast(spark).cast("string")).otherwise(value)
    value = F.when(F.col("field_id").isNull(), F.col("cell.value")).otherwise(value)
    failed = (text.isNotNull() & value.isNull()) | (F.col("path") == "")
    return x.select("stream_id", "stream_position", "uri", "row_no", "field_id", F.coalesce("newest_name", "path").alias("name"), F.col("newest_type").alias("type"), value.alias("value"), failed.alias("cast_failed"))


def stream_table(cells: DataFrame, stream_id: str, schema_fields: DataFrame) -> DataFrame:
    """The consistent typed table of one stream: one column per field, in the order of field ids."""
    f = schema_fields.filter(F.col("stream_id") == stream_id)
    newest = f.groupBy("field_id").agg(F.max_by(F.struct(F.lower(F.trim("field_name")).alias("n"), F.lower(F.trim("field_type")).alias("t")), "schema_id").alias("_n")).orderBy("field_id").collect()
    one = cells.filter(F.col("stream_id") == stream_id)
    wide = one.groupBy("stream_position", "row_no").agg(*[F.max(F.when(F.col("field_id") == r["field_id"], F.col("value"))).alias(f"_f{r['field_id']}") for r in newest])
    used: set[str] = set()
    cols = []
    for r in newest:
        name = r["_n"]["n"] if r["_n"]["n"] not in used else f"{r['_n']['n']}_{r['field_id']}"
        used.add(name)
        cols.append(F.col(f"_f{r['field_id']}").cast(TYPES.get(r["_n"]["t"], "string")).alias(name))
    return wide.select("stream_position", "row_no", *cols)

