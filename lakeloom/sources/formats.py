"""File formats: content types, readers, writers, connectors that need jars, reader compatibility."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.feather as feather
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..plans.store import Files
from ..session import ship
from . import avro
from .files import open_input, write_whole

#: Content types.
PARQUET, CSV, TSV, PSV, RAW_TSV, JSON, ORC, FEATHER, AVRO, TEXT, XML, BINARY = (
    "application/parquet", "text/csv", "text/tsv", "text/psv", "application/x-amzn-unescaped-tsv", "application/json", "application/orc", "application/feather", "application/avro", "text/plain", "application/xml", "application/octet-stream",
)
DELIMITED = {CSV: ",", TSV: "\t", PSV: "|", RAW_TSV: "\t"}
#: Formats whose files carry their schema.
SELF_DESCRIBING = {PARQUET, ORC, FEATHER, AVRO}
EXTENSIONS = {
    "parquet": PARQUET, "pq": PARQUET, "csv": CSV, "tsv": TSV, "psv": PSV, "json": JSON, "jsonl": JSON, "ndjson": JSON, "orc": ORC, "feather": FEATHER, "arrow": FEATHER, "ipc": FEATHER,
    "avro": AVRO, "txt": TEXT, "log": TEXT, "xml": XML, "png": BINARY, "jpg": BINARY, "jpeg": BINARY, "gif": BINARY, "bin": BINARY,
}
#: Endings that only compress.
CODECS = {"gz": "gzip", "gzip": "gzip", "bz2": "bzip2", "zst": "zstd", "zstd": "zstd", "snappy": "snappy", "deflate": "deflate"}
#: Sources and sinks that need a connector on the class path.
CONNECTORS = {
    "bigquery": "spark-bigquery", "clickhouse": "clickhouse-spark", "databricks": "delta-spark", "delta_lake": "delta-spark", "delta_sharing": "delta-sharing-spark", "hudi": "hudi-spark", "iceberg": "iceberg-spark-runtime", "lance": "lance-spark",
    "mongo": "mongo-spark-connector", "tfrecords": "spark-tfrecord", "webdataset": "a tar reader", "warc": "a warc reader", "audio": "an audio decoder", "videos": "a video decoder", "hdf": "pytables", "html": "an html parser",
}


class ConnectorUnavailable(RuntimeError):
    """The format is known but its connector is not on the class path."""


class ReaderIncompatible(ValueError):
    """A field that one of the supported readers can't read."""


def content_type(url: str) -> tuple[str, str | None]:
    """(content type, codec) by the endings of a file name; unknown endings are binary."""
    name = url.rsplit("/", 1)[-1].split("?")[0].strip().lower()
    parts = name.split(".")
    codec = CODECS.get(parts[-1]) if len(parts) > 1 else None
    if codec:
        parts = parts[:-1]
    return EXTENSIONS.get(parts[-1], BINARY) if len(parts) > 1 else BINARY, codec


@dataclass(frozen=True)
class Delimited:
    """How delimited text is read: ``booleans`` are the signs for true and false."""

    header: bool = True
    delimiter: str | None = None
    null_as: str | None = None
    quote: str = '"'
    escape: str = '"'
    booleans: tuple[str, str] | None = None
    all_text: bool = False
    #: No cell holds a line end, so a large file may be split between tasks.
    line_per_row: bool = False


def read_delimited(spark: SparkSession, paths: Sequence[str], kind: str = CSV, schema: T.StructType | None = None, options: Delimited = Delimited()) -> DataFrame:
    """Delimited text; with a schema decimals are read as text, rounded half to even to the field's scale, and fail on overflow."""
    o = options
    r = spark.read.option("header", o.header).option("sep", o.delimiter or DELIMITED[kind]).option("escape", o.escape).option("multiLine", kind != RAW_TSV and not o.line_per_row)
    r = r.option("quote", "" if kind == RAW_TSV else o.quote)
    r = r.option("nullValue", "" if o.null_as is None else o.null_as).option("mode", "FAILFAST")
    if schema is None:
        return r.option("inferSchema", not o.all_text).csv(list(paths))
    if o.all_text:
        return r.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])).csv(list(paths))
    indirect = lambda t: isinstance(t, T.DecimalType) or (o.booleans and isinstance(t, T.BooleanType))
    raw = r.schema(T.StructType([T.StructField(f.name, T.StringType() if indirect(f.dataType) else f.dataType) for f in schema.fields])).csv(list(paths))
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            cols.append(rounded_decimal(c, f.dataType).alias(f.name))
        elif o.booleans and isinstance(f.dataType, T.BooleanType):
            yes, no = o.booleans
            cols.append(F.when(c == yes, True).when(c == no, False).when(c.isNotNull(), F.raise_error(F.concat(F.lit("no boolean: "), c))).alias(f.name))
        else:
            cols.append(c)
    return raw.select(*cols)


def rounded_decimal(text, kind: T.DecimalType):
    """Text as a decimal of the type, rounded half to even; more whole digits than fit raise an error."""
    wide = F.trim(text).cast(T.DecimalType(38, min(18, 38 - (kind.precision - kind.scale))))
    return F.bround(wide, kind.scale).cast(kind)


def _file_rows(spark: SparkSession, paths: Sequence[str], kind: str) -> DataFrame:
    """Feather or Avro files: the schema from the first, the rows by tasks that read whole files in Arrow batches."""
    files = [f for p in paths for f in ([x for x, _ in Files(spark).sizes(p)] or [p])]
    ship()
    if kind == FEATHER:
        with open_input(files[0]) as f:
            arrow = pa.ipc.open_file(f).schema
        schema = from_arrow_schema(arrow)
    else:
        with open_input(files[0]) as f:
            schema = avro.spark_type(avro.header(f)[0])
        arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                with open_input(path) as f:
                    if kind == FEATHER:
                        source = pa.ipc.open_file(f)
                        for n in range(source.num_record_batches):
                            yield from pa.Table.from_batches([source.get_batch(n)]).select(arrow.names).cast(arrow).to_batches(max_chunksize=10_000)
                    else:
                        for part in avro.rows(f):
                            for k in range(0, len(part), avro.ROWS):
                                yield pa.RecordBatch.from_pylist(part[k : k + avro.ROWS], arrow)

    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(len(files))
    return listed.mapInArrow(rows, schema)


def connector(spark: SparkSession, name: str) -> str:
    """The Spark name of a connector, or ConnectorUnavailable."""
    try:
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource(name, spark._jsparkSession.sessionState().conf())
    except Exception as e:
        raise ConnectorUnavailable(f"{name} needs {CONNECTORS.get(name, 'a connector')} on the class path") from e
    return name


def read(spark: SparkSession, paths: Sequence[str] | str, kind: str | None = None, schema: T.StructType | None = None, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """Files of one content type (by their ending if none is told) as a DataFrame; ``columns`` resolve without case."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    kind = kind or content_type(paths[0])[0]
    with_schema = lambda r: r.schema(schema) if schema is not None else r
    if kind == PARQUET:
        df = with_schema(spark.read.options(**options)).parquet(*paths)
    elif kind == ORC:
        df = with_schema(spark.read.options(**options)).orc(paths)
    elif kind == JSON:
        df = with_schema(spark.read.options(**options)).json(paths)
    elif kind in DELIMITED:
        df = read_delimited(spark, paths, kind, schema, Delimited(**options))
    elif kind in (FEATHER, AVRO):
        df = _file_rows(spark, paths, kind)
    elif kind == TEXT:
        df = spark.read.options(**options).text(paths)
    elif kind == XML:
        df = with_schema(spark.read.format("xml").options(**{"rowTag": "row", **options})).load(paths)
    elif kind == BINARY:
        df = spark.read.format("binaryFile").options(**options).load(paths)
    elif kind in CONNECTORS:
        df = spark.read.format(connector(spark, kind)).options(**options).load(paths)
    else:
        raise ValueError(f"unknown content type {kind}")
    return df if columns is None else project(df, columns)


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns found without case, under the names that they have; a missing one raises."""
    names = {c.lower(): c for c in df.columns}
    missing = [c for c in columns if c.lower() not in names]
    if missing:
        raise ValueError(f"no columns {missing}")
    return df.select(*[f"`{names[c.lower()]}`" for c in columns])


def with_file_path(df: DataFrame, name: str = "file_path") -> DataFrame:
    return df.withColumn(name, F.col("_metadata.file_path"))


def write(df: DataFrame, path: str, kind: str = PARQUET, records_per_file: int | None = None, codec: str | None = None) -> list[tuple[str, int]]:
    """Writes ``df`` and returns (file, bytes); files hold at most ``records_per_file`` rows."""
    spark = df.sparkSession
    if kind in (FEATHER, AVRO):
        _write_whole_files(df, path, kind, records_per_file)
        return Files(spark).sizes(path)
    w = df.write.mode("errorifexists")
    if records_per_file:
        w = w.option("maxRecordsPerFile", records_per_file)
    if codec:
        w = w.option("compression", codec)
    if kind == PARQUET:
        w.parquet(path)
    elif kind == ORC:
        w.orc(path)
    elif kind == JSON:
        w.json(path)
    elif kind in DELIMITED:
        w.option("sep", DELIMITED[kind]).option("header", True).option("quote", "" if kind == RAW_TSV else '"').option("escape", '"').csv(path)
    elif kind == TEXT:
        w.text(path)
    elif kind == XML:
        w.format("xml").option("rowTag", "row").save(path)
    else:
        w.format(connector(spark, kind)).save(path)
    return Files(spark).sizes(path)


def _write_whole_files(df: DataFrame, path: str, kind: str, records_per_file: int | None) -> None:
    """Feather or Avro: each task writes its rows in files of at most so many, each under its name only when it is whole.

    A task that is run again writes the same names, so a lost executor leaves no rows twice.
    """
    if Files(df.sparkSession).exists(path):
        raise FileExistsError(path)
    per, schema, run = records_per_file or 1_000_000, df.schema, uuid.uuid4().hex
    ship()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names: list[str] = []
        task = TaskContext.get().partitionId()

        def flush() -> None:
            name = f"{path}/part-{task:05d}-{len(names):05d}-{run}.{'feather' if kind == FEATHER else 'avro'}"
            if kind == FEATHER:
                out = pa.BufferOutputStream()
                feather.write_feather(pa.Table.from_batches(held), out)
                write_whole(name, out.getvalue())
            else:
                write_whole(name, avro.packed(schema, held))
            names.append(name)
            held.clear()

        rows = 0
        for b in batches:
            while b.num_rows:
                take = b.slice(0, per - rows)
                held.append(take)
                rows, b = rows + take.num_rows, b.slice(take.num_rows)
                if rows == per:
                    flush()
                    rows = 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["path"])

    df.mapInArrow(save, "path string").count()


#: Which readers read a Spark type from a format; what is not listed is readable by all.
UNREADABLE: dict[tuple[str, str], set[str]] = {
    ("interval", PARQUET): {"pandas", "arrow"}, ("interval", ORC): {"spark", "pandas", "arrow"}, ("void", PARQUET): {"spark"}, ("void", ORC): {"spark"},
    ("variant", PARQUET): {"pandas", "arrow"}, ("map", CSV): {"spark", "pandas", "arrow"}, ("array", CSV): {"spark", "pandas", "arrow"}, ("struct", CSV): {"spark", "pandas", "arrow"}, ("binary", CSV): {"spark", "pandas", "arrow"},
    ("binary", JSON): {"pandas", "arrow"}, ("interval", JSON): {"spark", "pandas", "arrow"}, ("map", FEATHER): {"pandas"},
}


def check_readers(schema: T.StructType, kind: str, readers: Sequence[str] = ("spark", "pandas", "arrow")) -> None:
    """Raises ReaderIncompatible if a field can't be read by one of the readers."""
    for f in schema.fields:
        family = "interval" if isinstance(f.dataType, T.DayTimeIntervalType | T.YearMonthIntervalType | T.CalendarIntervalType) else f.dataType.typeName()
        bad = UNREADABLE.get((family, CSV if kind in DELIMITED else kind), set()) & set(readers)
        if bad:
            raise ReaderIncompatible(f"{f.name} ({f.dataType.simpleString()}) in {kind} can't be read by {sorted(bad)}")


def read_urls(spark: SparkSession, urls: Sequence[str], **options) -> DataFrame:
    """All files of all urls, whatever their formats, as one table by column name."""
    kinds: dict[str, list[str]] = {}
    for u in urls:
        kinds.setdefault(content_type(u)[0], []).append(u)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(spark, paths, kind, **options) for kind, paths in kinds.items()])


def from_manifest(spark: SparkSession, entries: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """The data behind manifest rows (path, meta_content_type), read by content type and united by name.

    Entries are file metadata: one row per file is fetched to plan the scan, as any file scan does.
    """
    kinds: dict[str, list[str]] = {}
    for r in entries.select("path", "meta_content_type").collect():
        kinds.setdefault(r["meta_content_type"] or content_type(r["path"])[0], []).append(r["path"])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(spark, p, k, schema) for k, p in kinds.items()])


def copy_with(spark: SparkSession, source: str, target: str, transforms: Sequence[Callable[[DataFrame], DataFrame]] = (), kind: str | None = None, target_kind: str | None = None, records_per_file: int | None = None) -> list[tuple[str, int]]:
    """Reads files, applies each transform in turn and writes the result."""
    df = reduce(lambda d, f: f(d), transforms, read(spark, source, kind))
    return write(df, target, target_kind or content_type(target)[0] if target_kind or content_type(target)[0] != BINARY else PARQUET, records_per_file)
