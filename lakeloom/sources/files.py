"""Files of any file system that Arrow knows (local and mounted folders, HDFS, object stores), read and written by tasks."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

from ..session import ship


def located(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it); names without scheme and file: urls are local or mounted folders."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + path[5:].lstrip("/"))
    if "://" not in path:
        return fs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def open_input(path: str) -> pa.NativeFile:
    system, p = located(path)
    return system.open_input_file(p)


def copy_one(source: str, target: str) -> None:
    """Copies a file in pieces; it appears under its name only when it is whole, and copying it again changes nothing."""
    system, p = located(target)
    system.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with open_input(source) as f, system.open_output_stream(p + ".tmp") as out:
        while piece := f.read(8 << 20):
            out.write(piece)
    system.move(p + ".tmp", p)


def copy_all(spark: SparkSession, pairs: list[tuple[str, str]]) -> None:
    """Copies files by tasks, several a core."""
    if not pairs:
        return
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, target in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                copy_one(source, target)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    listed = spark.createDataFrame(pairs, "source string, target string").repartition(min(len(pairs), 4 * spark.sparkContext.defaultParallelism))
    listed.mapInArrow(run, "n long").count()


def write_whole(path: str, data: bytes | pa.Buffer) -> None:
    """Writes a file that appears under its name only when it is whole."""
    system, p = located(path)
    system.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(p + ".tmp") as out:
        out.write(data)
    system.move(p + ".tmp", p)
