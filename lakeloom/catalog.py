"""The public API: catalogs of namespaces, tables, versions, streams and deltas; write modes, reads, services."""

from __future__ import annotations

import fnmatch
import json
import random
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.expressions import Predicate, to_column
from .functions.expressions import fields as fields_of
from .functions.transforms import Transform, check_sort_keys, hash_bucket, sort_columns
from .operators import merge
from .operators.evolution import AUTO, DISABLED, NONE, Field, Schema, Update, apply_updates, coerce_read, coerce_write
from .plans.log import Log, Transaction, janitor
from .plans.store import Conflict
from .sources import formats
from .sources.files import copy_all
from .sources.footers import footers, may_match

DEFAULT_NAMESPACE = "DEFAULT"
#: Table properties and their defaults.
PROPERTIES = {
    "read_optimization_level": "MAX", "records_per_compacted_file": 4_000_000, "appended_record_count_compaction_trigger": 64_000_000, "appended_file_count_compaction_trigger": 1_000,
    "appended_delta_count_compaction_trigger": 100, "default_compaction_hash_bucket_count": 8, "schema_evolution_mode": AUTO, "default_schema_consistency_type": NONE, "supported_reader_types": ["spark", "pandas", "arrow"],
}
MODES = ("auto", "create", "add", "chrono", "append", "replace", "merge", "delete")


class NotFound(KeyError):
    """No such namespace, table or version."""


class Exists(ValueError):
    """The object is there already."""


@dataclass
class TableInfo:
    """A resolved table version."""

    namespace: str
    table: str
    version: str
    path: list[str]
    data: dict

    @property
    def schema(self) -> Schema | None:
        s = self.data.get("schemas")
        return Schema.from_json(s[-1]) if s else None

    @property
    def properties(self) -> dict:
        return PROPERTIES | self.data.get("properties", {})


class Catalog:
    """A self-contained folder of tables.

    Every call joins the transaction of the surrounding ``with catalog.transaction()`` or makes one of its own.
    """

    def __init__(self, spark: SparkSession, root: str, name: str = "default"):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self.log = Log(spark, self.root)
        self._open: list[Transaction] = []
        header = f"{self.root}/catalog.json"
        if not self.log.files.exists(header):
            self.log.files.create(header, json.dumps({"format": 1, "since": time.time_ns()}))

    # transactions

    @contextmanager
    def transaction(self, message: str = "", as_of: int | None = None) -> Iterator[Transaction]:
        """Atomic over any number of tables; nested ones are independent; with ``as_of`` a read-only view of the past."""
        t = Transaction(self.log, message, as_of)
        self._open.append(t)
        try:
            yield t
        except BaseException:
            if t.status == "RUNNING" and as_of is None:
                t.fail()
            raise
        else:
            if as_of is None and t.status == "RUNNING":
                t.seal()
        finally:
            self._open.remove(t)

    @contextmanager
    def _work(self, message: str = "") -> Iterator[Transaction]:
        if self._open:
            yield self._open[-1]
        else:
            with self.transaction(message) as t:
                yield t

    def transactions(self, limit: int | None = 10, status: str = "SUCCESS") -> DataFrame:
        """History, newest first: one row per transaction with its times, operations and numbers of touched objects."""
        rows = []
        if status == "SUCCESS":
            for v in self.log.versions():
                c = self.log.commit(v)
                paths = [o[1] for o in c["ops"]]
                at = lambda n, key: len({tuple(p[:n]) for p in paths if len(p) >= n and p[n - 2] == key})
                rows.append((c["id"], c["message"], c["start"], c["end"], "SUCCESS", len(c["ops"]), ",".join(sorted(set(c["steps"]))), at(2, "namespaces"), at(2, "tables"), at(4, "versions"), at(6, "streams"), at(8, "deltas")))
        else:
            for n in self.log.files.list(f"{self.root}/txn/{status.lower()}"):
                if n.endswith(".json"):
                    m = json.loads(self.log.files.read(f"{self.root}/txn/{status.lower()}/{n}"))
                    rows.append((m["id"], m["message"], m["start"], None, status, 0, "", 0, 0, 0, 0, 0))
        schema = "transaction_id string, commit_message string, start_time long, end_time long, status string, operation_count int, operation_types string, namespace_count int, table_count int, table_version_count int, stream_count int, delta_count int"
        df = self.spark.createDataFrame(rows, schema).orderBy(F.col("start_time").desc())
        return df if limit is None else df.limit(limit)

    def read_transaction(self, transaction_id: str) -> dict:
        for v in self.log.versions():
            if self.log.commit(v)["id"] == transaction_id:
                return self.log.commit(v)
        raise NotFound(transaction_id)

    # namespaces

    def _ns_id(self, t: Transaction, name: str) -> str | None:
        return next((i for i, n in t.get("namespaces", default={}).items() if n["name"] == name), None)

    def create_namespace(self, name: str, properties: dict | None = None) -> None:
        with self._work(f"create namespace {name}") as t:
            if self._ns_id(t, name):
                raise Exists(f"namespace {name}")
            t.put(["namespaces", uuid.uuid4().hex], {"name": name, "properties": properties or {}}, "CREATE")

    def alter_namespace(self, name: str, properties: dict | None = None, new_name: str | None = None) -> None:
        with self._work(f"alter namespace {name}") as t:
            i = self._need_ns(t, name)
            if new_name and new_name != name and self._ns_id(t, new_name):
                raise Exists(f"namespace {new_name}")
            old = t.get("namespaces", i)
            t.put(["namespaces", i], {"name": new_name or name, "properties": old["properties"] | (properties or {})})

    def drop_namespace(self, name: str) -> None:
        with self._work(f"drop namespace {name}") as t:
            i = self._need_ns(t, name)
            for tid, tab in list(t.get("tables", default={}).items()):
                if tab["namespace"] == i:
                    t.delete(["tables", tid])
            t.delete(["namespaces", i])

    def _need_ns(self, t: Transaction, name: str) -> str:
        i = self._ns_id(t, name)
        if i is None:
            raise NotFound(f"namespace {name}")
        return i

    def get_namespace(self, name: str) -> dict:
        with self._work() as t:
            return t.get("namespaces", self._need_ns(t, name))

    def namespace_exists(self, name: str) -> bool:
        with self._work() as t:
            return self._ns_id(t, name) is not None

    def list_namespaces(self) -> DataFrame:
        with self._work() as t:
            rows = [(i, n["name"], json.dumps(n["properties"])) for i, n in t.get("namespaces", default={}).items()]
        return self.spark.createDataFrame(rows, "namespace_id string, namespace string, properties string")

    @staticmethod
    def default_namespace() -> str:
        return DEFAULT_NAMESPACE

    # tables

    def _table_id(self, t: Transaction, namespace: str, table: str) -> str | None:
        ns = self._ns_id(t, namespace)
        return next((i for i, x in t.get("tables", default={}).items() if x["namespace"] == ns and x["name"] == table), None) if ns else None

    def _info(self, t: Transaction, table: str, namespace: str, version: str | None = None) -> TableInfo:
        """The version asked for, else the latest active one."""
        i = self._table_id(t, namespace, table)
        if i is None:
            raise NotFound(f"table {namespace}.{table}")
        versions = t.get("tables", i, "versions")
        if version is None:
            active = [v for v, d in versions.items() if d["lifecycle"] == "ACTIVE"]
            if not active:
                raise NotFound(f"no active version of {namespace}.{table}")
            version = max(active, key=lambda v: (int(v) if v.isdigit() else -1, v))
        if version not in versions:
            raise NotFound(f"version {version} of {namespace}.{table}")
        return TableInfo(namespace, table, version, ["tables", i, "versions", version], versions[version])

    def create_table(
        self, table: str, namespace: str = DEFAULT_NAMESPACE, version: str | None = None, schema: Schema | None = None, partition_by: Sequence[tuple[str, Transform, str]] = (),
        sort_keys: Sequence[tuple[str, bool, bool]] = (), properties: dict | None = None, description: str = "", lifecycle: str = "ACTIVE", content_types: Sequence[str] | None = None,
        fail_if_exists: bool = True, auto_create_namespace: bool = True,
    ) -> TableInfo:
        """Creates a table, or a new version of one. Without a schema the table keeps files and reads as a manifest table."""
        with self._work(f"create table {namespace}.{table}") as t:
            if self._ns_id(t, namespace) is None:
                if not auto_create_namespace:
                    raise NotFound(f"namespace {namespace}")
                self.create_namespace(namespace)
            ns, i = self._ns_id(t, namespace), self._table_id(t, namespace, table)
            if i is not None:
                have = t.get("tables", i, "versions")
                if version is None or version in have:
                    if fail_if_exists:
                        raise Exists(f"table {namespace}.{table}")
                    return self._info(t, table, namespace, version)
            unknown = set(properties or {}) - set(PROPERTIES)
            if unknown:
                raise ValueError(f"unknown properties {sorted(unknown)}")
            if schema is not None:
                names = {f.name for f in schema.fields}
                for c in [*(s for s, _, _ in partition_by), *(s for s, _, _ in sort_keys)]:
                    if c not in names:
                        raise ValueError(f"{c} is not in the schema")
                if sort_keys:
                    check_sort_keys(schema.struct(), [(s, Transform("identity")) for s, _, _ in sort_keys])
                formats.check_readers(schema.struct(), formats.PARQUET, (PROPERTIES | (properties or {}))["supported_reader_types"])
            data = {
                "lifecycle": lifecycle, "schemas": [schema.to_json()] if schema else [], "properties": properties or {}, "description": description, "content_types": list(content_types or []),
                "partition_by": [[s, tr.name, tr.size, tr.strategy, n] for s, tr, n in partition_by], "sort_keys": [list(s) for s in sort_keys],
            }
            if i is None:
                i, version = uuid.uuid4().hex, version or "1"
                t.put(["tables", i], {"namespace": ns, "name": table, "description": description, "versions": {}}, "CREATE")
            t.put(["tables", i, "versions", version], data, "CREATE")
            self._new_stream(t, ["tables", i, "versions", version])
            return self._info(t, table, namespace, version)

    def _new_stream(self, t: Transaction, path: list[str]) -> str:
        stream = uuid.uuid4().hex
        old = t.get(*path, "stream")
        if old:
            t.put([*path, "streams", old, "state"], "DEPRECATED")
        t.put([*path, "streams", stream], {"state": "COMMITTED", "format": "native", "deltas": {}, "last": 0}, "CREATE")
        t.put([*path, "stream"], stream)
        return stream

    def alter_table(self, table: str, namespace: str = DEFAULT_NAMESPACE, version: str | None = None, updates: Sequence[Update] = (), properties: dict | None = None, lifecycle: str | None = None, description: str | None = None, allow_incompatible: bool = False) -> None:
        with self._work(f"alter table {namespace}.{table}") as t:
            info = self._info(t, table, namespace, version)
            if updates:
                if info.schema is None:
                    raise ValueError("a table without schema has nothing to update")
                new = apply_updates(info.schema, updates, allow_incompatible, info.properties["schema_evolution_mode"])
                t.put([*info.path, "schemas"], [*info.data["schemas"], new.to_json()])
            if properties:
                unknown = set(properties) - set(PROPERTIES)
                if unknown:
                    raise ValueError(f"unknown properties {sorted(unknown)}")
                t.put([*info.path, "properties"], info.data["properties"] | properties)
            if lifecycle:
                t.put([*info.path, "lifecycle"], lifecycle)
            if description is not None:
                t.put([*info.path, "description"], description)

    def drop_table(self, table: str, namespace: str = DEFAULT_NAMESPACE, version: str | None = None) -> None:
        """Drops the table, or marks one version DELETED."""
        with self._work(f"drop table {namespace}.{table}") as t:
            info = self._info(t, table, namespace, version) if version else None
            i = self._table_id(t, namespace, table)
            if i is None:
                raise NotFound(f"table {namespace}.{table}")
            if info:
                t.put([*info.path, "lifecycle"], "DELETED")
            else:
                t.delete(["tables", i])

    def rename_table(self, table: str, new_name: str, namespace: str = DEFAULT_NAMESPACE) -> None:
        with self._work(f"rename table {namespace}.{table}") as t:
            i = self._table_id(t, namespace, table)
            if i is None:
                raise NotFound(f"table {namespace}.{table}")
            if self._table_id(t, namespace, new_name):
                raise Exists(f"table {namespace}.{new_name}")
            t.put(["tables", i, "name"], new_name)

    def truncate_table(self, table: str, namespace: str = DEFAULT_NAMESPACE, version: str | None = None) -> None:
        """A new empty stream; the old one stays for time travel."""
        with self._work(f"truncate table {namespace}.{table}") as t:
            self._new_stream(t, self._info(t, table, namespace, version).path)

    def refresh_table(self, table: str, namespace: str = DEFAULT_NAMESPACE) -> None:
        """Drops cached plans of the table's view."""
        self.spark.catalog.refreshByPath(f"{self.root}/data")

    def get_table(self, table: str, namespace: str = DEFAULT_NAMESPACE, version: str | None = None) -> TableInfo:
        with self._work() as t:
            return self._info(t, table, namespace, version)

    def table_exists(self, table: str, namespace: str = DEFAULT_NAMESPACE, version: str | None = None) -> bool:
        try:
            self.get_table(table, namespace, version)
            return True
        except NotFound:
            return False

    def list_tables(self, namespace: str | None = None) -> DataFrame:
        with self._work() as t:
            names = {i: n["name"] for i, n in t.get("namespaces", default={}).items()}
            rows = [(names.get(x["namespace"]), x["name"], v, d["lifecycle"], d.get("description", "")) for x in t.get("tables", default={}).values() for v, d in x["versions"].items()]
        rows = [r for r in rows if namespace is None or r[0] == namespace]
        return self.spark.createDataFrame(rows, "namespace string, table string, version string, lifecycle string, description string")

    # writing

    def write(
        self, data: DataFrame | Any, table: str, namespace: str = DEFAULT_NAMESPACE, mode: str = "auto", version: str | None = None, schema: Schema | None = None, merge_keys: Sequence[str] = (),
        delete_columns: Sequence[str] | None = None, content_type: str = formats.PARQUET, compact: bool | None = None, records_per_file: int | None = None, **table_options,
    ) -> int:
        """Writes rows in one of MODES; returns the delta's position. pandas, Arrow and NumPy data are taken as well."""
        mode = mode.lower()
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        df = self._frame(data)
        with self._work(f"{mode} {namespace}.{table}") as t:
            exists = self.table_exists(table, namespace, version)
            if mode == "create" and exists:
                raise Exists(f"table {namespace}.{table}")
            if not exists:
                if mode not in ("auto", "create"):
                    raise NotFound(f"table {namespace}.{table}")
                made = schema or Schema.infer(df, merge_keys, table_options.get("properties", {}).get("default_schema_consistency_type", NONE))
                self.create_table(table, namespace, version, made, **table_options)
            info = self._info(t, table, namespace, version)
            keys = info.schema.merge_keys if info.schema else []
            if mode in ("add", "append", "chrono") and keys:
                raise ValueError(f"{mode} is for tables without merge keys")
            if mode in ("merge", "delete") and not keys:
                raise ValueError(f"{mode} needs a merge key")
            if info.schema and content_type not in formats.SELF_DESCRIBING:
                raise ValueError(f"{content_type} can't keep a schema")
            if mode == "replace":
                self._new_stream(t, info.path)
                info = self._info(t, table, namespace, info.version)
            kind = "DELETE" if mode == "delete" else "UPSERT" if keys else {"add": "ADD", "chrono": "CHRONO", "append": "APPEND", "replace": "APPEND", "create": "APPEND"}.get(mode, "ADD" if exists else "APPEND")
            position = self._stage(t, info, df, kind, list(delete_columns or keys) if kind == "DELETE" else None, content_type, records_per_file)
            info = self._info(t, table, namespace, info.version)
            if compact or (compact is None and self._due(t, info, kind)):
                self._compact(t, info)
            return position

    def _frame(self, data: Any) -> DataFrame:
        if isinstance(data, DataFrame):
            return data
        if type(data).__module__.startswith("numpy"):
            import pandas as pd

            data = pd.DataFrame(data if data.ndim > 1 else data.reshape(-1, 1)).rename(columns=str)
        return self.spark.createDataFrame(data)

    def _stage(self, t: Transaction, info: TableInfo, df: DataFrame, kind: str, columns: list[str] | None, content_type: str, records_per_file: int | None) -> int:
        given = [c.lower() for c in df.columns]
        schema = info.schema
        if kind == "DELETE":
            columns = [c for c in columns if c.lower() in given]
            if not columns:
                raise ValueError("a delete needs at least one of its columns")
            df = df.select(*columns)
        elif schema is not None:
            df, new = coerce_write(df, schema, info.properties["schema_evolution_mode"], info.properties["default_schema_consistency_type"], fill_missing=kind != "UPSERT")
            formats.check_readers(df.schema, content_type, info.properties["supported_reader_types"])
            if new.id != schema.id:
                t.put([*info.path, "schemas"], [*info.data["schemas"], new.to_json()])
                schema = new
        at = f"{self.root}/data/{uuid.uuid4().hex}"
        t.stage(at)
        if info.data["sort_keys"] and kind != "DELETE":
            df = df.sortWithinPartitions(*sort_columns([tuple(k) for k in info.data["sort_keys"]]))
        if info.data["partition_by"] and kind != "DELETE":
            parts = {f"_p_{n}": Transform(tr, size, strategy).column(df, s) for s, tr, size, strategy, n in info.data["partition_by"]}
            limit = records_per_file or info.properties["records_per_compacted_file"]
            df.withColumns(parts).write.option("maxRecordsPerFile", limit).partitionBy(*parts).parquet(at)
            files = self.log.files.sizes(at)
        else:
            files = formats.write(df, at, content_type, records_per_file or info.properties["records_per_compacted_file"])
        entries = self._entries(files, content_type, schema, info)
        return self._commit_delta(t, info, kind, entries, columns, sorted(given) if kind == "UPSERT" else None, schema)

    def _entries(self, files: list[tuple[str, int]], content_type: str, schema: Schema | None, info: TableInfo) -> list[dict]:
        found = footers(self.spark, [f for f, _ in files]) if files and content_type == formats.PARQUET else {}
        out = []
        for n, (path, size) in enumerate(files):
            folders = dict(x.split("=", 1) for x in path.split("/") if x.startswith("_p_") and "=" in x)
            rows, bounds = found.get(path, (None, {}))
            out.append({
                "id": uuid.uuid4().hex, "order": n, "path": path, "bytes": size, "records": rows, "bounds": bounds, "content_type": content_type,
                "schema_id": schema.id if schema else None, "kind": "DATA", "partition": {k[3:]: v for k, v in folders.items()}, "bucket": next((int(x[9:]) for x in path.split("/") if x.startswith("__bucket=")), None),
            })
        return out

    def _commit_delta(self, t: Transaction, info: TableInfo, kind: str, entries: list[dict], columns: list[str] | None, given: list[str] | None, schema: Schema | None, position: int | None = None) -> int:
        stream = t.get(*info.path, "stream")
        at = [*info.path, "streams", stream]
        deltas = t.get(*at, "deltas", default={})
        last = t.get(*at, "last", default=0)
        if position is None:
            if kind == "ADD":
                position = random.SystemRandom().randrange(2**48 + 1, 2**63)
            elif kind == "CHRONO":
                position = time.time_ns() // 1_000_000
                while str(position) in deltas:
                    position += 1
            else:
                position = last + 1
                t.put([*at, "last"], position)  # ordered writers meet here
        manifest = f"{self.root}/manifests/{uuid.uuid4().hex}.json"
        self.log.files.write(manifest, json.dumps(entries))
        meta = {
            "type": kind, "manifest": manifest, "columns": columns, "given": given, "files": len(entries), "records": sum(e["records"] or 0 for e in entries), "bytes": sum(e["bytes"] for e in entries), "previous": last or None,
        }
        t.put([*at, "deltas", position], meta, "CREATE")
        return position

    # reading

    def _deltas(self, t: Transaction, info: TableInfo, stream: str | None = None) -> list[tuple[int, dict]]:
        found = t.get(*info.path, "streams", stream or t.get(*info.path, "stream"), "deltas", default={})
        return sorted((int(p), d) for p, d in found.items())

    def _load(self, delta: dict) -> list[dict]:
        return json.loads(self.log.files.read(delta["manifest"]))

    def manifest(self, table: str, namespace: str = DEFAULT_NAMESPACE, version: str | None = None, as_of: int | None = None) -> DataFrame:
        """One row per file of the table's deltas."""
        with self._snapshot(as_of) as t:
            info = self._info(t, table, namespace, version)
            rows = [
                (e["id"], True, e["path"], e["content_type"], None, e["bytes"], e["records"], e["bytes"], e["schema_id"], "lakeloom", d.get("previous"), p, e["order"], d["type"], json.dumps(e["partition"]))
                for p, d in self._deltas(t, info) for e in self._load(d)
            ]
        schema = "id string, mandatory boolean, path string, meta_content_type string, meta_content_encoding string, meta_content_length long, meta_record_count long, meta_source_content_length long, meta_schema_id int, author_name string, previous_stream_position long, stream_position long, entry_order int, delta_type string, partition_values string"
        return self.spark.createDataFrame(rows, schema)

    @contextmanager
    def _snapshot(self, as_of: int | None) -> Iterator[Transaction]:
        if as_of is None:
            with self._work() as t:
                yield t
        else:
            yield Transaction(self.log, "", as_of)

    def read(
        self, table: str, namespace: str = DEFAULT_NAMESPACE, version: str | None = None, columns: Sequence[str] | None = None, partition_filter: dict[str, Sequence[Any]] | None = None, as_of: int | None = None,
        file_path_column: str | None = None, ordered: bool = False, read_as: str = "spark", row_filter: Predicate | None = None, limit: int | None = None,
    ) -> Any:
        """The table's rows in a snapshot. Deltas not yet compacted are merged on read; ``partition_filter`` prunes files.

        ``row_filter`` keeps rows for which it is true; files whose bounds rule that out are not planned (of keyed tables
        with deltas not yet compacted only by the merge keys, as the last row of a key decides). ``limit`` plans no more files
        than hold so many rows where nothing else has to be read. ``file_path_column`` names the file that each row comes
        from, ``ordered`` sorts by position, file and row; both hold for merged rows as well.
        ``as_of`` (nanoseconds) sees transactions that ended strictly before. ``read_as``: spark, pandas, arrow, numpy or files.
        """
        with self._snapshot(as_of) as t:
            info = self._info(t, table, namespace, version)
            if info.schema is None:
                df = self.manifest(table, namespace, version, as_of)
            elif read_as == "files":
                return [e["path"] for _, d in self._deltas(t, info) for e in self._planned(info, d, self._load(d), partition_filter, row_filter, self._settled(info, self._deltas(t, info)))]
            else:
                df = self._rows(t, info, partition_filter, file_path_column, ordered, row_filter=row_filter, limit=limit)
                if row_filter is not None:
                    df = df.filter(to_column(row_filter))
        if limit is not None:
            df = df.limit(limit)
        if columns is not None:
            df = formats.project(df, [*columns, *([file_path_column] if file_path_column and file_path_column not in columns else [])])
        return {"spark": lambda: df, "pandas": df.toPandas, "arrow": df.toArrow, "numpy": lambda: df.toPandas().to_numpy()}[read_as]()

    def read_window(self, table: str, after: int, upto: int, namespace: str = DEFAULT_NAMESPACE, version: str | None = None, as_of: int | None = None) -> DataFrame:
        """The rows written by the deltas with positions in (after, upto], each under its position; deletes and compacted deltas are left out."""
        with self._snapshot(as_of) as t:
            info = self._info(t, table, namespace, version)
            found = [(p, d) for p, d in self._deltas(t, info) if after < p <= upto and d["type"] not in ("DELETE", "COMPACTED")]
            parts = [x for p, d in found if (x := self._scan(info, d, p, self._load(d), system=True)) is not None]
        names = [f.name for f in info.schema.fields]
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*[T.StructField(f.name, f.dataType, True) for f in info.schema.struct().fields], T.StructField("stream_position", T.LongType())]))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return df.select(*[f"`{n}`" for n in names], F.col("__pos").cast("long").alias("stream_position"))

    def _scan(self, info: TableInfo, delta: dict, position: int, entries: list[dict], system: bool) -> DataFrame | None:
        """The rows of some entries, each group of one schema and format in one scan, coerced to the current schema."""
        current, out = info.schema, None
        schemas = {s["id"]: Schema.from_json(s) for s in info.data["schemas"]}
        groups: dict[tuple, list[str]] = {}
        for e in entries:
            groups.setdefault((e["schema_id"], e["content_type"]), []).append(e["path"])
        for (sid, kind), paths in groups.items():
            df = formats.read(self.spark, paths, kind)
            if system:
                df = df.withColumns({"__pos": F.lit(position), "__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
            given = delta.get("given")
            if given is not None:
                keep = Schema([f for f in current.fields if any(o.id == f.id and o.name.lower() in given for o in schemas[sid].fields)], current.id, current.last_field_id)
                df = coerce_read(df, schemas[sid], keep)
            elif delta["type"] != "DELETE":
                df = coerce_read(df, schemas[sid], current)
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    @staticmethod
    def _settled(info: TableInfo, deltas: list) -> bool:
        """Whether every stored row stands by itself: there are no keys, or nothing but compacted deltas."""
        return not info.schema.merge_keys or all(d["type"] == "COMPACTED" for _, d in deltas)

    def _planned(self, info: TableInfo, delta: dict, entries: list[dict], partition_filter: dict | None, row_filter: Predicate | None, settled: bool) -> list[dict]:
        """The entries that a scan must read."""
        if partition_filter:
            entries = [e for e in entries if all(k not in e["partition"] or e["partition"][k] in {str(x) for x in v} for k, v in partition_filter.items())]
        if row_filter is None or delta["type"] == "DELETE" or not (settled or fields_of(row_filter) <= set(info.schema.merge_keys)):
            return entries
        # bounds go by the names of the file's own schema, so only files of the present one are left out
        return [e for e in entries if e["schema_id"] != info.schema.id or may_match(row_filter, e.get("bounds") or {})]

    def _rows(self, t: Transaction, info: TableInfo, partition_filter: dict | None = None, file_path_column: str | None = None, ordered: bool = False, bucket: set[int] | None = None, deltas: list | None = None, row_filter: Predicate | None = None, limit: int | None = None) -> DataFrame:
        schema = info.schema
        keys, names = schema.merge_keys, [f.name for f in schema.fields]
        found = self._deltas(t, info) if deltas is None else deltas
        settled = self._settled(info, found)
        parts, planned = [], 0
        for p, d in found:
            entries = self._planned(info, d, self._load(d), partition_filter, row_filter, settled)
            if bucket is not None and d["type"] == "COMPACTED":
                entries = [e for e in entries if e["bucket"] in bucket]
            if limit is not None and settled and row_filter is None and not ordered:
                some = []
                for e in entries:
                    if planned >= limit:
                        break
                    some.append(e)
                    planned += e["records"] or 0
                entries = some
            if entries:
                parts.append((p, d, self._scan(info, d, p, entries, system=True)))
        traced = bool(file_path_column or ordered)
        if not parts:
            empty = self.spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.struct().fields]))
            return empty.withColumn(file_path_column, F.lit(None).cast("string")) if file_path_column else empty
        if settled:
            df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x for _, _, x in parts])
            df = df.withColumn("__source", F.struct("__pos", "__file", "__row")) if traced else df
        else:
            df = self._merge_on_read(schema, parts, names, keys, traced)
        if ordered:
            df = df.orderBy("__source")
        extra = [F.col("__source.__file").alias(file_path_column)] if file_path_column else []
        return df.select(*[f"`{n}`" for n in names], *extra)

    def _merge_on_read(self, schema: Schema, parts: list, names: list[str], keys: list[str], traced: bool = False) -> DataFrame:
        """``traced``: with ``__source``, the position, file and row number of the row that was merged last into each."""
        kind = "struct<__pos:bigint,__file:string,__row:bigint>"
        if traced:
            names = [*names, "__source"]
            parts = [(p, d, x if d["type"] == "DELETE" else x.withColumn("__source", F.struct(F.col("__pos").cast("long").alias("__pos"), "__file", "__row"))) for p, d, x in parts]
        orders = [merge.MergeOrder(n, asc) for n, asc in schema.merge_orders]
        seq = [*([schema.event_time] if schema.event_time and not orders else []), "__file", "__row"]
        state: DataFrame | None = None
        defaults = {f.name: f.future_default for f in schema.fields}
        full = {n.lower() for n in names}
        nothing = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in schema.struct().fields], *([T.StructField("__source", T._parse_datatype_string(kind), True)] if traced else [])])
        run: list = []

        def flush() -> None:
            nonlocal state
            if not run:
                return
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x for _, _, x in run])
            order = ["__pos", *seq] if not schema.event_time or orders else [schema.event_time, "__pos", "__file", "__row"]
            partial = not full <= {c.lower() for c in rows.columns}
            if state is None and not partial:
                state = merge.dedupe_merge_order(rows, keys, orders, order) if orders else merge.dedupe_last(rows, keys, order)
                state = state.select(*[f"`{n}`" for n in names])
            elif partial:
                base = state if state is not None else self.spark.createDataFrame([], nothing)
                state = merge.upsert_partial(base, rows, keys, order, defaults).select(*[f"`{n}`" for n in names])
            else:
                state = merge.upsert(state, rows, keys, order, orders).select(*[f"`{n}`" for n in names])
            run.clear()

        for p, d, df in parts:
            if d["type"] == "COMPACTED":
                state = df.select(*[f"`{n}`" for n in names])
            elif d["type"] == "DELETE":
                flush()
                if state is not None:
                    state = merge.equality_delete(state, df, d["columns"])
            else:
                if run and set(run[-1][2].columns) != set(df.columns):
                    flush()  # batches that give other columns are merged apart
                run.append((p, d, df))
        flush()
        return state if state is not None else self.spark.createDataFrame([], nothing)

    # services

    def _due(self, t: Transaction, info: TableInfo, kind: str) -> bool:
        """Keyed changes are compacted at once; appends by numbers of deltas, files or records since the last compaction."""
        if info.schema is None or info.properties["read_optimization_level"] != "MAX":
            return False
        if kind in ("UPSERT", "DELETE"):
            return True
        new = [d for _, d in self._deltas(t, info) if d["type"] != "COMPACTED"]
        p = info.properties
        return (
            len(new) >= p["appended_delta_count_compaction_trigger"] or sum(d["files"] for d in new) >= p["appended_file_count_compaction_trigger"]
            or sum(d["records"] for d in new) >= p["appended_record_count_compaction_trigger"]
        )

    def compact(self, table: str, namespace: str = DEFAULT_NAMESPACE, version: str | None = None) -> dict:
        with self._work(f"compact {namespace}.{table}") as t:
            return self._compact(t, self._info(t, table, namespace, version))

    def _compact(self, t: Transaction, info: TableInfo) -> dict:
        """Merges all deltas into one; of keyed tables only hash buckets with changes are rewritten, others kept by reference."""
        deltas = self._deltas(t, info)
        stream = t.get(*info.path, "stream")
        at = [*info.path, "streams", stream]
        keys = info.schema.merge_keys
        old = next((d for _, d in deltas if d["type"] == "COMPACTED"), None)
        round_info = t.get(*at, "round", default={})
        n = self._buckets(info, deltas, round_info)
        if old and round_info.get("buckets") not in (None, n) and keys:
            old = None  # another bucket count: everything is rewritten
        new = [(p, d) for p, d in deltas if d["type"] != "COMPACTED"]
        if not new:
            return round_info
        touched: set[int] | None = None
        if keys and old is not None and all(d["type"] != "DELETE" or set(keys) <= set(d["columns"]) for _, d in new):
            marks = None
            for p, d in new:
                x = self._scan(info, d, p, self._load(d), system=False).select(hash_bucket(keys, n).alias("b"))
                marks = x if marks is None else marks.unionByName(x)
            touched = {r["b"] for r in marks.distinct().collect()}  # at most n values
        watch = Observation(f"compact {uuid.uuid4().hex}")
        df = self._rows(t, info, bucket=touched).observe(watch, F.count(F.lit(1)).alias("output_records"))
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        t.stage(folder)
        limit = info.properties["records_per_compacted_file"]
        if keys:
            df.withColumn("__bucket", hash_bucket(keys, n)).repartition(n, "__bucket").write.option("maxRecordsPerFile", limit).partitionBy("__bucket").parquet(folder)
        else:
            df.write.option("maxRecordsPerFile", limit).parquet(folder)
        entries = self._entries(self.log.files.sizes(folder), formats.PARQUET, info.schema, info)
        kept = [e for e in self._load(old) if e["bucket"] not in touched] if old is not None and touched is not None else []
        for p, _ in deltas:
            t.delete([*at, "deltas", p], "COMPACT")
        self._commit_delta(t, info, "COMPACTED", [*kept, *entries], None, None, info.schema, position=0)
        done = {"watermark": max(p for p, _ in new), "buckets": n if keys else None, "rewritten_files": len(entries), "kept_files": len(kept), "input_records": sum(d["records"] for _, d in new), "output_records": watch.get["output_records"], "output_bytes": sum(e["bytes"] for e in entries)}
        t.put([*at, "round"], done, "COMPACT")
        return done

    @staticmethod
    def _buckets(info: TableInfo, deltas: list, round_info: dict) -> int:
        """Hash buckets of a compaction: the table's property if it is set, else so many that a bucket is about one file; never fewer than before."""
        n = int(info.properties["default_compaction_hash_bucket_count"])
        if "default_compaction_hash_bucket_count" in info.data.get("properties", {}):
            return n
        rows = sum(d["records"] or 0 for _, d in deltas)
        while n * info.properties["records_per_compacted_file"] < rows:
            n *= 2
        return max(n, round_info.get("buckets") or n)

    def rebase(self, table: str, source: str, namespace: str = DEFAULT_NAMESPACE, source_namespace: str | None = None) -> dict:
        """Compacts the deltas of ``source`` into a new stream of ``table``, whatever was compacted there before."""
        with self._work(f"rebase {namespace}.{table} from {source}") as t:
            origin, info = self._info(t, source, source_namespace or namespace), self._info(t, table, namespace)
            rows = self._rows(t, origin)
            self._new_stream(t, info.path)
            info = self._info(t, table, namespace, info.version)
            self._stage(t, info, rows, "UPSERT" if info.schema.merge_keys else "APPEND", None, formats.PARQUET, None)
            return self._compact(t, self._info(t, table, namespace, info.version))

    def repartition(self, table: str, column: str, ranges: Sequence[int], namespace: str = DEFAULT_NAMESPACE) -> list[int]:
        """Rewrites a keyless table as one delta per range (lo, hi] of a column, nulls in the first; returns the positions."""
        from .operators.repartition import range_repartition

        with self._work(f"repartition {namespace}.{table}") as t:
            info = self._info(t, table, namespace)
            if info.schema is None or info.schema.merge_keys:
                raise ValueError("only tables with a schema and without merge keys are repartitioned")
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            t.stage(folder)
            old = self._deltas(t, info)
            range_repartition(self._rows(t, info), column, ranges, folder, info.properties["records_per_compacted_file"])
            at = [*info.path, "streams", t.get(*info.path, "stream")]
            for p, _ in old:
                t.delete([*at, "deltas", p], "REPARTITION")
            done = []
            for k in range(len(ranges) + 1):
                files = self.log.files.sizes(f"{folder}/_range={k}")
                if files:
                    entries = self._entries(files, formats.PARQUET, info.schema, info)
                    done.append(self._commit_delta(t, info, "APPEND", entries, None, None, info.schema))
            return done

    def statistics(self, table: str, namespace: str = DEFAULT_NAMESPACE) -> DataFrame:
        from .operators.repartition import file_statistics

        return file_statistics(self.manifest(table, namespace), ["delta_type"])

    def clean(self, timeout_s: float = 3600) -> dict[str, int]:
        return janitor(self.log, timeout_s)

    def view(self, table: str, namespace: str = DEFAULT_NAMESPACE, name: str | None = None, **options) -> str:
        """Registers a temporary view, so that Spark SQL can query the snapshot."""
        self.read(table, namespace, **options).createOrReplaceTempView(name or table)
        return name or table

    # urls

    def list(self, url: str, recursive: bool = False) -> DataFrame:
        """Objects below lake://namespace/table/version; * matches one level, ** all below."""
        want = url.removeprefix("lake://").strip("/").split("/") if url.removeprefix("lake://").strip("/") else []
        deep = recursive or "**" in want
        want = [w for w in want if w != "**"]
        rows = []
        with self._work() as t:
            for i, n in t.get("namespaces", default={}).items():
                rows.append(("namespace", [n["name"]]))
                for x in t.get("tables", default={}).values():
                    if x["namespace"] != i:
                        continue
                    rows.append(("table", [n["name"], x["name"]]))
                    for v, d in x["versions"].items():
                        rows.append(("version", [n["name"], x["name"], v]))
                        for s, sd in d.get("streams", {}).items():
                            rows.append(("stream", [n["name"], x["name"], v, s]))
                            rows += [("delta", [n["name"], x["name"], v, s, p]) for p in sd["deltas"]]
        hit = lambda p: all(fnmatch.fnmatchcase(a, b) for a, b in zip(p, want, strict=False))
        star = bool(want) and want[-1] == "*"
        depth = len(want) if star else len(want) + 1
        keep = [(k, "lake://" + "/".join(p)) for k, p in rows if hit(p) and (len(p) >= depth if deep else len(p) == depth)]
        return self.spark.createDataFrame(sorted(keep), "kind string, url string")

    def get(self, url: str) -> Any:
        """The object behind a url: a namespace's properties or a table version."""
        parts = url.removeprefix("lake://").strip("/").split("/")
        return self.get_namespace(parts[0]) if len(parts) == 1 else self.get_table(parts[1], parts[0], parts[2] if len(parts) > 2 else None)

    def put(self, url: str, **options) -> Any:
        parts = url.removeprefix("lake://").strip("/").split("/")
        return self.create_namespace(parts[0], **options) if len(parts) == 1 else self.create_table(parts[1], parts[0], parts[2] if len(parts) > 2 else None, **options)

    def copy(self, source: str, target: Catalog, new_namespace: str | None = None) -> int:
        """Copies matching tables with their files to another catalog, in order: namespaces, tables, versions, deltas."""
        done = 0
        for r in self.list(source, recursive=True).filter("kind = 'version'").orderBy("url").collect():
            ns, table, version = r["url"].removeprefix("lake://").split("/")
            info = self.get_table(table, ns, version)
            with self._work() as t, target.transaction(f"copy {r['url']}") as o:
                target.create_table(table, new_namespace or ns, version, info.schema, [(s, Transform(tr, size, st), n) for s, tr, size, st, n in info.data["partition_by"]], [tuple(k) for k in info.data["sort_keys"]], info.data["properties"], info.data["description"], info.data["lifecycle"])
                made = target._info(o, table, new_namespace or ns, version)
                o.put([*made.path, "schemas"], info.data["schemas"])
                made = target._info(o, table, new_namespace or ns, version)
                for p, d in self._deltas(t, info):
                    folder = f"{target.root}/data/{uuid.uuid4().hex}"
                    o.stage(folder)
                    entries, pairs = [], []
                    for e in self._load(d):
                        keep = "/".join(x for x in e["path"].split("/")[:-1] if x.startswith(("_p_", "__bucket=")))
                        to = "/".join(x for x in (folder, keep, e["path"].rsplit("/", 1)[1]) if x)
                        pairs.append((e["path"], to))
                        entries.append(e | {"path": to})
                    copy_all(self.spark, pairs)
                    target._commit_delta(o, made, d["type"], entries, d["columns"], d["given"], made.schema, position=p)
                done += 1
        return done


_catalogs: dict[str, Catalog] = {}
_default: list[str] = []


def init(spark: SparkSession, catalogs: dict[str, str], default: str | None = None) -> None:
    """Registers catalogs by name and folder."""
    for name, root in catalogs.items():
        put_catalog(name, Catalog(spark, root, name))
    if default or len(catalogs) == 1:
        _default[:] = [default or next(iter(catalogs))]


def init_local(spark: SparkSession, root: str) -> Catalog:
    init(spark, {"default": root}, "default")
    return get_catalog("default")


def get_catalog(name: str | None = None) -> Catalog:
    name = name or (_default[0] if _default else "default")
    if name not in _catalogs:
        raise NotFound(f"catalog {name}")
    return _catalogs[name]


def put_catalog(name: str, catalog: Catalog, fail_if_exists: bool = False) -> Catalog:
    if fail_if_exists and name in _catalogs:
        raise Exists(f"catalog {name}")
    _catalogs[name] = catalog
    return catalog


def pop_catalog(name: str) -> Catalog | None:
    return _catalogs.pop(name, None)


def clear_catalogs() -> None:
    _catalogs.clear()
    _default.clear()


def save_catalogs(path: str) -> None:
    with open(path, "w") as f:
        json.dump({"default": _default[0] if _default else None, "catalogs": {n: c.root for n, c in _catalogs.items()}}, f, indent=2)


def load_catalogs(spark: SparkSession, path: str) -> None:
    with open(path) as f:
        saved = json.load(f)
    init(spark, saved["catalogs"], saved["default"])


__all__ = [
    "AUTO", "DISABLED", "NONE", "Catalog", "Conflict", "Exists", "Field", "NotFound", "Schema", "TableInfo", "Update", "clear_catalogs", "get_catalog", "init", "init_local", "load_catalogs", "pop_catalog", "put_catalog", "save_catalogs",
]
