"""Structured Streaming around tables: an upsert sink, change application, and a monitor that acts on new versions."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Catalog
from ..operators.changefeed import BucketedTable


def upsert_stream(stream: DataFrame, catalog: Catalog, table: str, checkpoint: str, namespace: str = "DEFAULT", event_time: str | None = None, lateness: str | None = None, once: bool = True) -> StreamingQuery:
    """Writes each micro-batch to a keyed table; a batch that is repeated after a failure changes nothing.

    The number of the last batch is kept in the table's state by checkpoint and committed with the rows, so a batch
    already committed is passed over without a look at the history. Within a batch the table's event time decides
    between rows of one key; a later batch wins over earlier ones. With ``event_time`` and ``lateness`` a watermark
    bounds the state of operators before the sink.
    """
    if event_time and lateness:
        stream = stream.withWatermark(event_time, lateness)

    def write(batch: DataFrame, number: int) -> None:
        with catalog.transaction(f"stream {checkpoint} batch {number}") as t:
            exists = catalog.table_exists(table, namespace)
            if exists and number <= t.get(*catalog.get_table(table, namespace).path, "batches", checkpoint, default=-1):
                return
            catalog.write(batch, table, namespace, mode="merge" if exists else "auto")
            t.put([*catalog.get_table(table, namespace).path, "batches", checkpoint], number)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def apply_stream(stream: DataFrame, table: BucketedTable, checkpoint: str) -> StreamingQuery:
    """Applies a stream of changes to a bucketed table; changes applied twice change nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: table.apply(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Monitor:
    """Polls a version and acts when it changes; stops after some time without change.

    ``before`` and ``after`` are called around the action with the version; an error in one is kept and does not stop the
    monitor.
    """

    def __init__(self, version: Callable[[], object], act: Callable[[object], None], before: Callable[[object], None] | None = None, after: Callable[[object], None] | None = None):
        self.version, self.act, self.before, self.after = version, act, before, after
        self.errors: list[Exception] = []
        self.acted = 0

    def _call(self, f: Callable[[object], None] | None, v: object) -> None:
        if f is not None:
            try:
                f(v)
            except Exception as e:  # noqa: BLE001
                self.errors.append(e)

    def run(self, every_s: float, idle_s: float) -> int:
        """Returns how often it acted."""
        seen, quiet = object(), time.monotonic()
        while time.monotonic() - quiet < idle_s:
            v = self.version()
            if v is not None and v != seen:
                seen, quiet = v, time.monotonic()
                self._call(self.before, v)
                self.act(v)
                self.acted += 1
                self._call(self.after, v)
            time.sleep(every_s)
        return self.acted
