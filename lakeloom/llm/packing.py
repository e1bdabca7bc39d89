"""Filling containers of fixed capacity with neighbouring items along a space-filling curve."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast, cut, ship

KEY = ["stream_id", "partition_id", "stream_position"]
#: Rows of the curve that one task packs at most, on average half as many.
CHUNK = 50_000
#: Neighbours on the curve that are packed together, and containers that stay open from one such window to the next.
WINDOW, OPEN = 1_024, 32
BITS = 16
#: Packed pieces, and (without keys) the containers that a task leaves open.
SCHEMA = "namespace string, container_id string, stream_id string, partition_id string, stream_position string, piece_no int, piece_bytes long, piece_records long, capacity_bytes long, capacity_records long, hilbert long, left_open boolean"


def newest_items(deltas: DataFrame) -> DataFrame:
    """The newest committed version of each delta; unknown sizes count as 0."""
    v = F.struct("committed_at", "manifest_id", "namespace", "table_name", F.coalesce(F.greatest("content_length", F.lit(0)), F.lit(0)).alias("bytes"), F.coalesce(F.greatest("record_count", F.lit(0)), F.lit(0)).alias("records"))
    return deltas.filter(F.col("committed_at").isNotNull()).groupBy(*KEY).agg(F.max(v).alias("_v")).select(*KEY, "_v.namespace", "_v.table_name", "_v.bytes", "_v.records")


def _axis(features: list[tuple[Column, float]], seed: int) -> Column:
    """One random direction for hashed features, scaled to 0 .. 2^BITS - 1."""
    total, most = F.lit(0.0), sum(w for _, w in features)
    for f, weight in features:
        total = total + weight * (F.xxhash64(F.lit(seed), F.coalesce(f.cast("string"), F.lit(""))) / F.lit(float(2**63)))
    return F.floor((total / most + 1) / 2 * (2**BITS - 1)).cast("long")


def hilbert_keys(x: np.ndarray, y: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of the cells (x, y) on the Hilbert curve over a grid of 2^bits by 2^bits, all cells at once from the top quadrant down."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    key, last = np.zeros(len(x), dtype=np.int64), (1 << bits) - 1
    for k in range(bits - 1, -1, -1):
        right, up = x >> k & 1, y >> k & 1
        key = key << 2 | (3 * right) ^ up
        flip, turn = (up == 0) & (right == 1), up == 0
        x, y = np.where(flip, last - x, x), np.where(flip, last - y, y)
        x, y = np.where(turn, y, x), np.where(turn, x, y)
    return key


def hilbert(x: Column, y: Column, bits: int = BITS) -> Column:
    """``hilbert_keys`` as a column, in Arrow batches."""
    ship()

    @F.pandas_udf("long")
    def keys(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(hilbert_keys(a.to_numpy(), b.to_numpy(), bits))

    return keys(x.cast("long"), y.cast("long"))


def placed(items: DataFrame) -> DataFrame:
    """``items`` with ``hilbert``: the delta's features (table, stream, partition, size class, time) hashed to a vector, projected to two dimensions."""
    size = F.floor(F.log2(F.col("bytes") + 1)).cast("int")
    day = F.floor(F.col("stream_position") / 86_400_000)
    features = [(F.col("table_name"), 4.0), (F.col("stream_id"), 3.0), (F.concat_ws("/", "stream_id", "partition_id"), 2.0), (size, 1.0), (day, 1.0)]
    return items.withColumn("hilbert", hilbert(_axis(features, 11), _axis(features, 23)))


def pieces(size: int, records: int, cap_size: int, cap_records: int, even: bool = False) -> list[tuple[int, int]]:
    """The item whole if it fits, else the least number of pieces; sums are kept exactly.

    Pieces are full but for the last, or even: even ones leave room in both capacities, so that pieces heavy in one can be
    packed with those heavy in the other.
    """
    if (size > 0 and cap_size <= 0) or (records > 0 and cap_records <= 0):
        raise ValueError("an item of positive size needs a positive capacity")
    n = max(1, -(-size // cap_size) if size else 1, -(-records // cap_records) if records else 1)
    if even:
        cuts = [(size * k // n, records * k // n) for k in range(n + 1)]
    else:
        f = max(size / cap_size if size else 0, records / cap_records if records else 0)
        a, b = (min(cap_size, int(size / f)), min(cap_records, int(records / f))) if n > 1 else (size, records)
        cuts = [(a * k, b * k) for k in range(n)] + [(size, records)]
        if size - a * (n - 1) > cap_size or records - b * (n - 1) > cap_records:  # rounding left too much for the last
            return pieces(size, records, cap_size, cap_records, even=True)
    return [(c[0] - d[0], c[1] - d[1]) for d, c in zip(cuts, cuts[1:], strict=False)]


class Packer:
    """Packs one namespace's items along the curve, window by window; at most ``open_`` containers outlast a window.

    Inside a window the largest items go first, each into the fitting container with the least room left. When more
    than ``open_`` containers are open at its end the fullest are closed for good, however full they are, so neither the
    memory nor the work per item grows with the number of items.
    """

    def __init__(self, cap_size: int, cap_records: int, open_: int = OPEN):
        self.caps, self.scale, self.open_ = (cap_size, cap_records), (max(cap_size, 1), max(cap_records, 1)), open_
        self.room_s = self.room_r = np.zeros(0, dtype=np.int64)
        self.ids: list[int] = []
        self.made = 0

    def window(self, sizes: np.ndarray, records: np.ndarray) -> np.ndarray:
        """The container number of each item; numbers are never used again."""
        n, most = len(self.ids), len(self.ids) + len(sizes)
        room_s, room_r, slack = np.zeros(most, dtype=np.int64), np.zeros(most, dtype=np.int64), np.zeros(most)
        room_s[:n], room_r[:n] = self.room_s, self.room_r
        (cap_s, cap_r), (scale_s, scale_r) = self.caps, self.scale
        slack[:n] = np.minimum(room_s[:n] / scale_s, room_r[:n] / scale_r)
        where = np.zeros(len(sizes), dtype=np.int64)
        order = np.argsort(-np.maximum(sizes / scale_s, records / scale_r), kind="stable")
        for i, s, r in zip(order.tolist(), sizes[order].tolist(), records[order].tolist(), strict=True):
            fits = ((room_s[:n] >= s) & (room_r[:n] >= r)).nonzero()[0]
            if len(fits):
                c = fits[slack[fits].argmin()]
            else:
                c, n = n, n + 1
                room_s[c], room_r[c] = cap_s, cap_r
                self.ids.append(self.made)
                self.made += 1
            a, b = room_s[c] - s, room_r[c] - r
            room_s[c], room_r[c] = a, b
            slack[c] = min(a / scale_s, b / scale_r)
            where[i] = c
        numbers = np.array(self.ids, dtype=np.int64)[where] if len(sizes) else where
        keep = np.sort(np.argsort(-slack[:n], kind="stable")[: self.open_])
        self.room_s, self.room_r, self.ids = room_s[keep], room_r[keep], [self.ids[k] for k in keep]
        return numbers


def _divided(rows: pd.DataFrame) -> pd.DataFrame:
    """``rows`` with items beyond the capacity in the least number of pieces.

    Where a namespace needs both capacities (``even``) the pieces are even and leave room in both, else full but for the last.
    """
    cap_s, cap_r = int(rows["capacity_bytes"].iloc[0]), int(rows["capacity_records"].iloc[0])
    over = ((rows["bytes"] > cap_s) | (rows["records"] > cap_r)).to_numpy()
    if not over.any():
        return rows.assign(piece_no=0)
    parts = [rows[~over].assign(piece_no=0)]
    for r in rows[over].to_dict("records"):
        cuts = pieces(int(r["bytes"]), int(r["records"]), cap_s, cap_r, even=bool(r["even"]))
        parts.append(pd.DataFrame([r | {"bytes": a, "records": b, "piece_no": n} for n, (a, b) in enumerate(cuts)]))
    return pd.concat(parts)


def _packed(batches: Iterator[pd.DataFrame], window: int, open_: int, divide: bool) -> Iterator[pd.DataFrame]:
    """Packs the sorted rows of one task; behind each namespace stand the containers that it left open."""
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    # texts of several batches in one column would be chunks, which no record batch takes
    texts = {c: object for c in ("namespace", "container_id", *KEY)}
    held: list[pd.DataFrame] = []
    rows, ns, packer, first = 0, None, None, {}
    used: dict[int, list[int]] = {}

    def flush(take: pd.DataFrame) -> pd.DataFrame:
        x = _divided(take) if divide else take
        numbers = packer.window(x["bytes"].to_numpy(np.int64), x["records"].to_numpy(np.int64))
        for c, k, n, h in zip(numbers.tolist(), x["key"], x["piece_no"], x["hilbert"], strict=True):
            if c not in first:
                first[c] = (f"{ns}-{hashlib.sha1(f'{k}|{n}'.encode()).hexdigest()[:20]}", h)
        out = x.rename(columns={"bytes": "piece_bytes", "records": "piece_records"})
        out["container_id"] = [first[c][0] for c in numbers.tolist()]
        out["left_open"] = False
        for c, a, b in zip(numbers.tolist(), out["piece_bytes"], out["piece_records"], strict=True):
            u = used.setdefault(c, [0, 0])
            u[0] += a
            u[1] += b
        for c in set(used) - set(packer.ids):
            del used[c], first[c]
        return out[cols].astype(texts)

    def rest() -> pd.DataFrame:
        x = pd.DataFrame({"container_id": [first[c][0] for c in packer.ids], "piece_bytes": [used[c][0] for c in packer.ids], "piece_records": [used[c][1] for c in packer.ids], "hilbert": [first[c][1] for c in packer.ids]})
        x["namespace"], x["left_open"], x["capacity_bytes"], x["capacity_records"] = ns, True, *packer.caps
        return x.reindex(columns=cols).astype(texts)

    for batch in batches:
        for name, part in batch.groupby("namespace", sort=False):
            if name != ns:
                if held:
                    yield flush(pd.concat(held))
                if packer is not None and packer.ids:
                    yield rest()
                held, rows, ns, first, used = [], 0, name, {}, {}
                packer = Packer(int(part["capacity_bytes"].iloc[0]), int(part["capacity_records"].iloc[0]), open_)
            while len(part):
                take = part.iloc[: window - rows]
                held.append(take)
                rows, part = rows + len(take), part.iloc[len(take) :]
                if rows >= window:
                    yield flush(pd.concat(held))
                    held, rows = [], 0
    if held:
        yield flush(pd.concat(held))
    if packer is not None and packer.ids:
        yield rest()


def ranges(rows: int, chunk: int, cores: int, window: int) -> int:
    """Ranges of the curve of ``chunk`` / 2 rows on average, as ranges are drawn by sampling; few rows still use all cores."""
    return max(-(-2 * rows // chunk), min(cores, -(-rows // window)))


def ranged(items: DataFrame, parts: int) -> DataFrame:
    order = ["namespace", "hilbert", "key"]
    return items.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _round(items: DataFrame, parts: int, window: int, open_: int, divide: bool) -> DataFrame:
    """One pass along the curve in ``parts`` ranges of it."""
    ship()
    return ranged(items, parts).mapInPandas(lambda batches: _packed(batches, window, open_, divide), SCHEMA)


def pack(deltas: DataFrame, targets: DataFrame, chunk: int = CHUNK, window: int = WINDOW, open_: int = OPEN) -> DataFrame:
    """Every newest committed delta (or its pieces, if it alone exceeds the capacity) with its container.

    Range-sorted by namespace and Hilbert key; each task walks its range of the curve and packs neighbours, ``window`` at
    a time with at most ``open_`` containers carried on, so neighbours share containers and a namespace of any share
    spreads over tasks. What a task leaves open, at most ``open_`` containers a namespace, is combined whole with
    what the others left, in rounds of some hundred times fewer rows, until one task takes them all. Deltas of a
    namespace without a positive capacity come out with a null container. Nulls in sizes count as 0, equal items are
    told apart by their keys; an empty input gives no rows.
    """
    caps = bounded_broadcast(targets.groupBy("namespace").agg(F.max("capacity_bytes").alias("capacity_bytes"), F.max("capacity_records").alias("capacity_records")))
    items = placed(newest_items(deltas)).join(caps, "namespace", "left").select("namespace", *KEY, "bytes", "records", "capacity_bytes", "capacity_records", "hilbert")
    items = cut(items)
    able = F.coalesce((F.col("capacity_bytes") > 0) & (F.col("capacity_records") > 0), F.lit(False))
    out = items.filter(~able).select("namespace", F.lit(None).cast("string").alias("container_id"), *KEY, F.lit(0).alias("piece_no"), F.col("bytes").alias("piece_bytes"), F.col("records").alias("piece_records"), "capacity_bytes", "capacity_records")
    rest = items.filter(able)
    rows = rest.count()
    if not rows:
        return out
    parts = ranges(rows, chunk, items.sparkSession.sparkContext.defaultParallelism, window)
    shares = F.sum("bytes") / F.max("capacity_bytes"), F.sum("records") / F.max("capacity_records")
    both = rest.groupBy("namespace").agg((F.least(*shares) > 0.5 * F.greatest(*shares)).alias("even"))
    # positions go through pandas as text: beside a null they would become floats and lose digits
    position = F.col("stream_position").cast("string")
    # where the parts of a key end is kept, so no two keys look alike
    key = F.to_json(F.array("stream_id", "partition_id", position))
    walk = rest.join(bounded_broadcast(both), "namespace").withColumns({"stream_position": position, "key": key})
    done = cut(_round(walk, parts, window, open_, divide=True))
    units = done.filter("left_open")
    moved: DataFrame | None = None
    while parts > 1:
        n = units.count()
        before, parts = parts, -(-2 * n // chunk)
        if parts >= before:
            break  # too few rows a range to gain anything
        last = parts == 1
        x = units.select("namespace", "capacity_bytes", "capacity_records", "hilbert", F.col("piece_bytes").alias("bytes"), F.col("piece_records").alias("records"), F.col("container_id").alias("key"), F.lit(None).cast("string").alias("stream_id"), F.lit(None).cast("string").alias("partition_id"), F.lit(None).cast("string").alias("stream_position"))
        x = x.withColumn("piece_no", F.lit(0))
        again = cut(_round(_keyed(x), parts, chunk if last else window, open_, divide=False))
        step = again.filter("NOT left_open").select(F.col("stream_id").alias("was"), F.col("container_id").alias("is"))
        moved = step if moved is None else moved.alias("a").join(step.alias("b"), F.col("a.is") == F.col("b.was"), "left").select("a.was", F.coalesce("b.is", "a.is").alias("is"))
        units = again.filter("left_open")
    packed = done.filter("NOT left_open").withColumn("stream_position", F.col("stream_position").cast("long"))
    if moved is not None:
        packed = packed.join(bounded_broadcast(moved), F.col("container_id") == F.col("was"), "left").withColumn("container_id", F.coalesce("is", "container_id"))
    return out.unionByName(packed.select(*out.columns))


def _keyed(units: DataFrame) -> DataFrame:
    """Containers as items: the container's id takes the place of a stream id, so that it comes out beside the new one."""
    return units.withColumn("stream_id", F.col("key"))


def fill(packed: DataFrame) -> DataFrame:
    """Per namespace: containers, the least number that the sums allow, and the share of the scarcer capacity in use."""
    per = packed.filter(F.col("container_id").isNotNull()).groupBy("namespace", "container_id").agg(F.sum("piece_bytes").alias("b"), F.sum("piece_records").alias("r"), F.max("capacity_bytes").alias("cb"), F.max("capacity_records").alias("cr"))
    x = per.groupBy("namespace").agg(F.count(F.lit(1)).alias("containers"), F.sum("b").alias("bytes"), F.sum("r").alias("records"), F.max("cb").alias("cb"), F.max("cr").alias("cr"))
    least = F.greatest(F.ceil(F.col("bytes") / F.col("cb")), F.ceil(F.col("records") / F.col("cr")))
    return x.select("namespace", "containers", least.cast("long").alias("least_possible"), "bytes", "records", F.round(F.greatest(F.col("bytes") / F.col("cb"), F.col("records") / F.col("cr")) / F.col("containers"), 4).alias("fill"))
