"""Admission by a sliding window per key, in batch and streaming.

A request is admitted if fewer than `capacity` admitted ones lie within the window before it (those exactly one window old still
count). Refused requests leave no trace, so each decision hangs on the ones before: a plain range window would not do.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

OUT = "event_id long, key string, ts double, allowed boolean, retry_after_s long"
COLUMNS = {"event_id": "long", "key": "string", "ts": "double"}


class Gate:
    """Decides requests of one key after another, each key's in order of time.

    Only the latest `capacity` admitted times matter: a request is refused if the oldest of so many still lies in its window.
    """

    def __init__(self, capacity: int, window_s: float, key=None, admitted=()):
        self.window_s, self.full, self.key, self.admitted = window_s, capacity, key, deque(admitted, maxlen=capacity)

    def wait(self, key, at: float) -> float | None:
        """None if the request is admitted, else the seconds until the window opens."""
        if key != self.key:
            self.key = key
            self.admitted.clear()
        oldest = self.admitted[0] if len(self.admitted) == self.full > 0 else None
        if self.full and (oldest is None or oldest + self.window_s < at):
            self.admitted.append(at)
            return None
        return self.window_s if oldest is None else max(0.0, oldest + self.window_s - at)

    def decide(self, keys, times) -> tuple[list[bool], list[int]]:
        waits = [self.wait(k, t) for k, t in zip(keys, times, strict=True)]
        return [w is None for w in waits], [0 if w is None else int(w) + 1 for w in waits]


def requests(df: DataFrame) -> DataFrame:
    """The columns that decisions take, without rows that lack a key or a time."""
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in COLUMNS.items()]).dropna(subset=["key", "ts"])


def request_key(forwarded: Column, peer: Column) -> Column:
    """The first forwarded address, else the peer's."""
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.coalesce(F.when(first != "", first), peer)


def admission(df: DataFrame, capacity: int, window_s: float) -> DataFrame:
    """event_id, key, ts, allowed, retry_after_s of each row of df (event_id, key, ts in seconds). Equal times go by event_id.

    One shuffle: a key's rows come to one partition, sorted there by Spark, which spills; they then flow by in batches, and a task holds no more than
    `capacity` times. Each decision hangs on the ones before, so a key stays one task's work. Null keys or times are left out.
    """

    def walk(batches):
        import pyarrow as pa

        gate = Gate(capacity, window_s)
        for b in batches:
            allowed, retry = gate.decide(b.column("key").to_pylist(), b.column("ts").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(allowed, pa.bool_()), pa.array(retry, pa.int64())], names=[*COLUMNS, "allowed", "retry_after_s"])

    return requests(df).repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInArrow(walk, OUT)


def _walk_of(capacity: int, window_s: float, taken: dict[int, tuple]):
    """Decides the requests of a range, from the times that it takes for granted; a last row has the times that the range leaves."""

    def walk(key, rows):
        import pyarrow as pa

        part = key[0].as_py()
        rows = rows.sort_by([("key", "ascending"), ("ts", "ascending"), ("event_id", "ascending")])
        gate = Gate(capacity, window_s, rows.column("key")[0].as_py(), taken[part])
        allowed, retry = gate.decide(rows.column("key").to_pylist(), rows.column("ts").to_pylist())
        found = pa.table([*(rows.column(c).combine_chunks() for c in COLUMNS), pa.array(allowed, pa.bool_()), pa.array(retry, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.nulls(len(rows), pa.list_(pa.float64()))], names=[*COLUMNS, "allowed", "retry_after_s", "part", "times"])
        state = pa.table([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.array([list(gate.admitted)], pa.list_(pa.float64()))], names=found.column_names)
        return pa.concat_tables([found, state])

    return walk


#: Rows of a range that one task walks through.
RANGE_ROWS = 500_000


def admission_in_ranges(df: DataFrame, capacity: int, window_s: float, range_rows: int = RANGE_ROWS) -> DataFrame:
    """admission() for keys with more requests than a task should walk through: the same rows, a key's requests in ranges of time over several tasks.

    All ranges are walked at once, as if nothing came before them. Then each one's last admitted times, at most `capacity`, are held against what the next
    range of the same key took for granted; those that lie outside the window of its first request are nothing to it. Only ranges that were
    wrong are walked again, until none is: a gap as long as the window ends the chain. Ranges come from Spark's sampling and are stored; what
    reaches the driver is each range's outermost keys and last times.
    """
    rows = requests(df)
    parts = -(-rows.count() // range_rows)
    if parts <= 1:
        return admission(df, capacity, window_s)
    dealt = stored(rows.repartitionByRange(parts, "key", "ts", "event_id").withColumn("part", F.spark_partition_id()))
    row = F.struct("key", "ts", "event_id")
    ends = sorted(dealt.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last")).collect(), key=lambda r: tuple(r["first"]))
    taken: dict[int, tuple] = {r["part"]: () for r in ends}  # the times that a range took for granted
    latest: dict[int, DataFrame] = {}
    last: dict[int, list[float]] = {}
    open_ = set(taken)
    while open_:
        out = stored(dealt.filter(F.col("part").isin(*open_)).groupBy("part").applyInArrow(_walk_of(capacity, window_s, {p: taken[p] for p in open_}), OUT + ", part int, times array<double>"))
        latest |= dict.fromkeys(open_, out)
        held = {r["part"]: r["times"] for r in out.filter("times IS NOT NULL").select("part", "times").collect()}
        last |= held
        open_ = set()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            first = b["first"]
            incoming = tuple(t for t in last[a["part"]] if t + window_s >= first["ts"]) if a["last"]["key"] == first["key"] else ()
            if incoming != taken[b["part"]]:
                taken[b["part"]] = incoming
                open_.add(b["part"])
    result = None
    for frame in dict.fromkeys(latest.values()):
        mine = frame.filter(F.col("times").isNull() & F.col("part").isin(*[p for p, f in latest.items() if f is frame])).drop("part", "times")
        result = mine if result is None else result.unionByName(mine)
    return result
