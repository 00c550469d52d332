"""Streaming forms of the sequential operators.

Each takes and returns a streaming DataFrame. The keyed ones are ``OrderedFold``: rows of a key wait in its state until
the watermark has passed them, are folded in order, and a timer lets an idle key leave the state store, when the
fold's last rows are flushed. So any arrival order within the lateness gives the batch operator's
result; later rows are dropped. There is no look-ahead, so gaps are left NULL where the batch form interpolates.
A key that comes back after it was idle starts anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from hoopflow.operators import video as V

#: Keyed state lives in this store, which keeps it on disk and supports timers and lists.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_MS = 6 * 3600 * 1000


def dedup(df: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """Drop repeats of a key that arrive within the lateness of its first copy.

    Rows later than that are dropped too; ``distinct_to_table`` keeps them.
    """
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def quality_windows(df: DataFrame, time: str, size: str, late: str, aggs: dict, slide: str | None = None) -> DataFrame:
    win = F.window(time, size, slide) if slide else F.window(time, size)
    return (df.withWatermark(time, late).groupBy(win.alias("w")).agg(*[c.alias(n) for n, c in aggs.items()])
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggs))


class OrderedFold(StatefulProcessor):
    """Folds a key's rows in event-time order.

    ``step(state, rows) -> (state, result)`` sees the rows that the watermark has passed, in order; ``finish(key, state)``
    gives the last rows of a key that was idle for ``idle_ms`` after its last one. ``_ms`` is the first of the row's
    columns: its event time in milliseconds, rounded up.
    """

    def __init__(self, names: list[str], columns: list[str], order: list[str], row_schema: str, state_schema: str, step: Callable, finish: Callable | None, idle_ms: int):
        self.names, self.columns, self.order = names, columns, order
        self.row_schema, self.state_schema, self.step, self.finish, self.idle_ms = row_schema, state_schema, step, finish, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.state = handle.getValueState("state", self.state_schema)
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None or key[0] != key[0]:
            return iter([])
        # Columns come in their order, but names that aren't Python names come changed.
        at = [self.names.index(c) for c in self.columns]
        new = [tuple(_plain(v) for v in r) for chunk in rows for r in chunk.iloc[:, at].itertuples(index=False, name=None)]
        if new:
            self.waiting.appendList(new)
            first = min(r[0] for r in new)
            if all(t > first for t in self.handle.listTimers()):
                self.handle.registerTimer(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        last = self.last.get()[0] if self.last.exists() else None
        if due:
            rows = pd.DataFrame(due, columns=self.columns).sort_values(self.order, kind="stable")
            state, res = self.step(state, rows)
            out.append(res)
            last = int(rows["_ms"].max())
            self.last.update((last,))
            if state is not None:
                self.state.update(state)
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if later:
            self.handle.registerTimer(min(r[0] for r in later))
        elif last is not None and now >= last + self.idle_ms:
            if self.finish is not None and state is not None:
                out.append(self.finish(key[0], state))
            for s in (self.waiting, self.state, self.last):
                s.clear()
        elif last is not None:
            self.handle.registerTimer(last + self.idle_ms)
        return iter([r for r in out if r is not None and len(r)])

    def close(self) -> None:
        pass


def _plain(v):
    if v is None or v != v or v is pd.NaT:
        return None
    return v.item() if hasattr(v, "item") else v


def _folded(df: DataFrame, by: str, time: str, late: str, order: list[str], step: Callable, out_schema: str, state_schema: str, finish: Callable | None = None, idle_ms: int = IDLE_MS) -> DataFrame:
    """``df`` has the key, the event time and what ``step`` needs; rows without an event time or key are left out."""
    spark = df.sparkSession
    spark.conf.set(*STORE)
    d = df.withColumn("_ms", F.ceil(F.unix_micros(time) / 1000)).withWatermark(time, late)
    cols = ["_ms", *[c for c in df.columns if c != time]]
    types = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    rows = ", ".join(f"`{c}` {types[c]}" for c in cols)
    fold = OrderedFold(d.columns, cols, order, rows, state_schema, step, finish, idle_ms)
    return d.groupBy(by).transformWithStateInPandas(statefulProcessor=fold, outputStructType=out_schema, outputMode="Append", timeMode="EventTime")


def ffill_diff(df: DataFrame, by: str, time: str, order: list[str], tie: str, value: str, late: str = "0 seconds", idle_ms: int = IDLE_MS) -> DataFrame:
    """Last non-null value and the change from the previous row, per key."""
    def step(state, rows):
        last, prev = (None, None) if state is None else state
        fills, diffs = [], []
        for v in rows[value]:
            v = None if v != v else v
            diffs.append(None if v is None or prev is None else v - prev)
            last = last if v is None else v
            prev = v
            fills.append(last)
        return (last, prev), rows[[by, tie]].assign(filled=pd.array(fills, dtype="Float64"), diff=pd.array(diffs, dtype="Float64"))

    return _folded(df.select(by, time, *dict.fromkeys([*order, tie, value])), by, time, late, order, step, f"{by} long, {tie} long, filled double, diff double", "last double, prev double", idle_ms=idle_ms)


def min_hold(df: DataFrame, by: str, time: str, order: list[str], tie: str, value: str, hold: int, late: str = "0 seconds", idle_ms: int = IDLE_MS) -> DataFrame:
    """Rows of a run once it is decided: kept when held ``hold`` rows, else blanked; NULL is a value.

    A run that is long enough goes out at once, so at most ``hold`` - 1 ids wait; the last, undecided ones go out when
    the key is idle.
    """
    def frame(key, ids, vals):
        return pd.DataFrame({by: pd.array([key] * len(ids), dtype="Int64"), tie: pd.array(ids, dtype="Int64"), "held": pd.Series(vals, dtype=object)})

    def step(state, rows):
        cur, n, pending = (None, 0, []) if state is None else (state[0], state[1], list(state[2]))
        ids, vals = [], []
        for i, v in zip(rows[tie], rows[value]):
            v = None if v != v else v
            if n and v != cur:
                ids += pending
                vals += [None] * len(pending)
                pending, n = [], 0
            cur, n = v, n + 1
            pending.append(int(i))
            if n >= hold:
                ids += pending
                vals += [cur] * len(pending)
                pending = []
        return (cur, n, pending), frame(rows[by].iloc[0], ids, vals)

    def finish(key, state):
        return frame(key, list(state[2]), [None] * len(state[2]))

    return _folded(df.select(by, time, *dict.fromkeys([*order, tie, value])), by, time, late, order, step, f"{by} long, {tie} long, held string", "cur string, n long, pending array<long>", finish, idle_ms)


def sessions(df: DataFrame, by: str, time: str, order: list[str], value: str, gap_ms: int, jump: float, late: str = "0 seconds") -> DataFrame:
    """Sessions of a key; a new one starts ``gap_ms`` or more after the last row, or when ``value`` rises by more than ``jump``.

    One row per closed session: key, segment (from 0), first and last time in microseconds, rows, and what closed
    it: ``reset``, ``gap``, or ``idle`` for the last one before the key leaves the state.
    """
    names = [by, "segment", "start_us", "last_us", "n", "closed_by"]
    types = {n: "Int64" for n in names[:-1]}

    def frame(rows):
        return pd.DataFrame(rows, columns=names).astype(types)

    def step(state, rows):
        segment, start, last, prev, n = state if state is not None else (0, None, None, None, 0)
        key, closed = rows[by].iloc[0], []
        for us, v in zip(rows["_us"].astype("int64"), rows[value]):
            v = None if v != v else v
            why = None
            if n and us - last >= gap_ms * 1000:
                why = "gap"
            elif n and v is not None and prev is not None and v - prev > jump:
                why = "reset"
            if why:
                closed.append((key, segment, start, last, n, why))
                segment, start, n = segment + 1, None, 0
            start = us if start is None else start
            last, prev, n = int(us), v, n + 1
            start = int(start)
        return (segment, start, last, prev, n), frame(closed)

    def finish(key, state):
        segment, start, last, _, n = state
        return frame([(key, segment, start, last, n, "idle")])

    d = df.withColumn("_us", F.unix_micros(time)).select(by, time, *dict.fromkeys(["_us", *order, value]))
    return _folded(d, by, time, late, ["_us", *order], step, f"{by} long, segment long, start_us long, last_us long, n long, closed_by string",
                   "segment long, start long, last long, prev double, n long", finish, gap_ms)


def clock_validate(df: DataFrame, by: str, time: str, frame: str, read: str, dt: float = 0.2, late: str = "0 seconds", idle_ms: int = IDLE_MS) -> DataFrame:
    def step(state, rows):
        last, out = (None if state is None else state[0]), []
        for r in rows[read]:
            good = r == r and V.clock_accepts(last, r, dt)
            out.append(r if good else None)
            last = r if good else last
        return (last,), rows[[by, frame]].assign(clock=pd.array(out, dtype="Float64"))

    return _folded(df.select(by, time, frame, read), by, time, late, [frame], step, f"{by} long, {frame} long, clock double", "last double", idle_ms=idle_ms)


def gate_track(df: DataFrame, by: str, time: str, frame: str, x: str, y: str, late: str = "0 seconds", idle_ms: int = IDLE_MS) -> DataFrame:
    def step(state, rows):
        st, xs, ys = state, [], []
        for a, b in zip(rows[x], rows[y]):
            st = V.ball_step(st, None if a != a else (a, b))
            xs.append(None if st is None else st[0])
            ys.append(None if st is None else st[1])
        return st, rows[[by, frame]].assign(ball_x=pd.array(xs, dtype="Float64"), ball_y=pd.array(ys, dtype="Float64"))

    return _folded(df.select(by, time, frame, x, y), by, time, late, [frame], step, f"{by} long, {frame} long, ball_x double, ball_y double",
                   "x double, y double, vx double, vy double, missed long", idle_ms=idle_ms)


def score_batches(df: DataFrame, model, out_path: str, checkpoint: str, predict):
    """Score arriving rows with a fitted model; returns the started query."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        # A replayed batch overwrites its own folder, so results are exactly once.
        predict(model, batch, "p").write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_to_table(df: DataFrame, key: list[str], out_path: str, checkpoint: str):
    """Each distinct key once, however late a copy of it arrives; returns the started query.

    What was given out before is read from the table itself, so nothing is dropped at a watermark and the state store holds
    nothing: a micro-batch and the table meet in one aggregate by key (NULL is a value).
    """
    stored = StructType([*df.select(*key).schema.fields, StructField("batch", LongType())])

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*key, F.lit(True).alias("_new"))
        if batch_id:
            # A replayed batch doesn't see its own folder and overwrites it.
            before = batch.sparkSession.read.schema(stored).parquet(out_path).where(F.col("batch") != batch_id)
            rows = rows.unionByName(before.select(*key, F.lit(False).alias("_new")))
        rows = rows.groupBy(*key).agg(F.min("_new").alias("_new")).where("_new")
        rows.select(*key).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, out_path: str, checkpoint: str) -> None:
    """Process everything available into parquet."""
    q = (df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
