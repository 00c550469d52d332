"""Keyed streaming operators against their batch forms: out-of-order and late rows, restarts, idle keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hoopflow.operators import sequence as Q, video as V
from hoopflow.plans.q_streaming import drained
from hoopflow.plans.staging import fresh_path
from hoopflow.session import ship
from hoopflow.streaming import operators as ST

HOUR = 3_600_000
BASE = 10**15  # rows at time zero would be behind the first watermark
SCHEMA = "k long, id long, us long, v double, c string, part int, ts timestamp"


def table(spark, rows):
    return spark.createDataFrame([(*r, dt.datetime.fromtimestamp(r[2] / 1e6, dt.timezone.utc) if r[2] is not None else None) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows(spark):
    """Two parts; inside a part rows come in any order within an hour. Key 9 is seen only in the first part."""
    ship(spark)
    rnd = random.Random(4)
    out = []
    for i in range(240):
        k = 9 if i < 100 and i % 10 == 0 else i % 3
        out.append((k, i, BASE + i * 600_000_000 + rnd.randrange(2), rnd.choice([None, 1.0, 5.0, 40.0, 90.0]), rnd.choice(["a", "b", None]), int(i >= 120)))
    return out


END = lambda: {"ts": F.timestamp_seconds(F.lit(4_000_000_000))}
LONG = 10**12


def run(spark, rows, operator, beat=True):
    d = table(spark, random.Random(1).sample(rows, len(rows))).repartition(3)
    return drained(d, "part = 1", "test", operator, END() if beat else None)


def by_id(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


S = Q.seq(["k"], ["us", "id"])


def test_ffill_diff_equals_batch(spark, rows):
    got = by_id(run(spark, rows, lambda s: ST.ffill_diff(s, "k", "ts", ["us", "id"], "id", "v", idle_ms=LONG)), "filled", "diff")
    d = Q.scan(table(spark, rows), S, ffill={"f": "v"}, lag={"p": "v"}).withColumn("d", F.col("v") - F.col("p"))
    assert got == by_id(d, "f", "d")


def test_min_hold_flushes_its_last_run(spark, rows):
    got = by_id(run(spark, rows, lambda s: ST.min_hold(s, "k", "ts", ["us", "id"], "id", "c", 3, idle_ms=LONG)), "held")
    assert len(got) == len(rows) and got == by_id(Q.min_hold(table(spark, rows), S, "c", 3, "held"), "held")


def test_sessions_equal_batch_segments(spark, rows):
    """Closed by the reset rule alone, segments are those of ``sessionize``, across restarts."""
    op = lambda s: ST.sessions(s, "k", "ts", ["id"], "v", LONG, 30.0)
    got = {(r.k, r.segment): (r.start_us, r.last_us, r.n) for r in run(spark, rows, op).collect()}
    d = Q.sessionize(table(spark, rows), S, "v", 30.0, "seg").groupBy("k", "seg").agg(F.min("us").alias("a"), F.max("us").alias("b"), F.count("*").alias("n"))
    assert got == {(r.k, r.seg): (r.a, r.b, r.n) for r in d.collect()}


def test_sessions_close_by_gap_reset_and_idle(spark):
    m = 60_000_000
    rows = [(1, 0, 0, 1.0, None, 0), (1, 1, m, 2.0, None, 0), (1, 2, 2 * m, 90.0, None, 0), (1, 3, 40 * m, 1.0, None, 0), (2, 4, 41 * m, 1.0, None, 0)]
    rows = [(k, i, us + BASE, *r) for k, i, us, *r in rows]
    got = sorted((r.k, (r.start_us - BASE) // m, (r.last_us - BASE) // m, r.n, r.closed_by) for r in run(spark, rows, lambda s: ST.sessions(s, "k", "ts", ["id"], "v", 30 * 60_000, 30.0)).collect())
    assert got == [(1, 0, 1, 2, "reset"), (1, 2, 2, 1, "gap"), (1, 40, 40, 1, "idle"), (2, 41, 41, 1, "idle")]


def test_clock_and_ball_equal_batch(spark):
    ship(spark)
    rnd = random.Random(2)
    rows = [(k, i, BASE + i * 200_000, rnd.choice([None, 24.0 - i * 0.2, 99.0, 14.0]), None, int(i >= 30)) for k in (1, 2) for i in range(60)]
    d = table(spark, rows)
    got = {(r.k, r.id): r.clock for r in run(spark, rows, lambda s: ST.clock_validate(s, "k", "ts", "id", "v")).collect()}
    def clock(last, batch):
        out = []
        for r in batch["v"]:
            good = r is not None and r == r and V.clock_accepts(last, r, 0.2)
            out.append(r if good else None)
            last = r if good else last
        return last, batch[["k", "id"]].assign(clock=out)

    want = Q.carried_state(d.select("k", "id", "v"), ["k"], ["id"], clock, "k long, id long, clock double")
    assert got == {(r.k, r.id): r.clock for r in want.collect()}
    xy = lambda s: s.withColumn("x", F.col("v") * 10).withColumn("y", F.col("v") - 3)
    got = {(r.k, r.id): (r.ball_x, r.ball_y) for r in run(spark, rows, lambda s: ST.gate_track(xy(s), "k", "ts", "id", "x", "y")).collect()}
    want = {(r.k, r.id): (r.ball_x, r.ball_y) for r in V.track_ball(xy(d), ["k"], "id", "x", "y").collect()}
    assert {k: v for k, v in got.items() if v[0] is not None} == {k: v for k, v in want.items() if got[k][0] is not None}
    assert len(got) == len(want)


def test_late_rows_are_dropped_and_idle_keys_leave(spark):
    """A row behind the watermark is not folded; after the idle time a key's state is gone and it starts anew."""
    ship(spark)
    first = [(1, 0, HOUR * 1000, 1.0, None, 0), (1, 1, 2 * HOUR * 1000, 2.0, None, 0)]
    late = [(1, 2, 90 * 60_000_000, 50.0, None, 0), (2, 3, 20 * HOUR * 1000, 7.0, None, 0)]
    back = [(1, 4, 21 * HOUR * 1000, None, None, 0)]
    path, out, ck = (fresh_path(spark, n) for n in ("late", "late-out", "late-ck"))
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "true")
    sizes = []
    for i, part in enumerate((first, late, back, [(None, None, 4_000_000_000_000_000, None, None, 0)])):
        table(spark, part).coalesce(1).write.mode("append").parquet(path)
        s = ST.ffill_diff(spark.readStream.schema(SCHEMA).parquet(path), "k", "ts", ["us", "id"], "id", "v", idle_ms=3 * HOUR)
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
        sizes.append(sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"]))
    got = {r.id: (r.filled, r.diff) for r in spark.read.parquet(out).collect()}
    assert got == {0: (1.0, None), 1: (2.0, 1.0), 3: (7.0, None), 4: (None, None)}
    assert sizes[-1] == 0 < sizes[0]
