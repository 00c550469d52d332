"""Block-wise scans must equal plain windows, whatever the skew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoopflow.operators import aggregates as AG, joins as J, sequence as Q


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = [(0 if i % 3 == 0 else i % 17, i, rnd.choice([None, 1.0, 2.0, 5.0, 9.0]), rnd.choice(["a", "b", None])) for i in range(900)]
    return spark.createDataFrame(rows, "k long, t long, v double, c string").repartition(5)


S = Q.seq(["k"], ["t"])


def both(df, fn):
    plain = fn(df, S)
    d, s = Q.split_hot(df, S, hot_rows=20)
    split = Q.unsplit(fn(d, s))
    assert s.split and d.agg(F.max(Q.BLOCKS)).first()[0] > 5
    key = lambda r: tuple(str(v) for v in r)
    cols = sorted(plain.columns)
    return [sorted(map(tuple, x.select(*cols).collect()), key=key) for x in (plain, split)]


@pytest.mark.parametrize("fn", [
    lambda d, s: Q.scan(d, s, lag={"a": "v"}, lead={"b": "v"}, index="i"),
    lambda d, s: Q.scan(d, s, ffill={"a": "v"}, before={"b": "v"}, bfill={"e": "v"}, after={"f": "v"}),
    lambda d, s: Q.scan(d, s, total={"a": "v"}, peak={"b": "v"}),
    lambda d, s: Q.min_hold(d, s, "c", 2, "h"),
    lambda d, s: Q.sessionize(d, s, "v", 3.0, "seg"),
    lambda d, s: Q.linear_fill(d, s, ["v"], "t", ["f"]),
    lambda d, s: Q.until_first(d, s, F.coalesce(F.col("v") == 9.0, F.lit(False))),
    lambda d, s: Q.every_nth(d, s, 4),
    lambda d, s: Q.rolling_mode(d, s, "c", 2, "m"),
])
def test_split_equals_plain(skewed, fn):
    a, b = both(skewed, fn)
    assert a == b


def test_split_equals_plain_without_broadcast(skewed, monkeypatch):
    """Many blocks: bounds and carries go by salted and sorted joins."""
    monkeypatch.setattr(Q, "BROADCAST_BLOCKS", 0)
    d, s = Q.split_hot(skewed, S, hot_rows=20, broadcast_blocks=0)
    got = Q.unsplit(Q.min_hold(d, s, "c", 2, "h")).select("k", "t", "h")
    assert sorted(got.collect()) == sorted(Q.min_hold(skewed, S, "c", 2, "h").select("k", "t", "h").collect())


def test_no_hot_key_leaves_plain_windows(skewed):
    d, s = Q.split_hot(skewed, S, hot_rows=10_000)
    assert d is skewed and s is S
    assert "Join" not in Q.min_hold(d, s, "c", 2, "h")._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_even_with_ties_and_outliers(spark):
    """99 % of a key tie on the first order column and one row is far away; null and NaN order values, a null key."""
    rows = [(None if i % 2 else 1, 5.0 if i % 100 else float(i), i, float(i % 7)) for i in range(12_000)]
    rows += [(1, 1e12, 50_000, 1.0), (1, None, 50_001, 2.0), (1, float("nan"), 50_002, 3.0), (2, 1.0, 50_003, 4.0)]
    df = spark.createDataFrame(rows, "k long, a double, t long, v double").repartition(7)
    s0 = Q.seq(["k"], ["a", "t"])
    d, s = Q.split_hot(df, s0, hot_rows=500)
    sizes = {}
    for r in d.groupBy("k", Q.BLOCK).count().collect():
        sizes.setdefault(r["k"], []).append(r["count"])
    assert len(sizes[2]) == 1 and min(len(sizes[1]), len(sizes[None])) > 10
    for k in (1, None):
        assert max(sizes[k]) < 2 * sum(sizes[k]) / len(sizes[k])
    both_ = [sorted(Q.unsplit(Q.sessionize(x, y, "v", 2.0, "seg")).select("t", "seg").collect()) for x, y in ((df, s0), (d, s))]
    assert both_[0] == both_[1]


def test_a_chain_reads_its_input_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(0, 4000, 1, 3).selectExpr("id % 2 AS k", "id AS t", "id % 5 AS v").mapInArrow(count, "k long, t long, v long")
    d, s = Q.split_hot(df, S, hot_rows=100)
    d = Q.min_hold(d, s, "v", 2, "a")
    d = Q.sessionize(d, s, "v", 2.0, "b")
    d = Q.linear_fill(d, s, ["v"], "t", ["c"])
    assert Q.unsplit(d).count() == 4000 and seen.value <= 2 * 4000


def test_rolling_across_parts(skewed):
    d, s = Q.split_hot(skewed, S, hot_rows=20)
    cut = Q.rolling(d, s, 3, 2, {"n": lambda w: F.count("v").over(w)}, part_rows=7)
    plain = Q.rolling(skewed, S, 3, 2, {"n": lambda w: F.count("v").over(w)})
    assert sorted(Q.unsplit(cut).select("k", "t", "n").collect()) == sorted(plain.select("k", "t", "n").collect())


def test_quantiles_by_rank(skewed):
    out = {r["k"]: r for r in AG.quantiles(skewed, ["k"], "v", {"m": 0.5, "p": 0.9}, hot_rows=15).collect()}
    data = skewed.where("v IS NOT NULL").toPandas().groupby("k")["v"]
    ties = AG.quantiles(skewed.selectExpr("k", "IF(t = 3, 1000D, 4D) AS v"), ["k"], "v", {"m": 0.5, "top": 1.0}, hot_rows=15).collect()
    assert {(r["m"], r["top"]) for r in ties} == {(4.0, 4.0), (4.0, 1000.0)}
    for k, v in data:
        assert out[k]["m"] == pytest.approx(np.quantile(v, 0.5)) and out[k]["p"] == pytest.approx(np.quantile(v, 0.9))


@pytest.mark.parametrize("hot", [None, 25])
def test_nearest_time_brute_force(spark, skewed, hot):
    left, right = skewed.where("t % 2 = 0").select("k", "t"), skewed.where("t % 5 = 1").select("k", F.col("t").alias("rt"))
    got = {(r["k"], r["t"]): (r["m"]["v"] if r["m"] else None) for r in
           J.nearest_time(left, right, ["k"], "t", "rt", F.col("rt"), 9.0, "m", hot_rows=hot).collect()}
    rs = right.collect()
    for r in left.collect():
        c = sorted((abs(x["rt"] - r["t"]), x["rt"]) for x in rs if x["k"] == r["k"] and abs(x["rt"] - r["t"]) <= 9)
        assert got[(r["k"], r["t"])] == (c[0][1] if c else None)


def test_carried_state_spans_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).selectExpr("id % 3 AS k", "id AS t")
        step = lambda n, b: ((n or 0) + len(b), b.assign(n=range((n or 0) + 1, (n or 0) + len(b) + 1)))
        out = Q.carried_state(df, ["k"], ["t"], step, "k long, t long, n long")
        assert out.where("n <> t div 3 + 1").count() == 0 and out.count() == 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_carried_state_keeps_a_null_group_together(spark):
    from hoopflow.operators import sequence as Q
    d = spark.createDataFrame([(None, 1), (None, 2), (None, 3), (5, 1), (5, 2)], "k long, t long")

    def step(state, batch):
        n = (state or 0) + len(batch)
        return n, batch.assign(n=range(n - len(batch) + 1, n + 1))

    got = Q.carried_state(d, ["k"], ["t"], step, "k long, t long, n long").collect()
    assert all(r.n == r.t for r in got)


@pytest.mark.parametrize("name", ["clock", "ball"])
def test_carried_blocks_equal_one_pass(spark, name):
    """A hot clip runs as blocks from guessed states; rows and values are those of one pass. A null clip and gaps included."""
    from hoopflow.operators import video as V
    rnd = random.Random(11)
    rows = [(None if i % 5 == 0 else 1, i, rnd.choice([None, 24.0 - (i % 120) * 0.2, 99.0, 14.0]), None if rnd.random() < 0.3 else rnd.uniform(0, 900), rnd.uniform(0, 500)) for i in range(2500)]
    rows += [(2, i, 20.0 - i, 1.0, 2.0) for i in range(10)]
    d = spark.createDataFrame(rows, "c long, f long, r double, x double, y double").repartition(4)
    run = {"clock": lambda n: V.validate_clock(d, ["c"], "f", "r", hot_rows=n), "ball": lambda n: V.track_ball(d, ["c"], "f", "x", "y", hot_rows=n)}[name]
    hot, plain = run(250), run(10**9)
    assert hot.columns == plain.columns
    assert sorted(map(str, hot.collect())) == sorted(map(str, plain.collect()))


def test_carried_blocks_with_a_state_that_never_forgets(spark):
    d = spark.range(600).selectExpr("0L AS k", "id AS t").repartition(3)
    step = lambda n, b: ((n or 0) + len(b), b.assign(n=range((n or 0) + 1, (n or 0) + len(b) + 1)))
    out, s = Q.carried_blocks(d, ["k"], ["t"], step, "k long, t long, n long", hot_rows=120)
    assert s.split and out.where("n <> t + 1").count() == 0 and out.count() == 600
