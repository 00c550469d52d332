"""Nearest-time, interval and band joins without pair explosion.

As-of and interval lookups are one ordered pass over the union of both sides: every left
row picks up the last (and next) right row. Work is linear in the rows, a key with many
rows on both sides never forms pairs, and ``hot_rows`` cuts a heavy key into blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hoopflow.operators import sequence as Q


def around(left: DataFrame, right: DataFrame, by: list[str], left_t: str, right_t: str,
           payload: dict[str, Column], right_tie: list[str] = (), hot_rows: int | None = None) -> DataFrame:
    """Left rows plus, per payload name, structs ``prev_<name>`` and ``next_<name>``.

    Each payload expression is evaluated on the right side; NULL rows are skipped, so a
    payload may be limited to rows that satisfy a condition. ``prev`` includes equal times.
    """
    lcols = [c for c in left.columns if c not in by]
    rcols = list(payload)
    ties = [F.col(c) for c in right_tie]
    lrow = left.select(*by, F.col(left_t).cast("double").alias("_t"), F.lit(1).alias("_side"),
                       F.struct(*lcols).alias("_left"))
    rrow = right.select(*by, F.col(right_t).cast("double").alias("_t"), F.lit(0).alias("_side"),
                        F.struct(*(ties or [F.lit(0)])).alias("_tie"),
                        F.struct(*[e.alias(n) for n, e in payload.items()]).alias("_right"))
    u = lrow.unionByName(rrow, allowMissingColumns=True)
    s = Q.seq(by, ["_t", "_side", "_tie"])
    if hot_rows:
        u, s = Q.split_hot(u, s, hot_rows)
    has = {n: F.when(F.col(f"_right.{n}").isNotNull(), F.struct(F.col("_t").alias("t"), F.col(f"_right.{n}").alias("v"))) for n in rcols}
    d = Q.scan(u, s, ffill={f"prev_{n}": e for n, e in has.items()}, bfill={f"next_{n}": e for n, e in has.items()})
    d = Q.unsplit(d).where("_side = 1")
    return d.select(*by, "_left.*", *[f"{p}_{n}" for n in rcols for p in ("prev", "next")])


def nearest_of(t: str, name: str, tol: float) -> Column:
    """The closer of prev / next within ``tol``; equal gaps go to the earlier one."""
    p, n, c = F.col(f"prev_{name}"), F.col(f"next_{name}"), F.col(t).cast("double")
    gp, gn = c - p["t"], n["t"] - c
    pick = F.when(p.isNotNull() & (n.isNull() | (gp <= gn)), p).otherwise(n)
    return F.when(F.abs(pick["t"] - c) <= tol, pick)


def nearest_time(left, right, by, left_t, right_t, value: Column, tol: float, out: str,
                 right_tie: list[str] = (), hot_rows: int | None = None) -> DataFrame:
    d = around(left, right, by, left_t, right_t, {"m": value}, right_tie, hot_rows)
    return d.withColumn(out, nearest_of(left_t, "m", tol)).drop("prev_m", "next_m")


def in_interval(points: DataFrame, spans: DataFrame, by: list[str], at: str, lo: str, hi: str,
                value: Column, out: str, hot_rows: int | None = None) -> DataFrame:
    """The first of ordered, non-overlapping intervals [lo, hi] that contains a point.

    Ends are inclusive, so a point on a shared edge belongs to the earlier interval. The
    span ends are looked up in reversed time, which makes "prev" the earliest end >= point.
    """
    neg = points.withColumn("_at", -F.col(at))
    rev = spans.withColumn("_end", -F.col(hi))
    d = around(neg, rev, by, "_at", "_end", {"m": F.struct(F.col(lo).alias("lo"), value.alias("v"))}, [lo], hot_rows)
    m = F.col("prev_m.v")
    return d.withColumn(out, F.when(m["lo"] <= F.col(at), m["v"])).drop("prev_m", "next_m", "_at")


def exists_between(spans: DataFrame, events: DataFrame, by: list[str], lo: str, hi: str, at: str,
                   out: str, hot_rows: int | None = None) -> DataFrame:
    """Does any event fall in [lo, hi]? Only the last event at or before ``hi`` matters."""
    d = around(spans, events, by, hi, at, {"m": F.lit(True)}, (), hot_rows)
    return d.withColumn(out, F.coalesce(F.col("prev_m.t") >= F.col(lo), F.lit(False))).drop("prev_m", "next_m")


def band_pairs(left: DataFrame, right: DataFrame, by: list[str], left_t: str, right_t: str, width: float) -> DataFrame:
    """Pairs with |left_t - right_t| <= width, for a right side of bounded density.

    Time buckets join the equi keys, so a group spreads over as many tasks as it has
    buckets; the caller guarantees few right rows per bucket (e.g. a fixed frame rate).
    """
    lo, hi = F.floor((F.col(left_t) - width) / width), F.floor((F.col(left_t) + width) / width)
    a = left.withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    b = right.withColumn("_bucket", F.floor(F.col(right_t) / width))
    gap = F.round(F.abs(F.col(left_t) - F.col(right_t)), 6)
    return a.join(b, [*by, "_bucket"]).where(gap <= width).drop("_bucket")


def ordered_vote(df: DataFrame, by: list[str], value: str, order: Column, out: str, weight: Column | None = None) -> DataFrame:
    """Most common non-null value per group; a tie goes to the value seen first.

    Two partial aggregations, so a heavy group is pre-reduced before each shuffle.
    """
    n = F.sum(weight) if weight is not None else F.count(F.lit(1))
    c = (df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("_n"), F.min(order).alias("_first")))
    w = Window.partitionBy(*by).orderBy(F.col("_n").desc(), F.col("_first"), F.col(value))
    return (c.withColumn("_rk", F.row_number().over(w)).where("_rk = 1")
            .select(*by, F.col(value).alias(out), F.col("_n").alias(f"{out}_n")))
