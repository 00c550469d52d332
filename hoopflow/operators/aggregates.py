"""Evaluation aggregates. All reduce partially before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hoopflow import fixed as K
from hoopflow.operators import actions as A, sequence as Q


def eb_rate(df: DataFrame, player: str, made: str, k: float = K.PRIOR_STRENGTH) -> DataFrame:
    """Make rate per player shrunk toward the league rate; one row per player."""
    per = df.groupBy(player).agg(F.sum(made).alias("made_n"), F.count(F.lit(1)).alias("n"))
    league = per.agg((F.sum("made_n") / F.sum("n")).alias("league"))
    # One row, so this broadcast is bounded by construction.
    return (per.join(F.broadcast(league))
            .withColumn("prior", (F.col("made_n") + k * F.col("league")) / (F.col("n") + k)))


def with_prior(df: DataFrame, priors: DataFrame, player: str, default: float | None = None) -> DataFrame:
    """Attach priors; an unseen player gets the league rate."""
    league = priors.agg(F.max("league").alias("_l"))
    p = priors.select(player, F.col("prior").alias("player_shot_prior"))
    d = df.drop("player_shot_prior").join(p, player, "left").join(F.broadcast(league))
    fill = F.lit(default) if default is not None else F.coalesce("_l", F.lit(K.DEF_PRIOR))
    return d.withColumn("player_shot_prior", F.coalesce("player_shot_prior", fill)).drop("_l")


def brier(df: DataFrame, p: str, y: str, by: list[str] = (), base: Column | None = None) -> DataFrame:
    """Mean squared error of probabilities and of the constant base rate.

    Without ``base`` the rate comes from the same rows, where the error of the constant
    reduces to the variance, so one pass is enough.
    """
    const = F.var_pop(y) if base is None else F.avg(F.pow(base - F.col(y), 2))
    return df.groupBy(*by).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), const.alias("brier_base"), F.count(F.lit(1)).alias("n"))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Mean prediction and outcome per equal-width bin; empty bins do not appear."""
    b = F.greatest(F.lit(0), F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    return df.groupBy(b.alias("bin")).agg(F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"), F.count(F.lit(1)).alias("n"))


def value_metrics(df: DataFrame, v: str, y: str, base: Column | None = None, by: list[str] = ()) -> DataFrame:
    const = F.var_pop(y) if base is None else F.avg(F.pow(base - F.col(y), 2))
    return df.groupBy(*by).agg(F.avg((F.col(v) - F.col(y)) ** 2).alias("mse"), const.alias("mse_baseline"),
                               F.corr(v, y).alias("corr"), F.avg(y).alias("ppp"))


POLICIES = ["model", "always_shoot", "pass_most_open", "random"]


def regret(scored: DataFrame, state: list[str], policies: list[str] = POLICIES, seed: int = 0) -> DataFrame:
    """Right / defensible / wrong rates and mean regret per policy."""
    picks = A.baseline_picks(scored, state, seed=seed)
    long = picks.select(F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), (F.col("best_true") - F.col(p)).alias("r")) for p in policies])).alias("x"))
    r = F.col("x.r")
    rate = lambda c: F.avg(c.cast("double"))
    return long.groupBy(F.col("x.policy").alias("policy")).agg(
        F.count(F.lit(1)).alias("n"), rate(r <= K.RIGHT_EPS).alias("right_rate"), rate(r <= K.DEFENSIBLE).alias("right_or_defensible"),
        rate(r >= K.WRONG).alias("wrong_rate"), F.avg(r).alias("mean_regret"))


def coverage(recs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Pause coverage of a recommendations table; ``actions`` is NULL or empty when gated.

    Shares are percent of all pauses (coverage) or of shown ones; the player median is over
    a handful of counts, so its histogram stays tiny in any group.
    """
    shown = F.coalesce(F.size("actions") > 0, F.lit(False))
    only = lambda c: F.when(shown, F.col(c))
    pct = lambda c: 100 * F.count_if(shown & F.col(c).isNotNull()) / F.greatest(F.count_if(shown), F.lit(1))
    return recs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pause_points"), F.count_if(shown).alias("recommended"),
        (100 * F.count_if(shown) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("coverage_share"),
        F.min(only("video_time")).alias("first_s"), F.max(only("video_time")).alias("last_s"),
        F.median(only("n_players")).alias("players_median"), F.min(only("n_players")).alias("players_min"),
        F.max(only("n_players")).alias("players_max"), pct("ball_px").alias("ball_share"),
        pct("handler_id").alias("handler_share"), pct("rim_px").alias("rim_share"))


def top_action_mix(recs: DataFrame) -> DataFrame:
    first = F.get("actions", F.lit(0))["action"]
    return recs.where(F.size("actions") > 0).groupBy(first.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def domain_gap(recovered: DataFrame, truth: DataFrame, key: list[str], by: list[str] = ()) -> DataFrame:
    """Position error, misses and identity errors of recovered against true positions.

    ``recovered`` has key columns (with the true player id), x, y and claimed_id; ``truth``
    has key columns, x, y. Percentiles are exact and merge partially per group.
    """
    r = recovered.select(*key, F.col("x").alias("rx"), F.col("y").alias("ry"), "claimed_id")
    j = truth.join(r, key, "left")
    err = F.sqrt((F.col("rx") - F.col("x")) ** 2 + (F.col("ry") - F.col("y")) ** 2)
    d = j.withColumn("_e", err)
    claimed = F.col("claimed_id").isNotNull()
    return d.groupBy(*by).agg(
        F.median("_e").alias("err_median"), F.avg("_e").alias("err_mean"), F.percentile("_e", F.lit(0.9)).alias("err_p90"),
        (1 - F.count("_e") / F.count(F.lit(1))).alias("miss_rate"),
        F.coalesce(1 - F.count_if(claimed & (F.col("claimed_id") == F.col("player_id"))) / F.when(F.count_if(claimed) > 0, F.count_if(claimed)), F.lit(1.0)).alias("id_error"))


def share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def quantiles(df: DataFrame, by: list[str], value: str, named: dict[str, float], hot_rows: int = Q.HOT_ROWS) -> DataFrame:
    """Exact interpolated quantiles by rank, for groups of any size.

    Equal values are counted first, so ties are one row; running counts over the distinct values give
    their ranks. A group with many values is cut into blocks, and only the rows around each quantile
    survive.
    """
    keys = list(by) or ["_all"]
    d = df.where(F.col(value).isNotNull())
    d = d.select(*(by or [F.lit(0).alias("_all")]), F.col(value).alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_m"))
    d, s = Q.split_hot(d, Q.seq(keys, ["_v"]), hot_rows)
    d = Q.unsplit(Q.scan(d, s, total={"_hi": "_m"}))
    d = d.join(d.groupBy(*keys).agg(F.max("_hi").alias("_n")), keys)
    out = []
    for name, q in named.items():
        pos = (F.col("_n") - 1) * q
        lo, frac = F.floor(pos), pos - F.floor(pos)

        def at(k: Column) -> Column:
            rank = F.least(k, F.col("_n") - 1)
            return F.max(F.when((F.col("_hi") > rank) & (F.col("_hi") - F.col("_m") <= rank), F.col("_v")))

        a, b = at(lo), at(lo + 1)
        out.append((a + (b - a) * F.max(frac)).alias(name))
    return d.groupBy(*keys).agg(*out).drop("_all")
