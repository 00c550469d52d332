"""Feature columns for shots, passes, drives and state values. Row-local expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hoopflow import fixed as K
from hoopflow.functions import geometry as G, scalars as S
from hoopflow.operators import state as ST
from hoopflow.operators.ranking import global_rank


def shot(shooter: Column, shot_clock: Column, prior: Column | None = None, training: bool = False) -> dict[str, Column]:
    """Shot features of a player struct. At scoring time the angle is signed and a handler
    always counts as catch-and-shoot; ``training`` uses the label-time rules instead."""
    nd = shooter["nearest_defender"]
    angle = shooter["angle_to_rim_deg"]
    return {
        "dist_to_rim": shooter["dist_to_rim"], "angle_to_rim_deg": F.abs(angle) if training else angle,
        "closest_defender_dist": F.coalesce(nd["dist"], F.lit(K.DEF_DIST)),
        "defender_angle_deg": F.coalesce(nd["angle_deg"], F.lit(K.DEF_ANGLE)),
        "defender_pressure": shooter["defender_pressure"],
        "shot_clock": F.coalesce(shot_clock, F.lit(K.DEF_SHOT_CLOCK)),
        "is_three": shooter["zone"].contains("three").cast("double"),
        "catch_and_shoot": (F.lit(0.0) if training else
                            F.coalesce((shooter["seconds_since_touch"] <= K.CATCH_SECONDS).cast("double"), F.lit(0.0))),
        "player_shot_prior": prior if prior is not None else F.lit(K.DEF_PRIOR)}


def lane_count(defense: Column, a: Column, b: Column) -> Column:
    return F.size(F.filter(defense, lambda d: G.point_segment(d["x"], d["y"], a["x"], a["y"], b["x"], b["y"]) < K.LANE_WIDTH))


def passing(defense: Column, passer: Column, receiver: Column, near: Column | None = None) -> dict[str, Column]:
    """Pass features; ``near`` is the distance of the receiver's nearest defender where the record lacks it."""
    return {
        "pass_distance": G.dist(receiver["x"], receiver["y"], passer["x"], passer["y"]),
        "defenders_in_lane": lane_count(defense, passer, receiver).cast("double"),
        "receiver_separation": F.coalesce(receiver["nearest_defender"]["dist"] if near is None else near, F.lit(K.DEF_DIST)),
        "passer_facing_receiver": G.facing(passer["orientation_deg"], receiver["x"] - passer["x"], receiver["y"] - passer["y"]),
        "receiver_pressure": receiver["defender_pressure"], "receiver_dist_to_rim": receiver["dist_to_rim"]}


def help_count(defense: Column, driver: Column, direction: Column) -> Column:
    """Defenders nearer the rim on the drive's side. "left" is the larger-y side here."""
    dy = lambda d: d["y"] - K.RIM[1]
    on_side = lambda d: (F.when(direction == "left", dy(d) > 0).when(direction == "right", dy(d) < 0)
                         .otherwise(F.abs(dy(d)) < K.HELP_MIDDLE))
    return F.size(F.filter(defense, lambda d: (d["dist_to_rim"] < driver["dist_to_rim"]) & on_side(d)))


def driving(defense: Column, driver: Column, direction: Column) -> dict[str, Column]:
    guard = F.get(F.filter(defense, lambda d: d["player_id"] == driver["nearest_defender"]["player_id"]), F.lit(0))
    return {
        "help_defenders_on_side": help_count(defense, driver, direction).cast("double"),
        "primary_defender_lateral": F.coalesce(F.abs(guard["y"] - driver["y"]), F.lit(0.0)),
        "primary_defender_dist": F.coalesce(driver["nearest_defender"]["dist"], F.lit(K.DEF_DIST)),
        "driver_speed": driver["speed"], "driver_dist_to_rim": driver["dist_to_rim"],
        "direction_sign": F.when(direction == "left", 1.0).when(direction == "right", -1.0).otherwise(0.0)}


def columns(feats: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in feats.items()]


def entities(states: DataFrame) -> DataFrame:
    """Normalised entities (all players, then the ball) and three globals per state."""
    rate = lambda v: S.finite_or(v, 0.0) / 10.0
    seen = F.filter("players", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    ent = lambda pid, x, y, vx, vy, off, de, ball, has: F.struct(
        pid.alias("player_id"), ((x - K.RIM[0]) / K.HALF_X).alias("x"), ((y - K.RIM[1]) / K.MID_Y).alias("y"),
        rate(vx).alias("vx"), rate(vy).alias("vy"), off.cast("double").alias("off"), de.cast("double").alias("def"),
        ball.cast("double").alias("ball"), has.cast("double").alias("has_ball"))
    people = F.transform(seen, lambda p: ent(
        p["player_id"], p["x"], p["y"], p["vx"], p["vy"], p["side"] == "offense", p["side"] == "defense",
        F.lit(False), p["has_ball"]))
    b = F.col("ball")
    ball = F.when(b["x"].isNotNull() & b["y"].isNotNull(), ent(
        F.lit(K.BALL_ID).cast("long"), b["x"], b["y"], b["vx"], b["vy"], F.lit(False), F.lit(False), F.lit(True), F.lit(False)))
    return states.withColumns({
        "entities": F.array_compact(F.concat(people, F.array(ball))),
        "g_clock": F.coalesce(F.col("shot_clock"), F.lit(K.DEF_SHOT_CLOCK)) / 24.0,
        "g_spacing": F.coalesce(F.col("context.spacing_area_sqft"), F.lit(0.0)) / 500.0,
        "g_players": F.col("context.n_players_observed") / 10.0})


POOLED = ["x", "y", "vx", "vy", "off", "def", "ball", "has_ball"]


def mean_pool(df: DataFrame, ents: str = "entities") -> DataFrame:
    """Order-free pooling of each state's entities to one mean per dimension and side."""
    mean = lambda a, f: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, e: s + e[f]) / F.size(a)).otherwise(0.0)
    out = {f"pool_{f}": mean(F.col(ents), f) for f in POOLED}
    marked = lambda flag: F.filter(ents, lambda e: e[flag] > 0.5)
    for side in ("off", "def", "ball", "has_ball"):
        part = marked(side)
        out |= {f"{side}_{f}": mean(part, f) for f in ("x", "y", "vx", "vy")}
    return df.withColumns(out)


def vocab(ids: DataFrame, col: str = "player_id") -> DataFrame:
    """Dense index of distinct ids from 1; id -1 and unknown ids are 0."""
    d = ids.select(F.col(col).alias("player_id")).distinct().where(F.col("player_id") != K.BALL_ID)
    return global_rank(d, ["player_id"], "idx")[0]


def encode(df: DataFrame, table: DataFrame, col: str = "player_id") -> DataFrame:
    t = table.withColumnRenamed("player_id", col)
    return df.join(t, col, "left").withColumn("idx", F.coalesce("idx", F.lit(0)))


def step_index(start_clock, clock) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.col(start_clock) - F.col(clock)) / K.STEP_SECONDS)


def step_weight(step) -> Column:
    return F.when(F.col(step) == 0, K.FIRST_STEP_WEIGHT).otherwise(1.0)
