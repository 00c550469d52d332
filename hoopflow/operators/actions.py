"""Candidate actions of a state, their hypothetical next states, scores and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hoopflow import fixed as K
from hoopflow.functions import geometry as G
from hoopflow.functions.geometry import rnd
from hoopflow.operators import state as ST


def shoot_legal(dist_to_rim, shot_clock) -> Column:
    return (dist_to_rim <= K.SHOT_MAX) | F.coalesce(shot_clock < K.HEAVE_CLOCK, F.lit(False))


def drive_legal(y, dist_to_rim, direction: str) -> Column:
    return {"left": y < K.WIDTH - K.SIDELINE, "right": y > K.SIDELINE}.get(direction, dist_to_rim > K.RIM_ZONE)


def _candidate(action: str, h: Column, **fields) -> Column:
    """One candidate struct; fields not given are NULL."""
    types = {"target": "long", "direction": "string", "zone": "string", "dist_to_rim": "double",
             "target_zone": "string", "target_open": "double", "screener_dist": "double"}
    get = lambda n: fields.get(n, F.lit(None)).cast(types[n]).alias(n)
    return F.struct(F.lit(action).alias("action"), h["player_id"].alias("actor"), *[get(n) for n in types])


def enumerate_actions(states: DataFrame) -> DataFrame:
    """Legal candidates in one pass: SHOOT, passes, drives, screens, RESET.

    Numbered after pruning (``ord`` from 1, id ``a<ord>``); states without a handler drop out.
    """
    d = ST.decided(states)
    h = F.col("handler")
    mates = F.filter("players", lambda p: (p["side"] == "offense") & (p["player_id"] != F.col("handler.player_id")))
    # The guard is the nearest defender by stated positions, found once per state.
    d = d.withColumns({"_mates": mates, "guard_id": ST.nearest(ST.of_side("players", "defense"), h["x"], h["y"])["player_id"]})
    gap = lambda t: G.dist(t["x"], t["y"], h["x"], h["y"])
    branches = F.concat(
        F.array(F.when(shoot_legal(h["dist_to_rim"], F.col("shot_clock")),
                       _candidate("SHOOT", h, zone=h["zone"], dist_to_rim=h["dist_to_rim"]))),
        F.transform("_mates", lambda t: _candidate("PASS_TO", h, target=t["player_id"], target_zone=t["zone"],
                                                   target_open=rnd(1 - t["defender_pressure"], 3))),
        F.array(*[F.when(drive_legal(h["y"], h["dist_to_rim"], k), _candidate("DRIVE", h, direction=F.lit(k)))
                  for k in ("left", "middle", "right")]),
        F.transform("_mates", lambda t: F.when(gap(t) <= K.SCREEN_MAX, _candidate(
            "SCREEN_WITH", h, target=t["player_id"], screener_dist=rnd(gap(t), 1)))),
        F.array(_candidate("RESET", h)))
    d = d.withColumn("_c", F.array_compact(branches)).drop("_mates")
    d = ST.unnest(d.withColumn("n_candidates", F.size("_c").cast("long")), "_c", "_cand", "_pos")
    return (d.select(*states.columns, "n_candidates", "guard_id", (F.col("_pos") + 1).cast("long").alias("ord"), "_cand.*")
            .withColumn("action_id", F.concat(F.lit("a"), F.col("ord").cast("string"))))


def next_states(cands: DataFrame) -> DataFrame:
    """State after each non-terminal candidate, rebuilt from the moved players.

    PASS moves the ball and the handler tag; the others move the handler, and the nearest
    defender follows (fully, or by 70 % after a drive).
    """
    d = cands.where("action <> 'SHOOT'")
    h, dirn = F.col("handler"), F.col("direction")
    dx, dy = K.RIM[0] - h["x"], K.RIM[1] - h["y"]
    d = d.withColumn("_r", F.sqrt(dx * dx + dy * dy))
    ok = F.col("_r") > 1e-6
    d = d.withColumns({"_ux": F.when(ok, dx / F.col("_r")).otherwise(0.0), "_uy": F.when(ok, dy / F.col("_r")).otherwise(0.0),
                       "_step": F.least(F.lit(K.DRIVE_STEP), F.greatest(F.lit(0.0), F.col("_r") - 2.0)),
                       "_lat": F.when(dirn == "left", K.DRIVE_LATERAL).when(dirn == "right", -K.DRIVE_LATERAL).otherwise(0.0),
                       "_target": F.get(F.filter("players", lambda p: p["player_id"] == F.col("target")), F.lit(0))})
    act = F.col("action")
    d = d.withColumns({
        "_nx": F.when(act == "DRIVE", h["x"] + F.col("_ux") * F.col("_step") - F.col("_uy") * F.col("_lat"))
                .when(act == "SCREEN_WITH", h["x"]).when(act == "RESET", K.TOP_OF_KEY[0]),
        "_ny": F.when(act == "DRIVE", h["y"] + F.col("_uy") * F.col("_step") + F.col("_ux") * F.col("_lat"))
                .when(act == "SCREEN_WITH", h["y"] + F.when(h["y"] < K.MID_Y, 2.0).otherwise(-2.0)).when(act == "RESET", K.TOP_OF_KEY[1])})
    share = F.when(act == "DRIVE", K.GUARD_RECOVERY).otherwise(1.0)
    moves = F.col("_nx").isNotNull()

    def moved(p):
        is_h = moves & (p["player_id"] == h["player_id"])
        is_g = moves & (p["player_id"] == F.col("guard_id"))
        drive = is_h & (act == "DRIVE")
        pos = lambda a, n: (F.when(is_h, F.col(n)).when(is_g, p[a] + (F.col(n) - h[a]) * share).otherwise(p[a]))
        return F.struct(p["player_id"].alias("player_id"), p["team_id"].alias("team_id"), p["side"].alias("side"),
                        pos("x", "_nx").alias("x"), pos("y", "_ny").alias("y"),
                        F.when(drive, F.col("_ux") * K.DRIVE_SPEED).otherwise(p["vx"]).alias("vx"),
                        F.when(drive, F.col("_uy") * K.DRIVE_SPEED).otherwise(p["vy"]).alias("vy"))

    passed = (act == "PASS_TO") & F.col("_target").isNotNull()
    ball = F.struct(
        F.when(passed, F.col("_target.x")).when(moves, F.col("_nx")).otherwise(F.col("ball.x")).alias("x"),
        F.when(passed, F.col("_target.y")).when(moves, F.col("_ny")).otherwise(F.col("ball.y")).alias("y"),
        F.col("ball.z").alias("z"), F.col("ball.vx").alias("vx"), F.col("ball.vy").alias("vy"))
    d = d.withColumns({"handler_player_id": F.when(passed, F.col("target")).otherwise(h["player_id"]),
                       "ball_in_flight": F.col("ball.in_flight"), "ball": ball, "players": F.transform("players", moved)})
    d = d.drop("_r", "_ux", "_uy", "_step", "_lat", "_target", "guard_id", "_nx", "_ny", "handler", "context")
    return ST.build_for_handler(d)


def expected_points(action, p, v_next, points) -> Column:
    """Q of a candidate from its success probability and the value of what follows."""
    a, p, v = F.col(action), F.col(p), F.col(v_next)
    return (F.when(a == "SHOOT", p * F.col(points))
            .when(a.isin("PASS_TO", "DRIVE"), p * v + (1 - p) * K.TURNOVER_VALUE)
            .otherwise(v))


def leaf_value(action, value, shot_q) -> Column:
    """Continuation value; a pass or drive may also cash in the fresh look."""
    return F.when(F.col(action).isin("PASS_TO", "DRIVE"), F.greatest(F.col(value), F.col(shot_q))).otherwise(F.col(value))


def rank_actions(scored: DataFrame, state: list[str], q: str = "q", ord_col: str = "ord", out: str = "rank") -> DataFrame:
    w = Window.partitionBy(*state).orderBy(F.col(q).desc(), F.col(ord_col))
    return scored.withColumn(out, F.row_number().over(w))


def top_k(scored: DataFrame, state: list[str], k: int, q: str = "q", ord_col: str = "ord") -> DataFrame:
    """Best k per state; rows beyond k are dropped before the exchange."""
    return rank_actions(scored, state, q, ord_col).where(F.col("rank") <= k)


def scores_by_id(scored: DataFrame, state: list[str]) -> DataFrame:
    """Map of action id to score per state; a state has at most a candidate list of rows."""
    pairs = F.array_sort(F.collect_list(F.struct("action_id", "q")))
    return scored.groupBy(*state).agg(F.map_from_entries(pairs).alias("scores"))


def why_not(scored: DataFrame, state: list[str], q: str = "q", ord_col: str = "ord") -> DataFrame:
    """Each candidate against the best of its state."""
    w = Window.partitionBy(*state)
    gap = rnd(F.max(q).over(w) - F.col(q), 3)
    d = scored.withColumns({"top_epv": rnd(F.max(q).over(w), 3), "epv": rnd(q, 3), "epv_gap": gap})
    return d.withColumn("verdict", F.when(F.col("epv_gap") <= 1e-6, "recommended").otherwise(
        F.concat(F.format_string("%.2f", "epv_gap"), F.lit(" EPV worse than the top option"))))


def baseline_picks(scored: DataFrame, state: list[str], q: str = "q", open_col: str = "open", seed: int = 0) -> DataFrame:
    """Per state, the true value of each policy's pick and of the best action, in one pass.

    The random policy takes the candidate with the smallest digest of seed, state and place in the list: uniform over the
    candidates, and the same whatever the order or partition of the rows.
    """
    first = F.min_by("true_v", "ord")
    best_of = lambda cond, key: F.max_by(F.when(cond, F.col("true_v")), F.when(cond, key))
    is_pass = F.col("action") == "PASS_TO"
    coin = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*state, "ord")]).cast("binary"))
    return (scored.groupBy(*state).agg(
        F.count(F.lit(1)).alias("n"), F.max("true_v").alias("best_true"),
        F.max_by("true_v", F.struct(F.col(q), -F.col("ord"))).alias("model"),
        F.coalesce(F.min_by("true_v", F.when(F.col("action") == "SHOOT", F.col("ord"))), first).alias("always_shoot"),
        F.coalesce(best_of(is_pass, F.struct(F.col(open_col), -F.col("ord"))), first).alias("pass_most_open"),
        F.min_by("true_v", F.struct(coin, F.col("ord"))).alias("random")).where("n >= 2"))
