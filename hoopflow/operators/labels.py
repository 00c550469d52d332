"""Labels: play-by-play possessions, shot moments, passes and drives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hoopflow import fixed as K
from hoopflow.functions import geometry as G
from hoopflow.operators import joins as J, possessions as P, sequence as Q, state as ST


def pbp_possessions(pbp: DataFrame, period_seconds: float = K.PERIOD_SECONDS, hot_rows: int | None = None) -> DataFrame:
    """Possessions of each (game, quarter), by running windows instead of a loop.

    The ball-holding team after an event is the value set by the last event that sets it:
    makes and turnovers clear it, misses set it, a free throw sets it only if it was clear,
    a rebound only if it was not. A change of team or a clearing event closes a possession.
    """
    e = pbp.where("game_clock IS NOT NULL")
    s = Q.seq(["game_id", "quarter"], [-F.col("game_clock"), "seq"])
    if hot_rows:
        e, s = Q.split_hot(e, s, hot_rows)
    typ, team = F.col("event_type"), F.col("team_id")
    clears, known = typ.isin(K.MADE, K.TURNOVER), team.isNotNull()
    sets = (typ == K.MISSED) & known
    d = Q.scan(e, s, index="_i")
    fixed_to = F.when(clears | sets, F.struct(F.when(sets, team).alias("v"), F.col("_i").alias("i")))
    d = Q.scan(d, s, before={"_base": fixed_to, "_ft": F.when((typ == K.FREE_THROW) & known, F.col("_i"))})
    held = F.col("_base.v").isNotNull() | F.coalesce(F.col("_ft") > F.coalesce(F.col("_base.i"), F.lit(0)), F.lit(False))
    d = d.withColumn("_held", held)
    takes = F.when(clears, F.struct(F.lit(None).cast("long").alias("v"))).when(
        sets | (known & (((typ == K.FREE_THROW) & ~F.col("_held")) | ((typ == K.REBOUND) & F.col("_held")))),
        F.struct(team.alias("v")))
    d = d.withColumn("_take", takes)
    d = Q.scan(d, s, before={"_state": "_take"}, total={"_sum": "points"}, lead={"_next": F.col("_i")})
    cur = F.col("_state.v")
    flip = F.coalesce(typ.isin(K.MADE, K.MISSED, K.TURNOVER, K.REBOUND) & (team != cur), F.lit(False))
    d = d.withColumns({"_flip": flip, "_cur": cur})
    closed = F.col("_flip") | clears
    base = F.when(clears, F.col("_sum")).when(F.col("_flip"), F.col("_sum") - F.col("points"))
    mark = F.when(closed, F.struct(F.col("game_clock").alias("t"), base.alias("p")))
    d = Q.scan(d.withColumn("_mark", mark), s, before={"_open": "_mark"})
    start, since = F.coalesce(F.col("_open.t"), F.lit(period_seconds)), F.coalesce(F.col("_open.p"), F.lit(0))
    row = lambda order, st, en, tm, pts: F.struct(
        order.cast("long").alias("poss_order"), st.cast("double").alias("start_clock"), en.cast("double").alias("end_clock"),
        tm.alias("offense_team_id"), pts.cast("double").alias("points"))
    here = F.when(closed, row(F.col("_i"), start, F.col("game_clock"), F.coalesce(F.col("_cur"), team),
                              F.col("_sum") - since - F.when(F.col("_flip"), F.col("points")).otherwise(0)))
    final_team = F.when(F.col("_take").isNotNull(), F.col("_take.v")).otherwise(F.col("_cur"))
    end = F.when(F.col("_next").isNull(), row(
        F.col("_i") + 1, F.coalesce(F.col("_mark.t"), start), F.lit(0.0), final_team,
        F.col("_sum") - F.coalesce(F.col("_mark.p"), since)))
    out = d.select("game_id", "quarter", F.explode_outer(F.array_compact(F.array(here, end))).alias("r"))
    return (out.where("r IS NOT NULL").select("game_id", "quarter", "r.*")
            .where("offense_team_id IS NOT NULL AND start_clock > end_clock"))


def shot_moments(shots: DataFrame, frames: DataFrame, window: float = 0.8) -> DataFrame:
    """Each shot with the frame, within +-0.8 s, where the ball is nearest the shooter.

    ``frames`` come from ``possessions.to_frames``; the frame rate bounds them per bucket.
    Equal distances go to the later clock value.
    """
    key = [c for c in shots.columns]
    f = frames.select("game_id", "quarter", F.col("game_clock").alias("frame_clock"), F.col("shot_clock").alias("frame_shot_clock"), "ball", "players")
    pairs = J.band_pairs(shots, f, ["game_id", "quarter"], "game_clock", "frame_clock", window)
    me = F.get(F.filter("players", lambda p: p["player_id"] == F.col("player_id")), F.lit(0))
    d = pairs.withColumn("shooter", me).where("shooter IS NOT NULL AND ball IS NOT NULL")
    dx, dy = F.col("shooter.x") - F.col("ball.x"), F.col("shooter.y") - F.col("ball.y")
    w = Window.partitionBy(*key).orderBy("ball_gap2", F.col("frame_clock").desc())
    return (d.withColumn("ball_gap2", dx * dx + dy * dy).withColumn("_rn", F.row_number().over(w))
            .where("_rn = 1").drop("_rn"))


def shot_label_features(matched: DataFrame) -> DataFrame:
    """Shot features at the labelled moment (label distance, unsigned angle)."""
    right = F.col("shooter.x") > K.HALF_X
    fx = lambda v: F.when(F.col("_right"), K.LENGTH - v).otherwise(v)
    fy = lambda v: F.when(F.col("_right"), K.WIDTH - v).otherwise(v)
    d = matched.withColumn("_right", right)
    d = d.withColumns({"_sx": fx(F.col("shooter.x")), "_sy": fy(F.col("shooter.y"))})
    foes = F.filter("players", lambda p: (p["team_id"] != F.col("team_id")) & (p["player_id"] != F.col("player_id")))
    d = d.withColumn("_n", F.array_min(F.transform(foes, lambda p: F.struct(
        G.dist(fx(p["x"]), fy(p["y"]), F.col("_sx"), F.col("_sy")).alias("d"), p["player_id"].alias("player_id"),
        fx(p["x"]).alias("x"), fy(p["y"]).alias("y")))))
    # Nobody seen: a far defender straight below the shooter.
    far = F.struct(F.lit(K.DEF_DIST).alias("d"), F.lit(None).cast("long").alias("player_id"),
                   F.col("_sx").alias("x"), (F.col("_sy") - K.DEF_DIST).alias("y"))
    d = d.withColumn("_n", F.coalesce("_n", far))
    tx, ty = K.RIM[0] - F.col("_sx"), K.RIM[1] - F.col("_sy")
    ex, ey = F.col("_n.x") - F.col("_sx"), F.col("_n.y") - F.col("_sy")
    cos = (tx * ex + ty * ey) / (F.sqrt(tx * tx + ty * ty) * F.sqrt(ex * ex + ey * ey) + 1e-9)
    return d.withColumns({
        "dist_to_rim": F.col("shot_distance").cast("double"),
        "angle_to_rim_deg": F.abs(G.polar("_sx", "_sy")[1]), "closest_defender_dist": F.col("_n.d"),
        "defender_angle_deg": F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos)))),
        "defender_pressure": G.pressure("_sx", "_sy", F.col("_n.x"), F.col("_n.y")),
        "shot_clock": F.coalesce("frame_shot_clock", F.lit(K.DEF_SHOT_CLOCK)),
        "is_three": F.col("is_three").cast("double"), "catch_and_shoot": F.lit(0.0), "player_shot_prior": F.lit(K.DEF_PRIOR)}
    ).drop("_right", "_sx", "_sy", "_n")


POSS = [*P.EVENT, "possession_id"]


def passes(frames: DataFrame) -> DataFrame:
    """Handler changes A -> B, placed at the passer's last frame; ``from_end`` is 1 for the last."""
    held = frames.where("handler_player_id IS NOT NULL").select(*POSS, "frame_idx", "handler_player_id")
    s = Q.seq(POSS, ["frame_idx"])
    d = Q.scan(held, s, lag={"_p": F.struct("handler_player_id", "frame_idx")})
    d = d.where(F.col("_p.handler_player_id") != F.col("handler_player_id"))
    w = Window.partitionBy(*POSS).orderBy(F.col("frame_idx").desc())
    return d.select(*POSS, F.col("_p.frame_idx").alias("frame_idx"), F.col("_p.handler_player_id").alias("passer_id"),
                    F.col("handler_player_id").alias("receiver_id"), F.row_number().over(w).alias("from_end"))


def drives(frames: DataFrame, drop: float = K.DRIVE_DROP, reach: float = K.DRIVE_SUCCESS) -> DataFrame:
    """Rim approaches of a handler by ``drop`` feet or more within 50 frames, not overlapping.

    Until someone else holds the ball, frames belong to their last handler, so only that
    player's distance per frame is needed. The greedy choice then only skips 50 frames
    ahead inside one hold, an array bounded by the frames of that hold.
    """
    s = Q.seq(POSS, ["frame_idx"])
    d = Q.scan(frames.select(*POSS, "frame_idx", "handler_player_id", "players"), s, ffill={"owner": "handler_player_id"})
    me = F.get(F.filter("players", lambda p: p["player_id"] == F.col("owner")), F.lit(0))
    d = d.where("owner IS NOT NULL").withColumn("_me", me).withColumns(
        {"_d": G.polar("_me.x", "_me.y")[0], "_y": F.col("_me.y")}).drop("players", "_me")
    d = Q.run_bounds(d, s, "owner", "_rs", "_re", "_i")
    w = Window.partitionBy(*POSS, "_rs").orderBy("frame_idx").rowsBetween(0, K.DRIVE_FRAMES - 1)
    d = d.withColumn("_min", F.min("_d").over(w))
    ok = F.col("handler_player_id").isNotNull() & (F.col("_d") - F.col("_min") >= drop)
    side = F.when(F.col("_y") > 29, "left").when(F.col("_y") < 21, "right").otherwise("middle")
    c = d.where(ok).select(*POSS, "_rs", F.struct(
        "frame_idx", F.col("owner").alias("driver_id"), side.alias("direction"),
        (F.col("_min") <= reach).cast("int").alias("success")).alias("c"))
    runs = c.groupBy(*POSS, "_rs").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    far = lambda acc, x: (F.size(acc) == 0) | (x["frame_idx"] >= F.element_at(acc, -1)["frame_idx"] + K.DRIVE_FRAMES)
    picked = F.aggregate("cs", F.slice("cs", 1, 0), lambda acc, x: F.when(far(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return ST.unnest(runs.select(*POSS, picked.alias("_k")), "_k", "d").select(*POSS, "d.*")


def label_possessions(frames: DataFrame, pbp: DataFrame, poss: DataFrame, min_frames: int = 15) -> DataFrame:
    """Tracked possessions matched to play-by-play: points, start clock and turnover flag.

    The upper-median clock is looked up; possessions whose offense disagrees drop out.
    """
    size = F.count(F.lit(1))
    mids = (frames.groupBy(*POSS).agg(size.alias("n"), F.max("offense_team_id").alias("offense_team_id"),
                                      F.min_by("quarter", "frame_idx").alias("quarter"),
                                      upper_median("game_clock").alias("mid_clock"))
            .where(F.col("n") >= min_frames))
    val = F.struct("start_clock", "end_clock", "offense_team_id", "points")
    m = J.in_interval(mids.withColumn("_e", -F.col("mid_clock")),
                      poss.withColumns({"_lo": -F.col("start_clock"), "_hi": -F.col("end_clock")}),
                      ["game_id", "quarter"], "_e", "_lo", "_hi", val, "real").drop("_e")
    m = m.where(F.col("real.offense_team_id") == F.col("offense_team_id")).select(
        *POSS, "quarter", "n", "mid_clock", "offense_team_id", "real.start_clock", "real.end_clock", "real.points")
    lost = pbp.where(F.col("event_type") == K.TURNOVER).select("game_id", "quarter", F.col("team_id").alias("offense_team_id"), "game_clock")
    t = J.exists_between(m, lost, ["game_id", "quarter", "offense_team_id"], "end_clock", "start_clock", "game_clock", "_lost")
    return t.withColumn("is_turnover", (F.col("points") == 0) & F.col("_lost")).drop("_lost")


def upper_median(value: str) -> Column:
    """``sorted[len // 2]`` of a group. Values and counts aggregate partially as a histogram
    inside ``percentile``; the discrete form never interpolates."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")
