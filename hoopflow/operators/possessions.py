"""Tracking moments to possession frames.

Layout: long rows (one per entity) are nested once into frames with a ``players`` array
(at most the roster), hash-partitioned by event. Every later step is a window inside that
partitioning or an array expression inside a frame, so the whole pipeline reads the rows
once and exchanges them once.

An event is one play, a few hundred frames; pass ``hot_rows`` when that cannot be trusted:
event facts then come from partially aggregated joins and the sequence steps are cut into
blocks (see ``sequence.split_hot``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hoopflow import fixed as K
from hoopflow.functions import geometry as G
from hoopflow.operators import sequence as Q
from hoopflow.operators.state import unnest

EVENT = ["game_id", "event_id"]
MOMENT_ORDER = ["event_pos", "moment_pos", "entity_pos"]


def dedup_moments(moments: DataFrame, order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """First occurrence per (game, quarter, clock, player) in document order.

    A given number of ``parts`` holds, so that a task's rows don't grow with the table. Without it
    ``row_number() = 1`` lets Spark drop later copies before the exchange (window group limit).
    Rows are dealt by the whole second: Spark normalises a double key, and would deal them again.
    """
    by = ["game_id", "quarter", "player_id", "_second"]
    d = moments.withColumn("_second", F.floor("game_clock"))
    w = Window.partitionBy(*by, "game_clock").orderBy(*[F.col(c) for c in order or MOMENT_ORDER])
    d = d.repartition(parts, *by) if parts else d
    return d.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_second")


def by_event(moments: DataFrame, parts: int | None) -> DataFrame:
    """Deal rows by event. A given number of ``parts`` holds, so that a task's rows don't grow with the table; else Spark chooses."""
    return moments.repartition(parts, *EVENT) if parts else moments.repartition(*EVENT)


def with_team_means(moments: DataFrame, parts: int | None = None) -> DataFrame:
    """Add each row's team mean x of the event (mean over players of their mean)."""
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    wp = Window.partitionBy(*EVENT, "player_id").orderBy("game_clock")
    d = by_event(moments, parts).withColumns({"_m": F.avg("x").over(wp.rowsBetween(*whole)), "_r": F.row_number().over(wp)})
    per_team = F.avg(F.when(F.col("_r") == 1, F.col("_m"))).over(Window.partitionBy(*EVENT, "team_id"))
    return d.withColumn("team_mean_x", per_team).drop("_m", "_r")


def with_offense(frames: DataFrame, s: Q.Seq) -> DataFrame:
    """Offense and mirror flag of each frame's event, by windows on the frame partitioning.

    Same rule as ``offense_of_events``, but without reading the moments again and without
    a join; needs ``team_mean_x`` in the players.
    """
    event = s.window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = nearest_to_ball(F.col("players"), F.col("ball"))
    d = frames.withColumn("_near", near).withColumn("_vote", F.when(F.col("_near.d") < K.VOTE_DIST, F.col("_near.team_id")))
    votes = Window.partitionBy(*EVENT, "_vote")
    tally = F.struct(F.count(F.lit(1)).over(votes).alias("n"), F.max("game_clock").over(votes).alias("seen"), (-F.col("_vote")).alias("t"))
    d = d.withColumn("_tally", F.when(F.col("_vote").isNotNull(), tally))
    lowest = F.array_min(F.transform("players", lambda p: p["team_id"]))
    d = d.withColumn("offense_team_id", F.coalesce(-F.max("_tally").over(event)["t"], F.min(lowest).over(event)))
    mean = F.array_max(F.transform("players", lambda p: F.when(p["team_id"] == F.col("offense_team_id"), p["team_mean_x"])))
    return d.withColumn("flip", F.max(mean).over(event) > K.HALF_X).drop("_near", "_vote", "_tally")


def to_frames(moments: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per (event, moment) with the ball and an ordered array of players."""
    player = F.struct("player_id", "team_id", "x", "y", *[c for c in ("team_mean_x",) if c in moments.columns])
    ball = F.struct("x", "y", "z")
    return (by_event(moments, parts)
            .groupBy(*EVENT, "quarter", "game_clock")
            .agg(F.max("shot_clock").alias("shot_clock"),
                 F.first(F.when(F.col("is_ball"), ball), True).alias("ball"),
                 F.array_sort(F.collect_list(F.when(~F.col("is_ball"), player))).alias("players")))


def frame_seq(slice_too: bool = False) -> Q.Seq:
    """Time order inside an event: the clock counts down."""
    by = [*EVENT, "slice"] if slice_too else EVENT
    return Q.seq(by, [-F.col("game_clock"), "quarter"])


def nearest_to_ball(players: Column, ball: Column) -> Column:
    """The player nearest the ball; equal distances go to the lowest id."""
    return F.array_min(F.transform(players, lambda p: F.struct(
        G.dist(p["x"], p["y"], ball["x"], ball["y"]).alias("d"), p["player_id"].alias("player_id"),
        p["team_id"].alias("team_id"))))


def offense_of_events(frames: DataFrame, moments: DataFrame) -> DataFrame:
    """Per event: the team nearest the ball on most frames, and whether to mirror it.

    Both parts aggregate partially before their shuffle. Ties go to the team seen first;
    an event without votes takes its lowest team id.
    """
    votes = (frames.withColumn("_near", nearest_to_ball(F.col("players"), F.col("ball")))
             .withColumn("_team", F.when(F.col("_near.d") < K.VOTE_DIST, F.col("_near.team_id")))
             .where(F.col("_team").isNotNull())
             .groupBy(*EVENT, F.col("_team").alias("team_id"))
             .agg(F.count(F.lit(1)).alias("votes"), F.max("game_clock").alias("seen")))
    means = (moments.where(~F.col("is_ball")).groupBy(*EVENT, "team_id", "player_id")
             .agg(F.avg("x").alias("mx")).groupBy(*EVENT, "team_id").agg(F.avg("mx").alias("mean_x")))
    both = means.join(votes, [*EVENT, "team_id"], "left")
    best = F.max_by(F.struct("team_id", "mean_x"),
                    F.struct(F.coalesce("votes", F.lit(0)), F.coalesce("seen", F.lit(-1.0)), -F.col("team_id")))
    return (both.groupBy(*EVENT).agg(best.alias("b"))
            .select(*EVENT, F.col("b.team_id").alias("offense_team_id"), (F.col("b.mean_x") > K.HALF_X).alias("flip")))


def mirror(frames: DataFrame) -> DataFrame:
    """Mirror flipped events so that every attack goes left."""
    fx = lambda v: F.when(F.col("flip"), K.LENGTH - v).otherwise(v)
    fy = lambda v: F.when(F.col("flip"), K.WIDTH - v).otherwise(v)
    return frames.withColumns({
        "players": F.transform("players", lambda p: F.struct(
            p["player_id"].alias("player_id"), p["team_id"].alias("team_id"),
            fx(p["x"]).alias("x"), fy(p["y"]).alias("y"))),
        "ball": F.struct(fx(F.col("ball.x")).alias("x"), fy(F.col("ball.y")).alias("y"), F.col("ball.z").alias("z"))})


def _rate(cur: Column, prev: Column, dt: Column, first: Column) -> Column:
    return F.when(first, F.lit(0.0)).otherwise((cur - prev) / dt)


def with_motion(frames: DataFrame, s: Q.Seq) -> DataFrame:
    """Fill the shot clock, add velocities (NULL when unseen a frame ago) and segments."""
    d = Q.scan(frames, s,
               lag={"_prev": F.struct("ball", "players", "game_clock")},
               ffill={"_shot": "shot_clock"}, before={"_shot_before": "shot_clock"}, index="_i")
    step = F.greatest(F.col("_prev.game_clock") - F.col("game_clock"), F.lit(0.0))
    d = d.withColumns({
        "_dt": F.when(step > K.MIN_DT, step).otherwise(K.FRAME_DT), "_new": F.col("_prev").isNull(),
        "_cut": F.coalesce((F.col("_shot") - F.col("_shot_before") > K.RESET_JUMP).cast("long"), F.lit(0))})
    old = lambda p: F.get(F.filter(F.col("_prev.players"), lambda q: q["player_id"] == p["player_id"]), F.lit(0))
    paired = F.transform("players", lambda p: F.struct(
        p["player_id"].alias("player_id"), p["team_id"].alias("team_id"),
        F.when(p["team_id"] == F.col("offense_team_id"), "offense").otherwise("defense").alias("side"),
        p["x"].alias("x"), p["y"].alias("y"), old(p).alias("old")))
    d = d.withColumn("players", paired)
    vel = lambda p, a: F.when(F.col("_new"), F.lit(0.0)).otherwise((p[a] - p["old"][a]) / F.col("_dt"))
    d = d.withColumns({
        "players": F.transform("players", lambda p: F.struct(
            p["player_id"].alias("player_id"), p["team_id"].alias("team_id"), p["side"].alias("side"),
            p["x"].alias("x"), p["y"].alias("y"), vel(p, "x").alias("vx"), vel(p, "y").alias("vy"))),
        "ball": F.struct(F.col("ball.x").alias("x"), F.col("ball.y").alias("y"), F.col("ball.z").alias("z"),
                         _rate(F.col("ball.x"), F.col("_prev.ball.x"), F.col("_dt"), F.col("_new")).alias("vx"),
                         _rate(F.col("ball.y"), F.col("_prev.ball.y"), F.col("_dt"), F.col("_new")).alias("vy")),
        "shot_clock": F.col("_shot")})
    d = Q.scan(d, s, total={"slice": "_cut"})
    return d.drop("_prev", "_shot", "_shot_before", "_dt", "_new", "_cut")


def raw_handler() -> Column:
    """Offensive player near the ball and moving with it; NULL motion passes the gate."""
    ball = F.col("ball")

    def near(p):
        gap = F.coalesce(G.dist(p["vx"], p["vy"], ball["vx"], ball["vy"]) < K.HANDLER_VEL_DIFF, F.lit(True))
        d = G.dist(p["x"], p["y"], ball["x"], ball["y"])
        return F.when((p["side"] == "offense") & (d < K.HANDLER_DIST) & gap,
                      F.struct(d.alias("d"), p["player_id"].alias("player_id")))
    best = F.array_min(F.transform("players", near))["player_id"]
    return F.when(ball["z"] < K.HANDLER_BALL_Z, best)


def frame_key() -> Column:
    return F.concat(F.col("game_id"), F.lit("_e"), F.col("event_id").cast("string"), F.lit("_p"),
                    F.col("slice").cast("string"))


def possession_frames(moments: DataFrame, hot_rows: int | None = None, parts: int | None = None) -> DataFrame:
    """Frames of every possession, mirrored, with velocities, slices and ball handler.

    ``parts`` is the number of tasks that events are dealt to, see ``by_event``.
    """
    s = frame_seq()
    if hot_rows:
        raw = to_frames(moments, parts)
        frames = mirror(raw.join(offense_of_events(raw, moments), EVENT))
        frames, s = Q.split_hot(frames, s, hot_rows)
    else:
        frames = mirror(with_offense(to_frames(with_team_means(moments, parts), parts), s))
    d = with_motion(frames, s)
    run = Window.partitionBy(*EVENT)
    per_slice = Window.partitionBy(*EVENT, "slice")
    if hot_rows:
        sizes = d.groupBy(*EVENT, "slice").agg(
            F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_i0"), F.max("ball.z").alias("_z"))
        whole = d.groupBy(*EVENT).agg(F.count(F.lit(1)).alias("_all"))
        d = d.join(sizes, [*EVENT, "slice"]).join(whole, EVENT)
    else:
        d = d.withColumns({"_n": F.count(F.lit(1)).over(per_slice), "_i0": F.min("_i").over(per_slice),
                           "_z": F.max("ball.z").over(per_slice), "_all": F.count(F.lit(1)).over(run)})
    d = (d.where((F.col("_n") >= K.HANDLER_HOLD) & (F.col("_all") >= K.HANDLER_HOLD))
         .withColumn("raw_handler_id", raw_handler()))
    held = Q.min_hold(d, Q.Seq(s.by + ("slice",), s.order, s.blocks), "raw_handler_id", K.HANDLER_HOLD, "handler_player_id")
    return Q.unsplit(held.withColumns({
        "possession_id": frame_key(), "frame_idx": F.col("_i") - F.col("_i0"),
        "ball_in_flight": F.col("handler_player_id").isNull(),
        "terminal_event": F.when(F.col("_z") >= K.SHOT_Z, "shot_attempt").otherwise("unknown")})
        .drop("_n", "_i0", "_all", "_i", "_z"))


def player_rows(frames: DataFrame) -> DataFrame:
    """Frames back to one row per player."""
    return unnest(frames, "players", "_p").select(*[c for c in frames.columns if c != "players"], "_p.*")
