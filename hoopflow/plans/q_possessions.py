"""Possession pipeline queries; each step of the oracle is a named sub-query."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoopflow.functions import geometry as G
from hoopflow.functions.geometry import r4
from hoopflow.operators import possessions as P, sequence as Q
from hoopflow.operators.state import unnest
from hoopflow.plans.q_geometry import zone_sql
from hoopflow.plans.registry import R, cte, query
from hoopflow.session import cut_lineage

# Frames as the oracle sees them: long rows, windows per event / entity.
cte("o_votes", """SELECT event_id, team_id, count(*) AS votes, max(game_clock) AS seen FROM (
  SELECT p.event_id, p.game_clock, p.team_id, p.player_id, sqrt((p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y)) AS d,
    row_number() OVER (PARTITION BY p.event_id, p.game_clock ORDER BY sqrt((p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y)), p.player_id) AS rn
  FROM fx_tracking_c p JOIN fx_tracking_c b ON p.event_id = b.event_id AND p.game_clock = b.game_clock AND b.is_ball
  WHERE NOT p.is_ball) WHERE rn = 1 AND d < 6 GROUP BY event_id, team_id""")
cte("o_means", """SELECT event_id, team_id, avg(mx) AS mean_x FROM (SELECT event_id, team_id, player_id, avg(x) AS mx
  FROM fx_tracking_c WHERE NOT is_ball GROUP BY ALL) GROUP BY ALL""")
cte("o_offense", """SELECT event_id, team_id AS offense_team_id, mean_x > 47 AS flip FROM (
  SELECT m.event_id, m.team_id, mean_x, row_number() OVER (PARTITION BY m.event_id ORDER BY coalesce(votes, 0) DESC, coalesce(seen, -1) DESC, m.team_id) AS rn
  FROM o_means m LEFT JOIN o_votes v ON m.event_id = v.event_id AND m.team_id = v.team_id) WHERE rn = 1""")
cte("o_moments", """SELECT event_id, any_value(game_id) AS game_id, quarter, game_clock, max(shot_clock) AS shot_raw,
  row_number() OVER (PARTITION BY event_id ORDER BY game_clock DESC) AS i FROM fx_tracking_c GROUP BY event_id, quarter, game_clock""")
cte("o_filled", """SELECT *, last_value(shot_raw IGNORE NULLS) OVER (PARTITION BY event_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS shot_clock FROM o_moments""")
cte("o_sliced", """SELECT *, CAST(sum(cut) OVER (PARTITION BY event_id ORDER BY i) AS BIGINT) AS slice, count(*) OVER (PARTITION BY event_id) AS n_event
  FROM (SELECT *, lag(game_clock) OVER w AS prev_clock, CASE WHEN shot_clock - lag(shot_clock) OVER w > 3 THEN 1 ELSE 0 END AS cut
        FROM o_filled WINDOW w AS (PARTITION BY event_id ORDER BY i))""")
cte("o_pos", """SELECT t.event_id, m.i, t.game_clock, t.player_id, t.team_id, t.is_ball, t.z, o.offense_team_id,
  CASE WHEN o.flip THEN 94 - t.x ELSE t.x END AS x, CASE WHEN o.flip THEN 50 - t.y ELSE t.y END AS y
  FROM fx_tracking_c t JOIN o_moments m ON t.event_id = m.event_id AND t.game_clock = m.game_clock JOIN o_offense o ON t.event_id = o.event_id""")
cte("o_vel", """SELECT c.*, CASE WHEN c.i = 1 THEN 0e0 ELSE (c.x - p.x)/dt END AS vx, CASE WHEN c.i = 1 THEN 0e0 ELSE (c.y - p.y)/dt END AS vy
  FROM (SELECT o.*, CASE WHEN s.prev_clock - s.game_clock > 1e-4 THEN s.prev_clock - s.game_clock ELSE 0.04e0 END AS dt
        FROM o_pos o JOIN o_sliced s ON o.event_id = s.event_id AND o.i = s.i) c
  LEFT JOIN o_pos p ON c.event_id = p.event_id AND c.player_id = p.player_id AND p.i = c.i - 1""")
cte("o_raw", """SELECT event_id, i, player_id AS raw FROM (
  SELECT p.event_id, p.i, p.player_id, row_number() OVER (PARTITION BY p.event_id, p.i
     ORDER BY sqrt((p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y)), p.player_id) AS rn
  FROM o_vel p JOIN o_vel b ON p.event_id = b.event_id AND p.i = b.i AND b.is_ball
  WHERE NOT p.is_ball AND p.team_id = p.offense_team_id AND b.z < 9
    AND sqrt((p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y)) < 4
    AND coalesce(sqrt((p.vx-b.vx)*(p.vx-b.vx)+(p.vy-b.vy)*(p.vy-b.vy)) < 6, true)) WHERE rn = 1""")
cte("o_runs", """SELECT *, sum(chg) OVER (PARTITION BY event_id, slice ORDER BY i) AS run FROM (
  SELECT s.*, r.raw, CASE WHEN lag(r.raw) OVER w IS NOT DISTINCT FROM r.raw AND lag(s.i) OVER w IS NOT NULL THEN 0 ELSE 1 END AS chg
  FROM o_sliced s LEFT JOIN o_raw r ON s.event_id = r.event_id AND s.i = r.i WINDOW w AS (PARTITION BY s.event_id, s.slice ORDER BY s.i))""")
cte("o_frames", """SELECT f.*, b.x AS ball_x, b.y AS ball_y, b.z AS ball_z, b.vx AS ball_vx, b.vy AS ball_vy, b.offense_team_id,
  CASE WHEN max(b.z) OVER (PARTITION BY f.event_id, f.slice) >= 10 THEN 'shot_attempt' ELSE 'unknown' END AS terminal_event
 FROM (SELECT *, game_id || '_e' || CAST(event_id AS VARCHAR) || '_p' || CAST(slice AS VARCHAR) AS possession_id,
   row_number() OVER (PARTITION BY event_id, slice ORDER BY i) - 1 AS frame_idx,
   CASE WHEN count(*) OVER (PARTITION BY event_id, slice, run) >= 5 THEN raw END AS handler_player_id,
   count(*) OVER (PARTITION BY event_id, slice) AS n_slice FROM o_runs) f
 JOIN o_vel b ON f.event_id = b.event_id AND f.i = b.i AND b.is_ball WHERE n_slice >= 5 AND n_event >= 5""")
cte("o_players", """SELECT f.possession_id, f.frame_idx, f.handler_player_id, f.game_clock, f.quarter, f.shot_clock, v.player_id, v.team_id,
  CASE WHEN v.team_id = v.offense_team_id THEN 'offense' ELSE 'defense' END AS side, v.x, v.y, v.vx, v.vy
 FROM o_frames f JOIN o_vel v ON f.event_id = v.event_id AND f.i = v.i AND NOT v.is_ball""")


def frames(src, name="fx_tracking_c"):
    return P.possession_frames(src(name), parts=src.tasks)


FRAME_COLS = "possession_id, frame_idx, quarter, game_clock, shot_clock, handler_player_id"


@query("win_possession_frames", f"""SELECT {FRAME_COLS}, handler_player_id IS NULL AS ball_in_flight, offense_team_id,
  {R('ball_x')} AS ball_x, {R('ball_y')} AS ball_y, {R('ball_z')} AS ball_z, {R('ball_vx')} AS ball_vx, {R('ball_vy')} AS ball_vy, terminal_event FROM o_frames""")
def _(src):
    return frames(src).select(*FRAME_COLS.split(", "), "ball_in_flight", "offense_team_id",
                              *[r4(f"ball.{a}").alias(f"ball_{a}") for a in ("x", "y", "z", "vx", "vy")], "terminal_event")


@query("who_holds_where", f"""SELECT handler_player_id, {zone_sql('p.x', 'p.y')} AS zone, count(*) AS frames
FROM o_players p WHERE player_id = handler_player_id GROUP BY ALL""")
def who_holds_where(src):
    p = P.player_rows(frames(src)).where("player_id = handler_player_id")
    return (p.select("handler_player_id", G.zone("x", "y").alias("zone"))
            .groupBy("handler_player_id", "zone").agg(F.count(F.lit(1)).alias("frames")))


@query("sink_frame_table", f"""SELECT possession_id, frame_idx, player_id, team_id, side, {R('x')} AS x, {R('y')} AS y, {R('vx')} AS vx, {R('vy')} AS vy FROM o_players""")
def _(src):
    from hoopflow.plans.staging import fresh_path
    from hoopflow.sources import sinks
    path = fresh_path(src.spark, "frames")
    t = sinks.frame_table(frames(src))
    sinks.write_by_game(t, path, ["possession_id", "frame_idx"])
    # The first half of the games comes again: its partitions are replaced, the others stay.
    back = sinks.read_by_game(t, path)
    half = back.where(F.col("game_id") <= back.agg(F.percentile_approx(F.col("game_id").cast("long"), 0.5)).first()[0])
    sinks.write_by_game(cut_lineage(half), path, ["possession_id", "frame_idx"])
    back = sinks.read_by_game(t, path)
    return (unnest(back, "players", "p")
            .select("possession_id", "frame_idx", "p.player_id", "p.team_id", "p.side",
                    *[r4(f"p.{a}").alias(a) for a in ("x", "y", "vx", "vy")]))


@query("join_offense_vote", "SELECT event_id, offense_team_id, flip FROM o_offense")
def _(src):
    m = src("fx_tracking_c")
    return P.offense_of_events(P.to_frames(m, src.tasks), m).select("event_id", "offense_team_id", "flip")


@query("agg_mean_of_means", f"SELECT event_id, team_id, {R('mean_x')} AS mean_x FROM o_means")
def _(src):
    return (src("fx_tracking_c").where("NOT is_ball").groupBy("event_id", "team_id", "player_id").agg(F.avg("x").alias("mx"))
            .groupBy("event_id", "team_id").agg(r4(F.avg("mx")).alias("mean_x")))


@query("join_handler", "SELECT f.possession_id, f.frame_idx, f.raw AS raw_handler_id FROM o_frames f")
def _(src):
    return frames(src).select("possession_id", "frame_idx", "raw_handler_id")


@query("agg_terminal_event", "SELECT DISTINCT possession_id, terminal_event FROM o_frames")
def _(src):
    b = frames(src).groupBy("possession_id").agg(F.max("ball.z").alias("z"))
    return b.select("possession_id", F.when(F.col("z") >= 10, "shot_attempt").otherwise("unknown").alias("terminal_event"))


@query("flt_min_length", "SELECT possession_id, count(*) AS n FROM o_frames GROUP BY possession_id HAVING count(*) >= 15")
def _(src):
    return frames(src).groupBy("possession_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 15")


_DEDUP = """SELECT event_id, quarter, game_clock, player_id, x, y FROM (SELECT *, row_number() OVER (
  PARTITION BY game_id, quarter, game_clock, player_id ORDER BY event_id, moment_pos, entity_pos) AS rn FROM fx_tracking_b) WHERE rn = 1"""


def canonical(src):
    return (P.dedup_moments(src("fx_tracking_b"), ["event_id", "moment_pos", "entity_pos"], src.tasks)
            .select("event_id", "quarter", "game_clock", "player_id", "x", "y"))


@query("set_dedup_moments", _DEDUP)
def _(src):
    return canonical(src)


@query("ord_canonical", f"""SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY quarter, game_clock DESC, player_id) AS pos FROM ({_DEDUP})""")
def _(src):
    s = Q.seq(["event_id"], ["quarter", -F.col("game_clock"), "player_id"])
    return Q.scan(canonical(src).repartition(src.tasks, "event_id"), s, index="pos")
