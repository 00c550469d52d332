"""Feature and action queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoopflow import fixed as K
from hoopflow.functions import geometry as G
from hoopflow.functions.geometry import r4
from hoopflow.operators import actions as A, features as FT, futures as FU, state as ST
from hoopflow.plans.q_geometry import segment_sql
from hoopflow.plans.q_possessions import frames
from hoopflow.plans.q_state import E, state_sql, states
from hoopflow.plans.registry import R, cte, query

SK = ["possession_id", "frame_idx"]
cte("o_h", "SELECT * FROM o_states0 WHERE has_ball")
cte("o_mates", """SELECT h.possession_id, h.frame_idx, h.player_id AS actor, h.sx AS hx, h.sy AS hy, h.orientation_deg AS ho, h.dist_to_rim AS hd,
  t.player_id AS target, t.sx AS tx, t.sy AS ty, t.zone AS tzone, t.pressure AS tpressure, t.def_dist AS tsep, t.dist_to_rim AS td
  FROM o_h h JOIN o_states0 t ON h.possession_id = t.possession_id AND h.frame_idx = t.frame_idx AND t.side = 'offense' AND t.player_id <> h.player_id""")


@query("feat_shot", f"""SELECT possession_id, frame_idx, {R('dist_to_rim')} AS dist_to_rim, {R('angle_to_rim_deg')} AS angle_to_rim_deg,
  {R('coalesce(def_dist, 30e0)')} AS closest_defender_dist, {R('coalesce(def_angle, 90e0)')} AS defender_angle_deg, {R('pressure')} AS defender_pressure,
  {R('coalesce(shot_clock, 12e0)')} AS shot_clock, CAST(zone LIKE '%three%' AS DOUBLE) AS is_three, 1e0 AS catch_and_shoot, 0.45e0 AS player_shot_prior FROM o_h""")
def _(src):
    s = ST.decided(states(src))
    f = FT.shot(F.col("handler"), F.col("shot_clock"))
    rounded = {n: (c if n in ("is_three", "catch_and_shoot", "player_shot_prior") else r4(c)) for n, c in f.items()}
    return s.select(*SK, *FT.columns(rounded))


cte("o_lane", f"""SELECT m.possession_id, m.frame_idx, m.target, count(d.player_id) FILTER (WHERE {segment_sql('d.sx', 'd.sy', 'm.hx', 'm.hy', 'm.tx', 'm.ty')} < 3) AS lane
  FROM o_mates m LEFT JOIN o_states0 d ON m.possession_id = d.possession_id AND m.frame_idx = d.frame_idx AND d.side = 'defense' GROUP BY ALL""")


def mates(src):
    """Handler states with each team-mate as struct ``t`` and the defenders as ``_def``."""
    return ST.unnest(ST.build_for_passes(frames(src)).select(*SK, "handler", "_def", "mates"), "mates", "t")


@query("join_lane", "SELECT * FROM o_lane")
def _(src):
    return mates(src).select(*SK, F.col("t.player_id").alias("target"),
                                     FT.lane_count(F.col("_def"), F.col("handler"), F.col("t")).cast("long").alias("lane"))


@query("join_teammates", f"SELECT possession_id, frame_idx, actor, target, {R('sqrt((tx-hx)*(tx-hx)+(ty-hy)*(ty-hy))')} AS dist FROM o_mates")
def _(src):
    return mates(src).select(*SK, F.col("handler.player_id").alias("actor"), F.col("t.player_id").alias("target"),
                                     r4(G.dist("t.x", "t.y", "handler.x", "handler.y")).alias("dist"))


@query("feat_pass", f"""SELECT possession_id, frame_idx, target, {R('n')} AS pass_distance, CAST(lane AS DOUBLE) AS defenders_in_lane,
  {R('coalesce(tsep, 30e0)')} AS receiver_separation,
  {R('CASE WHEN ho IS NULL OR n < 1e-6 THEN 0e0 ELSE cos(radians(ho))*((tx-hx)/n) + sin(radians(ho))*((ty-hy)/n) END')} AS passer_facing_receiver,
  {R('tpressure')} AS receiver_pressure, {R('td')} AS receiver_dist_to_rim
FROM (SELECT *, sqrt((tx-hx)*(tx-hx)+(ty-hy)*(ty-hy)) AS n FROM o_mates) JOIN o_lane USING (possession_id, frame_idx, target)""")
def _(src):
    f = FT.passing(F.col("_def"), F.col("handler"), F.col("t"), F.col("t.nearest_dist"))
    return mates(src).select(*SK, F.col("t.player_id").alias("target"), *FT.columns({n: r4(c) for n, c in f.items()}))


cte("o_dirs", "SELECT unnest(['left', 'middle', 'right']) AS direction")
cte("o_help", """SELECT h.possession_id, h.frame_idx, direction, count(d.player_id) FILTER (WHERE d.dist_to_rim < h.dist_to_rim AND CASE direction
   WHEN 'left' THEN d.sy > 25 WHEN 'right' THEN d.sy < 25 ELSE abs(d.sy - 25) < 8 END) AS help
  FROM o_h h CROSS JOIN o_dirs LEFT JOIN o_states0 d ON h.possession_id = d.possession_id AND h.frame_idx = d.frame_idx AND d.side = 'defense' GROUP BY ALL""")


def directions(s):
    d = ST.decided(s).withColumn("_def", ST.of_side("players", "defense"))
    return d.select(*SK, "handler", "_def", F.explode(F.array(*map(F.lit, ("left", "middle", "right")))).alias("direction"))


@query("join_help", "SELECT * FROM o_help")
def _(src):
    return directions(states(src)).select(*SK, "direction", FT.help_count(F.col("_def"), F.col("handler"), F.col("direction")).cast("long").alias("help"))


@query("feat_drive", f"""SELECT possession_id, frame_idx, direction, CAST(help AS DOUBLE) AS help_defenders_on_side,
  {R('coalesce(abs(def_y - sy), 0e0)')} AS primary_defender_lateral, {R('coalesce(def_dist, 30e0)')} AS primary_defender_dist,
  {R('speed')} AS driver_speed, {R('dist_to_rim')} AS driver_dist_to_rim, CASE direction WHEN 'left' THEN 1e0 WHEN 'right' THEN -1e0 ELSE 0e0 END AS direction_sign
FROM o_h JOIN o_help USING (possession_id, frame_idx)""")
def _(src):
    f = FT.driving(F.col("_def"), F.col("handler"), F.col("direction"))
    out = {n: (c if n == "direction_sign" else r4(c)) for n, c in f.items()}
    return directions(states(src)).select(*SK, "direction", *FT.columns(out))


cte("o_ents", """SELECT possession_id, frame_idx, player_id, (sx-5.25e0)/47e0 AS x, (sy-25e0)/25e0 AS y, coalesce(svx, 0e0)/10e0 AS vx, coalesce(svy, 0e0)/10e0 AS vy,
   CAST(side = 'offense' AS DOUBLE) AS off, CAST(side = 'defense' AS DOUBLE) AS def, 0e0 AS ball, CAST(has_ball AS DOUBLE) AS has_ball FROM o_states0
 UNION ALL SELECT possession_id, frame_idx, -1, (round_even(ball_x*100, 0)/100 - 5.25e0)/47e0, (round_even(ball_y*100, 0)/100 - 25e0)/25e0,
   round_even(ball_vx*100, 0)/100/10e0, round_even(ball_vy*100, 0)/100/10e0, 0e0, 0e0, 1e0, 0e0 FROM o_frames""")


@query("feat_entities", f"""SELECT possession_id, frame_idx, e.player_id, {R('x')} AS x, {R('y')} AS y, {R('vx')} AS vx, {R('vy')} AS vy, off, def, ball, e.has_ball,
  {R('coalesce(f.shot_clock, 12e0)/24')} AS g_clock, {R('round_even(round_even(CASE WHEN n_off >= 3 THEN area ELSE 0e0 END*1e6, 0)/1e6*10, 0)/10/500')} AS g_spacing, {R('n/10e0')} AS g_players
FROM o_ents e JOIN o_frames f USING (possession_id, frame_idx) JOIN o_noff USING (possession_id, frame_idx) LEFT JOIN o_hull USING (possession_id, frame_idx)""")
def _(src):
    e = ST.unnest(FT.entities(ST.build_for_entities(frames(src))).select(*SK, "g_clock", "g_spacing", "g_players", "entities"), "entities", "e")
    return e.select(*SK, "e.player_id", *[r4(f"e.{a}").alias(a) for a in ("x", "y", "vx", "vy")], "e.off", "e.def", "e.ball", "e.has_ball",
                    *[r4(g).alias(g) for g in ("g_clock", "g_spacing", "g_players")])


@query("feat_mean_pool", f"SELECT possession_id, frame_idx, {', '.join(f'{R(f'avg({c})')} AS pool_{c}' for c in FT.POOLED)} FROM o_ents GROUP BY possession_id, frame_idx")
def _(src):
    p = FT.mean_pool(FT.entities(ST.build_for_entities(frames(src))))
    return p.select(*SK, *[r4(f"pool_{c}").alias(f"pool_{c}") for c in FT.POOLED])


@query("feat_vocab", """SELECT event_id, moment_pos, player_id, CASE WHEN player_id = -1 OR player_id = 204 THEN 0 ELSE idx END AS idx FROM fx_tracking
  JOIN (SELECT player_id, CASE WHEN player_id = -1 THEN 0 ELSE dense_rank() OVER (ORDER BY CASE WHEN player_id IN (-1, 204) THEN 1000 ELSE player_id END) END AS idx
        FROM (SELECT DISTINCT player_id FROM fx_tracking)) USING (player_id)""")
def _(src):
    t = src("fx_tracking")
    v = FT.vocab(t.where("player_id <> 204"))
    return FT.encode(t.select("event_id", "moment_pos", "player_id"), v)


@query("set_player_union", "SELECT DISTINCT player_id FROM (SELECT player_id FROM fx_tracking UNION SELECT PLAYER_ID FROM fx_shots_raw UNION SELECT player_id FROM fx_roster)")
def _(src):
    return (src("fx_tracking").select("player_id").distinct().unionByName(src("fx_shots_raw").select(F.col("PLAYER_ID").alias("player_id")).distinct())
            .unionByName(src("fx_roster").select("player_id")).distinct())


# Candidates ---------------------------------------------------------------------
cte("o_cands", f"""SELECT *, row_number() OVER (PARTITION BY possession_id, frame_idx ORDER BY kind, sub) AS ord FROM (
  SELECT possession_id, frame_idx, player_id AS actor, 'SHOOT' AS action, NULL::BIGINT AS target, NULL AS direction, zone, dist_to_rim, NULL AS target_zone,
    NULL::DOUBLE AS target_open, NULL::DOUBLE AS screener_dist, 0 AS kind, 0 AS sub FROM o_h WHERE dist_to_rim <= 32 OR coalesce(shot_clock < 2, false)
  UNION ALL SELECT possession_id, frame_idx, actor, 'PASS_TO', target, NULL, NULL, NULL, tzone, {E('1 - tpressure', 3)}, NULL, 1, target FROM o_mates
  UNION ALL SELECT possession_id, frame_idx, player_id, 'DRIVE', NULL, direction, NULL, NULL, NULL, NULL, NULL, 2, CASE direction WHEN 'left' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END
    FROM o_h, o_dirs WHERE CASE direction WHEN 'left' THEN sy < 47 WHEN 'right' THEN sy > 3 ELSE dist_to_rim > 4 END
  UNION ALL SELECT possession_id, frame_idx, actor, 'SCREEN_WITH', target, NULL, NULL, NULL, NULL, NULL, {E('sqrt((tx-hx)*(tx-hx)+(ty-hy)*(ty-hy))', 1)}, 3, target
    FROM o_mates WHERE sqrt((tx-hx)*(tx-hx)+(ty-hy)*(ty-hy)) <= 25
  UNION ALL SELECT possession_id, frame_idx, player_id, 'RESET', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 4, 0 FROM o_h)""")
CAND = f"""SELECT possession_id, frame_idx, ord, 'a' || CAST(ord AS VARCHAR) AS action_id, action, actor, target, direction, zone, {R('dist_to_rim')} AS dist_to_rim,
  target_zone, {R('target_open')} AS target_open, {R('screener_dist')} AS screener_dist FROM o_cands"""


@query("act_enumerate", CAND)
def _(src):
    c = A.enumerate_actions(states(src))
    return c.select(*SK, "ord", "action_id", "action", "actor", "target", "direction", "zone", r4("dist_to_rim").alias("dist_to_rim"),
                    "target_zone", r4("target_open").alias("target_open"), r4("screener_dist").alias("screener_dist"))


@query("set_union_candidates", "SELECT action, direction, count(*) AS n, min(ord) AS first_ord, max(ord) AS last_ord FROM o_cands GROUP BY ALL")
def _(src):
    c = A.enumerate_actions(states(src))
    return c.groupBy("action", "direction").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


@query("flt_action_legal", f"""SELECT possession_id, frame_idx, dist_to_rim <= 32 OR coalesce(shot_clock < 2, false) AS shoot, sy < 47 AS drive_left,
  dist_to_rim > 4 AS drive_middle, sy > 3 AS drive_right FROM o_h""")
def _(src):
    s = ST.decided(states(src))
    h = F.col("handler")
    return s.select(*SK, A.shoot_legal(h["dist_to_rim"], F.col("shot_clock")).alias("shoot"),
                    *[A.drive_legal(h["y"], h["dist_to_rim"], k).alias(f"drive_{k}") for k in ("left", "middle", "right")])


@query("ord_first_decision", """SELECT possession_id, coalesce(min(CASE WHEN k >= 3 THEN frame_idx END), CAST(floor(count(*)/3) AS BIGINT)) AS decision_frame
  FROM (SELECT DISTINCT possession_id, frame_idx FROM o_frames) LEFT JOIN (SELECT possession_id, frame_idx, count(*) AS k FROM o_cands GROUP BY ALL) USING (possession_id, frame_idx)
  GROUP BY possession_id""")
def _(src):
    s = states(src)
    # A handler's frame always lists at least one candidate, so the count is enough.
    n = A.enumerate_actions(s).where("ord = 1").select(*SK, "n_candidates")
    d = s.select(*SK).join(n, SK, "left")
    return d.groupBy("possession_id").agg(F.coalesce(F.min(F.when(F.col("n_candidates") >= 3, F.col("frame_idx"))),
                                                     F.floor(F.count(F.lit(1)) / 3)).alias("decision_frame"))


# Transition: move players in SQL, then rebuild the state with the same text as before.
cte("o_moves", """SELECT c.possession_id || '|' || CAST(c.ord AS VARCHAR) AS possession_id, c.frame_idx, c.possession_id AS p0, c.ord, c.action, c.actor, g.def_id AS guard, h.sx AS hx, h.sy AS hy,
   CASE WHEN c.action = 'PASS_TO' THEN c.target ELSE c.actor END AS handler_player_id, ux, uy,
   CASE c.action WHEN 'DRIVE' THEN h.sx + ux*step - uy*lat WHEN 'SCREEN_WITH' THEN h.sx WHEN 'RESET' THEN 29.25e0 END AS nx,
   CASE c.action WHEN 'DRIVE' THEN h.sy + uy*step + ux*lat WHEN 'SCREEN_WITH' THEN h.sy + (CASE WHEN h.sy < 25 THEN 2e0 ELSE -2e0 END) WHEN 'RESET' THEN 25e0 END AS ny
 FROM (SELECT *, CASE direction WHEN 'left' THEN 4e0 WHEN 'right' THEN -4e0 ELSE 0e0 END AS lat FROM o_cands WHERE action <> 'SHOOT') c
 JOIN (SELECT *, CASE WHEN r > 1e-6 THEN (5.25e0-sx)/r ELSE 0e0 END AS ux, CASE WHEN r > 1e-6 THEN (25e0-sy)/r ELSE 0e0 END AS uy, least(8e0, greatest(0e0, r-2)) AS step
       FROM (SELECT *, sqrt((5.25e0-sx)*(5.25e0-sx)+(25e0-sy)*(25e0-sy)) AS r FROM o_h)) h ON c.possession_id = h.possession_id AND c.frame_idx = h.frame_idx
 LEFT JOIN (SELECT possession_id, frame_idx, player_id AS def_id FROM (SELECT d.*, row_number() OVER (PARTITION BY d.possession_id, d.frame_idx
     ORDER BY sqrt((d.sx-h.sx)*(d.sx-h.sx)+(d.sy-h.sy)*(d.sy-h.sy)), d.player_id) AS rn FROM o_states0 d JOIN o_h h ON d.possession_id = h.possession_id AND d.frame_idx = h.frame_idx
     WHERE d.side = 'defense') WHERE rn = 1) g ON c.possession_id = g.possession_id AND c.frame_idx = g.frame_idx""")
cte("o_moved", """SELECT m.possession_id, m.frame_idx, m.action, m.handler_player_id, s.player_id, s.team_id, s.side,
   CASE WHEN nx IS NOT NULL AND s.player_id = m.actor THEN nx WHEN nx IS NOT NULL AND s.player_id = guard THEN sx + (nx-hx)*(CASE WHEN m.action = 'DRIVE' THEN 0.7e0 ELSE 1e0 END) ELSE sx END AS x,
   CASE WHEN nx IS NOT NULL AND s.player_id = m.actor THEN ny WHEN nx IS NOT NULL AND s.player_id = guard THEN sy + (ny-hy)*(CASE WHEN m.action = 'DRIVE' THEN 0.7e0 ELSE 1e0 END) ELSE sy END AS y,
   CASE WHEN m.action = 'DRIVE' AND s.player_id = m.actor THEN ux*6 ELSE svx END AS vx, CASE WHEN m.action = 'DRIVE' AND s.player_id = m.actor THEN uy*6 ELSE svy END AS vy
 FROM o_moves m JOIN o_states0 s ON m.p0 = s.possession_id AND m.frame_idx = s.frame_idx""")
cte("o_mholder", "SELECT * FROM o_moved WHERE player_id = handler_player_id")
cte("o_mnear", """SELECT possession_id, frame_idx, player_id, def_id, def_x, def_y, dist FROM (SELECT o.possession_id, o.frame_idx, o.player_id, d.player_id AS def_id, d.x AS def_x, d.y AS def_y,
   sqrt((o.x-d.x)*(o.x-d.x)+(o.y-d.y)*(o.y-d.y)) AS dist, row_number() OVER (PARTITION BY o.possession_id, o.frame_idx, o.player_id ORDER BY sqrt((o.x-d.x)*(o.x-d.x)+(o.y-d.y)*(o.y-d.y)), d.player_id) AS rn
  FROM o_mholder o JOIN o_moved d ON o.possession_id = d.possession_id AND o.frame_idx = d.frame_idx WHERE d.side = 'defense') WHERE rn = 1""")
cte("o_next", state_sql("o_mholder", "o_mnear", "0"))


@query("act_transition", f"""SELECT possession_id, frame_idx, action, player_id AS handler_id, {R('sx')} AS x, {R('sy')} AS y, {R('speed')} AS speed, zone, def_id, {R('def_dist')} AS def_dist,
  {R('def_angle')} AS def_angle, {R('pressure')} AS pressure FROM o_next""")
def _(src):
    n = FU.candidates(frames(src), ["possession_id", "frame_idx"], built=False).where("action <> 'SHOOT'")
    return n.select(F.concat_ws("|", "possession_id", F.col("ord").cast("string")).alias("possession_id"), "frame_idx", "action", F.col("next_handler").alias("handler_id"),
                    *[r4(f"next_{c}").alias(c) for c in ("x", "y", "speed")], F.col("next_zone").alias("zone"), F.col("next_def_id").alias("def_id"),
                    *[r4(f"next_{c}").alias(c) for c in ("def_dist", "def_angle", "pressure")])


# Scoring and ranking over a plain candidate table --------------------------------
_LEAF = "(CASE WHEN action IN ('PASS_TO', 'DRIVE') THEN greatest(q, true_v) ELSE q END)"


@query("act_leaf", f"SELECT state, ord, {R(_LEAF)} AS leaf FROM fx_cands")
def _(src):
    return src("fx_cands").select("state", "ord", r4(A.leaf_value("action", "q", "true_v")).alias("leaf"))


@query("act_q", f"""SELECT state, ord, {R(f"CASE WHEN action = 'SHOOT' THEN p*(2 + ord % 2) WHEN action IN ('PASS_TO', 'DRIVE') THEN p*{_LEAF} + (1 - p)*(-0.1e0) ELSE {_LEAF} END")} AS score FROM fx_cands""")
def _(src):
    c = src("fx_cands").withColumns({"leaf": A.leaf_value("action", "q", "true_v"), "pts": 2 + F.col("ord") % 2})
    return c.select("state", "ord", r4(A.expected_points("action", "p", "leaf", "pts")).alias("score"))


_RANKED = "SELECT *, row_number() OVER (PARTITION BY state ORDER BY q DESC, ord) AS rnk FROM fx_cands"


@query("win_rank_actions", f"SELECT state, ord, rnk AS rank FROM ({_RANKED})")
def _(src):
    return A.rank_actions(src("fx_cands"), ["state"]).select("state", "ord", F.col("rank").cast("long").alias("rank"))


@query("ord_top_k", f"SELECT state, ord, rnk AS rank, {R('q')} AS q FROM ({_RANKED}) WHERE rnk <= 3")
def _(src):
    return A.top_k(src("fx_cands"), ["state"], 3).select("state", "ord", F.col("rank").cast("long").alias("rank"), r4("q").alias("q"))


@query("map_scores_by_id", f"SELECT state, string_agg(action_id || '=' || CAST(CAST(floor(q*100 + 0.5e0) AS BIGINT) AS VARCHAR), ',' ORDER BY action_id) AS scores FROM fx_cands GROUP BY state")
def _(src):
    m = A.scores_by_id(src("fx_cands").withColumn("q", F.floor(F.col("q") * 100 + 0.5)), ["state"])
    pairs = F.array_sort(F.map_entries("scores"))
    return m.select("state", F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("scores"))


@query("join_why_not", f"""SELECT state, ord, {R('gap')} AS epv_gap, CASE WHEN gap <= 1e-6 THEN 'recommended' ELSE printf('%.2f', gap) || ' EPV worse than the top option' END AS verdict
FROM (SELECT *, round_even((max(q) OVER (PARTITION BY state) - q)*1000, 0)/1000 AS gap FROM (SELECT state, ord, floor(q*10)/10 AS q FROM fx_cands))""")
def _(src):
    c = src("fx_cands").withColumn("q", F.floor(F.col("q") * 10) / 10)
    return A.why_not(c, ["state"]).select("state", "ord", r4("epv_gap").alias("epv_gap"), "verdict")


cte("o_picks", """SELECT state, count(*) AS n, max(true_v) AS best_true, arg_max(true_v, q*1e6 - ord) AS model,
  coalesce(arg_min(true_v, ord) FILTER (WHERE action = 'SHOOT'), arg_min(true_v, ord)) AS always_shoot,
  coalesce(arg_max(true_v, open*1e6 - ord) FILTER (WHERE action = 'PASS_TO'), arg_min(true_v, ord)) AS pass_most_open,
  arg_min(true_v, md5('0:' || state || ':' || ord)) AS random FROM fx_cands GROUP BY state HAVING count(*) >= 2""")
POLICIES = ["model", "always_shoot", "pass_most_open", "random"]


@query("act_baselines", f"SELECT state, n, {', '.join(f'{R(p)} AS {p}' for p in ['best_true', *POLICIES])} FROM o_picks")
def _(src):
    return A.baseline_picks(src("fx_cands"), ["state"]).select("state", "n", *[r4(p).alias(p) for p in ["best_true", *POLICIES]])
