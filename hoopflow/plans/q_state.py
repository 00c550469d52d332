"""State queries: the array form in Spark against the join form in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoopflow.functions import geometry as G
from hoopflow.functions.geometry import r4
from hoopflow.operators import futures as FU, possessions as P, state as ST
from hoopflow.plans.q_geometry import pressure_sql, zone_sql
from hoopflow.plans.q_possessions import frames
from hoopflow.plans.registry import R, cte, query


def E(expr: str, digits: int) -> str:
    """Oracle text of half-even rounding."""
    return f"(round_even(({expr})*1e{digits}, 0)/1e{digits})"


PK = ["possession_id", "frame_idx", "player_id"]
_D = "sqrt((o.x-d.x)*(o.x-d.x)+(o.y-d.y)*(o.y-d.y))"
cte("o_near", f"""SELECT possession_id, frame_idx, player_id, def_id, def_x, def_y, dist FROM (
  SELECT o.possession_id, o.frame_idx, o.player_id, d.player_id AS def_id, d.x AS def_x, d.y AS def_y, {_D} AS dist,
    row_number() OVER (PARTITION BY o.possession_id, o.frame_idx, o.player_id ORDER BY {_D}, d.player_id) AS rn
  FROM o_players o JOIN o_players d ON o.possession_id = d.possession_id AND o.frame_idx = d.frame_idx
  WHERE o.side = 'offense' AND d.side = 'defense') WHERE rn = 1""")


def angle_sql(ax, ay, bx, by) -> str:
    return f"""(SELECT CASE WHEN n1 < 1e-6 OR n2 < 1e-6 THEN 0e0 ELSE degrees(acos(greatest(-1e0, least(1e0, (ux*vx+uy*vy)/(n1*n2))))) END
      FROM (SELECT *, sqrt(ux*ux+uy*uy) AS n1, sqrt(vx*vx+vy*vy) AS n2 FROM (SELECT {ax} AS ux, {ay} AS uy, {bx} AS vx, {by} AS vy)))"""


cte("o_touch", """SELECT *, last_value(CASE WHEN handler_player_id = player_id THEN game_clock END IGNORE NULLS)
  OVER (PARTITION BY possession_id, player_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS touch FROM o_players""")


def state_sql(players: str, near: str, touch: str) -> str:
    """State rows for a table of players and their nearest defenders."""
    sp = "sqrt(p.vx*p.vx + p.vy*p.vy)"
    has = "coalesce(p.player_id = p.handler_player_id, false)"
    return f"""SELECT p.*, {E('p.x', 2)} AS sx, {E('p.y', 2)} AS sy, {E('p.vx', 2)} AS svx, {E('p.vy', 2)} AS svy, {E(sp, 2)} AS speed,
  CASE WHEN {sp} >= 0.5 THEN {E('degrees(atan2(p.vy, p.vx))', 1)} END AS orientation_deg, {has} AS has_ball,
  {E('sqrt((p.x-5.25e0)*(p.x-5.25e0)+(p.y-25e0)*(p.y-25e0))', 2)} AS dist_to_rim,
  {E('degrees(atan2(p.y-25e0, p.x-5.25e0))', 1)} AS angle_to_rim_deg, {zone_sql('p.x', 'p.y')} AS zone,
  n.def_id, {E('n.dist', 2)} AS def_dist, {E('n.def_y', 2)} AS def_y,
  CASE WHEN n.def_id IS NOT NULL THEN {E(angle_sql('5.25e0 - p.x', '25e0 - p.y', 'n.def_x - p.x', 'n.def_y - p.y'), 1)} END AS def_angle,
  CASE WHEN n.def_id IS NULL THEN 0e0 ELSE {E(pressure_sql('p.x', 'p.y', 'n.def_x', 'n.def_y'), 3)} END AS pressure,
  CASE WHEN {has} THEN 0e0 ELSE {E(f'greatest(0e0, {touch})', 2)} END AS since_touch
FROM {players} p LEFT JOIN {near} n USING (possession_id, frame_idx, player_id)"""


# greatest() skips NULLs in this engine, so an unknown touch is kept out by the CASE.
cte("o_states", state_sql("o_touch", "o_near", "p.touch - p.game_clock").replace(
    "ELSE (round_even((greatest(0e0, p.touch", "WHEN p.touch IS NULL THEN NULL ELSE (round_even((greatest(0e0, p.touch"))
cte("o_states0", state_sql("o_players", "o_near", "0").replace("CASE WHEN coalesce(p.player_id = p.handler_player_id, false) THEN 0e0 ELSE",
                                                              "CASE WHEN coalesce(p.player_id = p.handler_player_id, false) THEN 0e0 WHEN true THEN NULL ELSE"))

SCOLS = f"""{', '.join(PK)}, {R('sx')} AS x, {R('sy')} AS y, {R('svx')} AS vx, {R('svy')} AS vy, {R('speed')} AS speed,
 {R('orientation_deg')} AS orientation_deg, has_ball, {R('dist_to_rim')} AS dist_to_rim, {R('angle_to_rim_deg')} AS angle_to_rim_deg, zone,
 def_id, {R('def_dist')} AS def_dist, {R('def_angle')} AS def_angle, {R('pressure')} AS pressure, {R('since_touch')} AS since_touch"""


def states(src, touches=False):
    """States of every frame; built once per query, then read by column."""
    f = frames(src)
    if touches:
        f = ST.with_touches(f, ["game_id", "event_id", "possession_id"], F.col("frame_idx"))
    return ST.build(f, touches)


def state_rows(s):
    p = ST.unnest(s.select("possession_id", "frame_idx", "players"), "players", "p")
    return p.select(
        "possession_id", "frame_idx", "p.player_id", *[r4(f"p.{a}").alias(a) for a in ("x", "y", "vx", "vy", "speed", "orientation_deg")],
        "p.has_ball", r4("p.dist_to_rim").alias("dist_to_rim"), r4("p.angle_to_rim_deg").alias("angle_to_rim_deg"), "p.zone",
        F.col("p.nearest_defender.player_id").alias("def_id"), r4("p.nearest_defender.dist").alias("def_dist"),
        r4("p.nearest_defender.angle_deg").alias("def_angle"), r4("p.defender_pressure").alias("pressure"),
        r4("p.seconds_since_touch").alias("since_touch"))


@query("state_build", f"SELECT {SCOLS} FROM o_states0")
def _(src):
    return state_rows(states(src))


@query("state_build_sequence", f"SELECT {SCOLS} FROM o_states")
def _(src):
    p = FU.player_rows(frames(src), "possession_id", "frame_idx")
    return p.select(*PK, "has_ball", "zone", "def_id", *[r4(c).alias(c) for c in FU.MEASURES])


@query("win_since_touch", f"SELECT {', '.join(PK)}, {R('since_touch')} AS since_touch FROM o_states")
def _(src):
    f = ST.with_touches(frames(src), ["game_id", "event_id", "possession_id"], F.col("frame_idx"))
    p = ST.unnest(f, "players", "p")
    since = F.when(F.col("p.player_id") == F.col("handler_player_id"), F.lit(0.0)).when(
        F.col("p.touch_clock").isNotNull(), G.rnd(F.greatest(F.lit(0.0), F.col("p.touch_clock") - F.col("game_clock")), 2))
    return p.select("possession_id", "frame_idx", "p.player_id", r4(since).alias("since_touch"))


# Within-frame joins ------------------------------------------------------------
@query("join_nearest_defender", f"SELECT {', '.join(PK)}, def_id, {R('dist')} AS dist FROM o_near")
def _(src):
    f = frames(src).withColumn("_def", ST.of_side("players", "defense"))
    p = ST.unnest(f.select("possession_id", "frame_idx", F.transform(ST.of_side("players", "offense"), lambda p: F.struct(
        p["player_id"].alias("player_id"), ST.nearest(F.col("_def"), p["x"], p["y"]).alias("n"))).alias("_x")), "_x", "p")
    return (p.where("p.n IS NOT NULL").select("possession_id", "frame_idx", "p.player_id", F.col("p.n.player_id").alias("def_id"),
                                              r4("p.n.d").alias("dist")))


@query("join_defender_row", f"SELECT {', '.join(PK)}, {R('def_x')} AS def_x, {R('def_y')} AS def_y, {R('abs(def_y - y)')} AS lateral FROM o_near JOIN o_players USING (possession_id, frame_idx, player_id)")
def _(src):
    f = frames(src).withColumn("_def", ST.of_side("players", "defense"))
    p = ST.unnest(f.select("possession_id", "frame_idx", F.transform(ST.of_side("players", "offense"), lambda p: F.struct(
        p["player_id"].alias("player_id"), p["y"].alias("y"), ST.nearest(F.col("_def"), p["x"], p["y"]).alias("n"))).alias("_x")), "_x", "p")
    return (p.where("p.n IS NOT NULL").select("possession_id", "frame_idx", "p.player_id", r4("p.n.x").alias("def_x"),
                                              r4("p.n.y").alias("def_y"), r4(F.abs(F.col("p.n.y") - F.col("p.y"))).alias("lateral")))


cte("o_guard", """SELECT possession_id, frame_idx, o.player_id AS handler_id, n.def_id AS guard_id
  FROM o_players o JOIN o_near n USING (possession_id, frame_idx, player_id) WHERE player_id = handler_player_id""")


@query("join_guard", "SELECT * FROM o_guard")
def _(src):
    f = frames(src).withColumn("_h", F.get(F.filter("players", lambda p: p["player_id"] == F.col("handler_player_id")), F.lit(0)))
    g = ST.nearest(ST.of_side("players", "defense"), F.col("_h.x"), F.col("_h.y"))["player_id"]
    return (f.where("_h IS NOT NULL").select("possession_id", "frame_idx", F.col("_h.player_id").alias("handler_id"), g.alias("guard_id"))
            .where("guard_id IS NOT NULL"))


cte("o_scheme", """SELECT possession_id, frame_idx, CASE WHEN median(gap) < 7 THEN 'man' ELSE 'zone' END AS scheme FROM (
  SELECT d.possession_id, d.frame_idx, d.player_id, min(sqrt((o.x-d.x)*(o.x-d.x)+(o.y-d.y)*(o.y-d.y))) AS gap
  FROM o_players d JOIN o_players o ON o.possession_id = d.possession_id AND o.frame_idx = d.frame_idx
  WHERE d.side = 'defense' AND o.side = 'offense' GROUP BY ALL) GROUP BY ALL""")


@query("join_scheme", "SELECT * FROM o_scheme")
def _(src):
    return frames(src).select("possession_id", "frame_idx", ST.scheme(ST.of_side("players", "offense"), ST.of_side("players", "defense")).alias("scheme"))


cte("o_screen", """SELECT h.possession_id, h.frame_idx, min(t.player_id) AS screener_id FROM o_states0 h JOIN o_states0 t
  ON h.possession_id = t.possession_id AND h.frame_idx = t.frame_idx AND t.side = 'offense' AND t.player_id <> h.player_id
  WHERE h.has_ball AND sqrt((t.sx-h.sx)*(t.sx-h.sx)+(t.sy-h.sy)*(t.sy-h.sy)) <= 10 GROUP BY ALL""")


# The view keeps players apart: a wider reach than the default, so that rows exist.
@query("join_screen", "SELECT * FROM o_screen")
def _(src):
    rr = F.transform("players", lambda p: p.withField("x", G.rnd(p["x"], 2)).withField("y", G.rnd(p["y"], 2)))
    f = frames(src).withColumn("players", rr)
    f = f.withColumn("_h", F.get(F.filter("players", lambda p: p["player_id"] == F.col("handler_player_id")), F.lit(0)))
    # Unnested, as a filter on the screener would be pushed below and evaluate all of it again for every player.
    screen = F.array(ST.active_screen(F.col("players"), F.col("_h"), 10.0)["screener_id"])
    return ST.unnest(ST.decided(f).select("possession_id", "frame_idx", screen.alias("_s")), "_s", "screener_id").drop("_s")


cte("o_hull", """SELECT a.possession_id, a.frame_idx, abs(sum(a.x*b.y - b.x*a.y))/2 AS area
  FROM o_players a JOIN o_players b ON a.possession_id = b.possession_id AND a.frame_idx = b.frame_idx AND b.side = 'offense' AND a.player_id <> b.player_id
  WHERE a.side = 'offense' AND NOT EXISTS (SELECT 1 FROM o_players c WHERE c.possession_id = a.possession_id AND c.frame_idx = a.frame_idx
    AND c.side = 'offense' AND c.player_id <> a.player_id AND c.player_id <> b.player_id
    AND ((b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) < -1e-9 OR (abs((b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x)) <= 1e-9
      AND (c.x-a.x)*(c.x-b.x) + (c.y-a.y)*(c.y-b.y) > 0))) GROUP BY ALL""")
cte("o_noff", "SELECT possession_id, frame_idx, count(*) FILTER (WHERE side = 'offense') AS n_off, count(*) AS n FROM o_players GROUP BY ALL")


@query("agg_hull_area", f"SELECT possession_id, frame_idx, {R('round_even(CASE WHEN n_off >= 3 THEN area ELSE 0e0 END*1e6, 0)/1e6')} AS area FROM o_noff JOIN o_hull USING (possession_id, frame_idx)")
def _(src):
    f = ST.with_ring(frames(src).withColumn("_off", ST.of_side("players", "offense")))
    return f.select("possession_id", "frame_idx", r4(ST.ring_area(F.col("_ring"), F.size("_off"))).alias("area"))


@query("join_snapshot", "SELECT p.event_id, p.game_clock, p.player_id, p.x, p.y, b.x AS ball_x FROM fx_tracking_c p JOIN fx_tracking_c b ON p.game_id = b.game_id AND p.quarter = b.quarter AND p.game_clock = b.game_clock AND p.event_id = b.event_id AND b.is_ball WHERE NOT p.is_ball")
def _(src):
    t = src("fx_tracking_c")
    keys = ["game_id", "quarter", "game_clock", "event_id"]
    snap = t.groupBy(*keys).agg(F.first(F.when(F.col("is_ball"), F.col("x")), True).alias("ball_x"),
                                F.collect_list(F.when(~F.col("is_ball"), F.struct("player_id", "x", "y"))).alias("ps"))
    return (snap.where("ball_x IS NOT NULL").select("event_id", "game_clock", "ball_x", F.explode("ps").alias("p"))
            .select("event_id", "game_clock", "p.*", "ball_x"))


@query("join_roster", "SELECT t.event_id, t.moment_pos, t.player_id, r.jersey, r.firstname || ' ' || r.lastname AS name FROM fx_tracking t LEFT JOIN fx_roster r ON t.player_id = r.player_id WHERE NOT t.is_ball")
def _(src):
    r = src("fx_roster").select("player_id", "jersey", F.trim(F.concat_ws(" ", "firstname", "lastname")).alias("name"))
    return src("fx_tracking").where("NOT is_ball").select("event_id", "moment_pos", "player_id").join(r, "player_id", "left")


@query("flt_class_side", """SELECT possession_id, frame_idx, count(*) FILTER (WHERE side = 'offense') AS n_offense,
  count(*) FILTER (WHERE side = 'defense') AS n_defense, max(CASE WHEN has_ball THEN player_id END) AS handler_id FROM o_states0 GROUP BY ALL""")
def _(src):
    s = states(src)
    return s.select("possession_id", "frame_idx", F.size(ST.of_side("players", "offense")).cast("long").alias("n_offense"),
                    F.size(ST.of_side("players", "defense")).cast("long").alias("n_defense"), F.col("handler.player_id").alias("handler_id"))


@query("chk_conformance", "SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 11 = 0 THEN 'no players in the state' END, CASE WHEN NOT value/100 BETWEEN 0 AND 1 THEN 'confidence is not a share' END, CASE WHEN event_type IN ('click', 'error') THEN 'a side is neither offense nor defense' END, CASE WHEN event_id % 7 = 0 THEN 'unknown kind of scheme' END], lambda v: v IS NOT NULL), '; ') AS problems FROM events")
def _(src):
    e = F.col("event_id")
    v = ST.violations(F.when(e % 11 == 0, 0).otherwise(10), F.col("value") / 100,
                      F.array(F.lit("offense"), F.when(F.col("event_type").isin("click", "error"), F.col("event_type")).otherwise("defense")),
                      F.when(e % 7 == 0, "press").otherwise("man"))
    return src("events").select("event_id", F.array_join(v, "; ").alias("problems"))


@query("set_missing_keys", "SELECT event_id, array_to_string(list_sort(list_filter(['purchase', 'view', 'click'], lambda v: v <> event_type)), ',') AS missing FROM events")
def _(src):
    need = F.array(F.lit("purchase"), F.lit("view"), F.lit("click"))
    return src("events").select("event_id", F.array_join(F.array_sort(F.array_except(need, F.array("event_type"))), ",").alias("missing"))


@query("sink_state_json", "SELECT possession_id, frame_idx, count(*) AS n_players, bool_or(has_ball) AS has_handler FROM o_states0 GROUP BY ALL")
def _(src):
    from hoopflow.plans.staging import fresh_path
    from hoopflow.sources import sinks
    path = fresh_path(src.spark, "states")
    # Frames are dealt and sorted, states are built where they are written.
    f = frames(src).select("game_id", "possession_id", "frame_idx", "game_clock", "handler_player_id", "ball_in_flight", "ball", "players")
    s = lambda f: ST.build(f).select("game_id", "possession_id", "frame_idx", "players", "context", "ball")
    sinks.write_by_game(f, path, ["possession_id", "frame_idx"], fmt="json", shape=s)
    back = sinks.read_by_game(s(f), path, "json")
    return back.select("possession_id", "frame_idx", F.size("players").cast("long").alias("n_players"), F.exists("players", lambda p: p["has_ball"]).alias("has_handler"))
