"""Reader, label and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoopflow import fixed as K
from hoopflow.functions import geometry as G
from hoopflow.functions.geometry import r4
from hoopflow.operators import features as FT, joins as J, labels as L, possessions as P, sequence as Q, state as ST
from hoopflow.plans.q_geometry import pressure_sql
from hoopflow.plans.q_possessions import frames
from hoopflow.plans.q_state import states
from hoopflow.plans.registry import R, cte, query
from hoopflow.plans.staging import fresh_path, stage
from hoopflow.sources import readers as RD


# Game documents -----------------------------------------------------------------
def game_documents(src, compression: str = "none") -> str:
    """Game files written from the tracking view, one document per file."""
    t = src("fx_tracking")
    num = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    ent = F.concat(F.lit("["), F.concat_ws(",", "team_id", "player_id", "x", "y", "z"), F.lit("]"))
    m = (t.groupBy("game_id", "event_id", "moment_pos", "quarter", "unix_ms", "game_clock", "shot_clock")
         .agg(F.array_sort(F.collect_list(F.struct("entity_pos", ent.alias("e")))).alias("es")))
    text = F.concat(F.lit("["), F.concat_ws(",", num("quarter"), num("unix_ms"), num("game_clock"), num("shot_clock"), F.lit("null"),
                    F.concat(F.lit("["), F.array_join(F.transform("es", lambda e: e["e"]), ","), F.lit("]"))), F.lit("]"))
    # A short moment and one without coordinates, which readers must drop.
    ev = m.groupBy("game_id", "event_id").agg(F.array_sort(F.collect_list(F.struct("moment_pos", text.alias("t")))).alias("ms"))
    team = lambda i, ab, lo, hi: (f'{{"teamid":{i},"abbreviation":"{ab}","name":"{ab}","players":[' + ",".join(
        f'{{"playerid":{(100 + k) if k < 5 else 195 + k},"firstname":"{"Ann" if k % 2 == 0 else "Bo"}","lastname":"P{k}",'
        f'"jersey":"{"" if k == 9 else (10 + k if k < 5 else 15 + k)}","position":"{"G" if k % 5 < 2 else "F"}"}}' for k in range(lo, hi)) + "]}")
    body = F.concat(F.lit('{"eventId":"'), F.col("event_id").cast("string"), F.lit(f'","home":{team(1, "AAA", 0, 5)},"visitor":{team(2, "BBB", 5, 10)},"moments":[[1,2,3],[1,2,3.0,null,null,[]],'),
                    F.array_join(F.transform("ms", lambda e: e["t"]), ","), F.lit("]}"))
    doc = (ev.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("event_id", body.alias("b")))).alias("es"))
           .select(F.concat(F.lit('{"gameid":"'), "game_id", F.lit('","gamedate":"2015-12-01","events":['),
                            F.array_join(F.transform("es", lambda e: e["b"]), ","), F.lit("]}")).alias("value")))
    path = fresh_path(src.spark, "games")
    doc.write.option("maxRecordsPerFile", 1).option("compression", compression).mode("overwrite").format("text").save(path)
    return path


def game_events(src):
    return RD.read_events(src.spark, game_documents(src))


@query("src_tracking_json", "SELECT game_id, count(DISTINCT event_id) AS n_events, count(DISTINCT event_id) AS n_sides FROM fx_tracking GROUP BY game_id")
def _(src):
    e = game_events(src)
    sides = F.count_if(F.col("ev.home.teamid").isNotNull() & F.col("ev.visitor.teamid").isNotNull())
    return e.groupBy("game_id").agg(F.count_distinct("ev.eventId").alias("n_events"), sides.alias("n_sides"))


_FLAT = "SELECT game_id, CAST(event_id AS VARCHAR) AS event_id, quarter, game_clock, shot_clock, unix_ms, team_id, player_id, x, y, z, is_ball FROM fx_tracking"


@query("src_moments_flatten", _FLAT)
def _(src):
    return RD.moments(game_events(src)).drop("event_pos", "moment_pos", "entity_pos")


@query("flt_valid_moments", "SELECT game_id, count(*) AS kept FROM fx_tracking GROUP BY game_id")
def _(src):
    return RD.moments(game_events(src)).groupBy("game_id").agg(F.count(F.lit(1)).alias("kept"))


_ROSTER = "SELECT game_id, team_id, team_abbr, side, player_id, firstname, lastname, jersey, position FROM fx_roster, (SELECT DISTINCT game_id FROM fx_tracking)"


@query("src_roster_flatten", _ROSTER)
def _(src):
    return RD.roster(game_events(src))


@query("set_dedup_roster", "SELECT game_id, count(*) AS n, count(DISTINCT player_id) AS d FROM (" + _ROSTER + ") GROUP BY game_id")
def _(src):
    return RD.roster(game_events(src)).groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("player_id").alias("d"))


@query("set_union_rosters", """SELECT team_id, side, count(*) AS n FROM (SELECT c_nationkey AS team_id, 'home' AS side, c_custkey AS player_id FROM customer
  UNION SELECT s_nationkey, 'visitor', s_suppkey FROM supplier) GROUP BY ALL""")
def _(src):
    # A nation's customers are its home roster, its suppliers the one it travels with.
    home = src("customer").select(F.col("c_nationkey").alias("team_id"), F.lit("home").alias("side"), F.col("c_custkey").alias("player_id"))
    away = src("supplier").select(F.lit("visitor").alias("side"), F.col("s_suppkey").alias("player_id"), F.col("s_nationkey").alias("team_id"))
    both = home.unionByName(away).dropDuplicates(["team_id", "side", "player_id"])
    return both.groupBy("team_id", "side").agg(F.count(F.lit(1)).alias("n"))


@query("src_game_listing", "SELECT DISTINCT game_id FROM fx_tracking")
def _(src):
    # The text writer names these files .txt.gz; documents are read by content all the same.
    p = game_documents(src, "gzip")
    listing = RD.game_files(src.spark, p).select("path", "pos")
    g = RD.read_games(src.spark, p).select(F.col("gameid").alias("game_id"), F.col("_metadata.file_path").alias("path"))
    # Listing and content agree on the file; scheme prefixes differ, names do not.
    name = lambda d: d.withColumn("file", F.element_at(F.split("path", "/"), -1)).drop("path")
    return name(g).join(name(listing), "file").select("game_id")


# Labels -------------------------------------------------------------------------
cte("o_shots", """SELECT lpad(CAST(GAME_ID AS VARCHAR), 10, '0') AS game_id, PLAYER_ID AS player_id, TEAM_ID AS team_id, PERIOD AS quarter,
  CAST(MINUTES_REMAINING*60 + SECONDS_REMAINING AS DOUBLE) AS game_clock, CAST(SHOT_MADE_FLAG AS BIGINT) AS made, CAST(CASE WHEN SHOT_TYPE LIKE '%3PT%' THEN 3 ELSE 2 END AS BIGINT) AS points,
  CAST(SHOT_TYPE LIKE '%3PT%' AS BIGINT) AS is_three, CAST(SHOT_DISTANCE AS DOUBLE) AS shot_distance FROM fx_shots_raw""")
cte("o_pbp", """SELECT GAME_ID AS game_id, SEQ AS seq, PERIOD AS quarter, CAST(string_split(PCTIMESTRING, ':')[1] AS DOUBLE)*60 + CAST(string_split(PCTIMESTRING, ':')[2] AS DOUBLE) AS game_clock,
  CAST(EVENTMSGTYPE AS BIGINT) AS event_type, PLAYER1_ID AS player1_id, PLAYER1_TEAM_ID AS team_id, CAST(CASE WHEN EVENTMSGTYPE = 1 THEN CASE WHEN d LIKE '%3PT%' THEN 3 ELSE 2 END
  WHEN EVENTMSGTYPE = 3 AND d NOT LIKE '%MISS%' THEN 1 ELSE 0 END AS BIGINT) AS points FROM (SELECT *, coalesce(HOMEDESCRIPTION, '') || ' ' || coalesce(VISITORDESCRIPTION, '') AS d FROM fx_pbp_raw)""")


def shots(src):
    return RD.shots(src("fx_shots_raw"))


def pbp(src):
    return RD.play_by_play(src("fx_pbp_raw"))


@query("src_shots_csv", "SELECT * FROM o_shots")
def _(src):
    p = stage(src("fx_shots_raw"), "csv", "shots", header=True)
    return RD.shots(RD.read_csv(src.spark, p, RD.SHOTS_SCHEMA))


@query("src_pbp_csv", "SELECT * FROM o_pbp")
def _(src):
    p = stage(src("fx_pbp_raw"), "csv", "pbp", header=True)
    return RD.play_by_play(RD.read_csv(src.spark, p, RD.PBP_SCHEMA))


@query("flt_actual_clock", "SELECT seq, game_clock FROM o_pbp WHERE seq % 9 <> 0")
def _(src):
    broken = src("fx_pbp_raw").withColumn("PCTIMESTRING", F.when(F.col("SEQ") % 9 != 0, F.col("PCTIMESTRING")).otherwise("n/a"))
    return RD.play_by_play(broken).where("game_clock IS NOT NULL").select("seq", "game_clock")


cte("o_ev", "SELECT *, row_number() OVER (PARTITION BY game_id, quarter ORDER BY game_clock DESC, seq) AS i FROM o_pbp")
cte("o_fold", """SELECT game_id, quarter, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS team, 720e0 AS start, CAST(0 AS DOUBLE) AS pts,
    CAST(NULL AS BIGINT) AS e_team, 0e0 AS e_start, 0e0 AS e_end, 0e0 AS e_pts FROM (SELECT DISTINCT game_id, quarter FROM o_ev)
  UNION ALL
  SELECT f.game_id, f.quarter, e.i,
    CASE WHEN event_type IN (1, 5) THEN NULL WHEN event_type IN (1,2,4,5) AND team_id <> team THEN team_id WHEN event_type IN (2,3) AND team IS NULL THEN team_id ELSE team END,
    CASE WHEN event_type IN (1, 5) OR (event_type IN (2,4) AND team_id <> team) THEN game_clock ELSE start END,
    CASE WHEN event_type IN (1, 5) THEN 0 WHEN event_type IN (2,4) AND team_id <> team THEN CAST(e.points AS DOUBLE) ELSE pts + e.points END,
    CASE WHEN start <= game_clock THEN NULL WHEN event_type IN (1,2,4,5) AND team_id <> team THEN team WHEN event_type IN (1,5) THEN coalesce(team, team_id) END,
    start, game_clock, CASE WHEN team_id <> team THEN pts ELSE pts + e.points END
  FROM o_fold f JOIN o_ev e ON f.game_id = e.game_id AND f.quarter = e.quarter AND e.i = f.i + 1""")
cte("o_poss", """SELECT game_id, quarter, i AS poss_order, e_start AS start_clock, e_end AS end_clock, e_team AS offense_team_id, e_pts AS points FROM o_fold WHERE e_team IS NOT NULL
  UNION ALL SELECT game_id, quarter, i + 1, start, 0e0, team, pts FROM (SELECT *, max(i) OVER (PARTITION BY game_id, quarter) AS last_i FROM o_fold) WHERE i = last_i AND team IS NOT NULL AND start > 0""")


@query("win_pbp_possessions", "SELECT game_id, quarter, poss_order, start_clock, end_clock, offense_team_id, points FROM o_poss")
def _(src):
    return L.pbp_possessions(pbp(src))


@query("agg_rate_sanity", f"SELECT offense_team_id, count(*) AS n, {R('avg(points)')} AS points_per_possession FROM o_poss GROUP BY offense_team_id")
def _(src):
    return (L.pbp_possessions(pbp(src)).groupBy("offense_team_id")
            .agg(F.count(F.lit(1)).alias("n"), r4(F.avg("points")).alias("points_per_possession")))


cte("o_snap", "SELECT p.game_id, p.quarter, p.game_clock AS frame_clock, p.shot_clock AS frame_shot, p.player_id, p.team_id, p.x, p.y, b.x AS bx0, b.y AS by0 FROM fx_tracking_c p JOIN fx_tracking_c b ON p.event_id = b.event_id AND p.game_clock = b.game_clock AND b.is_ball WHERE NOT p.is_ball")
cte("o_shotm", """SELECT * FROM (SELECT s.*, m.frame_clock, m.frame_shot, m.x AS sx0, m.y AS sy0, (m.x-bx0)*(m.x-bx0)+(m.y-by0)*(m.y-by0) AS gap2,
  row_number() OVER (PARTITION BY s.game_id, s.quarter, s.game_clock, s.player_id ORDER BY (m.x-bx0)*(m.x-bx0)+(m.y-by0)*(m.y-by0), m.frame_clock DESC) AS rn
  FROM o_shots s JOIN o_snap m ON s.game_id = m.game_id AND s.quarter = m.quarter AND s.player_id = m.player_id AND round(abs(s.game_clock - m.frame_clock), 6) <= 0.8) WHERE rn = 1""")


def matched(src):
    return L.shot_moments(shots(src), P.to_frames(src("fx_tracking_c"), src.tasks))


@query("join_shot_moment", f"SELECT game_id, quarter, game_clock, player_id, frame_clock, {R('gap2')} AS ball_gap2 FROM o_shotm")
def _(src):
    return matched(src).select("game_id", "quarter", "game_clock", "player_id", "frame_clock", r4("ball_gap2").alias("ball_gap2"))


_FLX = lambda v: f"CASE WHEN s.sx0 > 47 THEN 94 - {v} ELSE {v} END"
_FLY = lambda v: f"CASE WHEN s.sx0 > 47 THEN 50 - {v} ELSE {v} END"
cte("o_shotn", f"""SELECT * FROM (SELECT s.*, {_FLX('s.sx0')} AS sx, {_FLY('s.sy0')} AS sy, {_FLX('m.x')} AS dx, {_FLY('m.y')} AS dy,
  row_number() OVER (PARTITION BY s.game_id, s.quarter, s.game_clock, s.player_id ORDER BY sqrt((m.x-s.sx0)*(m.x-s.sx0)+(m.y-s.sy0)*(m.y-s.sy0)), m.player_id) AS rk
  FROM o_shotm s JOIN o_snap m ON s.game_id = m.game_id AND s.quarter = m.quarter AND s.frame_clock = m.frame_clock AND m.team_id <> s.team_id) WHERE rk = 1""")


@query("feat_shot_label", f"""SELECT game_id, quarter, game_clock, player_id, made, points, shot_distance AS dist_to_rim, {R('abs(degrees(atan2(sy-25e0, sx-5.25e0)))')} AS angle_to_rim_deg,
  {R('n2')} AS closest_defender_dist, {R('degrees(acos(greatest(-1e0, least(1e0, (tx*ex+ty*ey)/(n1*n2+1e-9)))))')} AS defender_angle_deg, {R(pressure_sql('sx', 'sy', 'dx', 'dy'))} AS defender_pressure,
  coalesce(frame_shot, 12e0) AS shot_clock, CAST(is_three AS DOUBLE) AS is_three FROM (SELECT *, sqrt(tx*tx+ty*ty) AS n1, sqrt(ex*ex+ey*ey) AS n2 FROM
  (SELECT *, 5.25e0-sx AS tx, 25e0-sy AS ty, dx-sx AS ex, dy-sy AS ey FROM o_shotn))""")
def _(src):
    f = L.shot_label_features(matched(src))
    return f.select("game_id", "quarter", "game_clock", "player_id", "made", "points", "dist_to_rim",
                    *[r4(c).alias(c) for c in ("angle_to_rim_deg", "closest_defender_dist", "defender_angle_deg", "defender_pressure")], "shot_clock", "is_three")


@query("join_shots_game", "SELECT g.game_id, count(*) AS n_shots, CAST(sum(made) AS BIGINT) AS made FROM o_shots s JOIN (SELECT DISTINCT game_id FROM fx_tracking) g ON s.game_id = g.game_id GROUP BY g.game_id")
def _(src):
    g = src("fx_tracking").select("game_id").distinct()
    return shots(src).join(g, "game_id").groupBy("game_id").agg(F.count(F.lit(1)).alias("n_shots"), F.sum("made").alias("made"))


@query("join_games_with_pbp", "SELECT game_id, count(*) AS n FROM o_shots WHERE game_id IN (SELECT game_id FROM o_pbp WHERE seq % 80 < 40) GROUP BY game_id")
def _(src):
    return (shots(src).join(pbp(src).where("seq % 80 < 40").select("game_id"), "game_id", "left_semi")
            .groupBy("game_id").agg(F.count(F.lit(1)).alias("n")))


# Nearest-time and interval joins on event and order tables ------------------------
_US = "epoch_us(ts)/1e6"


@query("join_nearest_clock", f"""SELECT event_id, match_id, {R('gap')} AS gap FROM (SELECT v.event_id, p.event_id AS match_id, abs(v.t - p.t) AS gap,
  row_number() OVER (PARTITION BY v.event_id ORDER BY abs(v.t - p.t), p.t, CASE WHEN p.t <= v.t THEN -p.event_id ELSE p.event_id END) AS rn
  FROM (SELECT event_id, user_id, {_US} AS t FROM events WHERE event_type = 'view') v JOIN (SELECT event_id, user_id, {_US} AS t FROM events WHERE event_type = 'purchase') p
  ON v.user_id = p.user_id AND abs(v.t - p.t) <= 7200) WHERE rn = 1""")
def _(src):
    e = src("fx_series").withColumn("t", F.col("us") / 1e6)
    v = e.where("event_type = 'view'").select("user_id", "event_id", "t")
    p = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("match_id"), "t")
    d = J.nearest_time(v, p, ["user_id"], "t", "t", F.col("match_id"), 7200.0, "m", ["match_id"], Q.HOT_ROWS)
    return d.where("m IS NOT NULL").select("event_id", F.col("m.v").alias("match_id"), r4(F.abs(F.col("m.t") - F.col("t"))).alias("gap"))


@query("join_pause_recommendation", f"""SELECT event_id, match_id, has_actions FROM (SELECT v.event_id, p.event_id AS match_id, p.shown AS has_actions,
  row_number() OVER (PARTITION BY v.event_id ORDER BY p.shown DESC, abs(v.t - p.t), p.t, CASE WHEN p.t <= v.t THEN -p.event_id ELSE p.event_id END) AS rn
  FROM (SELECT event_id, user_id, {_US} AS t FROM events WHERE event_type = 'click') v JOIN (SELECT event_id, user_id, {_US} AS t, event_id % 3 = 0 AS shown FROM events WHERE event_type <> 'click') p
  ON v.user_id = p.user_id AND abs(v.t - p.t) <= 3600) WHERE rn = 1""")
def _(src):
    from hoopflow.operators import video as V
    e = src("fx_series").withColumn("t", F.col("us") / 1e6)
    pauses = e.where("event_type = 'click'").select("user_id", "event_id", "t")
    recs = e.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("match_id"), "t", (F.col("event_id") % 3 == 0).alias("has_actions"))
    d = V.recommendation_at(pauses, recs, ["user_id"], "t", "match_id", 3600.0)
    return d.where("match_id IS NOT NULL").select("event_id", "match_id", "has_actions")


# Order dates fall into month-like spans per customer segment of the key.
cte("o_spans", "SELECT k, s AS span, s*200e0 AS lo, s*200e0 + 150 AS hi FROM (SELECT DISTINCT l_orderkey % 25 AS k FROM lineitem), range(0, 60) r(s)")


@query("join_possession_interval", f"""SELECT k, day, count(*) AS n, min(span) AS span FROM (SELECT l.k, l.day, l.ln, min(span) AS span
  FROM (SELECT l_orderkey % 25 AS k, CAST(epoch_us(l_shipdate)/86400000000 AS BIGINT) AS day, row_number() OVER () AS ln FROM lineitem) l
  JOIN o_spans s ON l.k = s.k AND l.day - 8000 BETWEEN s.lo AND s.hi GROUP BY ALL) GROUP BY k, day""")
def _(src):
    day = (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86400000000).cast("long")
    pts = src("lineitem").select((F.col("l_orderkey") % 25).alias("k"), day.alias("day"), (day - 8000).cast("double").alias("at"))
    # Points that share a key and day land in the same span: reduce before the lookup.
    pts = pts.groupBy("k", "day", "at").agg(F.count(F.lit(1)).alias("n"))
    sp = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long")))
    spans = src("lineitem").select((F.col("l_orderkey") % 25).alias("k")).distinct().withColumn("span", sp)
    spans = spans.withColumns({"lo": F.col("span") * 200.0, "hi": F.col("span") * 200.0 + 150})
    d = J.in_interval(pts, spans, ["k"], "at", "lo", "hi", F.col("span"), "hit", Q.HOT_ROWS)
    return d.where("hit IS NOT NULL").select("k", "day", "n", F.col("hit").alias("span"))


@query("join_turnover_exists", """SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'
  AND epoch_us(l_shipdate) BETWEEN epoch_us(o_orderdate) AND epoch_us(o_orderdate) + CAST(1000 AS BIGINT)*86400000000) AS lost FROM orders""")
def _(src):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    o = src("orders").select("o_orderkey", F.col("o_orderkey").alias("k"), us("o_orderdate").alias("lo"), (us("o_orderdate") + 1000 * 86400000000).alias("hi"))
    li = src("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), us("l_shipdate").alias("at"))
    return J.exists_between(o, li, ["k"], "lo", "hi", "at", "lost", Q.HOT_ROWS).select("o_orderkey", "lost")


# Passes, drives, state values ------------------------------------------------------
cte("o_passes", """SELECT possession_id, prev_idx AS frame_idx, prev_h AS passer_id, handler_player_id AS receiver_id, row_number() OVER (PARTITION BY possession_id ORDER BY frame_idx DESC) AS from_end
  FROM (SELECT *, lag(handler_player_id) OVER w AS prev_h, lag(frame_idx) OVER w AS prev_idx FROM o_frames WHERE handler_player_id IS NOT NULL WINDOW w AS (PARTITION BY possession_id ORDER BY frame_idx))
  WHERE prev_h <> handler_player_id""")


@query("win_passes", "SELECT * FROM o_passes")
def _(src):
    return L.passes(frames(src)).select("possession_id", "frame_idx", "passer_id", "receiver_id", F.col("from_end").cast("long").alias("from_end"))


cte("o_dist", """SELECT f.*, CASE WHEN p.player_id IS NOT NULL THEN sqrt((p.x-5.25e0)*(p.x-5.25e0)+(p.y-25e0)*(p.y-25e0)) END AS d, p.y AS py FROM (
  SELECT possession_id, frame_idx, handler_player_id, last_value(handler_player_id IGNORE NULLS) OVER (PARTITION BY possession_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS owner FROM o_frames) f
  LEFT JOIN o_players p ON f.possession_id = p.possession_id AND f.frame_idx = p.frame_idx AND p.player_id = f.owner WHERE owner IS NOT NULL""")
cte("o_dcand", """SELECT possession_id, i0, frame_idx, owner, py, mn FROM (SELECT a.possession_id, a.i0, a.frame_idx, a.owner, a.py, a.d, a.handler_player_id, min(b.d) AS mn
  FROM (SELECT *, min(frame_idx) OVER (PARTITION BY possession_id, run) AS i0 FROM (SELECT *, sum(chg) OVER (PARTITION BY possession_id ORDER BY frame_idx) AS run FROM
     (SELECT *, CASE WHEN owner IS DISTINCT FROM lag(owner) OVER (PARTITION BY possession_id ORDER BY frame_idx) THEN 1 ELSE 0 END AS chg FROM o_dist))) a
  JOIN (SELECT *, min(frame_idx) OVER (PARTITION BY possession_id, run) AS i0 FROM (SELECT *, sum(chg) OVER (PARTITION BY possession_id ORDER BY frame_idx) AS run FROM
     (SELECT *, CASE WHEN owner IS DISTINCT FROM lag(owner) OVER (PARTITION BY possession_id ORDER BY frame_idx) THEN 1 ELSE 0 END AS chg FROM o_dist))) b
  ON a.possession_id = b.possession_id AND a.i0 = b.i0 AND b.frame_idx BETWEEN a.frame_idx AND a.frame_idx + 49 GROUP BY ALL)
  WHERE handler_player_id IS NOT NULL AND d - mn >= 1.5e0""")
cte("o_dpick", """SELECT possession_id, i0, min(frame_idx) AS frame_idx FROM o_dcand GROUP BY ALL
  UNION ALL SELECT p.possession_id, p.i0, n.frame_idx FROM o_dpick p JOIN LATERAL (SELECT c.frame_idx FROM o_dcand c WHERE c.possession_id = p.possession_id AND c.i0 = p.i0
    AND c.frame_idx >= p.frame_idx + 50 ORDER BY c.frame_idx LIMIT 1) n ON true""")
cte("o_drives", """SELECT possession_id, frame_idx, owner AS driver_id, CASE WHEN py > 29 THEN 'left' WHEN py < 21 THEN 'right' ELSE 'middle' END AS direction,
  CAST(CASE WHEN mn <= 14 THEN 1 ELSE 0 END AS BIGINT) AS success FROM o_dpick JOIN o_dcand USING (possession_id, i0, frame_idx)""")


@query("win_drives", "SELECT * FROM o_drives")
def _(src):
    # The view's players move slowly: a smaller drop than the default 6 ft.
    return L.drives(frames(src), drop=1.5, reach=14.0).select("possession_id", "frame_idx", "driver_id", "direction", F.col("success").cast("long").alias("success"))


@query("ord_upper_median", "SELECT possession_id, list_sort(list(game_clock))[1 + CAST(floor(count(*)/2) AS BIGINT)] AS mid_clock FROM o_frames GROUP BY possession_id")
def _(src):
    return frames(src).groupBy("possession_id").agg(L.upper_median("game_clock").alias("mid_clock"))


cte("o_real", """SELECT possession_id, game_id, quarter, n, mid_clock, offense_team_id, start_clock, end_clock, points,
   points = 0 AND EXISTS (SELECT 1 FROM o_pbp e WHERE e.game_id = r.game_id AND e.quarter = r.quarter AND e.event_type = 5 AND e.team_id = r.offense_team_id AND e.game_clock BETWEEN r.end_clock AND r.start_clock) AS is_turnover
 FROM (SELECT f.*, p.start_clock, p.end_clock, p.points, p.offense_team_id AS real_team, row_number() OVER (PARTITION BY f.possession_id ORDER BY p.poss_order) AS rk
  FROM (SELECT possession_id, any_value(game_id) AS game_id, any_value(quarter) AS quarter, any_value(offense_team_id) AS offense_team_id, count(*) AS n,
     list_sort(list(game_clock))[1 + CAST(floor(count(*)/2) AS BIGINT)] AS mid_clock FROM o_frames GROUP BY possession_id HAVING count(*) >= 15) f
  JOIN o_poss p ON f.game_id = p.game_id AND f.quarter = p.quarter AND f.mid_clock BETWEEN p.end_clock AND p.start_clock) r WHERE rk = 1 AND real_team = offense_team_id""")


def labelled(src, f=None):
    b = pbp(src)
    return L.label_possessions(f if f is not None else frames(src), b, L.pbp_possessions(b))


@query("flt_offense_agrees", "SELECT possession_id, n, mid_clock, offense_team_id, start_clock, end_clock, points, is_turnover FROM o_real")
def _(src):
    return labelled(src).select("possession_id", "n", "mid_clock", "offense_team_id", "start_clock", "end_clock", "points", "is_turnover")


_STEP = "CAST(floor(greatest(0e0, start_clock - f.game_clock)/2) AS BIGINT)"


@query("feat_v_states", f"SELECT f.possession_id, f.frame_idx, {_STEP} AS step, points AS y, CASE WHEN {_STEP} = 0 THEN 0.4e0 ELSE 1e0 END AS w FROM o_frames f JOIN o_real r USING (possession_id) WHERE frame_idx % 15 = 0")
def _(src):
    f = frames(src)
    r = labelled(src, f).select("possession_id", "start_clock", "points")
    d = f.where("frame_idx % 15 = 0").join(r, "possession_id").withColumn("step", FT.step_index("start_clock", "game_clock"))
    return d.select("possession_id", "frame_idx", "step", F.col("points").alias("y"), FT.step_weight("step").alias("w"))


@query("win_step_weight", f"SELECT event_id, CAST(floor(greatest(0e0, 60 - value)/2) AS BIGINT) AS step, CASE WHEN floor(greatest(0e0, 60 - value)/2) = 0 THEN 0.4e0 ELSE 1e0 END AS w FROM events")
def _(src):
    d = src("events").select("event_id", F.lit(60.0).alias("start"), F.col("value").alias("clk"))
    return d.withColumn("step", FT.step_index("start", "clk")).select("event_id", "step", FT.step_weight("step").alias("w"))


@query("win_subsample", "SELECT possession_id, frame_idx FROM o_frames WHERE frame_idx % 15 = 0")
def _(src):
    f = frames(src).select(*P.EVENT, "possession_id", "frame_idx")
    return Q.every_nth(f, Q.seq(L.POSS, ["frame_idx"]), 15).select("possession_id", "frame_idx")
