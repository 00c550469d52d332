"""Detection, identity, homography and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoopflow import fixed as K
from hoopflow.functions import geometry as G, scalars as S
from hoopflow.functions.geometry import r4
from hoopflow.operators import aggregates as AG, joins as J, ordering as O, sequence as Q, video as V
from hoopflow.plans.q_geometry import project_sql
from hoopflow.plans.registry import R, cte, query
from hoopflow.plans.views import IMG_H, IMG_W
from hoopflow.sources import readers as RD

TRK = "clip_id, track_id"


# Filters ----------------------------------------------------------------------------
@query("flt_detection_conf", "SELECT clip_id, frame_idx, det_no, cls FROM fx_detections WHERE CASE WHEN cls = 'ball' THEN conf >= 0.6 WHEN cls IN ('player','referee','rim') THEN conf >= 0.8 ELSE false END")
def _(src):
    return RD.confident(src("fx_detections"), 0.8, 0.6).select("clip_id", "frame_idx", "det_no", "cls")


@query("flt_keypoint_conf", "SELECT clip_id, frame_idx, count(*) AS n FROM fx_keypoints WHERE conf >= 0.5 GROUP BY ALL HAVING count(*) >= 4")
def _(src):
    return src("fx_keypoints").where("conf >= 0.5").groupBy("clip_id", "frame_idx").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")


@query("flt_track_length", f"SELECT {TRK}, count(*) AS n, count(jersey_read) AS n_read FROM fx_track_points GROUP BY ALL HAVING count(*) >= 20 AND count(jersey_read) >= 1")
def _(src):
    return (src("fx_track_points").groupBy(*V.TRACK).agg(F.count(F.lit(1)).alias("n"), F.count("jersey_read").alias("n_read"))
            .where("n >= 20 AND n_read >= 1"))


@query("flt_on_floor_tracks", f"""SELECT {TRK}, n, {R('mx')} AS mx, {R('my')} AS my FROM (SELECT {TRK}, count(*) AS n, median(x) AS mx, median(y) AS my FROM fx_track_points GROUP BY ALL)
  JOIN (SELECT clip_id, count(*) AS frames FROM fx_video_frames GROUP BY ALL) USING (clip_id) WHERE n/frames >= 0.25 AND mx BETWEEN -3 AND 97 AND my BETWEEN -3 AND 53 AND my BETWEEN 1.5 AND 48.5""")
def _(src):
    return V.on_floor_tracks(src("fx_track_points"), src("fx_video_frames")).select("clip_id", "track_id", "n", r4("mx").alias("mx"), r4("my").alias("my"))


@query("flt_clip_events", "SELECT event_id, event_type FROM events WHERE event_id % 2 = 1 AND event_type IN ('purchase', 'view', 'error')")
def _(src):
    return O.clip_events(src("events"), F.col("event_id") % 2, "event_type", ["purchase", "view", "error"]).select("event_id", "event_type")


@query("flt_placeholder_clip", "SELECT clip_id, max(n) <= 1 AS placeholder FROM (SELECT clip_id, frame_idx, count(*) FILTER (WHERE cls = 'player' AND conf >= 0.97) AS n FROM fx_detections JOIN (SELECT clip_id, max(frame_idx) + 1 AS len FROM fx_detections GROUP BY clip_id) USING (clip_id) WHERE frame_idx IN (3 * len // 10, len // 2, 7 * len // 10) GROUP BY ALL) GROUP BY clip_id")
def _(src):
    return V.placeholder_clips(V.probe_frames(src("fx_detections")), 0.97)


@query("flt_showable", "SELECT event_id, value/100 >= 0.6 AND event_id % 12 >= 8 AND event_id % 5 > 0 AS showable FROM events")
def _(src):
    e = F.col("event_id")
    return src("events").select("event_id", O.showable(F.col("value") / 100, e % 12, e % 5 > 0).alias("showable"))


# Identity ---------------------------------------------------------------------------
cte("o_jv", f"""SELECT {TRK}, any_value(team_label) AS team_label, count(*) AS len FROM fx_track_points GROUP BY ALL""")
cte("o_jersey", f"""SELECT v.*, j.jersey, coalesce(j.n/CAST(len AS DOUBLE), 0e0) AS agreement FROM o_jv v LEFT JOIN (SELECT {TRK}, jersey_read AS jersey, n FROM (SELECT {TRK}, jersey_read, count(*) AS n,
  row_number() OVER (PARTITION BY {TRK} ORDER BY count(*) DESC, min(frame_idx), jersey_read) AS rk FROM fx_track_points WHERE jersey_read IS NOT NULL GROUP BY {TRK}, jersey_read) WHERE rk = 1) j USING ({TRK})""")
cte("o_hits", """SELECT s.clip_id, s.team_label, t.team_id, count(DISTINCT s.jersey) AS hits FROM (SELECT DISTINCT clip_id, team_label, jersey FROM o_jersey WHERE jersey IS NOT NULL) s
  CROSS JOIN (SELECT DISTINCT team_id FROM fx_roster) t JOIN fx_roster r ON r.team_id = t.team_id AND r.jersey = s.jersey GROUP BY ALL""")
cte("o_cmap", """SELECT clip_id, l.team_label, CASE WHEN (l.team_label = 0) = (straight >= crossed) THEN 1 ELSE 2 END AS team_id FROM (SELECT c.clip_id,
   coalesce(sum(hits) FILTER (WHERE (team_label = 0 AND team_id = 1) OR (team_label = 1 AND team_id = 2)), 0) AS straight,
   coalesce(sum(hits) FILTER (WHERE (team_label = 0 AND team_id = 2) OR (team_label = 1 AND team_id = 1)), 0) AS crossed
  FROM (SELECT DISTINCT clip_id FROM o_jersey WHERE jersey IS NOT NULL) c LEFT JOIN o_hits USING (clip_id) GROUP BY c.clip_id), (SELECT unnest([0, 1]) AS team_label) l""")
cte("o_ident", f"""SELECT j.clip_id, j.track_id, j.team_label, m.team_id, j.jersey, r.player_id, round_even((CASE WHEN r.player_id IS NOT NULL THEN agreement ELSE least(agreement, 0.3e0) END)*1000, 0)/1000 AS confidence
  FROM o_jersey j LEFT JOIN o_cmap m ON j.clip_id = m.clip_id AND j.team_label = m.team_label LEFT JOIN fx_roster r ON r.team_id = m.team_id AND r.jersey = j.jersey""")


def ident(src):
    return V.identities(src("fx_track_points"), src("fx_roster"))


@query("join_identity", f"SELECT {TRK}, team_id, jersey, player_id, {R('confidence')} AS confidence FROM o_ident")
def _(src):
    return ident(src).select("clip_id", "track_id", F.col("team_id"), "jersey", "player_id", r4("confidence").alias("confidence"))


@query("join_cluster_team", "SELECT clip_id, team_label, team_id FROM o_cmap")
def _(src):
    return V.cluster_teams(V.jersey_sets(V.jersey_votes(src("fx_track_points"))), src("fx_roster"))


@query("agg_jersey_sets", "SELECT clip_id, team_label, string_agg(CAST(jersey AS VARCHAR), ',' ORDER BY jersey) AS jerseys FROM (SELECT DISTINCT clip_id, team_label, jersey FROM o_jersey WHERE jersey IS NOT NULL) GROUP BY ALL")
def _(src):
    s = V.jersey_sets(V.jersey_votes(src("fx_track_points")))
    return s.select("clip_id", "team_label", F.array_join(F.transform("jerseys", lambda j: j.cast("string")), ",").alias("jerseys"))


@query("set_intersect_jerseys", "SELECT clip_id, team_label, team_id, hits FROM o_hits")
def _(src):
    s = V.jersey_sets(V.jersey_votes(src("fx_track_points")))
    return V.jersey_hits(s, src("fx_roster"))


@query("agg_identity_accuracy", f"SELECT count(*) AS n, {R('avg(CAST(player_id = truth AS DOUBLE))')} AS accuracy FROM o_ident JOIN (SELECT DISTINCT {TRK}, true_player_id AS truth FROM fx_track_points) USING ({TRK}) WHERE player_id IS NOT NULL")
def _(src):
    t = V.true_ids(src("fx_track_points"), "true_player_id", "truth")
    d = ident(src).where("player_id IS NOT NULL").join(t, V.TRACK)
    return d.agg(F.count(F.lit(1)).alias("n"), r4(AG.share(F.col("player_id") == F.col("truth"))).alias("accuracy"))


@query("agg_team_accuracy", f"SELECT clip_id, count(*) AS n, {R('greatest(avg(a), 1 - avg(a))')} AS accuracy FROM (SELECT clip_id, CAST((team_label = 0) = (truth = 't1') AS DOUBLE) AS a FROM (SELECT {TRK}, any_value(team_label) AS team_label, any_value(true_team) AS truth FROM fx_track_points GROUP BY ALL)) GROUP BY clip_id")
def _(src):
    p = src("fx_track_points")
    d = p.groupBy(*V.TRACK).agg(F.first("team_label").alias("team_label")).join(V.true_ids(p, "true_team", "truth"), V.TRACK)
    hit = AG.share((F.col("team_label") == 0) == (F.col("truth") == "t1"))
    return d.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), r4(F.greatest(hit, 1 - hit)).alias("accuracy"))


@query("agg_track_purity", f"SELECT {R('avg(m/CAST(n AS DOUBLE))')} AS purity, count(*) AS tracks FROM (SELECT {TRK}, max(c) AS m, sum(c) AS n FROM (SELECT {TRK}, coalesce(true_player_id, -1) AS j, count(*) AS c FROM fx_track_points GROUP BY ALL) GROUP BY {TRK})")
def _(src):
    c = src("fx_track_points").groupBy(*V.TRACK, F.coalesce("true_player_id", F.lit(-1)).alias("j")).agg(F.count(F.lit(1)).alias("c"))
    t = c.groupBy(*V.TRACK).agg((F.max("c") / F.sum("c")).alias("p"))
    return t.agg(r4(F.avg("p")).alias("purity"), F.count(F.lit(1)).alias("tracks"))


@query("agg_weighted_vote", f"""SELECT {TRK}, jersey_read AS jersey, {R('w')} AS weight FROM (SELECT *, row_number() OVER (PARTITION BY {TRK} ORDER BY w DESC, f, jersey_read) AS rk FROM
  (SELECT {TRK}, jersey_read, sum(conf) AS w, min(rn) AS f FROM (SELECT *, row_number() OVER (PARTITION BY {TRK} ORDER BY y2 - y1 DESC, frame_idx) AS rn FROM fx_track_points) WHERE rn <= 5 AND jersey_read IS NOT NULL GROUP BY ALL)) WHERE rk = 1 AND w >= 1""")
def _(src):
    return V.weighted_jersey(src("fx_track_points")).select("clip_id", "track_id", "jersey", r4("weight").alias("weight"))


cte("o_rov", """SELECT clip_id, frame_idx, team_label, team_abbr FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_idx, team_label ORDER BY n DESC, f, team_abbr) AS rk FROM
  (SELECT p.clip_id, p.frame_idx, p.team_label, r.team_abbr, count(*) AS n, min(p.track_id) AS f FROM fx_track_points p JOIN fx_roster r ON r.jersey = p.jersey_read GROUP BY ALL)) WHERE rk = 1""")


@query("join_roster_override", """SELECT p.clip_id, p.frame_idx, p.track_id, CASE WHEN v.team_abbr IS NOT NULL THEN v.team_abbr WHEN u.used IS NULL THEN CAST(p.team_label AS VARCHAR)
  WHEN u.used = 'AAA' THEN 'BBB' ELSE 'AAA' END AS team FROM fx_track_points p LEFT JOIN o_rov v ON p.clip_id = v.clip_id AND p.frame_idx = v.frame_idx AND p.team_label = v.team_label
  LEFT JOIN (SELECT clip_id, frame_idx, string_agg(DISTINCT team_abbr, ',') AS used FROM o_rov GROUP BY ALL) u ON p.clip_id = u.clip_id AND p.frame_idx = u.frame_idx""")
def _(src):
    p = src("fx_track_points").select("clip_id", "frame_idx", "track_id", F.col("team_label").alias("team_id"), F.col("jersey_read").alias("jersey"))
    link = src("fx_roster").where("jersey IS NOT NULL").select("jersey", F.col("team_abbr").alias("team"))
    return V.roster_override(p, link).select("clip_id", "frame_idx", "track_id", "team")


@query("join_track_frames", "SELECT clip_id, frame_idx, track_id, coalesce(i.player_id, -(1000 + track_id)) AS pid, (x1+x2)/2 AS foot_x, y2 AS foot_y FROM fx_track_points LEFT JOIN o_ident i USING (clip_id, track_id)")
def _(src):
    p = src("fx_track_points").select("clip_id", "frame_idx", "track_id", *[c.alias(n) for c, n in zip(G.box_foot("x1", "y1", "x2", "y2"), ("foot_x", "foot_y"))])
    d = p.join(ident(src).select("clip_id", "track_id", "player_id"), V.TRACK, "left")
    return d.select("clip_id", "frame_idx", "track_id", S.fallback_id("player_id", "track_id").alias("pid"), "foot_x", "foot_y")


cte("o_truth", "SELECT event_id AS clip_id, CAST(floor(moment_pos/5e0) AS BIGINT) AS frame_idx, player_id, x, y FROM fx_tracking WHERE NOT is_ball AND moment_pos % 5 = 0")
cte("o_gap", """SELECT t.clip_id, t.frame_idx, t.player_id, sqrt((p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y)) AS e, i.player_id AS claimed FROM o_truth t
  LEFT JOIN fx_track_points p ON t.clip_id = p.clip_id AND t.frame_idx = p.frame_idx AND t.player_id = p.true_player_id LEFT JOIN o_ident i ON p.clip_id = i.clip_id AND p.track_id = i.track_id""")


def recovered(src):
    p = src("fx_track_points")
    i = ident(src).select("clip_id", "track_id", F.col("player_id").alias("claimed_id"))
    truth = (src("fx_tracking").where("NOT is_ball AND moment_pos % 5 = 0")
             .select(F.col("event_id").alias("clip_id"), F.floor(F.col("moment_pos") / 5).alias("frame_idx"), "player_id", "x", "y"))
    rec = p.join(i, V.TRACK, "left").select("clip_id", "frame_idx", F.col("true_player_id").alias("player_id"), "x", "y", "claimed_id")
    return rec, truth


@query("join_domain_gap", f"SELECT clip_id, frame_idx, player_id, {R('e')} AS err FROM o_gap WHERE e IS NOT NULL")
def _(src):
    rec, truth = recovered(src)
    j = truth.join(rec.select("clip_id", "frame_idx", "player_id", F.col("x").alias("rx"), F.col("y").alias("ry")), ["clip_id", "frame_idx", "player_id"])
    return j.select("clip_id", "frame_idx", "player_id", r4(G.dist("rx", "ry", "x", "y")).alias("err"))


@query("agg_domain_gap", f"""SELECT clip_id, {R('median(e)')} AS err_median, {R('avg(e)')} AS err_mean, {R('quantile_cont(e, 0.9)')} AS err_p90, {R('1 - count(e)/CAST(count(*) AS DOUBLE)')} AS miss_rate,
  {R('coalesce(1 - count(*) FILTER (WHERE claimed = player_id)/CAST(nullif(count(claimed), 0) AS DOUBLE), 1e0)')} AS id_error FROM o_gap GROUP BY clip_id""")
def _(src):
    rec, truth = recovered(src)
    g = AG.domain_gap(rec, truth, ["clip_id", "frame_idx", "player_id"], ["clip_id"])
    return g.select("clip_id", *[r4(c).alias(c) for c in ("err_median", "err_mean", "err_p90", "miss_rate", "id_error")])


@query("agg_team_clusters")
def _(src):
    d = src("fx_detections").where("cls = 'player'").withColumnRenamed("det_no", "track_id")
    return V.team_clusters(d)


@query("win_assign_tracks")
def _(src):
    return V.assign_tracks(src("fx_detections"), src("fx_video_frames"))


# Homography -------------------------------------------------------------------------
@query("agg_homography_fit")
def _(src):
    f = V.fit_homographies(src("fx_keypoints"), ["clip_id", "frame_idx"])
    return f.select("clip_id", "frame_idx", r4("median_ft").alias("median_ft"), "n_points", "ok")


@query("win_corner_smooth")
def _(src):
    f = V.smooth_corners(V.fit_homographies(src("fx_keypoints"), ["clip_id", "frame_idx"]), ["clip_id"], "frame_idx")
    x, y = G.project("h_smooth", F.lit(640.0), F.lit(400.0))
    return f.select("clip_id", "frame_idx", "ok", r4(x).alias("court_x"), r4(y).alias("court_y"))


# Corners in turn: 0 (0, 0), 1 (94, 0), 2 (94, 50), 3 (0, 50); ``i`` is the inverse of h.
_AT = lambda row, x, y: f"(i[{3 * row + 1}]*{x} + i[{3 * row + 2}]*{y} + i[{3 * row + 3}])"
_PX = ", ".join(f"{_AT(0, x, y)}/{_AT(2, x, y)} AS x{n}, {_AT(1, x, y)}/{_AT(2, x, y)} AS y{n}" for n, (x, y) in enumerate([(0, 0), (94, 0), (94, 50), (0, 50)]))
cte("o_corner_px", f"""SELECT clip_id, frame_idx, {_PX} FROM (SELECT clip_id, frame_idx, list_transform([m*r - n*q, l*q - k*r, k*n - l*m, n*p - j*r, h0*r - l*p, l*j - h0*n, j*q - m*p, k*p - h0*q, h0*m - k*j],
    lambda v: v/(h0*(m*r - n*q) + k*(n*p - j*r) + l*(j*q - m*p))) AS i FROM
  (SELECT clip_id, frame_idx, h[1] AS h0, h[2] AS k, h[3] AS l, h[4] AS j, h[5] AS m, h[6] AS n, h[7] AS p, h[8] AS q, h[9] AS r FROM fx_homographies WHERE reproj_ft <= 2))""")
cte("o_corner_mean", f"""SELECT clip_id, frame_idx, {', '.join(f'avg({a}{n}) OVER w AS {a}{n}' for n in range(4) for a in 'xy')} FROM o_corner_px
  WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
cte("o_corner_map", """SELECT clip_id, frame_idx, x1 - x0 + g*x1 AS a, x3 - x0 + h*x3 AS b, x0 AS c, y1 - y0 + g*y1 AS d, y3 - y0 + h*y3 AS e, y0 AS f, g, h FROM
  (SELECT *, ((x0-x1+x2-x3)*(y3-y2) - (x3-x2)*(y0-y1+y2-y3))/det AS g, ((x1-x2)*(y0-y1+y2-y3) - (x0-x1+x2-x3)*(y1-y2))/det AS h FROM
    (SELECT *, (x1-x2)*(y3-y2) - (x3-x2)*(y1-y2) AS det FROM o_corner_mean))""")
# The point (640, 400) goes through the inverse of [[a, b, c], [d, e, f], [g, h, 1]] to the unit square, then to the court's size.
cte("o_corner_pt", """SELECT clip_id, frame_idx, 94*((e - f*h)*640 + (c*h - b)*400 + (b*f - c*e))/w AS x, 50*((f*g - d)*640 + (a - c*g)*400 + (c*d - a*f))/w AS y FROM
  (SELECT *, (d*h - e*g)*640 + (b*g - a*h)*400 + (a*e - b*d) AS w FROM o_corner_map)""")


@query("win_corner_smooth_maps", f"""SELECT f.clip_id, f.frame_idx, {R('last_value(x IGNORE NULLS) OVER w')} AS court_x, {R('last_value(y IGNORE NULLS) OVER w')} AS court_y FROM fx_homographies f
  LEFT JOIN o_corner_pt p ON p.clip_id = f.clip_id AND p.frame_idx = f.frame_idx WINDOW w AS (PARTITION BY f.clip_id ORDER BY f.frame_idx ROWS UNBOUNDED PRECEDING)""")
def _(src):
    f = src("fx_homographies").select("clip_id", "frame_idx", "h", (F.col("reproj_ft") <= 2).alias("ok"))
    f = V.smooth_corners(f, ["clip_id"], "frame_idx", hold_first=False)
    x, y = G.project("h_smooth", F.lit(640.0), F.lit(400.0))
    return f.select("clip_id", "frame_idx", r4(x).alias("court_x"), r4(y).alias("court_y"))


@query("join_homography_source", f"""SELECT clip_id, frame_idx, CASE WHEN n_inliers >= 6 AND reproj_ft <= 2 AND plausible THEN 'model' ELSE 'calibration' END AS source,
  {R('CASE WHEN n_inliers >= 6 AND reproj_ft <= 2 AND plausible THEN f.h[1] ELSE c.h[1] END * 1000')} AS h0 FROM fx_homographies f JOIN o_plausible USING (clip_id, frame_idx) LEFT JOIN fx_calibrations c USING (clip_id)""")
def _(src):
    d = V.pick_homography(src("fx_homographies"), src("fx_calibrations"), ["clip_id"], IMG_W, IMG_H)
    return d.select("clip_id", "frame_idx", "source", r4(G.h_at("h", 0) * 1000).alias("h0"))


@query("agg_accept_rate", f"SELECT clip_id, count(*) AS n, {R('avg(CAST(n_inliers >= 6 AND reproj_ft <= 2 AND plausible AS DOUBLE))')} AS accept_rate FROM fx_homographies JOIN o_plausible USING (clip_id, frame_idx) GROUP BY clip_id")
def _(src):
    d = V.pick_homography(src("fx_homographies"), src("fx_calibrations"), ["clip_id"], IMG_W, IMG_H)
    return d.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), r4(AG.share(F.col("accepted"))).alias("accept_rate"))


_KX, _KY = project_sql("h", "px", "py")
cte("o_kres", f"""SELECT clip_id, frame_idx, conf, sqrt((px-true_px)*(px-true_px)+(py-true_py)*(py-true_py)) AS px_err, sqrt((kx-court_x)*(kx-court_x)+(ky-court_y)*(ky-court_y)) AS ft
  FROM (SELECT k.*, {_KX} AS kx, {_KY} AS ky FROM fx_keypoints k JOIN fx_calibrations USING (clip_id))""")


def residuals(src):
    d = src("fx_keypoints").join(src("fx_calibrations").select("clip_id", "h"), "clip_id")
    return V.keypoint_residuals(d)


@query("agg_reproj_error", f"SELECT clip_id, frame_idx, {R('median(ft)')} AS reproj_ft FROM o_kres GROUP BY clip_id, frame_idx")
def _(src):
    return residuals(src).groupBy("clip_id", "frame_idx").agg(r4(F.median("ft")).alias("reproj_ft"))


@query("agg_keypoint_eval", f"""SELECT {R('px')} AS px_median, {R('fm')} AS ft_median, {R('solve')} AS solve_rate, {R('used')} AS mean_used FROM
  (SELECT median(px_err) AS px FROM o_kres WHERE conf >= 0.5), (SELECT median(m) FILTER (WHERE u >= 6) AS fm, count(*) FILTER (WHERE u >= 6 AND m <= 2)/CAST(count(*) AS DOUBLE) AS solve, avg(u) AS used
   FROM (SELECT clip_id, frame_idx, count(*) FILTER (WHERE conf >= 0.5) AS u, median(ft) FILTER (WHERE conf >= 0.5) AS m FROM o_kres GROUP BY ALL))""")
def _(src):
    e = V.keypoint_eval(residuals(src))
    return e.select(*[r4(c).alias(c) for c in ("px_median", "ft_median", "solve_rate", "mean_used")])


@query("agg_diagnostics", f"""SELECT f.clip_id, {R('avg(CAST(reproj_ft <= 2 AS DOUBLE))')} AS homog_valid_rate, {R('avg(coalesce(np, 0))')} AS mean_players, {R('avg(CAST(coalesce(nb, 0) > 0 AS DOUBLE))')} AS ball_recall
FROM fx_homographies f LEFT JOIN (SELECT clip_id, frame_idx, count(*) FILTER (WHERE cls = 'player') AS np, count(*) FILTER (WHERE cls = 'ball') AS nb FROM fx_detections GROUP BY ALL) USING (clip_id, frame_idx) GROUP BY f.clip_id""")
def _(src):
    ok = src("fx_homographies").select("clip_id", "frame_idx", (F.col("reproj_ft") <= 2).alias("homog_ok"))
    d = V.diagnostics(ok, src("fx_detections"), ["clip_id"])
    return d.select("clip_id", *[r4(c).alias(c) for c in ("homog_valid_rate", "mean_players", "ball_recall")])


# Camera shots and pauses ---------------------------------------------------------------
_SQ = """SELECT clip_id, shot, vec_id, t, n_players, row_number() OVER (PARTITION BY clip_id ORDER BY -least(n_players, 12), -frac, t) AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY clip_id, shot ORDER BY frac DESC, t) AS rk FROM fx_shot_frames) WHERE rk = 1 AND frac >= 0.2 AND n_players >= 2"""


@query("agg_shot_quality", _SQ)
def _(src):
    return V.shot_quality(src("fx_shot_frames"), 0.2, 2).select("clip_id", "shot", "vec_id", "t", "n_players", F.col("rank").cast("long").alias("rank"))


cte("o_sq", _SQ)
cte("o_picked", """SELECT clip_id, CAST(0 AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS vec_id, CAST(NULL AS DOUBLE) AS t, CAST([] AS DOUBLE[]) AS had, CAST([] AS DOUBLE[]) AS picks FROM (SELECT DISTINCT clip_id FROM o_sq)
  UNION ALL SELECT p.clip_id, q.rank, q.vec_id, CAST(q.t AS DOUBLE), p.picks, CASE WHEN len(p.picks) < 3 AND len(list_filter(p.picks, lambda v: abs(v - q.t) < 8)) = 0 THEN list_append(p.picks, CAST(q.t AS DOUBLE)) ELSE p.picks END
  FROM o_picked p JOIN o_sq q ON q.clip_id = p.clip_id AND q.rank = p.rank + 1""")


@query("ord_spread_top_n", "SELECT clip_id, rank, vec_id, t FROM o_picked WHERE len(picks) > len(had)")
def _(src):
    d = V.shot_quality(src("fx_shot_frames"), 0.2, 2).select("clip_id", F.col("rank").cast("long").alias("rank"), "vec_id", "t")
    return V.spread_top(d, ["clip_id"], "rank", "t", n=3, gap=8.0)


@query("join_pause_shot", "SELECT p.vec_id, max(s.vec_id) AS anchor FROM fx_shot_frames p JOIN fx_shot_frames s ON p.clip_id = s.clip_id AND s.vec_id % 7 = 0 AND s.t <= p.t GROUP BY p.vec_id")
def _(src):
    f = src("fx_shot_frames")
    d = J.around(f.select("clip_id", "vec_id", "t"), f.where("vec_id % 7 = 0").select("clip_id", "t", F.col("vec_id").alias("a")), ["clip_id"], "t", "t", {"a": F.col("a")}, ["a"])
    return d.where("prev_a IS NOT NULL").select("vec_id", F.col("prev_a.v").alias("anchor"))


@query("join_pause_context", "SELECT p.clip_id, p.frame_idx AS pause, c.frame_idx, c.det_no FROM (SELECT * FROM fx_video_frames WHERE frame_idx % 8 = 0) p JOIN fx_detections c ON p.clip_id = c.clip_id AND c.frame_idx BETWEEN p.frame_idx - 3 AND p.frame_idx + 3")
def _(src):
    pauses = src("fx_video_frames").where("frame_idx % 8 = 0").select("clip_id", F.col("frame_idx").alias("pause"))
    return V.pause_context(pauses, src("fx_detections").select("clip_id", "frame_idx", "det_no"), 3)


@query("set_seed_override", f"SELECT clip_id, frame_idx, det_no, {R('(x1+x2)/2')} AS cx FROM fx_detections WHERE NOT (cls = 'ball' AND frame_idx = 0) UNION ALL SELECT DISTINCT clip_id, 0, -2, clip_id*10e0 FROM fx_video_frames")
def _(src):
    seeds = src("fx_video_frames").select("clip_id").distinct().select("clip_id", (F.col("clip_id") * 10.0).alias("sx"), F.lit(300.0).alias("sy"))
    return V.seed_ball(src("fx_detections"), seeds).select("clip_id", "frame_idx", "det_no", r4((F.col("x1") + F.col("x2")) / 2).alias("cx"))


@query("set_union_shots", "SELECT clip_id, video_time, event_id, row_number() OVER (PARTITION BY clip_id ORDER BY video_time, event_id) AS pos FROM fx_recs")
def _(src):
    r = src("fx_recs").select("clip_id", "video_time", "event_id")
    u = r.where("event_id % 2 = 0").unionByName(r.where("event_id % 2 = 1"))
    # Five clips hold all rows: the position is computed in blocks.
    d, s = Q.split_hot(u, Q.seq(["clip_id"], ["video_time", "event_id"]))
    return Q.unsplit(Q.scan(d, s, index="pos"))


# Evaluation ---------------------------------------------------------------------------
@query("agg_brier", f"SELECT game, count(*) AS n, {R('avg((p-y)*(p-y))')} AS brier, {R('var_pop(y)')} AS brier_base FROM fx_scored GROUP BY game")
def _(src):
    return AG.brier(src("fx_scored"), "p", "y", ["game"]).select("game", "n", r4("brier").alias("brier"), r4("brier_base").alias("brier_base"))


@query("agg_reliability", f"SELECT CAST(least(floor(p*10), 9) AS BIGINT) AS bin, count(*) AS n, {R('avg(p)')} AS mean_p, {R('avg(y)')} AS mean_y FROM fx_scored GROUP BY ALL")
def _(src):
    d = AG.reliability(src("fx_scored"), "p", "y")
    return d.select(F.col("bin").cast("long").alias("bin"), "n", r4("mean_p").alias("mean_p"), r4("mean_y").alias("mean_y"))


@query("agg_value_metrics", f"SELECT {R('avg((p-y)*(p-y))')} AS mse, {R('var_pop(y)')} AS mse_baseline, {R('corr(p, y)')} AS corr, {R('avg(y)')} AS ppp FROM fx_scored")
def _(src):
    d = AG.value_metrics(src("fx_scored"), "p", "y")
    return d.select(*[r4(c).alias(c) for c in ("mse", "mse_baseline", "corr", "ppp")])


@query("agg_regret", " UNION ALL ".join(f"""SELECT '{p}' AS policy, count(*) AS n, {R('avg(CAST(r <= 1e-6 AS DOUBLE))')} AS right_rate, {R('avg(CAST(r <= 0.15 AS DOUBLE))')} AS right_or_defensible,
  {R('avg(CAST(r >= 0.3 AS DOUBLE))')} AS wrong_rate, {R('avg(r)')} AS mean_regret FROM (SELECT best_true - {p} AS r FROM o_picks)""" for p in AG.POLICIES))
def _(src):
    d = AG.regret(src("fx_cands"), ["state"])
    return d.select("policy", "n", *[r4(c).alias(c) for c in ("right_rate", "right_or_defensible", "wrong_rate", "mean_regret")])


def recs(src):
    one = F.when(F.col("action").isNotNull(), F.array(F.struct("action")))
    return src("fx_recs").withColumns({"actions": one, "ball_px": F.when(F.col("ball_x").isNotNull(), F.array("ball_x")), "rim_px": F.array("rim_x")})


@query("agg_coverage", f"""SELECT clip_id, count(*) AS pause_points, count(action) AS recommended, {R('100*count(action)/CAST(count(*) AS DOUBLE)')} AS coverage, min(n_players) FILTER (WHERE action IS NOT NULL) AS players_min,
  max(n_players) FILTER (WHERE action IS NOT NULL) AS players_max, median(n_players) FILTER (WHERE action IS NOT NULL) AS players_median,
  {R('100*count(*) FILTER (WHERE action IS NOT NULL AND ball_x IS NOT NULL)/CAST(count(action) AS DOUBLE)')} AS ball FROM fx_recs GROUP BY clip_id""")
def _(src):
    c = AG.coverage(recs(src), ["clip_id"])
    return c.select("clip_id", "pause_points", "recommended", r4("coverage_share").alias("coverage"), "players_min", "players_max", "players_median", r4("ball_share").alias("ball"))


@query("agg_top_action_mix", "SELECT action, count(*) AS n FROM fx_recs WHERE action IS NOT NULL GROUP BY action")
def _(src):
    return AG.top_action_mix(recs(src))


cte("o_eb", "SELECT player_id, sum(made) AS m, count(*) AS n FROM fx_rates GROUP BY player_id")
cte("o_prior", "SELECT player_id, n, (m + 200*(SELECT sum(m)/CAST(sum(n) AS DOUBLE) FROM o_eb))/(n + 200) AS prior FROM o_eb")


@query("agg_eb_rate", f"SELECT player_id, n, {R('prior')} AS prior FROM o_prior")
def _(src):
    return AG.eb_rate(src("fx_rates"), "player_id", "made").select("player_id", "n", r4("prior").alias("prior"))


@query("join_player_prior", f"SELECT event_id, {R('coalesce(prior, (SELECT sum(made)/CAST(count(*) AS DOUBLE) FROM fx_rates WHERE player_id % 9 > 0))')} AS player_shot_prior FROM fx_rates LEFT JOIN (SELECT player_id, (m + 200*l)/(n + 200) AS prior FROM (SELECT player_id, sum(made) AS m, count(*) AS n FROM fx_rates WHERE player_id % 9 > 0 GROUP BY ALL), (SELECT sum(made)/CAST(count(*) AS DOUBLE) AS l FROM fx_rates WHERE player_id % 9 > 0)) USING (player_id)")
def _(src):
    r = src("fx_rates")
    p = AG.eb_rate(r.where("player_id % 9 > 0"), "player_id", "made")
    return AG.with_prior(r, p, "player_id").select("event_id", r4("player_shot_prior").alias("player_shot_prior"))


@query("agg_quantiles", f"SELECT event_type, {R('median(value)')} AS p50, {R('quantile_cont(value, 0.9)')} AS p90 FROM events GROUP BY event_type")
def _(src):
    return AG.quantiles(src("events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9}).select("event_type", r4("p50").alias("p50"), r4("p90").alias("p90"))


# Orders, holdouts, sets -------------------------------------------------------------------
@query("ord_holdout_games", "SELECT event_id, game > (SELECT max(dr) - greatest(1, max(dr)//5) FROM (SELECT dense_rank() OVER (ORDER BY game) AS dr FROM (SELECT DISTINCT game FROM fx_rates))) - 1 AS test FROM fx_rates")
def _(src):
    return O.holdout_last(src("fx_rates"), "game").select("event_id", "test")


_MID = "(SELECT event_type FROM (SELECT event_type, row_number() OVER (ORDER BY count(*), event_type) AS rn, count(*) OVER () AS k FROM events GROUP BY event_type) WHERE rn = k//2 + 1)"


@query("ord_holdout_group", f"SELECT event_type, count(*) AS n FROM events WHERE event_type = {_MID} GROUP BY event_type")
def _(src):
    return O.median_group(src("events"), "event_type")


@query("set_train_val_complement", f"SELECT event_id, CASE WHEN event_type = {_MID} THEN 'val' ELSE 'train' END AS part FROM events")
def _(src):
    e = src("events").select("event_id", "event_type")
    v = O.median_group(e, "event_type")
    train, val = O.split_by_group(e, v, "event_type")
    return (train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))).select("event_id", "part")


@query("ord_cap", "SELECT game, event_id, dense_rank() OVER (ORDER BY game) AS group_pos, dense_rank() OVER (ORDER BY game) <= 30 AS inside FROM fx_rates")
def _(src):
    # Every row comes back: the cap is a flag on the games beyond it.
    return O.capped_groups(src("fx_rates"), "game", 30).select("game", "event_id", "group_pos", "inside")


@query("ord_best_frame", f"""SELECT clip_id, arg_max(event_id, conf + 0.05e0*n_players - event_id*1e-9) AS event_id FROM (SELECT clip_id, event_id, n_players, rim_x/100 AS conf FROM fx_recs WHERE handler_id IS NOT NULL) WHERE conf >= 0.6 AND n_players >= 8 GROUP BY clip_id""")
def _(src):
    r = src("fx_recs").withColumn("conf", F.col("rim_x") / 100).where("handler_id IS NOT NULL")
    return O.best_frame(r, ["clip_id"], "conf", "n_players", "event_id")


@query("set_union_slices", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(src):
    from hoopflow.plans.staging import stage
    e = src("events")
    paths = [stage(e.where(F.col("event_id") % 3 == k), "parquet", f"slice{k}") for k in range(3)]
    return src.spark.read.parquet(*paths).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
