"""Generic ordered operators on the event series; hot users are split into blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoopflow import fixed as K
from hoopflow.functions.geometry import r4
from hoopflow.operators import joins as J, sequence as Q, video as V
from hoopflow.plans.q_geometry import histograms
from hoopflow.plans.registry import R, cte, query

S = Q.seq(["user_id"], ["us", "event_id"])
W = "(PARTITION BY user_id ORDER BY us, event_id)"


def series(src):
    return Q.split_hot(src("fx_series"), S)


@query("win_ffill", f"SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM fx_series")
def _(src):
    d, s = series(src)
    return Q.forward_fill(d, s, "v", "filled").select("event_id", "filled")


cte("o_cut7", f"SELECT *, CASE WHEN v - lag(v) OVER {W} > 30 THEN 1 ELSE 0 END AS cut FROM fx_series")


@query("win_split_reset", f"SELECT event_id, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM o_cut7")
def _(src):
    d, s = series(src)
    return Q.sessionize(d, s, "v", 30.0, "segment").select("event_id", "segment")


@query("win_finite_diff", f"""SELECT event_id, {R('CASE WHEN pu IS NULL THEN 0e0 ELSE (v - pv)/(CASE WHEN (us - pu)/1e6 > 600 THEN (us - pu)/1e6 ELSE 60e0 END) END')} AS rate
FROM (SELECT *, lag(v) OVER w AS pv, lag(us) OVER w AS pu FROM fx_series WINDOW w AS {W})""")
def _(src):
    d, s = series(src)
    d = d.withColumn("t", F.col("us") / 1e6)
    # The first row of a group has no rate; steps under ten minutes use a fixed minute.
    return Q.finite_diff(d, s, "v", None, "rate", clock="t", fallback=60.0, min_dt=600.0).select("event_id", r4("rate").alias("rate"))


cte("o_r7", f"""SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM
 (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER {W} AND lag(event_id) OVER {W} IS NOT NULL THEN 0 ELSE 1 END AS chg FROM
   (SELECT user_id, event_id, us, CASE WHEN event_type <> 'error' THEN event_type END AS event_type FROM fx_series))""")


@query("win_min_hold", "SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY user_id, run) >= 2 THEN event_type END AS held FROM o_r7")
def _(src):
    d, s = series(src)
    d = d.withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")))
    return Q.min_hold(d, s, "event_type", 2, "held").select("event_id", "held")


cte("o_near7", f"""SELECT a.event_id, b.event_type, count(*) AS n, min(b.rn) AS first_rn FROM (SELECT *, row_number() OVER {W} AS rn FROM fx_series) a
  JOIN (SELECT *, row_number() OVER {W} AS rn FROM fx_series) b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 2 AND a.rn + 2 WHERE b.event_type <> 'error' GROUP BY ALL""")


@query("win_rolling_mode", "SELECT event_id, event_type AS mode FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, first_rn) AS rk FROM o_near7) WHERE rk = 1")
def _(src):
    d, s = series(src)
    d = d.withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")))
    return Q.rolling_mode(d, s, "event_type", 2, "mode").where("mode IS NOT NULL").select("event_id", "mode")


@query("win_linear_interp", f"""SELECT event_id, {R('CASE WHEN v IS NOT NULL THEN v WHEN av IS NULL THEN bv WHEN bv IS NULL THEN av ELSE av + (us - au)/CAST(b_u - au AS DOUBLE)*(bv - av) END')} AS filled FROM
 (SELECT *, last_value(v IGNORE NULLS) OVER p AS av, last_value(CASE WHEN v IS NOT NULL THEN us END IGNORE NULLS) OVER p AS au,
    first_value(v IGNORE NULLS) OVER n AS bv, first_value(CASE WHEN v IS NOT NULL THEN us END IGNORE NULLS) OVER n AS b_u FROM fx_series
  WINDOW p AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
def _(src):
    d, s = series(src)
    return Q.linear_fill(d, s, ["v"], "us", ["filled"]).select("event_id", r4("filled").alias("filled"))


@query("win_recent_value", f"SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 47e0) AS recent FROM fx_series")
def _(src):
    d, s = series(src)
    d = Q.rolling(d, s, 3, 0, {"recent": lambda w: F.last("v", True).over(w)})
    return d.select("event_id", F.coalesce("recent", F.lit(K.HALF_X)).alias("recent"))


@query("win_any_nearby", "SELECT event_id, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS seen FROM fx_series")
def _(src):
    d, s = series(src)
    return Q.rolling(d, s, 2, 2, {"seen": lambda w: F.max(F.col("event_type") == "purchase").over(w)}).select("event_id", "seen")


@query("win_next_anchor", f"SELECT event_id, us AS start_us, coalesce(lead(us) OVER {W}, us + 1000000) AS end_us FROM fx_series WHERE event_type = 'view'")
def _(src):
    d, s = Q.split_hot(src("fx_series").where("event_type = 'view'"), S)
    d = Q.scan(d, s, lead={"_n": "us"})
    return d.select("event_id", F.col("us").alias("start_us"), F.coalesce("_n", F.col("us") + 1000000).alias("end_us"))


@query("win_until_first_cut", "SELECT event_id FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS hit FROM fx_series) WHERE hit = 0")
def _(src):
    d, s = series(src)
    return Q.until_first(d, s, F.col("event_type") == "error").select("event_id")


@query("win_cut_flag", "SELECT vec_id, coalesce(d > 0.3, false) AS cut FROM o_hist_step")
def _(src):
    d = V.cut_distance(histograms(src), ["clip_id"], ["vec_id"], "h")
    return d.select("vec_id", F.coalesce(F.col("dist") > 0.3, F.lit(False)).alias("cut"))


@query("win_shot_segments", "SELECT vec_id, CAST(sum(CASE WHEN d > 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY vec_id) AS BIGINT) AS shot FROM o_hist_step")
def _(src):
    d = V.cut_distance(histograms(src), ["clip_id"], ["vec_id"], "h")
    d = d.withColumn("_cut", F.coalesce((F.col("dist") > 0.3).cast("long"), F.lit(0)))
    return Q.scan(d, Q.seq(["clip_id"], ["vec_id"]), total={"shot": "_cut"}).select("vec_id", "shot")


@query("win_velocity_contiguous", f"""SELECT clip_id, frame_idx, det_no, {R('CASE WHEN frame_idx - pf = 1 THEN (true_x - px)/0.2e0 END')} AS vx, {R('CASE WHEN frame_idx - pf = 1 THEN (true_y - py)/0.2e0 END')} AS vy
FROM (SELECT *, lag(frame_idx) OVER w AS pf, lag(true_x) OVER w AS px, lag(true_y) OVER w AS py FROM fx_detections WHERE det_no >= 0 WINDOW w AS (PARTITION BY clip_id, det_no ORDER BY frame_idx))""")
def _(src):
    d = src("fx_detections").where("det_no >= 0")
    return V.contiguous_velocity(d, ["clip_id", "det_no"], "frame_idx", "true_x", "true_y", 0.2).select(
        "clip_id", "frame_idx", "det_no", r4("vx").alias("vx"), r4("vy").alias("vy"))


_H = "OVER (PARTITION BY clip_id ORDER BY frame_idx)"
cte("o_cr", "SELECT clip_id, frame_idx, clock_read AS r, row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS i FROM fx_video_frames WHERE clock_read IS NOT NULL")
_OK = "(last IS NULL OR (last <= 8 AND r > last AND (abs(r - 24) <= 1.5 OR abs(r - 14) <= 1.5)) OR (r <= last + 0.5 AND r >= last - 0.2e0 - 2))"
cte("o_cfold", f"""SELECT clip_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS frame_idx, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS DOUBLE) AS acc FROM (SELECT DISTINCT clip_id FROM o_cr)
  UNION ALL SELECT f.clip_id, c.i, c.frame_idx, CASE WHEN {_OK} THEN r ELSE last END, CASE WHEN {_OK} THEN r END FROM o_cfold f JOIN o_cr c ON f.clip_id = c.clip_id AND c.i = f.i + 1""")
cte("o_cacc", "SELECT v.clip_id, v.frame_idx, v.clock_true, f.acc FROM fx_video_frames v LEFT JOIN o_cfold f ON v.clip_id = f.clip_id AND v.frame_idx = f.frame_idx")
cte("o_clock", """SELECT clip_id, frame_idx, clock_true, CASE WHEN acc IS NOT NULL THEN acc WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a + (frame_idx - fa)/CAST(fb - fa AS DOUBLE)*(b - a) END AS clock FROM
 (SELECT *, last_value(acc IGNORE NULLS) OVER p AS a, last_value(CASE WHEN acc IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER p AS fa, first_value(acc IGNORE NULLS) OVER n AS b,
   first_value(CASE WHEN acc IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER n AS fb FROM o_cacc
  WINDOW p AS (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")


@query("win_clock_validate", f"SELECT clip_id, frame_idx, {R('clock')} AS clock FROM o_clock")
def _(src):
    return V.validate_clock(src("fx_video_frames")).select("clip_id", "frame_idx", r4("clock").alias("clock"))


@query("agg_clock_accuracy", f"SELECT {R('avg(CAST(abs(clock - clock_true) <= 0.75 AS DOUBLE))')} AS accuracy, count(*) AS n FROM o_clock WHERE clock IS NOT NULL AND clock_true IS NOT NULL")
def _(src):
    d = V.validate_clock(src("fx_video_frames")).where("clock IS NOT NULL AND clock_true IS NOT NULL")
    return d.agg(r4(F.avg((F.abs(F.col("clock") - F.col("clock_true")) <= 0.75).cast("double"))).alias("accuracy"), F.count(F.lit(1)).alias("n"))


cte("o_ball", """SELECT v.clip_id, v.frame_idx, (d.x1 + d.x2)/2 AS bx0, (d.y1 + d.y2)/2 AS by0, row_number() OVER (PARTITION BY v.clip_id ORDER BY v.frame_idx) AS i
  FROM fx_video_frames v LEFT JOIN fx_detections d ON v.clip_id = d.clip_id AND v.frame_idx = d.frame_idx AND d.cls = 'ball'""")
_HIT = "(bx0 IS NOT NULL AND (sqrt((bx0-x-vx)*(bx0-x-vx)+(by0-y-vy)*(by0-y-vy)) <= 280 OR missed >= 2))"
cte("o_bfold", f"""SELECT clip_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS frame_idx, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, 0e0 AS vx, 0e0 AS vy, 0 AS missed FROM (SELECT DISTINCT clip_id FROM o_ball)
  UNION ALL SELECT f.clip_id, b.i, b.frame_idx,
   CASE WHEN x IS NULL THEN bx0 WHEN {_HIT} THEN 0.85e0*bx0 + (1 - 0.85e0)*(x+vx) ELSE x+vx END, CASE WHEN x IS NULL THEN by0 WHEN {_HIT} THEN 0.85e0*by0 + (1 - 0.85e0)*(y+vy) ELSE y+vy END,
   CASE WHEN x IS NULL THEN 0e0 WHEN {_HIT} THEN 0.4e0*vx + 0.6e0*(bx0-x) ELSE vx*0.7e0 END, CASE WHEN x IS NULL THEN 0e0 WHEN {_HIT} THEN 0.4e0*vy + 0.6e0*(by0-y) ELSE vy*0.7e0 END,
   CASE WHEN x IS NULL OR {_HIT} THEN 0 ELSE missed + 1 END FROM o_bfold f JOIN o_ball b ON f.clip_id = b.clip_id AND b.i = f.i + 1""")


@query("win_gate_track", f"""SELECT clip_id, frame_idx, {R('coalesce(x, first_value(x IGNORE NULLS) OVER w)')} AS ball_x, {R('coalesce(y, first_value(y IGNORE NULLS) OVER w)')} AS ball_y FROM o_bfold WHERE i > 0
  WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def _(src):
    d = src("fx_detections").where("cls = 'ball'").selectExpr("clip_id", "frame_idx", "(x1 + x2)/2 AS bx", "(y1 + y2)/2 AS b_y")
    f = src("fx_video_frames").select("clip_id", "frame_idx").join(d, ["clip_id", "frame_idx"], "left")
    return V.track_ball(f, ["clip_id"], "frame_idx", "bx", "b_y").select("clip_id", "frame_idx", r4("ball_x").alias("ball_x"), r4("ball_y").alias("ball_y"))


# Aggregates over series -----------------------------------------------------------
@query("agg_majority_vote", """SELECT user_id, event_type AS top, n AS top_n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, event_type) AS rk FROM
  (SELECT user_id, event_type, count(*) AS n, min(us*10000000 + event_id % 10000000) AS f FROM (SELECT user_id, event_id, event_type, epoch_us(ts) - 1700000000000000 AS us0, CAST(epoch_us(ts)/1e6 AS BIGINT) AS us FROM events) GROUP BY ALL)) WHERE rk = 1""")
def _(src):
    d = src("fx_series").withColumn("sec", (F.col("us") / 1e6))
    return J.ordered_vote(d, ["user_id"], "event_type", F.struct("us", "event_id"), "top").select("user_id", "top", "top_n")


@query("agg_drift", """SELECT user_id, n, floor(h1*10000 + 0.5e0)/10000 AS first_half, floor(h2*10000 + 0.5e0)/10000 AS second_half, v0 AS first_v, v1 AS last_v FROM (
  SELECT user_id, count(*) AS n, median(v) FILTER (WHERE rn <= n0//2) AS h1, median(v) FILTER (WHERE rn > n0//2) AS h2, arg_min(value, rn) AS v0, arg_max(value, rn) AS v1
  FROM (SELECT s.user_id, s.event_id, s.v, e.value, row_number() OVER (PARTITION BY s.user_id ORDER BY us, s.event_id) AS rn, count(*) OVER (PARTITION BY s.user_id) AS n0 FROM fx_series s JOIN events e USING (event_id)) GROUP BY user_id)""")
def _(src):
    return V.drift(src("events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
                                        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), "value"), S, "v", "value")
