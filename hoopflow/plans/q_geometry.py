"""Geometry, parsing and small numeric queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoopflow import fixed as K
from hoopflow.functions import geometry as G, scalars as S
from hoopflow.functions.geometry import r4
from hoopflow.operators import video
from hoopflow.plans.registry import R, cte, query
from hoopflow.plans.views import CAMERA, IMG_H, IMG_W

KEY = ["event_id", "moment_pos", "entity_pos"]
KEYS = ", ".join(KEY)

# Shared oracle pieces ------------------------------------------------------------
DX, DY = "(x - 5.25e0)", "(y - 25e0)"
DIST = f"sqrt({DX}*{DX} + {DY}*{DY})"
ANG = f"degrees(atan2({DY}, {DX}))"
CORNER = "((y <= 3 OR y >= 47) AND x <= 14)"
SIDE = f"(CASE WHEN {ANG} > 30 THEN 'left' WHEN {ANG} < -30 THEN 'right' ELSE 'center' END)"
ZONE = f"""(CASE WHEN x > 47 THEN 'backcourt'
  WHEN {CORNER} THEN (CASE WHEN y > 25 THEN 'corner_three_left' ELSE 'corner_three_right' END)
  WHEN {DIST} >= 23.75e0 THEN 'above_break_three_' || {SIDE}
  WHEN {DIST} <= 4 THEN 'restricted_area'
  WHEN y BETWEEN 17 AND 33 AND x <= 19 THEN 'paint_non_ra'
  ELSE 'mid_range_' || {SIDE} END)"""


def zone_sql(x: str, y: str) -> str:
    return f"(SELECT {ZONE} FROM (SELECT {x} AS x, {y} AS y))"


# A pair of neighbouring entities per moment, as a source of two-point geometry.
cte("o_pairs", f"""SELECT a.event_id, a.moment_pos, a.entity_pos, a.x, a.y, b.x AS b_x, b.y AS b_y, c.x AS cx, c.y AS cy
FROM fx_tracking a JOIN fx_tracking b ON a.event_id = b.event_id AND a.moment_pos = b.moment_pos AND b.entity_pos = a.entity_pos + 5
JOIN fx_tracking c ON a.event_id = c.event_id AND a.moment_pos = c.moment_pos AND c.is_ball""")


def pairs(src):
    """Each player beside the one five places on and the ball, by one shuffle on the moment."""
    t = src("fx_tracking")
    m = (t.groupBy("event_id", "moment_pos")
         .agg(F.collect_list(F.struct("entity_pos", "x", "y")).alias("ents")))
    ent = lambda n: F.get(F.filter("ents", lambda e: e["entity_pos"] == n), F.lit(0))
    return (m.select("event_id", "moment_pos", ent(F.lit(0)).alias("c"), "ents", F.explode("ents").alias("a"))
            .withColumn("b", ent(F.col("a.entity_pos") + 5)).where(F.col("b").isNotNull())
            .select("event_id", "moment_pos", F.col("a.entity_pos").alias("entity_pos"), F.col("a.x").alias("x"),
                    F.col("a.y").alias("y"), F.col("b.x").alias("b_x"), F.col("b.y").alias("b_y"),
                    F.col("c.x").alias("cx"), F.col("c.y").alias("cy")))


@query("geo_basket_side", f"SELECT {KEYS}, CASE WHEN x < 47 THEN 'left' ELSE 'right' END AS side FROM fx_tracking")
def _(src):
    return src("fx_tracking").select(*KEY, G.basket_side("x").alias("side"))


@query("geo_flip", f"SELECT {KEYS}, {R('94 - x')} AS fx, {R('50 - y')} AS fy FROM fx_tracking")
def _(src):
    fx, fy = G.flip("x", "y")
    return src("fx_tracking").select(*KEY, r4(fx).alias("fx"), r4(fy).alias("fy"))


@query("geo_flip_velocity", "SELECT event_id, -value AS fvx, -(event_id % 13) AS fvy FROM events")
def _(src):
    vx, vy = G.flip_velocity("value", F.col("event_id") % 13)
    return src("events").select("event_id", vx.alias("fvx"), vy.alias("fvy"))


@query("geo_polar", f"SELECT {KEYS}, {R(DIST)} AS dist, {R(ANG)} AS angle FROM fx_tracking")
def _(src):
    d, a = G.polar("x", "y")
    return src("fx_tracking").select(*KEY, r4(d).alias("dist"), r4(a).alias("angle"))


@query("geo_is_three", f"SELECT {KEYS}, {CORNER} OR {DIST} >= 23.75e0 AS is_three FROM fx_tracking")
def _(src):
    return src("fx_tracking").select(*KEY, G.is_three("x", "y").alias("is_three"))


@query("geo_zone", f"SELECT {KEYS}, {ZONE} AS zone FROM fx_tracking")
def _(src):
    return src("fx_tracking").select(*KEY, G.zone("x", "y").alias("zone"))


@query("geo_region_flags", f"""SELECT {KEYS}, y BETWEEN 17 AND 33 AND x <= 19 AS in_paint, x <= 47 AS crossed,
  x BETWEEN -1 AND 95 AND y BETWEEN -1 AND 51 AS on_court FROM fx_tracking""")
def _(src):
    return src("fx_tracking").select(*KEY, G.in_paint("x", "y").alias("in_paint"),
                                     G.crossed_halfcourt("x").alias("crossed"),
                                     G.on_court("x", "y", 1.0).alias("on_court"))


@query("geo_speed_heading", f"""SELECT {KEYS}, {R('sp')} AS speed,
  CASE WHEN sp >= 0.5 THEN {R('degrees(atan2(vy, vx))')} END AS heading,
  CASE WHEN sp >= 0.5 THEN 'velocity_heading' ELSE 'velocity_heading_unavailable' END AS source
FROM (SELECT *, sqrt(vx*vx + vy*vy) AS sp FROM (SELECT {KEYS}, (x - 47)/10 AS vx, (y - 25)/10 AS vy FROM fx_tracking))""")
def _(src):
    t = src("fx_tracking").withColumns({"vx": (F.col("x") - 47) / 10, "vy": (F.col("y") - 25) / 10})
    return t.select(*KEY, r4(G.speed("vx", "vy")).alias("speed"), r4(G.heading("vx", "vy")).alias("heading"),
                    G.heading_source("vx", "vy").alias("source"))


def pressure_sql(px, py, dx, dy) -> str:
    return f"""(SELECT exp(-nd/4e0)*(1 + 0.5e0*CASE WHEN nr < 1e-6 OR nd < 1e-6 THEN 0e0
        ELSE greatest(0e0, (tx*ex + ty*ey)/(nr*nd)) END)
      FROM (SELECT *, sqrt(tx*tx + ty*ty) AS nr, sqrt(ex*ex + ey*ey) AS nd
            FROM (SELECT 5.25e0 - {px} AS tx, 25e0 - {py} AS ty, {dx} - {px} AS ex, {dy} - {py} AS ey)))"""


@query("geo_pressure", f"SELECT {KEYS}, {R(pressure_sql('x', 'y', 'b_x', 'b_y'))} AS pressure FROM o_pairs")
def _(src):
    return pairs(src).select(*KEY, r4(G.pressure("x", "y", "b_x", "b_y")).alias("pressure"))


@query("geo_angle_between", f"""SELECT {KEYS}, {R('''CASE WHEN n1 < 1e-6 OR n2 < 1e-6 THEN 0e0
  ELSE degrees(acos(greatest(-1e0, least(1e0, (ux*vx + uy*vy)/(n1*n2))))) END''')} AS angle
FROM (SELECT *, sqrt(ux*ux + uy*uy) AS n1, sqrt(vx*vx + vy*vy) AS n2
      FROM (SELECT {KEYS}, b_x - x AS ux, b_y - y AS uy, cx - x AS vx, cy - y AS vy FROM o_pairs))""")
def _(src):
    a = G.angle_between(F.col("b_x") - F.col("x"), F.col("b_y") - F.col("y"),
                        F.col("cx") - F.col("x"), F.col("cy") - F.col("y"))
    return pairs(src).select(*KEY, r4(a).alias("angle"))


def segment_sql(px, py, ax, ay, bx, by) -> str:
    return f"""(SELECT sqrt((px-(ax+t*ux))*(px-(ax+t*ux)) + (py-(ay+t*uy))*(py-(ay+t*uy)))
      FROM (SELECT *, CASE WHEN den < 1e-9 THEN 0e0 ELSE least(1e0, greatest(0e0, ((px-ax)*ux + (py-ay)*uy)/den)) END AS t
            FROM (SELECT *, ux*ux + uy*uy AS den
                  FROM (SELECT {px} AS px, {py} AS py, {ax} AS ax, {ay} AS ay, {bx} - {ax} AS ux, {by} - {ay} AS uy))))"""


@query("geo_point_segment", f"SELECT {KEYS}, {R(segment_sql('cx', 'cy', 'x', 'y', 'b_x', 'b_y'))} AS dist FROM o_pairs")
def _(src):
    return pairs(src).select(*KEY, r4(G.point_segment("cx", "cy", "x", "y", "b_x", "b_y")).alias("dist"))


@query("geo_facing", f"""SELECT {KEYS}, {R('''CASE WHEN hd IS NULL OR n < 1e-6 THEN 0e0
  ELSE cos(radians(hd))*(dx/n) + sin(radians(hd))*(dy/n) END''')} AS facing
FROM (SELECT *, sqrt(dx*dx + dy*dy) AS n FROM (SELECT {KEYS}, b_x - x AS dx, b_y - y AS dy,
  CASE WHEN moment_pos % 10 = 0 THEN NULL ELSE (moment_pos*7 % 360) - 180e0 END AS hd FROM o_pairs))""")
def _(src):
    hd = F.when(F.col("moment_pos") % 10 != 0, (F.col("moment_pos") * 7 % 360) - 180.0)
    return pairs(src).select(*KEY, r4(G.facing(hd, F.col("b_x") - F.col("x"), F.col("b_y") - F.col("y"))).alias("facing"))


@query("geo_box_points", f"""SELECT clip_id, frame_idx, det_no, {R('(x1+x2)/2')} AS foot_x, {R('y2')} AS foot_y,
  {R('(x1+x2)/2')} AS center_x, {R('(y1+y2)/2')} AS center_y FROM fx_detections""")
def _(src):
    fx, fy = G.box_foot("x1", "y1", "x2", "y2")
    cx, cy = G.box_center("x1", "y1", "x2", "y2")
    return src("fx_detections").select("clip_id", "frame_idx", "det_no", r4(fx).alias("foot_x"), r4(fy).alias("foot_y"),
                                       r4(cx).alias("center_x"), r4(cy).alias("center_y"))


def project_sql(h, x, y):
    """H applied to a point; ``h`` is an array column (1-based)."""
    w = f"({h}[7]*{x} + {h}[8]*{y} + {h}[9])"
    return f"(({h}[1]*{x} + {h}[2]*{y} + {h}[3])/{w})", f"(({h}[4]*{x} + {h}[5]*{y} + {h}[6])/{w})"


cte("o_hinv", """SELECT clip_id, frame_idx, img_w, img_h, [m1/det, m2/det, m3/det, m4/det, m5/det, m6/det, m7/det, m8/det, m9/det] AS hi
FROM (SELECT *, h[1]*m1 + h[2]*m4 + h[3]*m7 AS det FROM (SELECT clip_id, frame_idx, h, 1280 AS img_w, 720 AS img_h,
  h[5]*h[9]-h[6]*h[8] AS m1, h[3]*h[8]-h[2]*h[9] AS m2, h[2]*h[6]-h[3]*h[5] AS m3,
  h[6]*h[7]-h[4]*h[9] AS m4, h[1]*h[9]-h[3]*h[7] AS m5, h[3]*h[4]-h[1]*h[6] AS m6,
  h[4]*h[8]-h[5]*h[7] AS m7, h[2]*h[7]-h[1]*h[8] AS m8, h[1]*h[5]-h[2]*h[4] AS m9 FROM fx_homographies))""")

_FX, _FY = project_sql("h", "((x1+x2)/2)", "y2")
_BX, _BY = project_sql("hi", "true_x", "true_y")


@query("geo_project", f"""SELECT clip_id, frame_idx, det_no, {R(_FX)} AS court_x, {R(_FY)} AS court_y, {R(_BX)} AS px, {R(_BY)} AS py
FROM fx_detections JOIN fx_homographies USING (clip_id, frame_idx) JOIN o_hinv USING (clip_id, frame_idx)""")
def _(src):
    d = src("fx_detections").join(src("fx_homographies").select("clip_id", "frame_idx", "h"), ["clip_id", "frame_idx"])
    d = d.withColumn("hi", G.invert_h("h"))
    cx, cy = G.project("h", *G.box_foot("x1", "y1", "x2", "y2"))
    px, py = G.project("hi", "true_x", "true_y")
    return d.select("clip_id", "frame_idx", "det_no", r4(cx).alias("court_x"), r4(cy).alias("court_y"),
                    r4(px).alias("px"), r4(py).alias("py"))


_LX, _LY = project_sql("hi", "court_x", "court_y")


@query("geo_landmarks", f"""SELECT clip_id, frame_idx, name, {R('px')} AS px, {R('py')} AS py,
  px >= -20 AND px < img_w + 20 AND py >= -20 AND py < img_h + 20 AS visible
FROM (SELECT clip_id, frame_idx, name, img_w, img_h, {_LX} AS px, {_LY} AS py FROM o_hinv, fx_landmarks)""")
def _(src):
    h = src("fx_homographies").withColumn("hi", G.invert_h("h"))
    out = video.place_landmarks(h, "hi", IMG_W, IMG_H, margin=20.0)
    return out.select("clip_id", "frame_idx", "name", r4("px").alias("px"), r4("py").alias("py"), "visible")


cte("o_grid", "SELECT 2e0 + 10*i AS gx, 2e0 + 9.2e0*j AS gy FROM range(10) a(i), range(6) b(j)")
_GX, _GY = project_sql("hi", "gx", "gy")
_HX, _HY = project_sql("hi", "(gx + 5)", "gy")
cte("o_scale", f"""SELECT clip_id, frame_idx, sqrt((b_x-ax)*(b_x-ax) + (b_y-ay)*(b_y-ay))/5 AS ppf
FROM (SELECT clip_id, frame_idx, img_w, img_h, {_GX} AS ax, {_GY} AS ay, {_HX} AS b_x, {_HY} AS b_y FROM o_hinv, o_grid)
WHERE ax >= 0 AND ax < img_w AND ay >= 0 AND ay < img_h""")
cte("o_plausible", """SELECT clip_id, frame_idx, count(ppf) FILTER (WHERE ppf > 0) AS n_visible, median(ppf) FILTER (WHERE ppf > 0) AS med,
  coalesce(count(ppf) FILTER (WHERE ppf > 0) >= 6 AND median(ppf) FILTER (WHERE ppf > 0) BETWEEN 8 AND 150
    AND quantile_cont(ppf, 0.95) FILTER (WHERE ppf > 0) / quantile_cont(ppf, 0.05) FILTER (WHERE ppf > 0) <= 12, false) AS plausible
FROM fx_homographies LEFT JOIN o_scale USING (clip_id, frame_idx) GROUP BY clip_id, frame_idx""")


@query("geo_plausible", f"SELECT clip_id, frame_idx, n_visible, {R('med')} AS median_px_per_ft, plausible FROM o_plausible")
def _(src):
    out = video.plausible(src("fx_homographies"), IMG_W, IMG_H)
    return out.select("clip_id", "frame_idx", "n_visible", r4("median_px_per_ft").alias("median_px_per_ft"), "plausible")


@query("geo_action_target", f"""SELECT clip_id, frame_idx, det_no, action, {R('hx')} AS circle_x, {R('hy')} AS circle_y,
  {R("CASE WHEN action = 'PASS_TO' THEN tx WHEN action = 'RESET' THEN NULL ELSE rx END")} AS to_x,
  {R("CASE WHEN action = 'PASS_TO' THEN ty WHEN action = 'RESET' THEN NULL ELSE ry END")} AS to_y
FROM (SELECT *, CASE det_no % 4 WHEN 0 THEN 'PASS_TO' WHEN 1 THEN 'DRIVE' WHEN 2 THEN 'SHOOT' ELSE 'RESET' END AS action,
   CASE WHEN (l_x-hx)*(l_x-hx)+(l_y-hy)*(l_y-hy) <= (r_x-hx)*(r_x-hx)+(r_y-hy)*(r_y-hy) THEN l_x ELSE r_x END AS rx,
   CASE WHEN (l_x-hx)*(l_x-hx)+(l_y-hy)*(l_y-hy) <= (r_x-hx)*(r_x-hx)+(r_y-hy)*(r_y-hy) THEN l_y ELSE r_y END AS ry
 FROM (SELECT a.clip_id, a.frame_idx, a.det_no, (a.x1+a.x2)/2 AS hx, a.y2 AS hy, (b.x1+b.x2)/2 AS tx, b.y2 AS ty,
   {project_sql('hi', '5.25e0', '25e0')[0]} AS l_x, {project_sql('hi', '5.25e0', '25e0')[1]} AS l_y,
   {project_sql('hi', '88.75e0', '25e0')[0]} AS r_x, {project_sql('hi', '88.75e0', '25e0')[1]} AS r_y
  FROM fx_detections a JOIN o_hinv USING (clip_id, frame_idx)
  JOIN fx_detections b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx AND b.det_no = a.det_no + 1
  WHERE a.det_no >= 0))""")
def _(src):
    feet = src("fx_detections").select("clip_id", "frame_idx", "det_no", *[c.alias(n) for c, n in zip(
        G.box_foot("x1", "y1", "x2", "y2"), ("hx", "hy"))])
    nxt = feet.select("clip_id", "frame_idx", (F.col("det_no") - 1).alias("det_no"), F.col("hx").alias("tx"), F.col("hy").alias("ty"))
    h = src("fx_homographies").select("clip_id", "frame_idx", "h")
    kind = F.element_at(F.array(*map(F.lit, ["PASS_TO", "DRIVE", "SHOOT", "RESET"])), (F.col("det_no") % 4 + 1).cast("int"))
    d = (feet.where("det_no >= 0").join(nxt, ["clip_id", "frame_idx", "det_no"])
         .join(h, ["clip_id", "frame_idx"]).withColumn("action", kind).withColumn("hi", G.invert_h("h")))
    d = video.action_target(d, "action", "hx", "hy", "tx", "ty", "hi")
    return d.select("clip_id", "frame_idx", "det_no", "action", r4("hx").alias("circle_x"), r4("hy").alias("circle_y"),
                    r4("to_x").alias("to_x"), r4("to_y").alias("to_y"))


@query("fmt_action_label", """SELECT state, ord, CASE action WHEN 'PASS_TO' THEN 'PASS' WHEN 'SCREEN_WITH' THEN 'SCREEN'
  WHEN 'DRIVE' THEN 'DRIVE left' ELSE action END || ' (EPV ' || printf('%.2f', floor(q*10)/10) || ')' AS label FROM fx_cands""")
def _(src):
    return src("fx_cands").select("state", "ord", S.action_label("action", F.lit("left"), F.floor(F.col("q") * 10) / 10).alias("label"))


@query("fmt_player_label", """SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END,
  '#' || CAST(CASE WHEN event_id % 5 > 0 THEN user_id END AS VARCHAR), 'a teammate') AS label FROM events""")
def _(src):
    e = F.col("event_id")
    return src("events").select("event_id", S.player_label(F.when(e % 3 == 0, F.col("event_type")),
                                                           F.when(e % 5 > 0, F.col("user_id")), "a teammate").alias("label"))


@query("str_clock_seconds", """SELECT event_id, txt, CASE WHEN len(string_split(txt, ':')) = 2 THEN
  try_cast(string_split(txt, ':')[1] AS INTEGER)*60 + try_cast(string_split(txt, ':')[2] AS DOUBLE) END AS seconds
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN '3:' || event_type WHEN 2 THEN '1:2:3'
  ELSE CAST(event_id % 12 AS VARCHAR) || ':' || CAST(user_id % 60 AS VARCHAR) || (CASE WHEN event_id % 2 = 0 THEN '.5' ELSE '' END) END AS txt FROM events)""")
def _(src):
    e, u = F.col("event_id"), F.col("user_id")
    txt = (F.when(e % 5 == 0, F.col("event_type")).when(e % 5 == 1, F.concat(F.lit("3:"), F.col("event_type")))
           .when(e % 5 == 2, "1:2:3").otherwise(F.concat((e % 12).cast("string"), F.lit(":"), (u % 60).cast("string"),
                                                         F.when(e % 2 == 0, ".5").otherwise(""))))
    return src("events").select("event_id", txt.alias("txt")).withColumn("seconds", S.clock_seconds("txt"))


@query("str_points", """SELECT SEQ, CAST(CASE WHEN EVENTMSGTYPE = 1 THEN CASE WHEN d LIKE '%3PT%' THEN 3 ELSE 2 END
  WHEN EVENTMSGTYPE = 3 AND d NOT LIKE '%MISS%' THEN 1 ELSE 0 END AS BIGINT) AS points
FROM (SELECT *, coalesce(HOMEDESCRIPTION, '') || ' ' || coalesce(VISITORDESCRIPTION, '') AS d FROM fx_pbp_raw)""")
def _(src):
    d = F.concat_ws(" ", F.coalesce("HOMEDESCRIPTION", F.lit("")), F.coalesce("VISITORDESCRIPTION", F.lit("")))
    return src("fx_pbp_raw").select("SEQ", S.points_scored("EVENTMSGTYPE", d).cast("long").alias("points"))


_WORDS = ["Basketball", "sports ball", "baseball bat", "Person", "player-white", "referee", "refrigerator", "hoop", "net", "dog"]


@query("str_class_map", f"""SELECT event_id, nm, CASE WHEN list_contains(w, 'referee') OR list_contains(w, 'ref') THEN 'referee'
  WHEN list_contains(w, 'rim') OR list_contains(w, 'hoop') OR list_contains(w, 'basket') OR list_contains(w, 'net') THEN 'rim'
  WHEN list_contains(w, 'basketball') OR list_contains(w, 'ball') OR contains(lower(nm), 'sports ball') THEN 'ball'
  WHEN list_contains(w, 'player') OR list_contains(w, 'person') THEN 'player' END AS cls
FROM (SELECT *, regexp_split_to_array(lower(nm), '[^a-z]+') AS w FROM
  (SELECT event_id, [{', '.join(repr(w) for w in _WORDS)}][1 + event_id % {len(_WORDS)}] || ' ' || event_type AS nm FROM events))""")
def _(src):
    nm = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("event_id") % len(_WORDS) + 1).cast("int")), F.col("event_type"))
    return src("events").select("event_id", nm.alias("nm")).withColumn("cls", S.class_of("nm"))


@query("num_safe_int", """SELECT doc_id, try_cast(CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN ' ' || CAST(n_chars AS VARCHAR) END AS BIGINT) AS v FROM documents""")
def _(src):
    d = F.col("doc_id")
    txt = F.when(d % 3 == 0, F.col("source")).when(d % 3 == 1, F.concat(F.lit(" "), F.col("n_chars").cast("string")))
    return src("documents").select("doc_id", S.safe_int(txt).alias("v"))


@query("num_finite_default", """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN 12.0e0 ELSE value END AS shot_clock,
  CASE WHEN event_id % 5 = 0 THEN 30.0e0 ELSE value END AS defender_dist FROM events""")
def _(src):
    e, v = F.col("event_id"), F.col("value")
    bad = F.when(e % 4 == 0, F.lit(float("nan"))).when(e % 4 == 1, F.lit(float("inf"))).when(e % 4 == 3, v)
    return src("events").select("event_id", S.finite_or(bad, K.DEF_SHOT_CLOCK).alias("shot_clock"),
                                S.finite_or(F.when(e % 5 != 0, v), K.DEF_DIST).alias("defender_dist"))


@query("num_confidence", f"""SELECT event_id, {R('''0.35e0*least((event_id % 13)/10e0, 1e0) + 0.35e0*CAST(event_id % 3 > 0 AS INT)
  + 0.15e0*CASE WHEN event_id % 7 = 0 THEN 0e0 ELSE (user_id % 10)/10e0 END + 0.15e0*CAST(event_id % 2 = 0 AS INT)''')} AS confidence FROM events""")
def _(src):
    e = F.col("event_id")
    c = S.confidence(e % 13, e % 3 > 0, F.when(e % 7 != 0, F.col("user_id") % 10 / 10.0), e % 2 == 0)
    return src("events").select("event_id", r4(c).alias("confidence"))


# Inputs are dyadic fractions, so half-even and half-up rounding agree away from exact ties.
@query("num_augment_recommend", """SELECT event_id, round_even(least(greatest(err*1.2e0, 0.5e0), 4e0), 2) AS jitter_ft,
  round_even(least(greatest(miss*2e0, 0.1e0), 0.9e0), 2) AS dropout_prob, CAST(CASE WHEN miss < 0.2e0 THEN 2 ELSE 3 END AS BIGINT) AS dropout_max,
  round_even(least(greatest(ide, 0.02e0), 0.5e0), 3) AS id_swap_prob
FROM (SELECT event_id, (event_id % 64)/13e0 AS err, (event_id % 32)/61e0 AS miss, (user_id % 128)/171e0 AS ide FROM events)""")
def _(src):
    e = F.col("event_id")
    rec = S.augment_recommendation(e % 64 / 13.0, e % 32 / 61.0, F.col("user_id") % 128 / 171.0)
    return src("events").select("event_id", rec["jitter_ft"].alias("jitter_ft"), rec["dropout_prob"].alias("dropout_prob"),
                                rec["dropout_max"].cast("long").alias("dropout_max"), rec["id_swap_prob"].alias("id_swap_prob"))


@query("num_fallback_id", """SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN user_id END, -(1000 + event_id)) AS pid,
  coalesce(CASE WHEN event_id % 2 = 0 THEN user_id % 2 END, event_id % 5) AS team FROM events""")
def _(src):
    e, u = F.col("event_id"), F.col("user_id")
    return src("events").select("event_id", S.fallback_id(F.when(e % 3 == 0, u), e).alias("pid"),
                                S.team_of_track(F.when(e % 2 == 0, u % 2), e % 5).alias("team"))


@query("str_group_key", "SELECT event_id, string_split(event_type || '@' || CAST(user_id AS VARCHAR) || '@x', '@')[1] AS grp FROM events")
def _(src):
    s = F.concat_ws("@", "event_type", F.col("user_id").cast("string"), F.lit("x"))
    return src("events").select("event_id", S.group_key(s).alias("grp"))


cte("o_hist", """SELECT vec_id, clip_id, label, list_transform(embedding, lambda e: abs(CAST(e AS DOUBLE)) /
  list_sum(list_transform(embedding, lambda z: abs(CAST(z AS DOUBLE))))) AS h FROM fx_vectors""")
cte("o_hist_step", """SELECT vec_id, clip_id, CASE WHEN ph IS NOT NULL THEN sqrt(greatest(0e0, 1 - list_sum(list_transform(list_zip(ph, h), lambda t: sqrt(t[1]*t[2]))))) END AS d
FROM (SELECT *, lag(h) OVER (PARTITION BY clip_id ORDER BY vec_id) AS ph FROM o_hist)""")


def histograms(src):
    e = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return src("fx_vectors").select("vec_id", "clip_id", F.transform(e, lambda v: v / total).alias("h"))


@query("vec_hist_distance", f"SELECT vec_id, clip_id, {R('d')} AS dist FROM o_hist_step")
def _(src):
    out = video.cut_distance(histograms(src), ["clip_id"], ["vec_id"], "h")
    return out.select("vec_id", "clip_id", r4("dist").alias("dist"))
