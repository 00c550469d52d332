"""Tracking-shaped views over the driver tables, in SQL text that both engines read.

``spark_view`` builds one as a DataFrame; ``oracle_ctes`` lists the same text for DuckDB.
Only the few spellings that differ go through ``Dialect``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hoopflow import fixed as K

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def ints(self, lo: int, hi: int) -> str:
        return (f"explode(sequence(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT)))" if self.spark
                else f"unnest(range({lo}, {hi + 1}))")

    def arr(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def micros(self, c: str) -> str:
        return f"unix_micros(CAST({c} AS TIMESTAMP))" if self.spark else f"epoch_us({c})"

    def rows(self, names: str, values: list[str]) -> str:
        body = ", ".join(f"({v})" for v in values)
        return f"(SELECT * FROM (VALUES {body}) AS t({names}))"

    def unnest(self, a: str) -> str:
        return f"explode({a})" if self.spark else f"unnest({a})"


SPARK, DUCK = Dialect(True), Dialect(False)


def idiv(a: str, n: int) -> str:
    return f"CAST(floor(({a}) / {n}e0) AS BIGINT)"


def _px(k: str) -> str:
    return (f"(6e0 + ((g*131 + ({k})*977) % 3500)/100e0"
            f" + (((g*17 + ({k})*29) % 41) - 20)/10e0 * f*0.04e0)")


def _py(k: str) -> str:
    return (f"(4e0 + ((g*173 + ({k})*613) % 4200)/100e0"
            f" + (((g*23 + ({k})*31) % 41) - 20)/10e0 * f*0.04e0)")


def _tracking(clock_step: int, where: str = ""):
    def build(d: Dialect) -> str:
        h, n = f"((g + {idiv('f', 30)}) % 5)", f"((g + {idiv('f', 30)} + 1) % 5)"
        a = "(CASE WHEN f % 30 < 22 THEN 0e0 ELSE (f % 30 - 21)/9e0 END)"
        bx = f"((1 - {a})*{_px(h)} + {a}*{_px(n)})"
        by = f"((1 - {a})*{_py(h)} + {a}*{_py(n)})"
        z = "(CASE WHEN f >= 106 THEN 3.5e0 + 9*sin(pi()*(f-106)/19e0) ELSE 3.5e0 END)"
        clock = f"round(700e0 - {clock_step}*(g % 5) - 0.04e0*f, 2)"
        return f"""
SELECT lpad(CAST({idiv('g', 20)} AS STRING), 10, '0') AS game_id, g AS event_id,
       1 + {idiv('g', 5)} % 4 AS quarter, {clock} AS game_clock,
       CASE WHEN src % 97 = 0 THEN NULL
            WHEN g % 3 = 0 AND f >= 70 THEN round(24e0 - 0.04e0*(f - 70), 2)
            ELSE round(18e0 - 0.04e0*f, 2) END AS shot_clock,
       1450000000000 + g*20000 + f*40 AS unix_ms,
       CAST(CASE WHEN k < 0 THEN -1 WHEN k < 5 THEN 1 ELSE 2 END AS BIGINT) AS team_id,
       CASE WHEN k < 0 THEN -1 WHEN k < 5 THEN 100 + k ELSE 200 + (k - 5) END AS player_id,
       round(CASE WHEN g % 2 = 1 THEN 94 - x0 ELSE x0 END, 3) AS x,
       round(CASE WHEN g % 2 = 1 THEN 50 - y0 ELSE y0 END, 3) AS y,
       round(CASE WHEN k < 0 THEN {z} ELSE 0e0 END, 3) AS z,
       k < 0 AS is_ball, f AS moment_pos, k + 1 AS entity_pos
FROM (SELECT *, CASE WHEN k < 0 THEN {bx} ELSE {_px('k')} END AS x0,
                CASE WHEN k < 0 THEN {by} ELSE {_py('k')} END AS y0
      FROM (SELECT event_id AS src, {idiv('event_id', 125)} AS g, event_id % 125 AS f,
                   {d.ints(-1, 9)} AS k FROM events) AS e0) AS e1 {where}"""
    return build


def _roster(d: Dialect) -> str:
    return """
SELECT CAST(CASE WHEN k < 5 THEN 1 ELSE 2 END AS BIGINT) AS team_id,
       CASE WHEN k < 5 THEN 'AAA' ELSE 'BBB' END AS team_abbr,
       CASE WHEN k < 5 THEN 'home' ELSE 'visitor' END AS side,
       CASE WHEN k < 5 THEN 100 + k ELSE 195 + k END AS player_id,
       CASE WHEN k % 2 = 0 THEN 'Ann' ELSE 'Bo' END AS firstname,
       concat('P', CAST(k AS STRING)) AS lastname,
       CASE WHEN k = 9 THEN NULL WHEN k < 5 THEN 10 + k ELSE 15 + k END AS jersey,
       CASE WHEN k % 5 < 2 THEN 'G' ELSE 'F' END AS position
FROM (SELECT """ + d.ints(0, 9) + " AS k) AS r0"


def _games(d: Dialect) -> str:
    return f"SELECT DISTINCT {idiv('event_id', 125)} AS g FROM events"


def _shots_raw(d: Dialect) -> str:
    c = "(696 - 8*(g % 5))"
    return f"""
SELECT CAST(CASE WHEN g % 2 = 0 THEN 'Jump Shot' ELSE 'Layup Shot' END AS STRING) AS ACTION_TYPE,
       {idiv('g', 20)} AS GAME_ID, {idiv(c, 60)} AS MINUTES_REMAINING,
       {c} % 60 AS SECONDS_REMAINING, 1 + {idiv('g', 5)} % 4 AS PERIOD,
       100 + (g + 3) % 5 AS PLAYER_ID, CAST(1 AS BIGINT) AS TEAM_ID,
       CASE WHEN (g*7) % 20 < 9 THEN 1 ELSE 0 END AS SHOT_MADE_FLAG,
       5 + (g*11) % 22 AS SHOT_DISTANCE,
       CASE WHEN g % 3 = 0 THEN '3PT Field Goal' ELSE '2PT Field Goal' END AS SHOT_TYPE
FROM fx_games WHERE g % 4 <> 3"""


def _pbp_raw(d: Dialect) -> str:
    made = "((g*7) % 20 < 9)"
    return f"""
SELECT lpad(CAST({idiv('g', 20)} AS STRING), 10, '0') AS GAME_ID, g*2 + s AS SEQ, typ AS EVENTMSGTYPE,
       1 + {idiv('g', 5)} % 4 AS PERIOD,
       concat(CAST({idiv('clk', 60)} AS STRING), ':', lpad(CAST(clk % 60 AS STRING), 2, '0')) AS PCTIMESTRING,
       CASE WHEN g % 2 = 0 THEN txt ELSE NULL END AS HOMEDESCRIPTION,
       CASE WHEN g % 2 = 1 THEN txt ELSE NULL END AS VISITORDESCRIPTION,
       100 + (g + 3) % 5 AS PLAYER1_ID, team AS PLAYER1_TEAM_ID
FROM (
  SELECT g, CAST(0 AS BIGINT) AS s, 696 - 8*(g % 5) AS clk,
         CASE WHEN g % 4 = 3 THEN 5 WHEN {made} THEN 1 ELSE 2 END AS typ,
         CASE WHEN g % 3 = 0 THEN 'jump 3PT shot' ELSE 'shot' END AS txt, CAST(1 AS BIGINT) AS team
  FROM fx_games
  UNION ALL
  SELECT g, CAST(1 AS BIGINT), 695 - 8*(g % 5), 4, 'REBOUND',
         CAST(CASE WHEN g % 10 = 9 THEN NULL WHEN g % 2 = 0 THEN 2 ELSE 1 END AS BIGINT)
  FROM fx_games WHERE g % 4 <> 3 AND NOT {made}
  UNION ALL
  SELECT g, CAST(1 AS BIGINT), 695 - 8*(g % 5), 3,
         CASE WHEN g % 16 = 0 THEN 'MISS free throw' ELSE 'free throw' END, CAST(1 AS BIGINT)
  FROM fx_games WHERE g % 4 <> 3 AND {made} AND g % 8 = 0) AS p0"""


# Camera of the video views: court feet -> pixels, row-major 3x3.
CAMERA = (12.0, 2.0, 60.0, 0.0, -7.0, 620.0, 0.0, 0.004, 1.0)
IMG_W, IMG_H = 1280, 720


def _inverse(m):
    a, b, c, d, e, f, g, i, j = m
    adj = [e*j - f*i, c*i - b*j, b*f - c*e, f*g - d*j, a*j - c*g, c*d - a*f,
           d*i - e*g, b*g - a*i, a*e - b*d]
    det = a*adj[0] + b*adj[3] + c*adj[6]
    return tuple(v/det for v in adj)


PIXEL_TO_COURT = _inverse(CAMERA)


def _u(x: str, y: str) -> str:
    return f"floor((12*{x} + 2*{y} + 60)/(1 + 0.004e0*{y})*10 + 0.5e0)/10"


def _v(x: str, y: str) -> str:
    return f"floor((620 - 7*{y})/(1 + 0.004e0*{y})*10 + 0.5e0)/10"


def _detections(d: Dialect) -> str:
    e = [f"6*team_id + ((g*13 + f*7 + k) % 10)/10e0", "((g*5 + f + k*3) % 10)/10e0", "0e0", "1e0"]
    return f"""
SELECT g AS clip_id, {idiv('f', 5)} AS frame_idx, k AS det_no,
       CASE WHEN k < 0 THEN 'ball' ELSE 'player' END AS cls,
       u - w AS x1, v - h AS y1, u + w AS x2, CASE WHEN k < 0 THEN v + 6 ELSE v END AS y2,
       0.5e0 + ((g + f + k + 1) % 50)/100e0 AS conf,
       CASE WHEN k >= 0 THEN {d.arr(*e)} END AS embedding,
       CASE WHEN k < 0 OR (g + f + k) % 9 < 4 THEN NULL
            ELSE (CASE WHEN k < 5 THEN 10 + k ELSE 15 + k END)
                 + (CASE WHEN (g*3 + f + k) % 41 = 0 THEN 1 ELSE 0 END) END AS jersey_read,
       CASE WHEN k >= 0 THEN player_id END AS true_player_id,
       CASE WHEN k < 0 THEN NULL WHEN k < 5 THEN 't1' ELSE 't2' END AS true_team, x AS true_x, y AS true_y
FROM (SELECT event_id AS g, moment_pos AS f, entity_pos - 1 AS k, team_id, player_id, x, y,
             {_u('x', 'y')} AS u, {_v('x', 'y')} AS v,
             CASE WHEN is_ball THEN 6e0 ELSE 15e0 END AS w, CASE WHEN is_ball THEN 6e0 ELSE 60e0 END AS h
      FROM fx_tracking WHERE moment_pos % 5 = 0) AS d0
WHERE NOT (k < 0 AND (g*7 + f) % 10 < 3) AND NOT (k >= 0 AND (g + f*3 + k*7) % 33 = 0)"""


def _video_frames(d: Dialect) -> str:
    return f"""
SELECT event_id AS clip_id, {idiv('moment_pos', 5)} AS frame_idx,
       moment_pos = 60 AND event_id % 4 = 0 AS cut,
       CASE WHEN moment_pos % 35 = 20 THEN 24e0 ELSE shot_clock END AS clock_read,
       shot_clock AS clock_true
FROM fx_tracking WHERE is_ball AND moment_pos % 5 = 0"""


def _landmarks(d: Dialect) -> str:
    vals = [f"CAST({i} AS BIGINT), '{n}', {x!r}e0, {y!r}e0" for i, (n, (x, y)) in enumerate(K.LANDMARKS.items())]
    return f"SELECT * FROM {d.rows('lm, name, court_x, court_y', vals)}"


def _keypoints(d: Dialect) -> str:
    noise = "(((clip_id*7 + frame_idx*3 + lm) % 5) - 2)*0.2e0"
    return f"""
SELECT clip_id, frame_idx, lm, name, court_x, court_y, u AS true_px, v AS true_py,
       u + {noise} AS px, v - {noise} AS py,
       0.4e0 + ((clip_id + frame_idx + lm) % 60)/100e0 AS conf
FROM (SELECT clip_id, frame_idx, lm, name, court_x, court_y,
             {_u('court_x', 'court_y')} AS u, {_v('court_x', 'court_y')} AS v
      FROM (SELECT clip_id, frame_idx, {d.ints(0, len(K.LANDMARKS) - 1)} AS lm FROM fx_video_frames) AS k0
      JOIN fx_landmarks USING (lm)) AS k1
WHERE u >= 0 AND u < {IMG_W} AND v >= 0 AND v < {IMG_H}"""


def _homographies(d: Dialect) -> str:
    """Per-frame pixel -> court maps; every 7th frame carries a bad one (wrong scale)."""
    good = [f"{v!r}e0" if "e" not in repr(v) else repr(v) for v in PIXEL_TO_COURT]
    h = [f"({g})*(CASE WHEN bad AND {i} < 6 THEN 9e0 ELSE 1e0 END)" for i, g in enumerate(good)]
    return f"""
SELECT clip_id, frame_idx, {d.arr(*h)} AS h, CASE WHEN frame_idx % 6 = 5 THEN 5 ELSE 14 END AS n_inliers,
       CASE WHEN frame_idx % 8 = 3 THEN 2.6e0 ELSE 0.4e0 END AS reproj_ft
FROM (SELECT *, (clip_id + frame_idx) % 7 = 0 AS bad FROM fx_video_frames) AS h0"""


def _calibrations(d: Dialect) -> str:
    h = [f"{v!r}e0" if "e" not in repr(v) else repr(v) for v in PIXEL_TO_COURT]
    return f"SELECT DISTINCT clip_id, {d.arr(*h)} AS h, {IMG_W} AS img_w, {IMG_H} AS img_h FROM fx_video_frames"


def _series(d: Dialect) -> str:
    return f"""
SELECT user_id, event_id, {d.micros('ts')} AS us, event_type,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events"""


def _cands(d: Dialect) -> str:
    """Candidate actions: an order is a state, its lines are candidates in a total order."""
    kind = ("CASE l_linenumber % 5 WHEN 1 THEN 'SHOOT' WHEN 2 THEN 'PASS_TO' WHEN 3 THEN 'DRIVE' "
            "WHEN 4 THEN 'SCREEN_WITH' ELSE 'RESET' END")
    return f"""
SELECT l_orderkey AS state, CAST(ord AS BIGINT) AS ord, concat('a', CAST(ord AS STRING)) AS action_id,
       {kind} AS action, l_extendedprice/10000 AS q,
       l_extendedprice/10000*(1 - l_discount) AS true_v, l_tax*10 AS p, l_quantity/50 AS open
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
                                   ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord
      FROM lineitem) AS c0"""


def _scored(d: Dialect) -> str:
    return ("SELECT doc_id, CAST(quality AS BIGINT) AS y, ((doc_id*37) % 1000)/1000e0 AS p, "
            "doc_id % 10 AS game FROM labels")


def _rates(d: Dialect) -> str:
    return ("SELECT event_id, user_id AS player_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS made, "
            + idiv("event_id", 125) + " AS game FROM events")


def _vectors(d: Dialect) -> str:
    return f"""
SELECT vec_id, {idiv('vec_id', 40)} AS clip_id, label, embedding FROM embeddings"""


def _track_points(d: Dialect) -> str:
    """Player detections as tracks (the entity number) with their foot in court feet."""
    h = [f"({v!r}e0)" if "e" not in repr(v) else f"({v!r})" for v in PIXEL_TO_COURT]
    w = f"({h[6]}*fx + {h[7]}*fy + {h[8]})"
    return f"""
SELECT clip_id, frame_idx, det_no AS track_id, CAST((CASE WHEN det_no < 5 THEN 0 ELSE 1 END + clip_id) % 2 AS BIGINT) AS team_label,
       conf, jersey_read, true_player_id, true_team, true_x, true_y, x1, y1, x2, y2,
       ({h[0]}*fx + {h[1]}*fy + {h[2]})/{w} AS x, ({h[3]}*fx + {h[4]}*fy + {h[5]})/{w} AS y
FROM (SELECT *, (x1 + x2)/2 AS fx, y2 AS fy FROM fx_detections WHERE cls = 'player') AS t0"""


def _shot_frames(d: Dialect) -> str:
    """Sampled frames with a court fraction, a player count and a camera-shot number."""
    return f"""
SELECT vec_id, clip_id, vec_id*2e0 AS t, {idiv('vec_id % 40', 4)} AS shot, ((vec_id*37) % 100)/100e0 AS frac, (vec_id*7) % 15 AS n_players
FROM fx_vectors"""


def _recs(d: Dialect) -> str:
    """Exported pauses: every third one is gated (no actions)."""
    return f"""
SELECT event_id, user_id % 5 AS clip_id, {d.micros('ts')}/1e6 AS video_time,
       CASE WHEN event_id % 3 > 0 THEN 6 + event_id % 7 END AS n_players,
       CASE WHEN event_id % 10 < 9 THEN value END AS ball_x, CASE WHEN event_id % 11 > 0 THEN user_id END AS handler_id,
       value AS rim_x, CASE WHEN event_id % 3 > 0 THEN event_type END AS action FROM events"""


VIEWS = {
    "fx_track_points": _track_points,
    "fx_shot_frames": _shot_frames,
    "fx_recs": _recs,
    "fx_tracking": _tracking(8),
    "fx_tracking_b": _tracking(4),
    "fx_tracking_c": _tracking(8, "WHERE NOT (k >= 0 AND (src + k) % 211 = 0)"),
    "fx_roster": _roster,
    "fx_games": _games,
    "fx_shots_raw": _shots_raw,
    "fx_pbp_raw": _pbp_raw,
    "fx_detections": _detections,
    "fx_video_frames": _video_frames,
    "fx_landmarks": _landmarks,
    "fx_keypoints": _keypoints,
    "fx_homographies": _homographies,
    "fx_calibrations": _calibrations,
    "fx_series": _series,
    "fx_cands": _cands,
    "fx_scored": _scored,
    "fx_rates": _rates,
    "fx_vectors": _vectors,
}

# Views that turn one event row into eleven entity rows.
EXPANDING = {"fx_tracking", "fx_tracking_b", "fx_tracking_c"}


#: Event rows of a task; each becomes eleven entities.
EVENT_ROWS = 10_000


def event_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for work that grows with the events: one a core at least, and none with more rows when the table grows.

    The rows are counted in the file footers.
    """
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    return max(spark.sparkContext.defaultParallelism, -(-rows // EVENT_ROWS))


def spread(df: DataFrame, tasks: int) -> DataFrame:
    """Rebalance a table that arrives in fewer splits than ``tasks``.

    Only then is the (narrow, not yet expanded) input shuffled; a table of many splits is
    left as it is.
    """
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


_WORD = re.compile(r"\b[A-Za-z_]\w*\b")


def spark_view(spark: SparkSession, sf_dir: str, name: str, tasks: Callable[[], int] | None = None) -> DataFrame:
    """A view (or a driver table) as a DataFrame over the whole tables; ``tasks`` gives ``event_tasks`` where it is known."""
    tasks = tasks or (lambda: event_tasks(spark, sf_dir))
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name](SPARK)
    used = {w for w in _WORD.findall(sql) if w in VIEWS or w in TABLES} - {name}
    args = {w: spark_view(spark, sf_dir, w, tasks) for w in used}
    if name in EXPANDING:
        args["events"] = spread(args["events"].select("event_id"), tasks())
    text = _WORD.sub(lambda m: "{" + m.group(0) + "}" if m.group(0) in used else m.group(0), sql)
    return spark.sql(text, **args)


def oracle_ctes() -> dict[str, str]:
    return {n: b(DUCK) for n, b in VIEWS.items()}
