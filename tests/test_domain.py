"""Small exact cases of the domain operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoopflow.functions import geometry as G, scalars as S, text as T
from hoopflow.operators import labels as L, possessions as P, rationale as RA, state as ST, video as V
from hoopflow.plans import q_text
from hoopflow.plans.registry import Source
from hoopflow.plans.views import PIXEL_TO_COURT
from hoopflow.sources import readers as RD

SF = "/root/testdata/sf0.001"


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()[0]


@pytest.mark.parametrize("x,y,zone", [(6.0, 25.0, "restricted_area"), (15.0, 25.0, "paint_non_ra"), (10.0, 1.0, "corner_three_right"),
                                      (10.0, 49.0, "corner_three_left"), (31.0, 25.0, "above_break_three_center"), (60.0, 25.0, "backcourt"),
                                      (22.0, 25.0, "mid_range_center")])
def test_zone(spark, x, y, zone):
    assert one(spark, G.zone(F.lit(x), F.lit(y))) == zone


def test_flip_twice_is_identity(spark):
    fx, fy = G.flip(*G.flip(F.lit(80.0), F.lit(10.0)))
    assert one(spark, F.array(fx, fy)) == [80.0, 10.0]


def test_hull(spark):
    pts = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])
    assert one(spark, ST.hull_area(pts((0, 0), (4, 0), (4, 4), (0, 4), (2, 2)))) == 16.0
    assert one(spark, ST.hull_area(pts((0, 0), (1, 1)))) == 0.0
    assert one(spark, ST.hull_area(pts((0, 0), (1, 1), (2, 2)))) == 0.0


def test_play_by_play_points_and_possessions(spark):
    rows = [("21", 0, 1, 1, "11:40", "A 3PT shot", None, 1, 10.0), ("21", 1, 2, 1, "11:20", None, "MISS jumper", 2, 20.0),
            ("21", 2, 4, 1, "11:18", "REBOUND", None, 1, 10.0), ("21", 3, 1, 1, "11:00", "layup", None, 1, 10.0),
            ("21", 4, 5, 1, "10:40", None, "Turnover", 2, 20.0)]
    pbp = RD.play_by_play(spark.createDataFrame(rows, RD.PBP_SCHEMA))
    assert [r["points"] for r in pbp.orderBy("seq").collect()] == [3, 0, 0, 2, 0]
    for hot in (None, 2):
        p = L.pbp_possessions(pbp, hot_rows=hot).orderBy("poss_order").collect()
        assert [(r["offense_team_id"], r["points"]) for r in p] == [(10, 3.0), (20, 0.0), (10, 2.0), (20, 0.0)]
        assert [r["start_clock"] for r in p] == [720.0, 700.0, 678.0, 660.0]


def test_play_by_play_file_without_sequence(spark, tmp_path):
    f = tmp_path / "pbp.csv"
    f.write_text("GAME_ID,EVENTMSGTYPE,PERIOD,PCTIMESTRING,HOMEDESCRIPTION,VISITORDESCRIPTION,PLAYER1_ID,PLAYER1_TEAM_ID\n"
                 "21,1,1,11:41,X 3PT Jump Shot,,1,10\n21,1,1,11:20,Y Layup,,2,20\n21,2,1,11:00,MISS Jumper,,1,10\n"
                 "21,3,1,10:50,X Free Throw 1 of 2,,1,10\n21,3,1,10:49,MISS Free Throw 2 of 2,,1,10\n21,5,1,10:30,X Turnover,,1,10\n")
    rows = RD.play_by_play(RD.read_csv(spark, str(f), RD.PBP_SCHEMA)).orderBy("seq").collect()
    assert [r["points"] for r in rows] == [3, 2, 0, 1, 0, 0]
    assert rows[0]["game_clock"] == 701.0 and rows[0]["game_id"] == "0000000021"


def test_clock_reader(spark):
    reads = [22.0, 22.0, 21.0, 8.7, 21.0, 20.0, 20.0]
    df = spark.createDataFrame([(1, i, r) for i, r in enumerate(reads)], "clip_id long, frame_idx long, clock_read double")
    out = [r["clock"] for r in V.validate_clock(df).orderBy("frame_idx").collect()]
    assert abs(out[3] - 21.0) < 0.6 and out[:3] == [22.0, 22.0, 21.0]


def test_ball_track_rejects_outlier(spark):
    xs = [(100.0 + 5 * i, 100.0) if i not in (4, 7) else None for i in range(12)]
    xs[6] = (900.0, 900.0)
    df = spark.createDataFrame([(1, i, *(p or (None, None))) for i, p in enumerate(xs)], "c long, f long, x double, y double")
    out = [(r["ball_x"], r["ball_y"]) for r in V.track_ball(df, ["c"], "f", "x", "y").orderBy("f").collect()]
    assert all(x is not None and abs(y - 100) < 5 and x < 200 for x, y in out)


def test_homography_round_trip(spark):
    from hoopflow.plans.views import CAMERA
    m = np.array(CAMERA).reshape(3, 3)
    rows = []
    for x, y in [(0, 0), (0, 50), (94, 0), (94, 50), (47, 25), (19, 17), (19, 33)]:
        u = m @ np.array([x, y, 1.0])
        rows.append((1, float(u[0] / u[2]), float(u[1] / u[2]), float(x), float(y), 0.9))
    rows.append((1, 10.0, 10.0, 90.0, 5.0, 0.9))          # one wrong landmark
    df = spark.createDataFrame(rows, "f long, px double, py double, court_x double, court_y double, conf double")
    r = V.fit_homographies(df, ["f"], inlier_ft=8.0).first()
    assert r["ok"] and r["median_ft"] < 2.0
    good = V.fit_homographies(df.where("court_x <> 90.0"), ["f"]).first()
    assert good["median_ft"] < 1e-6 and good["n_points"] == 7
    assert np.allclose(np.array(good["h"]), np.array(PIXEL_TO_COURT) / PIXEL_TO_COURT[8], rtol=1e-6)


def test_possession_frames_invariants(spark):
    m = Source(spark, SF)("fx_tracking_c")
    cols = ["possession_id", "frame_idx", "handler_player_id", "offense_team_id", "slice", "terminal_event"]
    plain = P.possession_frames(m).select(*cols)
    split = P.possession_frames(m.repartition(64), hot_rows=40).select(*cols)
    key = lambda r: tuple(str(v) for v in r)
    rows = sorted(map(tuple, plain.collect()), key=key)
    assert rows == sorted(map(tuple, split.collect()), key=key)
    # No handler run shorter than five frames inside a possession.
    by = {}
    for p, i, h, *_ in rows:
        by.setdefault(p, []).append((i, h))
    for fr in by.values():
        run, prev = 0, object()
        for _, h in sorted(fr):
            if h != prev:
                assert prev is None or run == 0 or run >= 5
                run, prev = 0, h
            run += 1


def test_drives_brute_force(spark):
    rows = []
    for i in range(160):
        h = 7 if i < 110 else 8
        hold = None if 20 <= i < 25 else h
        d7, d8 = abs(30 - (i % 70) * 0.3), 20.0
        rows.append(("g", 1, "p", i, hold, [(7, "offense", 5.25 + d7, 25.0), (8, "offense", 5.25 + d8, 35.0)]))
    f = spark.createDataFrame(rows, "game_id string, event_id long, possession_id string, frame_idx long, handler_player_id long, "
                                    "players array<struct<player_id: long, side: string, x: double, y: double>>")
    got = [(r["frame_idx"], r["driver_id"], r["success"]) for r in L.drives(f).orderBy("frame_idx").collect()]
    want, i = [], 0
    dist = lambda r, h: next(math.hypot(x - 5.25, y - 25) for p, _, x, y in r[5] if p == h)
    while i < len(rows):
        h = rows[i][4]
        if h is None:
            i += 1
            continue
        d0 = best = dist(rows[i], h)
        j = i
        while j < len(rows) and j < i + 50 and rows[j][4] in (None, h):
            best = min(best, dist(rows[j], h))
            j += 1
        if d0 - best >= 6:
            want.append((i, h, int(best <= 8)))
            i = max(j, i + 1)
        else:
            i += 1
    assert got == want and want


def test_template_is_always_clean(spark):
    t = RA.audit(RA.template(q_text.briefs(Source(spark, SF))))
    assert t.where("size(violations) > 0").count() == 0 and t.count() > 100


def test_text_audit(spark):
    allowed = F.array(F.lit(2.0), F.lit(1.23))
    assert one(spark, T.fabricated(F.lit("worth 1.23 or 9.9"), allowed)) == [9.9]
    assert one(spark, T.has_coordinate(F.lit("at (12.3, 4)"))) and not one(spark, T.has_coordinate(F.lit("at 12")))
    assert one(spark, T.leaked_ids(F.lit("give it to 201566 now"), F.array(F.lit(201566)))) == ["201566"]


@pytest.mark.parametrize("q,intent", [("show the best play", "best"), ("why not shoot?", "SHOOT"), ("explain", "why"), ("next", "next"), ("to 12", "pass_to_number"), ("hello", "help")])
def test_routes(spark, q, intent):
    assert one(spark, T.route(F.lit(q))) == intent


@pytest.mark.parametrize("name,cls", [("Basketball", "ball"), ("baseball bat", None), ("refrigerator", None), ("Person", "player"), ("hoop", "rim")])
def test_class_names(spark, name, cls):
    assert one(spark, S.class_of(F.lit(name))) == cls


def test_conformance(spark):
    s = ST.build(P.possession_frames(Source(spark, SF)("fx_tracking_c")))
    assert ST.missing_fields(s) == []
    assert ST.check(s).where("size(violations) > 0").count() == 0


def test_clusters_map_to_any_two_of_many_teams(spark):
    roster = spark.createDataFrame([(t, 10 * t + k, 100 * t + k) for t in (1, 2, 3, 4) for k in range(4)], "team_id long, jersey long, player_id long")
    sets = spark.createDataFrame([("a", 0, [40, 41, 42]), ("a", 1, [30, 31, 10]), ("b", 0, [20, 21]), ("b", 1, [20, 21, 22]), ("c", 1, [30]), ("d", 0, [99]), ("d", 1, [98])],
                                 "clip_id string, team_label long, jerseys array<long>")
    got = {(r.clip_id, r.team_label): r.team_id for r in V.cluster_teams(sets, roster).collect()}
    assert got == {("a", 0): 4, ("a", 1): 3, ("b", 0): 1, ("b", 1): 2, ("c", 0): 1, ("c", 1): 3, ("d", 0): 1, ("d", 1): 2}
    one = V.cluster_teams(sets, roster.where("team_id = 1")).select("team_id").distinct().collect()
    assert [r.team_id for r in one] == [None]


def test_clusters_without_evidence_take_different_teams(spark):
    link = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "jersey long, team string")
    p = spark.createDataFrame([("x", 1, 1, 0, 2), ("x", 1, 2, 1, None), ("x", 1, 3, 2, None), ("y", 1, 1, 0, None)], "clip_id string, frame_idx long, track_id long, team_id long, jersey long")
    got = {(r.clip_id, r.track_id): r.team for r in V.roster_override(p, link).collect()}
    assert got == {("x", 1): "B", ("x", 2): "A", ("x", 3): "C", ("y", 1): "0"}


def test_video_states_take_the_teams_of_the_roster(spark):
    """Two clusters with wrong teams: the jerseys read in them decide, the third one takes what is left."""
    from hoopflow.operators import app as AP
    cols = "clip_id long, frame_idx long, track_id long, team_label long, team_id long, player_id long, confidence double, jersey int, x double, y double, vx double, vy double, homog_ok boolean, possessor long, ball_last struct<x: double, y: double>, ball_seen boolean"
    row = lambda f, t, team, jersey: (1, f, t, team % 2, team, 100 + t, 0.9, jersey, 10.0 + t, 20.0, 0.0, 0.0, True, 1, (11.0, 20.0), True)
    rec = spark.createDataFrame([row(f, t, 8 if t < 3 else 9, {1: 4, 2: 5, 3: 30}.get(t)) for f in (0, 1) for t in (1, 2, 3, 4)], cols)
    link = spark.createDataFrame([(4, 77), (5, 77), (30, 66), (31, 66)], "jersey int, team long")
    teams = lambda d: {(p.player_id, p.team_id) for r in d.collect() for p in r.players}
    assert teams(AP.cv_states(rec)) == {(101, 8), (102, 8), (103, 9), (104, 9)}
    assert teams(AP.cv_states(rec, link)) == {(101, 77), (102, 77), (103, 66), (104, 66)}
    assert {r.offense_team_id for r in AP.cv_states(rec, link).collect()} == {77}


def test_random_policy_ignores_row_order(spark):
    from hoopflow.operators import actions as A
    c = spark.range(4000).selectExpr("id div 8 AS state", "id % 8 + 1 AS ord", "'PASS_TO' AS action", "rand(1) AS q", "id * 1.0 AS true_v", "0.5 AS open")
    c = c.persist()
    pick = lambda d, seed: {r.state: r.random for r in A.baseline_picks(d, ["state"], seed=seed).select("state", "random").collect()}
    a = pick(c, 0)
    assert a == pick(c.repartition(13).sortWithinPartitions("q"), 0) and a != pick(c, 1)
    counts = [sum(1 for s, v in a.items() if v == s * 8 + k) for k in range(8)]
    assert min(counts) > 30 and sum(counts) == 500
    c.unpersist()


def test_models_take_rows_with_unknown_features(spark):
    from hoopflow.operators import models as M
    rows = [(float(i % 7), None if i % 5 == 0 else float("nan") if i % 5 == 1 else float(i % 3), i % 2) for i in range(200)]
    d = spark.createDataFrame(rows, "a double, b double, label int")
    out = M.predict(M.fit_binary(d, ["a", "b"], rounds=2), d, "p")
    assert out.columns == ["a", "b", "label", "p"]
    got = out.collect()
    assert len(got) == 200 and all(0 <= r["p"] <= 1 for r in got)
    # The unknown counts as 0, and the input column comes back as it was.
    assert len({r["p"] for r in got if r["a"] == 3 and (r["b"] is None or r["b"] != r["b"] or r["b"] == 0)}) == 1
    assert sum(r["b"] is None for r in got) == 40


def test_states_for_entities_work_out_the_hull_once(spark):
    f = P.possession_frames(Source(spark, SF)("fx_tracking_c"))
    for s in (ST.build_for_entities(f), ST.build(f)):
        plan = s.select("context.spacing_area_sqft")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sequence(2, size(") == 2


def test_narrow_states_equal_whole_ones(spark):
    f = P.possession_frames(Source(spark, SF)("fx_tracking_c"))
    names = ["player_id", "team_id", "side", "x", "y", "vx", "vy", "has_ball"]
    rows = lambda s: s.select("possession_id", "frame_idx", "ball", "context.spacing_area_sqft", "context.n_players_observed",
                              F.transform("players", lambda p: F.struct(*[p[c] for c in names])).alias("players"))
    assert rows(ST.build_for_entities(f)).exceptAll(rows(ST.build(f))).count() == 0


def test_states_of_a_training_set_are_dealt_to_given_tasks(spark):
    from hoopflow.operators import datasets as D
    f = P.possession_frames(Source(spark, SF)("fx_tracking_c"))
    real = f.select(*D.POSS).distinct().withColumns({"start_clock": F.lit(700.0), "points": F.lit(2.0)})
    assert D.value_rows(f, real, parts=23).rdd.getNumPartitions() == 23
    assert D.value_rows(f, real, parts=23).count() == f.count()


def test_states_of_passes_are_dealt_to_given_tasks(spark):
    from hoopflow.operators import datasets as D
    f = P.possession_frames(Source(spark, SF)("fx_tracking_c"))
    assert D._states_at(f, f.where("frame_idx % 50 = 0"), 23).rdd.getNumPartitions() == 23


def test_value_model_is_fitted_on_all_rows(spark, monkeypatch):
    from hoopflow.operators import models as M
    import __spark_entry__ as entry
    d = spark.range(40000).selectExpr("id / 40000 AS a", "id % 7 / 1 AS b", "CASE WHEN id >= 20000 THEN 2e0 ELSE 0e0 END AS y", "1e0 AS w")
    model = M.fit_value(d, ["a", "b"], rounds=1, depth=1)
    assert model.stages[-1].getSubsamplingRate() == 1.0
    # The only step lies at a quantile of all rows, so one split finds it to the rank error.
    p = M.predict(model, d, "p").selectExpr("a", "p", "y").collect()
    assert sum(abs(r.p - r.y) > 0.5 for r in p) <= 2 * M.QUANTILE_ERROR * len(p)
    seen = []
    monkeypatch.setattr(M, "fit_value", lambda v, validation=None: seen.append((v.count(), v.selectExpr("max(frame_idx % 15)").first()[0])) or model)
    monkeypatch.setattr(M, "predict", lambda m, v, out: v.withColumn(out, F.lit(0.0)))
    entry.queries()["ml_fit_value"](spark, SF)
    assert seen[0][1] == 14


def test_candidates_by_batch_equal_those_by_column(spark):
    from hoopflow import fixed as K
    from hoopflow.operators import actions as A, features as FT, futures as FU
    key, act, h = ["possession_id", "frame_idx"], F.col("action"), F.col("handler")
    f = P.possession_frames(Source(spark, SF)("fx_tracking_c")).limit(300)
    # Some frames lack the ball, the shot clock, velocities or all but one defender.
    some = F.filter("players", lambda p: (p["side"] == "offense") | (p["player_id"] % 5 == 3))
    odd = f.withColumns({"possession_id": F.concat(F.lit("odd"), "possession_id"), "players": F.when(F.col("frame_idx") % 3 == 0, F.filter("players", lambda p: p["side"] == "offense"))
                         .when(F.col("frame_idx") % 3 == 1, some).otherwise(F.transform("players", lambda p: p.withField("vx", F.lit(None).cast("double")))),
                         "ball": F.when(F.col("frame_idx") % 2 == 0, F.col("ball")), "shot_clock": F.lit(None).cast("double")})
    s = ST.build(f.unionByName(odd)).persist()
    got = FU.candidates(s, key)
    c = A.enumerate_actions(s).withColumns({"_def": ST.of_side("players", "defense"), "_t": F.get(F.filter("players", lambda p: p["player_id"] == F.col("target")), F.lit(0))})
    now = {f"{kind}_{n}": F.when(act == name, v) for kind, name, m in (("shot", "SHOOT", FT.shot(h, F.col("shot_clock"))), ("pass", "PASS_TO", FT.passing(F.col("_def"), h, F.col("_t"))),
                                                                      ("drive", "DRIVE", FT.driving(F.col("_def"), h, F.coalesce("direction", F.lit("middle"))))) for n, v in m.items() if f"{kind}_{n}" in FU.NOW}
    want = c.select(*key, "ord", "action", "actor", "target", "direction", "zone", "target_zone", "target_open", F.col("_t.nearest_defender.dist").alias("target_sep"), *[v.cast("double").alias(n) for n, v in now.items()])
    nxt = FT.mean_pool(FT.entities(A.next_states(A.enumerate_actions(s))))
    near = F.col("handler.nearest_defender")
    after = nxt.select(*key, "ord", h["player_id"].alias("next_handler"), near["player_id"].alias("next_def_id"), h["zone"].alias("next_zone"), near["dist"].alias("next_def_dist"), near["angle_deg"].alias("next_def_angle"),
                       h["defender_pressure"].alias("next_pressure"), *[h[n].alias(f"next_{n}") for n in ("x", "y", "speed", "dist_to_rim", "angle_to_rim_deg")], *[F.col(n[6:]).alias(n) for n in FU.DOUBLES if n.startswith("value_")])
    rows = lambda d, cols: sorted(tuple("~" if r[n] is None else f"{r[n] + 0.0:.9f}" if isinstance(r[n], float) else str(r[n]) for n in cols) for r in d.select(*cols).collect())
    for d, part in ((want, got), (after, got.where("action <> 'SHOOT'"))):
        a = rows(part, d.columns)
        assert len(a) > 2000 and a == rows(d, d.columns)
    s.unpersist()


def test_frames_measured_by_batch_equal_states(spark):
    from hoopflow.operators import futures as FU
    from hoopflow.plans import q_state as QS
    key = ["possession_id", "frame_idx"]
    f = P.possession_frames(Source(spark, SF)("fx_tracking_c")).persist()
    want = QS.state_rows(ST.build(ST.with_touches(f, ["game_id", "event_id", "possession_id"], F.col("frame_idx")), True))
    got = FU.player_rows(f, *key)
    got = got.select(*[G.r4(c).alias(c) if c in FU.MEASURES else F.col(c) for c in want.columns])
    assert got.count() == want.count() > 5000 and got.exceptAll(want).count() == 0
    rows = lambda d: d.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])
    a, b = rows(FU.candidates(f, key, built=False)), rows(FU.candidates(ST.build(f), key))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    f.unpersist()


def test_last_touches_go_on_in_the_next_batch():
    from hoopflow.operators import futures as FU
    group, handler = np.array([1] * 5 + [2] * 4), np.array([7, -1, 8, -1, -1, -1, 8, -1, 7])
    clock, ids = 100.0 - np.arange(9), np.array([[7, 8]] * 9)
    whole, last = FU._touches(group, handler, clock, ids, {})
    assert np.array_equal(whole, np.array([[100, np.nan], [100, np.nan], [100, 98], [100, 98], [100, 98], [np.nan, np.nan], [np.nan, 94], [np.nan, 94], [92, 94]]), equal_nan=True)
    assert last == {7: 92.0, 8: 94.0}
    for cut in range(1, 9):
        first, carried = FU._touches(group[:cut], handler[:cut], clock[:cut], ids[:cut], {})
        goes_on = group[cut] == group[cut - 1]
        rest, end = FU._touches(group[cut:] - group[cut] + (not goes_on), handler[cut:], clock[cut:], ids[cut:], carried if goes_on else {})
        assert np.array_equal(np.concatenate([first, rest]), whole, equal_nan=True) and end == last
