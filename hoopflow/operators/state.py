"""Per-frame state: everything about a frame's players, computed inside its array.

All operators here are row-local (no shuffle): nearest defender, lane counts, help, hull,
scheme and screen are folds over at most a roster of structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hoopflow import fixed as K
from hoopflow.functions import geometry as G
from hoopflow.functions.geometry import rnd


def of_side(players, side: str) -> Column:
    return F.filter(players, lambda p: p["side"] == side)


def nearest(defenders: Column, x: Column, y: Column) -> Column:
    """Closest of an array as struct(d, player_id, x, y); ties go to the lowest id."""
    return F.array_min(F.transform(defenders, lambda q: F.struct(
        G.dist(q["x"], q["y"], x, y).alias("d"), q["player_id"].alias("player_id"),
        q["x"].alias("x"), q["y"].alias("y"))))


def unnest(df: DataFrame, array: str | Column, alias: str, pos: str | None = None) -> DataFrame:
    """Explode without the filter that a plain ``explode`` infers.

    That filter (size > 0) would be pushed below and evaluate the whole array expression a
    second time.
    """
    gen = F.posexplode_outer(array).alias(pos, alias) if pos else F.explode_outer(array).alias(alias)
    return df.select("*", gen).where(F.col(alias).isNotNull())


def decided(states: DataFrame) -> DataFrame:
    """States with a ball handler, by the plain id column for the same reason."""
    return states.where("handler_player_id IS NOT NULL")


def sorted_median(a: Column) -> Column:
    n = F.size(a)
    mid = (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, mid)


def _chain(points: Column) -> Column:
    """One half of the hull: drop trailing points that do not turn left, then append."""
    empty = F.filter(points, lambda p: F.lit(False))

    def add(hull, p):
        turn = lambda m: ((F.get(hull, m - 1)["x"] - F.get(hull, m - 2)["x"]) * (p["y"] - F.get(hull, m - 2)["y"])
                          - (F.get(hull, m - 1)["y"] - F.get(hull, m - 2)["y"]) * (p["x"] - F.get(hull, m - 2)["x"]))
        sizes = F.when(F.size(hull) >= 2, F.sequence(F.lit(2), F.size(hull)))
        keep = F.coalesce(F.array_max(F.filter(sizes, lambda m: turn(m) > 0)), F.least(F.size(hull), F.lit(1)))
        return F.concat(F.slice(hull, F.lit(1), keep), F.array(p))

    return F.aggregate(points, empty, add)


def _ring(pts: Column) -> Column:
    """Hull of sorted points. Both chains end where the other starts, so the doubled corners add nothing to the area."""
    return F.concat(_chain(pts), _chain(F.reverse(pts)))


def ring_area(ring: Column, n: Column) -> Column:
    nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    twice = F.aggregate(F.zip_with(ring, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]),
                        F.lit(0.0), lambda s, v: s + v)
    # Snapped to 1e-6, so that the order of the sum cannot show in later rounding.
    return F.when(n >= 3, rnd(F.abs(twice) / 2, 6)).otherwise(0.0)


def hull_area(points: Column) -> Column:
    """Area of the convex hull of an array of struct(x, y); 0 below three points."""
    return ring_area(_ring(F.array_sort(points)), F.size(points))


def scheme(offense: Column, defense: Column) -> Column:
    gaps = F.array_sort(F.transform(defense, lambda d: F.array_min(
        F.transform(offense, lambda o: G.dist(d["x"], d["y"], o["x"], o["y"])))))
    return (F.when((F.size(offense) == 0) | (F.size(defense) == 0), "unknown")
            .when(sorted_median(gaps) < K.MAN_MEDIAN, "man").otherwise("zone"))


def with_touches(frames: DataFrame, by: list[str], order) -> DataFrame:
    """Add each player's last touch clock inside the possession.

    Works on the frame partitioning: explode, one window per player, nest again.
    """
    w = (Window.partitionBy(*by, "_p.player_id").orderBy(order)
         .rowsBetween(Window.unboundedPreceding, 0))
    rest = [c for c in frames.columns if c not in ("players", *by)]
    keep = F.struct(*rest).alias("_rest")
    long = unnest(frames.select(*by, keep, "players"), "players", "_p").drop("players")
    held = F.col("_rest.handler_player_id") == F.col("_p.player_id")
    long = (long.select("*", *[F.col(f"_rest.{c}").alias(c) for c in ("frame_idx", "game_clock")])
            .withColumn("_t", F.last(F.when(held, F.col("game_clock")), True).over(w)))
    return (long.groupBy(*by, "frame_idx")
            .agg(F.first("_rest").alias("_rest"),
                 F.array_sort(F.collect_list(F.struct("_p.*", F.col("_t").alias("touch_clock")))).alias("players"))
            .select(*by, "_rest.*", "players"))


def _player_fields(p, n, d, ang, spd, touch, has, clock, fields: list[str] | None = None) -> list[Column]:
    """The full per-player record, or its ``fields``, from a raw player, its nearest defender and measures."""
    near = F.struct(n["player_id"].alias("player_id"), rnd(n["d"], 2).alias("dist"),
                    rnd(G.angle_between(K.RIM[0] - p["x"], K.RIM[1] - p["y"], n["x"] - p["x"], n["y"] - p["y"]), 1).alias("angle_deg"))
    since = rnd(F.greatest(F.lit(0.0), touch - clock), 2)
    rest = {"speed": rnd(spd, 2), "orientation_deg": rnd(G.heading(p["vx"], p["vy"]), 1),
            "orientation_source": G.heading_source(p["vx"], p["vy"]),
            "dist_to_rim": rnd(d, 2), "angle_to_rim_deg": rnd(ang, 1), "zone": G.zone(p["x"], p["y"], d, ang),
            "nearest_defender": F.when(n.isNotNull(), near),
            "nearest_dist": F.when(n.isNotNull(), rnd(n["d"], 2)),
            "defender_pressure": F.when(n.isNotNull(), rnd(G.pressure(p["x"], p["y"], n["x"], n["y"]), 3)).otherwise(0.0),
            "seconds_since_touch": F.when(has, F.lit(0.0)).when(touch.isNotNull(), since)}
    keep = [f for f in rest if f != "nearest_dist"] if fields is None else fields
    return [*_basic_fields(p, has), *[rest[f].alias(f) for f in keep]]


def _basic_fields(p, has) -> list[Column]:
    return [p["player_id"].alias("player_id"), p["team_id"].alias("team_id"), p["side"].alias("side"),
            *[rnd(p[c], 2).alias(c) for c in ("x", "y", "vx", "vy")], has.alias("has_ball")]


def _holds(p) -> Column:
    return F.coalesce(p["player_id"] == F.col("handler_player_id"), F.lit(False))


def _finish(d: DataFrame, scheme_col: Column, screen: Column, confidence: Column | None) -> DataFrame:
    return d.withColumns({
        "ball": F.struct(*[rnd(F.col(f"ball.{a}"), 2).alias(a) for a in ("x", "y", "z", "vx", "vy")],
                         F.col("ball_in_flight").alias("in_flight")),
        "context": F.struct(
            F.size("players").alias("n_players_observed"), F.col("_spacing").alias("spacing_area_sqft"),
            scheme_col.alias("defense_scheme"), screen.alias("active_screen"),
            (confidence if confidence is not None else F.lit(1.0)).alias("confidence"))})


def with_ring(d: DataFrame) -> DataFrame:
    """Adds ``_ring``, the hull of ``_off``. Sorted points and hull are columns of their own: an expression that reads them
    several times would work them out each time."""
    d = d.withColumn("_pts", F.array_sort(F.transform("_off", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    return d.withColumn("_ring", _ring(F.col("_pts"))).drop("_pts")


def _spacing() -> Column:
    return rnd(ring_area(F.col("_ring"), F.size("_off")), 1)


def build(frames: DataFrame, touches: bool = False, confidence: Column | None = None) -> DataFrame:
    """Frames to states. Needs handler_player_id, game_clock, ball, players; keeps the rest."""
    d = with_ring(frames.withColumns({"_def": of_side("players", "defense"), "_off": of_side("players", "offense")}))

    def measured(p):
        dist, ang = G.polar(p["x"], p["y"])
        touch = p["touch_clock"] if touches else F.lit(None).cast("double")
        return F.struct(
            *[p[c].alias(c) for c in ("player_id", "team_id", "side", "x", "y", "vx", "vy")],
            dist.alias("d"), ang.alias("a"), G.speed(p["vx"], p["vy"]).alias("s"), touch.alias("touch_clock"),
            F.when(p["side"] == "offense", nearest(F.col("_def"), p["x"], p["y"])).alias("n"))

    d = d.withColumns({"_spacing": _spacing(), "_scheme": scheme(F.col("_off"), F.col("_def")),
                       "players": F.transform("players", measured)})
    d = d.withColumn("players", F.transform("players", lambda p: F.struct(*_player_fields(
        p, p["n"], p["d"], p["a"], p["s"], p["touch_clock"], _holds(p), F.col("game_clock")))))
    d = d.withColumn("handler", F.get(F.filter("players", lambda p: p["has_ball"]), F.lit(0)))
    d = _finish(d, F.col("_scheme"), active_screen(F.col("players"), F.col("handler")), confidence)
    return d.drop("_def", "_off", "_ring", "_spacing", "_scheme")


def build_for_entities(frames: DataFrame) -> DataFrame:
    """States with the basic player records, the ball and the spacing, which is all that ``features.entities`` reads."""
    d = with_ring(frames.withColumn("_off", of_side("players", "offense")))
    d = d.withColumns({"_spacing": _spacing(), "players": F.transform("players", lambda p: F.struct(*_basic_fields(p, _holds(p))))})
    d = _finish(d, F.lit("unknown"), F.lit(None).cast("struct<screener_id: bigint, phase: string, source: string>"), None)
    return d.drop("_off", "_ring", "_spacing")


#: What ``features.passing`` reads of a player beside the basic record.
PASS_RECORD = ["orientation_deg", "dist_to_rim", "nearest_dist", "defender_pressure"]


def build_for_passes(frames: DataFrame) -> DataFrame:
    """Handler, team-mates (``mates``) and basic defenders (``_def``) of frames with a handler; only the offense is measured."""
    d = decided(frames).withColumn("_def", of_side("players", "defense"))

    def measured(p):
        return F.struct(*[p[c].alias(c) for c in ("player_id", "team_id", "side", "x", "y", "vx", "vy")],
                        G.polar(p["x"], p["y"])[0].alias("d"), nearest(F.col("_def"), p["x"], p["y"]).alias("n"))

    d = d.withColumn("_off", F.transform(of_side("players", "offense"), measured))
    none = F.lit(None).cast("double")
    d = d.withColumn("_off", F.transform("_off", lambda p: F.struct(*_player_fields(
        p, p["n"], p["d"], none, none, none, _holds(p), F.col("game_clock"), PASS_RECORD))))
    return d.withColumns({"_def": F.transform("_def", lambda p: F.struct(*_basic_fields(p, F.lit(False)))),
                          "handler": F.get(F.filter("_off", lambda p: p["has_ball"]), F.lit(0)),
                          "mates": F.filter("_off", lambda p: p["player_id"] != F.col("handler_player_id"))}).drop("_off")


def build_for_handler(frames: DataFrame) -> DataFrame:
    """States in which only the ball handler carries the full record.

    Enough to value a hypothetical state (handler's shot plus pooled entities), and its
    handler columns are generated code instead of lambdas over all players.
    """
    d = with_ring(frames.withColumns({"_def": of_side("players", "defense"), "_off": of_side("players", "offense"),
                                       "_h": F.get(F.filter("players", _holds), F.lit(0))}))
    h = F.col("_h")
    dist, ang = G.polar(h["x"], h["y"])
    d = d.withColumns({"_d": dist, "_a": ang, "_s": G.speed(h["vx"], h["vy"]), "_spacing": _spacing(),
                       "_n": F.when(h["side"] == "offense", nearest(F.col("_def"), h["x"], h["y"]))})
    full = F.struct(*_player_fields(h, F.col("_n"), F.col("_d"), F.col("_a"), F.col("_s"), F.lit(None).cast("double"),
                                    F.lit(True), F.col("game_clock")))
    d = d.withColumns({"handler": F.when(h.isNotNull(), full),
                       "players": F.transform("players", lambda p: F.struct(*_basic_fields(p, _holds(p))))})
    d = _finish(d, F.lit("unknown"), F.lit(None).cast("struct<screener_id: bigint, phase: string, source: string>"), None)
    return d.drop("_def", "_off", "_ring", "_h", "_d", "_a", "_s", "_n", "_spacing")


def active_screen(players: Column, handler: Column, within: float = K.SCREEN_DIST) -> Column:
    """First offensive team-mate within 3.5 ft (by default) of the handler."""
    mates = F.filter(players, lambda p: (p["side"] == "offense") & (p["player_id"] != handler["player_id"])
                     & (G.dist(p["x"], p["y"], handler["x"], handler["y"]) <= within))
    return F.when(F.size(mates) > 0, F.struct(F.get(mates, F.lit(0))["player_id"].alias("screener_id"),
                                              F.lit("approach").alias("phase"), F.lit("heuristic").alias("source")))


# Conformance --------------------------------------------------------------------
PLAYER_FIELDS = ["player_id", "team_id", "side", "x", "y", "vx", "vy", "speed", "orientation_deg", "has_ball",
                 "dist_to_rim", "angle_to_rim_deg", "zone", "nearest_defender", "defender_pressure", "seconds_since_touch"]
CONTEXT_FIELDS = ["n_players_observed", "spacing_area_sqft", "defense_scheme", "active_screen", "confidence"]
BALL_FIELDS = ["x", "y", "z", "vx", "vy", "in_flight"]


def missing_fields(df: DataFrame) -> list[str]:
    """Schema part of the contract: required nested fields that are absent."""
    t = {f.name: f.dataType for f in df.schema.fields}
    want = {"ball": BALL_FIELDS, "context": CONTEXT_FIELDS}
    out = [f"missing top-level key: {k}" for k in (*want, "players", "quarter", "game_clock", "shot_clock") if k not in t]
    for k, names in want.items():
        if k in t:
            out += [f"{k} missing sub-keys: {n}" for n in sorted(set(names) - set(t[k].names))]
    if "players" in t:
        out += [f"player missing fields: {n}" for n in sorted(set(PLAYER_FIELDS) - set(t["players"].elementType.names))]
    return out


def violations(n_players, confidence, sides, scheme_col) -> Column:
    """Value part of the contract, as an array of messages; empty means conforming."""
    return F.array_compact(F.array(
        F.when(n_players == 0, "no players in the state"),
        F.when(~confidence.between(0.0, 1.0), "confidence is not a share"),
        F.when(F.size(F.array_except(sides, F.array(F.lit("offense"), F.lit("defense")))) > 0, "a side is neither offense nor defense"),
        F.when(~scheme_col.isin("man", "zone", "unknown"), "unknown kind of scheme")))


def check(states: DataFrame) -> DataFrame:
    return states.withColumn("violations", violations(
        F.size("players"), F.col("context.confidence"), F.array_distinct(F.transform("players", lambda p: p["side"])),
        F.col("context.defense_scheme")))
