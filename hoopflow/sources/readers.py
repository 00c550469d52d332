"""Readers. Every schema is explicit, so nothing is inferred and unused fields are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from hoopflow import fixed as K
from hoopflow.functions import scalars as S
from hoopflow.operators.ranking import global_rank

_PLAYERS = "array<struct<playerid: bigint, firstname: string, lastname: string, jersey: string, position: string>>"
_TEAM = f"struct<teamid: bigint, abbreviation: string, name: string, players: {_PLAYERS}>"
EVENT_TYPE = f"struct<eventId: string, home: {_TEAM}, visitor: {_TEAM}, moments: array<array<string>>>"
GAME_SCHEMA = f"gameid string, gamedate string, events array<{EVENT_TYPE}>"
#: An event object opens with this key, so a document can be cut there.
EVENT_KEY = '"eventId"'


def game_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Sorted listing of game files with a position for slicing; reads no content."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    return global_rank(f, ["path"], "pos")[0]


def read_games(spark: SparkSession, paths, events_only: bool = False) -> DataFrame:
    """Whole-game documents, plain or gzip. One file is one record, hence one task."""
    return spark.read.schema(GAME_SCHEMA).option("multiLine", True).json(paths)


def read_events(spark: SparkSession, paths) -> DataFrame:
    """(game_id, game_date, event_pos, ev): the events of whole-game documents, read without holding a document in one task.

    The text is cut at the key that opens every event, so a plain file is read by as many tasks as it has splits; a
    compressed one can't be split. ``event_pos`` grows with an event's place in its document: it is the start of the
    split plus the event's number in the task, and a split has more bytes than a task has events. What is before the
    first event is the header, one short row a document, joined back by file. A part that
    isn't an event raises.
    """
    raw = spark.read.option("lineSep", EVENT_KEY).text(paths)
    number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    raw = raw.select("value", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") + number).alias("event_pos"))
    is_event = F.ltrim("value").startswith(":")
    field = lambda name: F.nullif(F.regexp_extract("value", rf'"{name}"\s*:\s*"([^"]*)"', 1), F.lit(""))
    head = raw.where(~is_event).select("_file", F.coalesce(field("gameid"), F.lit("unknown")).alias("game_id"), field("gamedate").alias("game_date"))
    body = F.concat(F.lit("{" + EVENT_KEY), "value")
    event = F.from_json(body, EVENT_TYPE)
    bad = F.raise_error(F.concat(F.lit("not an event: "), F.substring("value", 1, 60)))
    parsed = raw.where(is_event).withColumn("ev", event)
    parsed = parsed.withColumn("ev", F.when(F.col("ev.eventId").isNotNull(), F.col("ev")).when(is_event, bad.cast(EVENT_TYPE)))
    return parsed.join(head, "_file").select("game_id", "game_date", "event_pos", "ev")


def events(games: DataFrame) -> DataFrame:
    """(game_id, event_pos, ev) of whole-game rows, spread over the cluster, as everything after a document should not be one task."""
    return (games.select(F.coalesce("gameid", F.lit("unknown")).alias("game_id"), F.posexplode("events").alias("event_pos", "ev"))
            .repartition("game_id", "event_pos"))


def moments(ev: DataFrame) -> DataFrame:
    """Long rows, one per (moment, entity), with document positions for dedup, from rows of events."""
    mo = ev.select("game_id", F.col("ev.eventId").alias("event_id"), "event_pos",
                   F.posexplode("ev.moments").alias("moment_pos", "m"))
    m = lambda i: F.get("m", F.lit(i))
    mo = mo.where(F.size("m") >= 6).select(
        "game_id", "event_id", "event_pos", "moment_pos", m(0).cast("long").alias("quarter"), m(1).cast("long").alias("unix_ms"),
        m(2).cast("double").alias("game_clock"), m(3).cast("double").alias("shot_clock"),
        F.from_json(m(5), "array<array<double>>").alias("coords"))
    en = mo.select(*[c for c in mo.columns if c != "coords"], F.posexplode("coords").alias("entity_pos", "e")).where(F.size("e") >= 5)
    at = lambda i: F.get("e", F.lit(i))
    return en.select("game_id", "event_id", "quarter", "game_clock", "shot_clock", "unix_ms", at(0).cast("long").alias("team_id"),
                     at(1).cast("long").alias("player_id"), at(2).alias("x"), at(3).alias("y"), at(4).alias("z"),
                     (at(0) == K.BALL_ID).alias("is_ball"), "event_pos", "moment_pos", "entity_pos")


def roster(ev: DataFrame) -> DataFrame:
    """First row per (game, player) of both sides, from rows of events."""
    side = lambda name, n: ev.select("game_id", "event_pos", F.lit(n).alias("side_no"), F.lit(name).alias("side"),
                                     F.col(f"ev.{name}").alias("t"))
    both = side("home", 0).unionByName(side("visitor", 1)).where("t IS NOT NULL")
    rows = both.select("game_id", "event_pos", "side_no", "side", "t.teamid", "t.abbreviation", F.posexplode("t.players").alias("p_pos", "p"))
    out = rows.select("game_id", F.col("teamid").alias("team_id"), F.col("abbreviation").alias("team_abbr"), "side",
                      F.col("p.playerid").alias("player_id"), "p.firstname", "p.lastname", S.safe_int("p.jersey").alias("jersey"),
                      "p.position", "event_pos", "side_no", "p_pos")
    return first_per(out, ["game_id", "player_id"], ["event_pos", "side_no", "p_pos"]).drop("event_pos", "side_no", "p_pos")


def first_per(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


SHOTS_SCHEMA = ("ACTION_TYPE string, GAME_ID string, MINUTES_REMAINING bigint, SECONDS_REMAINING bigint, PERIOD bigint, PLAYER_ID bigint, "
                "TEAM_ID bigint, SHOT_MADE_FLAG bigint, SHOT_DISTANCE double, SHOT_TYPE string")
PBP_SCHEMA = ("GAME_ID string, SEQ bigint, EVENTMSGTYPE bigint, PERIOD bigint, PCTIMESTRING string, HOMEDESCRIPTION string, "
              "VISITORDESCRIPTION string, PLAYER1_ID bigint, PLAYER1_TEAM_ID double")


def read_csv(spark: SparkSession, path, schema: str) -> DataFrame:
    """CSV with a header: the wanted columns by name, cast without inference.

    Other columns are pruned, absent ones are NULL; an absent SEQ becomes the row position,
    which breaks ties between equal clocks in file order.
    """
    raw = spark.read.option("header", True).csv(path)
    pick = lambda f: F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else (
        F.monotonically_increasing_id() if f.name == "SEQ" else F.lit(None).cast(f.dataType))
    return raw.select(*[pick(f).alias(f.name) for f in T.StructType.fromDDL(schema).fields])


def shots(raw: DataFrame, game_ids=None) -> DataFrame:
    d = raw.withColumn("game_id", F.lpad(F.col("GAME_ID").cast("string"), 10, "0"))
    if game_ids is not None:
        d = d.where(F.col("game_id").isin([str(g) for g in game_ids]))
    three = F.col("SHOT_TYPE").contains("3PT").cast("long")
    return d.select("game_id", F.col("PLAYER_ID").alias("player_id"), F.col("TEAM_ID").alias("team_id"), F.col("PERIOD").alias("quarter"),
                    (F.col("MINUTES_REMAINING") * 60 + F.col("SECONDS_REMAINING")).cast("double").alias("game_clock"),
                    F.col("SHOT_MADE_FLAG").cast("long").alias("made"), (three + 2).alias("points"), three.alias("is_three"),
                    F.col("SHOT_DISTANCE").alias("shot_distance"))


def play_by_play(raw: DataFrame) -> DataFrame:
    d = F.concat_ws(" ", F.coalesce("HOMEDESCRIPTION", F.lit("")), F.coalesce("VISITORDESCRIPTION", F.lit("")))
    return raw.select(F.lpad(F.col("GAME_ID").cast("string"), 10, "0").alias("game_id"), F.col("SEQ").alias("seq"),
                      F.col("PERIOD").cast("long").alias("quarter"), S.clock_seconds("PCTIMESTRING").alias("game_clock"),
                      F.col("EVENTMSGTYPE").cast("long").alias("event_type"), F.col("PLAYER1_ID").alias("player1_id"),
                      F.col("PLAYER1_TEAM_ID").cast("long").alias("team_id"), S.points_scored("EVENTMSGTYPE", d).cast("long").alias("points"))


def link_roster(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """Team rosters, one document per file or (not ``multi_line``) one per line."""
    sch = "teams array<struct<id: string, players: array<struct<jersey: int, name: string, fg3_pct: double, fg_pct: double>>>>"
    t = spark.read.schema(sch).option("multiLine", multi_line).json(path).select(F.explode("teams").alias("t"))
    return t.select(F.col("t.id").alias("team"), F.explode("t.players").alias("p")).select("team", "p.*")


def calibrations(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """Camera calibrations, one document per file or (not ``multi_line``) one per line."""
    sch = ("H array<array<double>>, points map<string, array<double>>, img_size array<int>, reproj_error_ft double, time double, "
           "ball_px array<double>")
    d = spark.read.schema(sch).option("multiLine", multi_line).json(path)
    return d.select(F.col("_metadata.file_name").alias("file"), F.flatten("H").alias("h"), "points", "img_size", "reproj_error_ft",
                    "time", "ball_px", F.size("points").alias("n_points"))


PREDICTIONS = "array<struct<class: string, confidence: double, x: double, y: double, width: double, height: double>>"


def detector_responses(raw: DataFrame, body: str = "response", keep: list[str] = ("frame_idx",)) -> DataFrame:
    """Stored detector responses to boxes of our classes; the list may be nested one deeper."""
    outs = F.from_json(body, "struct<outputs: array<struct<predictions: string>>>")["outputs"]
    def listed(o):
        p = o["predictions"]
        flat = F.from_json(p, PREDICTIONS)
        deep = F.from_json(p, f"struct<predictions: {PREDICTIONS}>")["predictions"]
        return F.when(p.startswith("["), flat).otherwise(deep)
    first = F.get(F.filter(F.transform(outs, listed), lambda v: v.isNotNull()), F.lit(0))
    d = raw.select(*keep, F.explode(first).alias("p"))
    cls = S.class_of(F.trim("p.class"))
    half = lambda side: F.col(f"p.{side}") / 2
    return (d.select(*keep, cls.alias("cls"), (F.col("p.x") - half("width")).alias("x1"), (F.col("p.y") - half("height")).alias("y1"),
                     (F.col("p.x") + half("width")).alias("x2"), (F.col("p.y") + half("height")).alias("y2"),
                     F.coalesce("p.confidence", F.lit(0.0)).alias("conf")).where("cls IS NOT NULL"))


def confident(dets: DataFrame, conf: float = 0.2, ball_conf: float = 0.05) -> DataFrame:
    """Per-class confidence floors; the ball has its own, lower one."""
    return dets.where(F.when(F.col("cls") == "ball", F.col("conf") >= ball_conf)
                      .when(F.col("cls").isin("player", "referee", "rim"), F.col("conf") >= conf).otherwise(False))


REC_SCHEMA = ("video_time double, frame_idx bigint, gate boolean, confidence double, n_players bigint, handler_id bigint, ball_px array<double>, "
              "rim_px array<double>, actions array<struct<id: string, action: string, label: string, epv: double, success_pct: bigint, target_id: bigint>>")


def recommendations(spark: SparkSession, path) -> DataFrame:
    sch = f"video string, fps double, duration double, recommendations array<struct<{', '.join(p.strip().replace(' ', ': ', 1) for p in _split_ddl(REC_SCHEMA))}>>"
    d = spark.read.schema(sch).option("multiLine", True).json(path)
    return d.select(F.col("_metadata.file_name").alias("file"), "video", "duration", F.explode("recommendations").alias("r")).select("file", "video", "duration", "r.*")


def _split_ddl(ddl: str) -> list[str]:
    return [f"{f.name} {f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl).fields]


def priors(spark: SparkSession, path) -> DataFrame:
    d = spark.read.schema("team_name string, emphasis string, avoid_zones array<string>, min_epv_to_recommend double").option("multiLine", True).json(path)
    return d.select(F.coalesce("team_name", F.lit("the offense")).alias("team_name"), F.coalesce("emphasis", F.lit("")).alias("emphasis"),
                    F.coalesce("avoid_zones", F.array().cast("array<string>")).alias("avoid_zones"),
                    F.coalesce("min_epv_to_recommend", F.lit(0.0)).alias("min_epv_to_recommend"))


def keypoint_labels(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """Label manifests, one document per file or (not ``multi_line``) one per line."""
    sch = ("keypoint_names array<string>, records array<struct<image: string, kp_px: array<array<double>>, visible: array<boolean>, "
           "source: string, reproj_ft: double>>")
    d = spark.read.schema(sch).option("multiLine", multi_line).json(path)
    r = d.select("keypoint_names", F.explode("records").alias("r"))
    k = r.select("keypoint_names", "r.image", "r.source", "r.reproj_ft", "r.visible", F.posexplode("r.kp_px").alias("pos", "px"))
    return k.select("image", "source", S.group_key("source").alias("grp"), "reproj_ft", F.get("keypoint_names", "pos").alias("name"),
                    F.get("px", F.lit(0)).alias("px"), F.get("px", F.lit(1)).alias("py"), F.get("visible", "pos").alias("visible"))


def metrics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Merge the metric documents that exist, one row each, columns by name."""
    out = None
    for p in paths:
        try:
            d = spark.read.option("multiLine", True).json(p)
        except Exception as e:  # a missing document is simply not reported
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
