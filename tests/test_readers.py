"""Readers and sinks on files of their own."""

import json

import pytest
from pyspark.sql import functions as F

from hoopflow.operators import dialogue as DG, ordering as O, ranking as RK
from hoopflow.plans.staging import fresh_path
from hoopflow.sources import readers as RD, sinks as SK


def document(game, n, pretty=False):
    team = lambda i: {"teamid": i, "abbreviation": "T", "name": "T", "players": [{"playerid": i * 10, "firstname": "A", "lastname": "B", "jersey": "7", "position": "G"}]}
    moment = lambda e, m: [1, 1000 * e + m, 700.0 - m, 20.0, None, [[-1, -1, 1.0 * e, 2.0, 3.0], [1, 10, 5.0, 6.0, 0.0]]]
    events = [{"eventId": str(e), "home": team(1), "visitor": team(2), "moments": [moment(e, m) for m in range(12)]} for e in range(n)]
    return json.dumps({"gameid": game, "gamedate": "2015-01-01", "events": events}, indent=1 if pretty else None)


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("pretty", [False, True])
def test_events_of_one_file_are_several_tasks(spark, tmp_path, small_splits, pretty):
    (tmp_path / "a.json").write_text(document("0021", 60, pretty))
    (tmp_path / "b.json").write_text(document("0022", 3))
    ev = RD.read_events(spark, str(tmp_path))
    whole = RD.events(RD.read_games(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]))
    parts = ev.where("game_id = '0021'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spark.read.option("lineSep", RD.EVENT_KEY).text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 2 and parts >= 1
    cols = ["game_id", "event_id", "unix_ms", "player_id", "x"]
    rows = lambda d: sorted(map(tuple, RD.moments(d).select(*cols).collect()))
    assert rows(ev) == rows(whole) and len(rows(ev)) == 63 * 12 * 2
    order = lambda d: [(r.game_id, r.e) for r in d.select("game_id", "event_pos", F.col("ev.eventId").alias("e")).orderBy("game_id", "event_pos").collect()]
    assert order(ev) == order(whole)
    assert sorted(map(tuple, RD.roster(ev).collect())) == sorted(map(tuple, RD.roster(whole).collect()))


def test_a_broken_event_raises(spark, tmp_path):
    (tmp_path / "a.json").write_text(document("1", 2).replace('"1", "home"', '1"1 home'))
    with pytest.raises(Exception, match="not an event"):
        RD.read_events(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_rerun_of_a_game_changes_nothing(spark, fmt):
    d = spark.range(200).selectExpr("concat('00', id % 3) AS game_id", "id AS n", "IF(id % 5 = 0, NULL, id / 2) AS v", "array(named_struct('a', id, 'b', CAST(NULL AS STRING))) AS p")
    path = fresh_path(spark, "rerun")
    SK.write_by_game(d, path, ["n"], fmt=fmt)
    first = sorted(map(tuple, SK.read_by_game(d, path, fmt).collect()))
    SK.write_by_game(d.where("game_id = '001'"), path, ["n"], fmt=fmt)
    back = SK.read_by_game(d, path, fmt)
    assert back.schema.simpleString() == d.schema.simpleString()
    assert first == sorted(map(tuple, back.collect())) == sorted(map(tuple, d.collect()))
    SK.write_by_game(d.where("game_id = '001' AND n < 50"), path, ["n"], fmt=fmt)
    assert SK.read_by_game(d, path, fmt).count() == d.where("game_id <> '001' OR n < 50").count()


def test_global_rank_has_no_unpartitioned_window(spark):
    d = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)] + [(None,)], "v long").repartition(9)
    r, n = RK.global_rank(d, ["v"], parts=6)
    assert n == 1001 and [(x.v, x._pos) for x in r.orderBy("_pos").collect()] == [(None, 1), *((i, i + 2) for i in range(1000))]
    assert "Window" not in r._jdf.queryExecution().optimizedPlan().toString()
    assert RK.global_rank(d.limit(0), ["v"])[1] == 0
    assert "Window" not in O.holdout_last(d, "v")._jdf.queryExecution().optimizedPlan().toString()


def test_answers(spark):
    c = spark.createDataFrame([(1, 1, "PASS_TO", "p7", None, 7, 1.2), (1, 2, "DRIVE", "dl", "left", None, 1.0), (1, 3, "DRIVE", "dr", "right", None, 0.9), (2, 1, "SHOOT", "s", None, None, 1.0)],
                              "state long, rank int, action string, action_id string, direction string, jersey int, q double")
    asked = [(1, "Best play?", 0, "p7"), (1, "next one", 2, "p7"), (1, "why this?", 1, "dl"), (1, "drive right", 0, "dr"), (1, "drive to the middle", 0, "dl"), (1, "why not drive", 0, "dl"),
             (1, "to #7", 0, "p7"), (1, "to #12", 0, "unknown_number"), (1, "shoot it", 0, "not_legal"), (2, "other", 0, "s"), (3, "best", 0, "no_play"), (1, "hm", 0, "help"), (1, None, 0, "help")]
    q = spark.createDataFrame([(i, s, t, n) for i, (s, t, n, _) in enumerate(asked)], "i long, state long, t string, shown int")
    got = {r.i: r.action_id or r.outcome for r in DG.answer(q, c, ["state"], "t", "shown").collect()}
    assert got == {i: w for i, (*_, w) in enumerate(asked)}
