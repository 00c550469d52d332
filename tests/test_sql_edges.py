"""Queries against their SQL on small tables with odd rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from hoopflow.plans.views import TABLES

SF = "/root/testdata/sf0.001"


def canon(rows):
    fmt = lambda v: "~" if v is None or v != v else (f"{float(v):.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return sorted(tuple(fmt(v) for v in r) for r in rows)


def both(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL, where ``tables`` (SQL texts) replace the given ones."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"COPY ({tables.get(t) or f'SELECT * FROM {chr(39)}{SF}/{t}.parquet{chr(39)}'}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    return canon(map(tuple, df.select(*cols).collect())), canon(con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("name", ["txt_intent_route", "txt_intent_answer"])
def test_words_of_a_question_end_at_letters_beyond_ascii(spark, tmp_path, name):
    said = ["zu bestä schersten", "einßbest für", "next", "PİCK left", "to İ 7", "leftä drive", "why not", "why", None]
    rows = ", ".join(f"({i}, {i % 4}, 'user', {'NULL' if t is None else repr(t)})" for i, t in enumerate(said))
    got, want = both(spark, tmp_path, name, conversations=f"SELECT CAST(c AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, x AS text FROM (VALUES {rows}) AS v(c, t, r, x)")
    assert got == want


def test_top_action_of_values_that_hardly_differ(spark, tmp_path):
    price = "CASE WHEN l_linenumber = 3 THEN 90000.02e0 WHEN l_linenumber = 1 THEN 90000.01e0 WHEN l_linenumber = 4 AND l_orderkey % 2 = 0 THEN 90000.09e0 WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END"
    got, want = both(spark, tmp_path, "app_analyze", lineitem=f"SELECT * REPLACE ({price} AS l_extendedprice) FROM '{SF}/lineitem.parquet'")
    assert got == want


def test_moments_that_arrive_days_late_stay(spark, tmp_path):
    # A play is 125 ids and 20 s: blocks of 100 plays spread the events over days.
    far = "CAST(floor(event_id / 25e0) AS BIGINT) * 12500 + CAST(floor(event_id / 5e0) AS BIGINT) % 2 * 2500 + event_id % 5 * 60"
    got, want = both(spark, tmp_path, "st_moments_dedup", events=f"SELECT * REPLACE ({far} AS event_id) FROM '{SF}/events.parquet' WHERE event_id < 4000")
    assert got == want


@pytest.mark.parametrize("name", ["src_calibration_json", "agg_calibration_summary", "src_link_roster", "sink_state_json", "sink_frame_table", "join_screen"])
def test_files_and_filters_keep_the_rows(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name)
    assert got and got == want


def _files(path, end):
    return [f for f in path.rglob(f"*{end}") if not f.name.startswith((".", "_"))]


def test_small_documents_share_files(spark, tmp_path, monkeypatch):
    from hoopflow.plans import q_models as QM, staging
    from hoopflow.plans.registry import Source
    for t in TABLES:
        duckdb.sql(f"SELECT * FROM '{SF}/{t}.parquet'").write_parquet(str(tmp_path / f"{t}.parquet"))
    duckdb.sql("SELECT 0::BIGINT + i AS event_id, TIMESTAMP '2024-01-01' AS ts, 1::BIGINT AS user_id, 'view' AS event_type, 1.0 AS value, '' AS props FROM range(20000) r(i)").write_parquet(str(tmp_path / "events.parquet"))
    out = tmp_path / "out"
    monkeypatch.setattr(staging, "fresh_path", lambda spark, name: str(out))
    assert QM.calibration_files(Source(spark, str(tmp_path))).count() == 160
    assert len(_files(out, ".json")) < 40


def test_a_small_game_is_one_file(spark, tmp_path):
    from pyspark.sql import functions as F
    from hoopflow.sources import sinks
    d = spark.range(2000).select((F.col("id") % 10).cast("string").alias("game_id"), "id")
    for rows in (d, d.where("game_id < '5'")):
        sinks.write_by_game(rows, str(tmp_path / "g"), ["id"])
    assert len(_files(tmp_path / "g", ".parquet")) == 10
    assert spark.read.parquet(str(tmp_path / "g")).count() == 2000


def test_tasks_grow_with_the_events(spark, tmp_path):
    from hoopflow.plans import views
    from hoopflow.plans.q_possessions import frames
    from hoopflow.plans.registry import Source
    duckdb.sql(f"SELECT i AS event_id FROM range({20 * views.EVENT_ROWS}) r(i)").write_parquet(str(tmp_path / "events.parquet"))
    src = Source(spark, str(tmp_path))
    assert src.tasks == 20
    assert src("fx_homographies").rdd.getNumPartitions() == 20
    assert frames(src).rdd.getNumPartitions() == 20


@pytest.mark.parametrize("name", ["set_dedup_moments", "ord_canonical"])
def test_moments_are_dealt_to_tasks_that_grow_with_the_events(spark, tmp_path, name):
    from hoopflow.plans import views
    from hoopflow.plans.registry import QUERIES
    duckdb.sql(f"SELECT i AS event_id FROM range({6 * views.EVENT_ROWS}) r(i)").write_parquet(str(tmp_path / "events.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 6


@pytest.mark.parametrize("name", ["set_dedup_moments", "ord_canonical"])
def test_copies_of_a_moment_and_odd_clocks(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, events=f"SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN event_id - 125 ELSE event_id END AS event_id) FROM '{SF}/events.parquet' WHERE event_id >= 125")
    assert got == want


def test_best_play_of_a_state_without_candidates(spark, tmp_path):
    said = "SELECT CAST(c AS BIGINT) AS conv_id, CAST(1 AS BIGINT) AS turn, 'user' AS role, x AS text FROM (VALUES (1, 'best'), (99999999, 'best'), (99999999, 'next'), (99999999, 'why'), (99999999, 'drive')) AS v(c, x)"
    got, want = both(spark, tmp_path, "txt_intent_answer", conversations=said)
    assert got == want


def test_route_leads_to_an_action(spark, tmp_path):
    said = ["best", "next", "why", "drive right", "pass it", "to 7", "to #28", "hello", "best"]
    rows = ", ".join(f"({i % 8}, 1, 'user', {t!r})" for i, t in enumerate(said))
    got, want = both(spark, tmp_path, "txt_intent_route", conversations=f"SELECT CAST(c AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, x AS text FROM (VALUES {rows}) AS v(c, t, r, x)")
    assert got == want
    # Columns by name: action_id, conv_id, direction, intent, n, number, place, role, turn.
    assert sum(r[0] != "~" for r in got) >= 4 and {r[5] for r in got} >= {"7.0000", "28.0000"}


def test_state_files_are_small(spark, tmp_path, monkeypatch):
    from hoopflow.plans import staging
    from hoopflow.plans.registry import QUERIES
    out = tmp_path / "states"
    monkeypatch.setattr(staging, "fresh_path", lambda spark, name: str(out))
    n = QUERIES["sink_state_json"](spark, SF).count()
    files = _files(out, ".json.gz")
    assert n == 1000 and files and not _files(out, ".json")
    # Plain text takes over 3,000 bytes a state.
    assert sum(f.stat().st_size for f in files) < 1000 * n
