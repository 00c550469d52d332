"""A sample of the registry against its SQL at the smallest scale; tools/check.py runs all."""

import duckdb
import pytest

import __spark_entry__ as entry
from hoopflow.plans.views import TABLES

SF = "/root/testdata/sf0.001"
NAMES = ["geo_zone", "set_dedup_moments", "win_possession_frames", "state_build", "act_enumerate", "win_pbp_possessions", "join_shot_moment",
         "win_linear_interp", "join_nearest_clock", "agg_regret", "join_identity", "txt_number_audit", "st_ffill_diff"]


def canon(rows):
    fmt = lambda v: "~" if v is None or v != v else (f"{float(v):.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return sorted(tuple(fmt(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    sql = f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})"
    assert canon(map(tuple, df.select(*cols).collect())) == canon(con.execute(sql).fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
