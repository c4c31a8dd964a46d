"""The registry: every query has a name, a plan, and compares where SQL is given."""

import duckdb
import pytest

import __spark_entry__ as entry
from closeline import plans
from closeline.plans import views
from scripts.check_queries import compare

SMALL = "/root/testdata/sf0.001"
# One query per module; the full comparison is scripts/check_queries.py.
SAMPLE = ("bet_down_to_price", "roi_by_market_and_tier", "backtest_verdict", "fair_board", "venue_state", "prior_expanding_mean", "trailing_weighted_mean", "retention_roll_up", "quote_json_staging", "graph_components", "move_since_first_capture")


def test_registry():
    assert set(plans.queries()) <= set(entry.queries()) and set(plans.oracles()) <= set(entry.oracle_sql())
    queries, oracles = plans.queries(), plans.oracles()
    assert set(oracles) <= set(queries) and len(queries) > 200
    assert set(queries) == set(oracles)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_duckdb(spark, name):
    entry.queries()
    con = duckdb.connect()
    for t in views.BASE:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    out, _ = compare(spark, con, name, SMALL)
    assert out.startswith("ok"), out
