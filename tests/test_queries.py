"""The entry point, and registered queries against their SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
#: One of each kind; the others run in the driver's own comparison.
NAMES = ["k1_bars", "a1_feed_messages", "a9_gap_recovery", "b2_structure_breaks", "b7_gap_fills", "b8_average_true_range", "b_chunked_windows", "b16_directional_range", "b15_levels_near_zones", "d4_zone_overlap", "d1_tiered_targets", "b20_any_bar", "h2_acceptance", "h2_h3_stream_events", "h1_h10_setup_store", "h13_strategy_figures", "h15_walk_forward", "i1_calendar_sessions", "f_price_action_funnel"]


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return str(value) if isinstance(value, list) else value


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert mine == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
