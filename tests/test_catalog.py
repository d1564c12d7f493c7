"""Registered queries against their SQL on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest
from conftest import SMOKE

import __spark_entry__ as entry
from tools.check import canon

LIGHT = (
    "a0_bars_week", "a0_bar_index", "a0_rankings", "a3_merge_bars", "a11_resample_4h", "a13_parse_rankings",
    "a15_idempotent_load", "b0_pin_bars_with_atr", "b5_adx", "b12_inside_bars", "b16_regime", "b20_bias",
    "c1_pin_bar_lines", "c2_horizontal_levels", "c9_final_levels", "c10_match_pin_bars", "d19_detect_patterns",
    "e4_signals", "f4_flow_state", "f6_sectors", "g6_metrics", "g12_rank_backtest", "g15_rank_momentum",
    "g26_strategy_metrics", "h12_stability", "s3_stream_rankings",
)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SMOKE):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMOKE}/{f}'")
    return c


@pytest.mark.parametrize("name", LIGHT)
def test_query_equals_sql(spark, con, name):
    got = canon(entry.queries()[name](spark, SMOKE).toPandas())
    want = canon(con.execute(entry.oracle_sql()[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
