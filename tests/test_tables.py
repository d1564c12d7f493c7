import os

from conftest import SMOKE

from candlemill.sources import tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_supplier_months_ship_each_line_once(spark, monkeypatch):
    monkeypatch.setattr(tables, "LINES_A_TASK", 1_000)
    df = tables.supplier_prices_raw(spark, SMOKE)
    plan = _plan(df)
    above, below = plan.split("Exchange hashpartitioning")  # one exchange
    assert "Aggregate" in above and "Aggregate" not in below
    lines = tables.read(spark, SMOKE, "lineitem").count()
    assert f", {1 + lines // 1_000})" in below.split("\n")[0]
    assert df.columns == ["symbol", "timeframe", "ts", "open", "high", "low", "close", "volume"]


def test_rankings_read_the_lines_once(spark):
    df = tables.rankings_raw(spark, SMOKE)
    assert not any(os.path.basename(f) == "lineitem.parquet" for f in df.inputFiles())
