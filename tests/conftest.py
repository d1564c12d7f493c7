import math
import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from candlemill.functions.blocks import with_index  # noqa: E402
from candlemill.schemas import KEYS  # noqa: E402
from candlemill.session import local_session  # noqa: E402

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    # tiny inputs: compiling code would take longer than running it
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session


def random_bars(n: int, seed: int = 0, symbol: str = "A", step: float = 2.0, wave: float = 0.0) -> pd.DataFrame:
    """A random walk of bars, optionally on a sine; prices stay positive."""
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, step, n)) + wave * np.sin(np.arange(n) / 7)
    close = np.abs(close) + 5
    open_ = np.concatenate([[close[0]], close[:-1]]) + rng.normal(0, step / 3, n)
    spread = rng.gamma(1.5, step, (2, n))
    high = np.maximum(open_, close) + spread[0] * (rng.random(n) < 0.7)
    low = np.maximum(np.minimum(open_, close) - spread[1] * (rng.random(n) < 0.7), 0.5)
    return pd.DataFrame({
        "symbol": symbol, "timeframe": "1d", "ts": pd.date_range("2020-01-01", periods=n, freq="D"),
        "open": open_, "high": high, "low": low, "close": close, "volume": np.round(rng.gamma(2, 500, n)),
    })


def from_closes(closes, symbol: str = "A") -> pd.DataFrame:
    """Daily bars around given closes: 1 percent wicks, open at the close before."""
    c = np.asarray(closes, dtype=float)
    return pd.DataFrame({
        "symbol": symbol, "timeframe": "1d", "ts": pd.date_range("2020-01-01", periods=len(c), freq="D"),
        "open": np.concatenate([[c[0]], c[:-1]]), "high": c * 1.01, "low": c * 0.99, "close": c, "volume": 1000.0,
    })


def to_spark(spark, *frames):
    pdf = pd.concat(frames, ignore_index=True).sample(frac=1.0, random_state=3)  # row order must not matter
    df = spark.createDataFrame(pdf).withColumn("ts", pd_ntz())
    return with_index(df, KEYS)


def pd_ntz():
    from pyspark.sql import functions as F

    return F.col("ts").cast("timestamp_ntz")


def rows(df, *by):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def close_to(a, b, tol=1e-9):
    return all(math.isclose(x, y, rel_tol=tol, abs_tol=tol) for x, y in zip(a, b, strict=True))
