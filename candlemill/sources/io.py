"""Bar and price sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlemill.functions.blocks import running, with_index
from candlemill.schemas import KEYS, OHLCV
from candlemill.session import materialize, table_path

TIME_NAMES = ("timestamp", "time", "date", "datetime")
LOCAL_ZONE = "America/Los_Angeles"
WRITERS = 32


def by_lower_name(df: DataFrame) -> DataFrame:
    """Lower-case the headers and call the time column ``ts``; missing volume becomes 0."""
    out = df.select(*[F.col(f"`{c}`").alias(c.strip().lower()) for c in df.columns])
    for name in TIME_NAMES:
        if name in out.columns:
            out = out.withColumnRenamed(name, "ts")
            break
    missing = [c for c in ("ts", *OHLCV[:4]) if c not in out.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return out if "volume" in out.columns else out.withColumn("volume", F.lit(0.0))


def read_csv_bars(
    spark: SparkSession, path: str, zone: str | None = LOCAL_ZONE,
    start: Column | None = None, end: Column | None = None,
) -> DataFrame:
    """CSV bars named ``{symbol}_{timeframe}.csv``; times are UTC and shown in ``zone``.

    All files under ``path`` share one header layout.
    """
    raw = spark.read.csv(path, header=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)
    df = by_lower_name(raw.withColumn("__file", name))
    at = F.to_timestamp_ntz(F.col("ts"))
    if zone:
        at = F.convert_timezone(F.lit("UTC"), F.lit(zone), at)
    df = df.select(
        F.regexp_extract("__file", r"^(.*)_([^_]+)$", 1).alias("symbol"),
        F.regexp_extract("__file", r"^(.*)_([^_]+)$", 2).alias("timeframe"),
        at.alias("ts"), *[F.col(c).cast("double").alias(c) for c in OHLCV],
    )
    if start is not None:
        df = df.filter(F.col("ts") >= start)
    return df if end is None else df.filter(F.col("ts") <= end)


def normalize(df: DataFrame, symbol: Column, timeframe: Column) -> DataFrame:
    """A provider's frame to the bar schema; stored times are UTC."""
    out = by_lower_name(df)
    return out.select(
        symbol.alias("symbol"), timeframe.alias("timeframe"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        *[F.col(c).cast("double").alias(c) for c in OHLCV],
    )


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str] = (*KEYS, "ts")) -> DataFrame:
    """Union in which a key present on both sides keeps the newer row.

    A max by batch combines map-side, so repeated keys never gather in one task.
    """
    keys = list(keys)
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return (
        both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r"))
        .select(*keys, "_r.*").select(*old.columns)
    )


def upsert(new: DataFrame, path: str) -> None:
    """Merge bars into a table partitioned by timeframe and year, rewriting touched parts only."""
    spark = new.sparkSession
    new = materialize(new.withColumn("year", F.year("ts")), "upsert_new")
    parts = new.select("timeframe", "year").distinct()
    old = spark.read.parquet(path).select(*new.columns).join(parts, ["timeframe", "year"], "left_semi")
    merged = materialize(merge(old.select(*new.columns), new), "upsert_merged")
    write_bars(merged, path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``, in any store; errors of the store are raised."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_bars(bars: DataFrame, path: str) -> None:
    """Write a bar table laid out for ``upsert``; only partitions present in ``bars`` change."""
    if "year" not in bars.columns:
        bars = bars.withColumn("year", F.year("ts"))
    # bounds the files per partition while a hot partition still has many writers
    bars = bars.repartition("timeframe", "year", F.pmod(F.xxhash64("symbol", F.month("ts")), F.lit(WRITERS)))
    (bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("timeframe", "year").parquet(path))


def insert_if_absent(
    target: DataFrame, incoming: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Incoming rows, one per key, whose key the target does not hold."""
    return incoming.dropDuplicates(list(keys)).join(target, list(keys), "left_anti")


def new_symbols(dimension: DataFrame, incoming: DataFrame) -> DataFrame:
    return incoming.select("symbol").distinct().join(dimension, "symbol", "left_anti")


def with_fallback(
    primary: DataFrame, secondary: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Series from ``primary``; whole series it lacks come from ``secondary``."""
    have = primary.select(*keys).distinct()
    return primary.unionByName(secondary.join(have, list(keys), "left_anti"))


def scan_prices(prices: DataFrame, start: str, end: str) -> DataFrame:
    """Daily prices in a date range; missing volume is 0, rows without a close are dropped."""
    return (
        prices.filter(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
        .filter(F.col("close").isNotNull())
        .withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    )


def to_wide(bars: DataFrame, symbols: Sequence[str], field: str = "close") -> DataFrame:
    """One row per time, one column per symbol. Naming the symbols spares a pass over the data."""
    return bars.groupBy("ts").pivot("symbol", list(symbols)).agg(F.first(field))


def to_long(wide: DataFrame, field: str = "close") -> DataFrame:
    names = [c for c in wide.columns if c != "ts"]
    return wide.unpivot("ts", names, "symbol", field).filter(F.col(field).isNotNull())


def as_of(bars: DataFrame, points: DataFrame) -> DataFrame:
    """Each symbol's bars up to each of its evaluation times (``eval_ts``)."""
    return bars.join(points, "symbol").filter(F.col("ts") <= F.col("eval_ts"))


def as_of_summary(
    bars: DataFrame, points: DataFrame, specs: dict[str, tuple[str, Column]], block: int | None = None,
) -> DataFrame:
    """``symbol, eval_ts`` and scans (``functions.blocks.running``) over the bars ``as_of`` would give.

    Bars and points are laid on one line per symbol, a point behind the bars of its time, and scanned
    once in blocks: as many rows as there are bars and points. Points before the first bar have no row.
    """
    line = bars.withColumn("_point", F.lit(False)).unionByName(
        points.select("symbol", F.col("eval_ts").alias("ts")).distinct().withColumn("_point", F.lit(True)), True
    ).withColumn("_order", F.struct("ts", "_point"))
    only = {name: (kind, F.when(~F.col("_point"), expr)) for name, (kind, expr) in specs.items()}
    line = with_index(line, ["symbol"], order="_order", out="_at", size="_size")
    out = running(line, ["symbol"], {"_bars": ("count", ~F.col("_point")), **only}, order="_at", block=block)
    return out.filter(F.col("_point") & (F.col("_bars") > 0)).select("symbol", F.col("ts").alias("eval_ts"), *specs)


def resample(bars: DataFrame, span: str, timeframe: str) -> DataFrame:
    """Coarser bars; empty bins do not appear. Bins are aligned to the start of the day in UTC."""
    at = F.window("ts", span)["start"].cast("timestamp_ntz")
    return (
        bars.groupBy("symbol", at.alias("bin"))
        .agg(
            F.min_by("open", "ts").alias("open"), F.max("high").alias("high"),
            F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("bin").alias("ts"), *OHLCV)
    )


def last_per_week(df: DataFrame, value: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    week = F.date_trunc("week", "ts").cast("timestamp_ntz")
    return df.groupBy(*keys, week.alias("week")).agg(F.max_by(value, "ts").alias(value))


def trading_days(
    spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None
) -> DataFrame:
    """Weekdays from ``start`` to ``end``, less the ``date`` column of ``holidays``."""
    days = spark.range(1).select(F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))).alias("date"))
    days = days.filter(F.weekday("date") < 5)
    return days if holidays is None else days.join(holidays, "date", "left_anti")


def last_trading_days(days: DataFrame, n: int) -> DataFrame:
    return days.orderBy(F.col("date").desc()).limit(n)


def write_and_read(df: DataFrame, fmt: str, name: str, **options: str) -> DataFrame:
    """Write ``df`` under the work folder and read it back with its own schema."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.format(fmt).options(**options).save(path)
    return spark.read.format(fmt).schema(df.schema).options(**options).load(path)


def journal_rows(signals: DataFrame) -> DataFrame:
    """Signals in the layout of a trade journal import."""
    two = "%.2f"
    notes = F.concat_ws(
        " | ", F.format_string("Confidence: %.2f", "confidence"),
        F.format_string("R:R: %.1f", "rr_ratio"), F.format_string("SL: %.2f", "stop"),
        F.format_string("TP: %.2f", "target"),
    )
    return signals.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("Date"), F.col("symbol").alias("Symbol"),
        F.when(F.col("direction") == "LONG", "BUY").otherwise("SELL").alias("Side"),
        F.lit(1).alias("Quantity"), F.format_string(two, "entry").alias("Entry Price"),
        F.lit("").alias("Exit Price"), F.lit("").alias("Commission"), notes.alias("Notes"),
    )


def append_log(trades: DataFrame, run_id: str, path: str) -> None:
    """Append a run's trades to a log table partitioned by run."""
    trades.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
