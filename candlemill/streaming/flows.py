"""Streaming ingestion: bar merge, bar building, ranking loads, threshold checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from candlemill.sources import io, rankings as rk


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None,
    only: str | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if only:
        reader = reader.option("pathGlobFilter", only)
    return reader.parquet(path)


def utc_instant(ts: Column) -> Column:
    """A zone-less UTC clock time as an instant; watermarks need one. The session zone plays no part."""
    day = F.unix_date(ts.cast("date")).cast("decimal(20,6)") * 86400
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), ts)
    return F.timestamp_seconds(day + clock)


def utc_clock(at: Column) -> Column:
    """The inverse of ``utc_instant``, to the second."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return zero + F.make_dt_interval(secs=F.unix_seconds(at).cast("decimal(18,6)"))


def merge_bars(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Merge arriving bars into a bar table; a later bar for the same time replaces it.

    ``arrived`` orders bars of one batch. Replaying a batch changes nothing.
    """
    keys = ["symbol", "timeframe", "ts"]

    def load(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in (*keys, "arrived")]
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), "arrived").alias("_r")).select(*keys, "_r.*")
        spark = batch.sparkSession
        if io.exists(spark, table):
            io.upsert(newest, table)
        else:
            io.write_bars(newest, table)

    return (stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def build_bars(
    stream: DataFrame, span: str, timeframe: str, table: str, checkpoint: str, late: str = "1 hour"
) -> StreamingQuery:
    """Tumbling bars from finer bars, each written once the watermark has passed its end."""
    bars = (
        stream.withColumn("_t", utc_instant(F.col("ts"))).withWatermark("_t", late)
        .groupBy("symbol", F.window("_t", span).alias("w"))
        .agg(F.min_by("open", "_t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
             F.max_by("close", "_t").alias("close"), F.sum("volume").alias("volume"))
        .select("symbol", F.lit(timeframe).alias("timeframe"), utc_clock(F.col("w.start")).alias("ts"),
                "open", "high", "low", "close", "volume")
    )
    return (bars.writeStream.format("parquet").outputMode("append").option("path", table)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def load_rankings(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append ranking rows the table lacks; repeats inside and across batches add nothing.

    The table itself says what has been loaded, so a slice may come however late and in parts.
    """
    key = ["data_date", "ranking_type", "symbol"]

    def load(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key)
        if io.exists(spark, table):
            new = new.join(spark.read.schema(batch.schema).parquet(table).select(*key), key, "left_anti")
        new.select(*batch.columns).write.mode("append").parquet(table)

    return (stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


STATE = "recent array<double>"
ALERT = "monitor string, field string, recorded_at timestamp, severity string, message string, value double"


class ThresholdCheck:
    """Alert when a reading exceeds a multiple of the mean of its last ``history`` readings."""

    def __init__(self, history: int = 5, warn: float = 2.0, critical: float = 4.0) -> None:
        self.history, self.warn, self.critical = history, warn, critical

    def evaluate(self, value: float, history: Sequence[float]) -> tuple[str, str] | None:
        """(severity, message) or None; ``history`` is most recent first."""
        if len(history) < self.history:
            return None
        known = [v for v in reversed(history) if v is not None]
        if value is None or not known:
            return None
        mean = 0.0
        for v in known:  # oldest first, as a database adds them
            mean += v
        mean /= len(known)
        if value > self.critical * mean:
            return "critical", f"above {self.critical} x recent mean"
        if value > self.warn * mean:
            return "warning", f"above {self.warn} x recent mean"
        return None


def check_readings(readings: DataFrame, check: ThresholdCheck, ties: Sequence[str] = ()) -> DataFrame:
    """Alerts of a stream of (monitor, field, recorded_at, value), with keyed history as state.

    A batch is read by ``recorded_at``, then by the columns ``ties``; name them where instants repeat.
    Missing values take their place in the history but not in its mean. Only the last few values of
    each key are kept between batches.
    """
    readings = readings.select("monitor", "field", "recorded_at", "value", *ties)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        batch = pd.concat(list(parts)).sort_values(["recorded_at", *ties], kind="stable", na_position="first")
        rows = []
        for at, value in zip(batch["recorded_at"], batch["value"]):
            value = None if pd.isna(value) else float(value)
            found = check.evaluate(value, recent)
            if found:
                rows.append((*key, at, *found, value))
            recent = [value, *recent][:check.history]
        state.update((recent,))
        yield pd.DataFrame(rows, columns=["monitor", "field", "recorded_at", "severity", "message", "value"])

    return readings.groupBy("monitor", "field").applyInPandasWithState(
        step, ALERT, STATE, "append", GroupStateTimeout.NoTimeout)


def write_alerts(alerts: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return (alerts.writeStream.format("parquet").outputMode("append").option("path", table)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
