"""Streams: bars by event time with late data dropped by a watermark, and running indicators kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidewright.functions.ewm import alpha


def read_events(spark: SparkSession, folder: str, schema: StructType | str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def stream_bars(events: DataFrame, key: str, ts: str, price: str, bucket: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars by tumbling windows of event time; a bar is final once the watermark has passed it."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    bars = timed.groupBy(F.col(key).alias("series"), F.window(ts, bucket)).agg(F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.sum(price).alias("volume"))
    return bars.select("series", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of events without a gap: their bounds and counts."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.col(key).alias("series"), F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select("series", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


STATE = "price double, mean double, gain double, loss double, obv double"
OUTPUT = "series string, ts timestamp, close double, ewm double, rsi double, obv double"


def running_indicators(bars: DataFrame, span: int = 14) -> DataFrame:
    """ewm, RSI and OBV row by row: a series' state is its last price and averages, not its history."""
    a = alpha(span)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        price, mean, gain, loss, obv = state.get if state.exists else (None, None, 0.0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, close, volume in zip(rows["ts"], rows["close"], rows["volume"], strict=True):
            change = 0.0 if price is None else close - price
            up, down = max(change, 0.0), max(-change, 0.0)
            first = price is None
            mean = close if first else mean * (1 - a) + close * a
            gain, loss = (up, down) if first else (gain * (1 - a) + up * a, loss * (1 - a) + down * a)
            obv += (change > 0) * volume - (change < 0) * volume
            price = close
            out.append((key[0], ts, close, mean, 50.0 if loss == 0 else 100 - 100 / (1 + gain / loss), obv))
        state.update((price, mean, gain, loss, obv))
        yield pd.DataFrame(out, columns=["series", "ts", "close", "ewm", "rsi", "obv"])

    return bars.groupBy("series").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
