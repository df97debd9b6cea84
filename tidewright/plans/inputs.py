"""The series, bars and scores that the catalogue's queries read, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.series import Series
from tidewright.operators.resample import resample_ohlcv
from tidewright.session import prepare

EVENTS = Series(("series",), "ts", ("event_id",))
BARS = Series(("series",), "ts")
ORDERS = Series(("series",), "ts", ("o_orderkey",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single values by event type."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which every seventh has no value."""
    return events(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_ohlcv(events(spark, sf_dir), EVENTS, "h", price="value", volume=F.sum("value"))


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderkey", "o_totalprice")
    return resample_ohlcv(o, ORDERS, "D", price="o_totalprice")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label and a probability that lands on the edges of bins."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", F.expr("CAST(l_returnflag = 'R' AS INT)").alias("y"), (F.col("l_discount") * 10).alias("p"))


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, so that two engines' sums in another order agree; minus zero becomes zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def out(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    """Keys (times as text) and rounded values."""
    kind = dict(df.dtypes)
    shown = [F.date_format(k, "yyyy-MM-dd HH:mm:ss").alias(k) if kind[k].startswith("timestamp") else F.col(k) for k in keys]
    return df.select(*shown, *[(r(v, digits) if kind[v] in ("double", "float") else F.col(v)).alias(v) for v in values])


SQL_EVENTS = "ev AS (SELECT event_type AS series, ts, event_id, value FROM events)"
SQL_GAPPY = "ev AS (SELECT event_type AS series, ts, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"
SQL_BARS = "bars AS (SELECT event_type AS series, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, sum(value) AS volume FROM events GROUP BY 1, 2)"
SQL_DAILY = "bars AS (SELECT o_orderpriority AS series, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2)"
SQL_SCORES = "sc AS (SELECT l_orderkey, l_linenumber, l_linestatus, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_discount * 10 AS p FROM lineitem)"
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
W = "PARTITION BY series ORDER BY ts"


def rnd(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def fullw(size: int, counted: str, expr: str, window: str = W) -> str:
    """SQL of a window value that is missing until its frame holds ``size`` present values."""
    frame = f"({window} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({counted}) OVER {frame} = {size} THEN {expr} OVER {frame} END"
