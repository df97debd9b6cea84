"""Time buckets, gap filling and alignment of series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.series import Series, windowed
from tidewright.operators.clean import fill_missing

#: Frequencies: the unit that buckets are floored to, and the step of a grid.
FREQUENCIES = {"min": ("minute", "interval 1 minute"), "h": ("hour", "interval 1 hour"), "D": ("day", "interval 1 day"), "W": ("week", "interval 7 days"), "ME": ("month", "interval 1 month")}
SIMPLE = ("mean", "sum", "first", "last")


def bucket(ts: Column | str, freq: str) -> Column:
    """The bucket of a time: its start; for W and ME its last day, as labels of such periods go."""
    unit, _ = FREQUENCIES[freq]
    c = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")
    if freq == "W":
        return F.date_trunc("week", c) + F.expr("interval 6 days")
    if freq == "ME":
        return F.last_day(c).cast("timestamp")
    return F.date_trunc(unit, c)


def _grid(buckets: DataFrame, spec: Series, freq: str) -> DataFrame:
    span = buckets.groupBy(*spec.key).agg(F.min(spec.ts).alias("_a"), F.max(spec.ts).alias("_b"))
    step = F.expr(FREQUENCIES[freq][1])
    grid = F.sequence("_a", "_b", step) if freq != "ME" else F.transform(F.sequence(F.date_trunc("month", "_a"), F.date_trunc("month", "_b"), step), lambda x: F.last_day(x).cast("timestamp"))
    return span.select(*spec.key, F.explode(grid).alias(spec.ts))


def resample(df: DataFrame, spec: Series, freq: str, how: str = "mean", columns: list[str] | None = None, gaps: bool = True) -> DataFrame:
    """Numeric columns by bucket: mean, sum, first or last present value. Empty buckets appear (sum: 0), unless gaps is false."""
    if how not in SIMPLE:
        raise ValueError(f"unknown aggregation {how!r}; one of {', '.join(SIMPLE)}, or resample_ohlcv()")
    names = columns or spec.numeric(df)
    at = F.struct(*spec.order)
    make = {"mean": F.avg, "sum": F.sum, "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at)), "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))}[how]
    out = df.groupBy(*spec.key, bucket(spec.ts, freq).alias("_bucket")).agg(*[make(c).alias(c) for c in names]).withColumnRenamed("_bucket", spec.ts)
    if gaps:
        out = _grid(out, spec, freq).join(out, [*spec.key, spec.ts], "left")
    return out.fillna(0, names) if how == "sum" else out


def resample_ohlcv(df: DataFrame, spec: Series, freq: str, price: str | None = None, volume: Column | None = None, gaps: bool = False) -> DataFrame:
    """Bars by bucket: first open, highest high, lowest low, last close, summed volume; other numeric columns averaged.

    With ``price``, bars come from single prices; volume is then the expression given, or the count of rows.
    """
    at = F.struct(*spec.order)
    if price:
        aggs = [F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), (volume if volume is not None else F.count("*").cast("double")).alias("volume")]
    else:
        rules = {"open": lambda: F.min_by("open", F.when(F.col("open").isNotNull(), at)), "high": lambda: F.max("high"), "low": lambda: F.min("low"), "close": lambda: F.max_by("close", F.when(F.col("close").isNotNull(), at)), "volume": lambda: F.sum("volume")}
        aggs = [rules[c]().alias(c) if c in rules else F.avg(c).alias(c) for c in spec.numeric(df)]
    out = df.groupBy(*spec.key, bucket(spec.ts, freq).alias("_bucket")).agg(*aggs).withColumnRenamed("_bucket", spec.ts)
    return _grid(out, spec, freq).join(out, [*spec.key, spec.ts], "left") if gaps else out


def infer_frequency(df: DataFrame, spec: Series, default: str = "D") -> str:
    """The commonest step between neighbouring rows, as a name of FREQUENCIES."""
    step = lambda s: F.unix_timestamp(F.col(s.ts).cast("timestamp")) - F.unix_timestamp(F.lag(s.ts).over(s.w).cast("timestamp"))
    steps = windowed(df.select(*spec.key, *spec.order), spec, 1, lambda d, s: d.withColumn("s", step(s)))
    top = steps.select("s").where("s > 0").groupBy("s").count().orderBy(F.desc("count"), "s").limit(1).collect()
    names = {60: "min", 3600: "h", 86400: "D", 604800: "W"}
    if not top:
        return default
    return names.get(top[0].s, "ME" if 28 * 86400 <= top[0].s <= 31 * 86400 else default)


def left_join_fill(left: DataFrame, right: DataFrame, spec: Series) -> DataFrame:
    """Slow-moving columns beside a series by time, carried forward over the rows that have none."""
    names = [c for c in right.columns if c != spec.ts]
    return fill_missing(left.join(right, spec.ts, "left"), spec, "forward_fill", names)


def align(frames: dict[str, DataFrame], ts: str, freq: str = "D", method: str = "outer") -> DataFrame:
    """Series of several tables on one grid of buckets; each is averaged by bucket, its columns prefixed by its name.

    The grid spans all tables (outer) or what they share (any other method), floored to buckets.
    """
    parts = []
    for name, df in frames.items():
        spec = Series((), ts)
        numeric = spec.numeric(df)
        parts.append(df.groupBy(bucket(ts, freq).alias(ts)).agg(*[F.avg(c).alias(f"{name}_{c}") for c in numeric]))
    spans = reduce(DataFrame.unionAll, [p.agg(F.min(ts).alias("a"), F.max(ts).alias("b")) for p in parts])
    low, high = (F.min, F.max) if method == "outer" else (F.max, F.min)
    span = spans.agg(low("a").alias("a"), high("b").alias("b")).where("a <= b")
    grid = span.select(F.explode(F.sequence("a", "b", F.expr(FREQUENCIES[freq][1]))).alias(ts))
    return reduce(lambda x, p: x.join(p, ts, "left"), parts, grid)


def intersect(features: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """Rows that both have, by time; none is an error."""
    out = features.join(target, on)
    if out.isEmpty():
        raise ValueError("features and target share no row")
    return out
