"""Signals, position sizes and backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.series import Series, running, sliced, unsliced, windowed
from tidewright.operators.clean import fill_missing, safe_divide

STRATEGIES = ("threshold", "directional")


def threshold_signals(df: DataFrame, p: str, buy: float = 0.6, sell: float = 0.4) -> DataFrame:
    """buy from one bound on, sell up to another, else hold; a missing prediction holds."""
    x = F.col(p)
    kind = F.when(x >= buy, "buy").when(x <= sell, "sell").otherwise("hold")
    sure = F.when(x >= buy, x).when(x <= sell, F.when(x.between(0, 1), 1 - x).otherwise(F.abs(x))).otherwise(0.0)
    return df.withColumns({"signal_type": kind, "confidence": sure, "metadata": F.create_map(F.lit("prediction"), x)})


def directional_signals(df: DataFrame, p: str, threshold: float = 0.0) -> DataFrame:
    x = F.col(p)
    kind = F.when(x > threshold, "buy").when(x < -threshold, "sell").otherwise("hold")
    sure = F.when((x > threshold) | (x < -threshold), F.abs(x)).otherwise(0.0)
    return df.withColumns({"signal_type": kind, "confidence": sure, "metadata": F.create_map(F.lit("prediction"), x)})


def generate_signals(df: DataFrame, p: str, strategy: str = "threshold", **bounds: float) -> DataFrame:
    """Signals by a strategy; an unknown one holds throughout."""
    if strategy == "threshold":
        return threshold_signals(df, p, **bounds)
    if strategy == "directional":
        return directional_signals(df, p, **bounds)
    return df.withColumns({"signal_type": F.lit("hold"), "confidence": F.lit(0.0), "metadata": F.create_map(F.lit("prediction"), F.col(p))})


def position_value(signal_type: Column, confidence: Column, capital: float, most: float = 0.2) -> Column:
    """Money put into a signal: at most a share of the capital, less with less confidence; none for hold."""
    return F.when(signal_type == "hold", 0.0).otherwise(F.lit(capital) * F.least(F.lit(most) * confidence, F.lit(most)))


def signal_number(signal_type: Column) -> Column:
    return F.when(signal_type == "buy", 1).when(signal_type == "sell", -1).otherwise(0)


def backtest(prices: DataFrame, signals: DataFrame, spec: Series, price: str, capital: float = 10_000.0) -> DataFrame:
    """Equity of holding, in each step, the position that the signal before it asked for.

    Prices without a signal have position 0, and a missing price beside one counts as 0. Steps whose return is missing
    carry the equity; the first row has none. Without signals the result is empty.
    """
    position = signals.select(*spec.key, spec.ts, signal_number(F.col("signal_type")).alias("position"))
    both = prices.select(*spec.key, *spec.order, price).join(position, [*spec.key, spec.ts], "left").fillna(0, [price, "position"])
    rows, own = sliced(both, spec)

    def step(d: DataFrame, s: Series) -> DataFrame:
        before = F.lag(price).over(s.w)
        return d.withColumn("strategy_return", F.lag("position").over(s.w) * safe_divide(F.col(price) - before, before))

    grown = running(windowed(rows, own, 1, step), own, {"_grown": ("product", 1 + F.col("strategy_return"))})
    out = grown.withColumn("equity", F.when(F.col("strategy_return").isNotNull(), capital * F.col("_grown"))).drop("_grown")
    out = unsliced(out, spec, own)
    return out.where(F.lit(not signals.isEmpty()))


def vote(columns: list[str]) -> Column:
    """The commonest label of a row; ties go to the smallest."""
    labels = F.filter(F.array(*[F.col(c) for c in columns]), lambda x: x.isNotNull())
    counted = F.transform(F.array_distinct(labels), lambda x: F.struct(F.size(F.filter(labels, lambda y: y == x)).alias("n"), (-x).alias("least")))
    return -F.array_max(counted)["least"]


def weighted(columns: list[str], weights: list[float] | None = None) -> Column:
    """The mean of a row's predictions, or the weighted one; missing models drop out and the weights are made to add up to 1."""
    w = weights or [1.0] * len(columns)
    if len(w) != len(columns) or min(w) < 0 or sum(w) <= 0:
        raise ValueError("a weight for each model is needed, and a positive sum")
    top = sum((F.when(F.col(c).isNotNull(), F.col(c) * v).otherwise(0.0) for c, v in zip(columns, w, strict=True)), F.lit(0.0))
    return safe_divide(top, sum((F.when(F.col(c).isNotNull(), v).otherwise(0.0) for c, v in zip(columns, w, strict=True)), F.lit(0.0)))


def mean_signal(columns: list[str], threshold: float = 0.3) -> Column:
    """The sign of a row's mean signal beyond a threshold."""
    mean = sum((F.col(c) for c in columns), F.lit(0)) / len(columns)
    return F.when(mean > threshold, 1).when(mean < -threshold, -1).otherwise(0)


def carry_forward(prices: DataFrame, side: DataFrame, spec: Series) -> DataFrame:
    """A side table beside prices by time, each value carried until the next."""
    names = [c for c in side.columns if c not in (*spec.key, spec.ts)]
    on = [c for c in (*spec.key, spec.ts) if c in side.columns]
    return fill_missing(prices.join(side, on, "left"), spec, "forward_fill", names)
