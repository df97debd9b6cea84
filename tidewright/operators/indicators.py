"""Technical indicators, volatility and market regimes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.ewm import ewm_mean, ewm_std, reach
from tidewright.functions.series import Series, full, positions, running, sliced, unsliced, windowed
from tidewright.operators.clean import safe_divide
from tidewright.operators.features import log_return

YEAR = 252


def rsi(df: DataFrame, spec: Series, close: str = "close", period: int = 14, name: str = "rsi") -> DataFrame:
    """Relative strength by ewm gains and losses; 50 where there has been no loss, and on the first row."""

    def build(df: DataFrame, spec: Series) -> DataFrame:
        delta = F.col(close) - F.lag(close).over(spec.w)
        staged = df.withColumns({"_gain": F.when(delta > 0, delta).otherwise(0.0), "_loss": F.when(delta < 0, -delta).otherwise(0.0)})
        staged = ewm_mean(staged, spec, {"_g": "_gain", "_l": "_loss"}, period)
        strength = safe_divide(F.col("_g"), F.col("_l"))
        return staged.withColumn(name, F.coalesce(100 - 100 / (1 + strength), F.lit(50.0))).drop("_gain", "_loss", "_g", "_l")

    return windowed(df, spec, reach(period) + 1, build)


def macd(df: DataFrame, spec: Series, close: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    def build(df: DataFrame, spec: Series) -> DataFrame:
        staged = ewm_mean(df, spec, {"_fast": close}, fast)
        staged = ewm_mean(staged, spec, {"_slow": close}, slow).withColumn("macd", F.col("_fast") - F.col("_slow"))
        staged = ewm_mean(staged, spec, {"macd_signal": "macd"}, signal)
        return staged.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")

    return windowed(df, spec, reach(max(fast, slow)) + reach(signal), build)


def bollinger(df: DataFrame, spec: Series, close: str = "close", period: int = 20, width: float = 2.0) -> DataFrame:
    def build(df: DataFrame, spec: Series) -> DataFrame:
        w = spec.frame(period)
        mean, sd = F.avg(close).over(w), F.stddev_samp(close).over(w)
        parts = {"bb_upper": mean + width * sd, "bb_middle": mean, "bb_lower": mean - width * sd}
        return df.withColumns({k: full(spec, period, v, F.col(close)) for k, v in parts.items()})

    return windowed(df, spec, period, build)


def true_range(spec: Series, high: str = "high", low: str = "low", close: str = "close") -> Column:
    before = F.lag(close).over(spec.w)
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def atr(df: DataFrame, spec: Series, period: int = 14, name: str = "atr") -> DataFrame:
    return windowed(df, spec, reach(period) + 1, lambda d, s: ewm_mean(d.withColumn("_tr", true_range(s)), s, {name: "_tr"}, period).drop("_tr"))


def _range(spec: Series, period: int) -> tuple[Column, Column]:
    w = spec.frame(period)
    return full(spec, period, F.max("high").over(w), F.col("high")), full(spec, period, F.min("low").over(w), F.col("low"))


def stochastic(df: DataFrame, spec: Series, period: int = 14, smooth: int = 3) -> DataFrame:
    def build(df: DataFrame, spec: Series) -> DataFrame:
        high, low = _range(spec, period)
        staged = df.withColumn("stoch_k", 100 * safe_divide(F.col("close") - low, high - low))
        return staged.withColumn("stoch_d", full(spec, smooth, F.avg("stoch_k").over(spec.frame(smooth)), F.col("stoch_k")))

    return windowed(df, spec, period + smooth, build)


def williams_r(df: DataFrame, spec: Series, period: int = 14) -> DataFrame:
    def build(df: DataFrame, spec: Series) -> DataFrame:
        high, low = _range(spec, period)
        return df.withColumn("williams_r", -100 * safe_divide(high - F.col("close"), high - low))

    return windowed(df, spec, period, build)


def cci(df: DataFrame, spec: Series, period: int = 20) -> DataFrame:
    """Commodity channel index; the mean absolute deviation is taken over the frame's own values."""

    def build(df: DataFrame, spec: Series) -> DataFrame:
        staged = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
        w = spec.frame(period)
        staged = staged.withColumns({"_mean": full(spec, period, F.avg("_tp").over(w), F.col("_tp")), "_all": F.collect_list("_tp").over(w)})
        mad = F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("_mean"))) / period
        return staged.withColumn("cci", safe_divide(F.col("_tp") - F.col("_mean"), 0.015 * mad)).drop("_tp", "_mean", "_all")

    return windowed(df, spec, period, build)


def obv(df: DataFrame, spec: Series) -> DataFrame:
    rows, own = sliced(df, spec)
    step = lambda d, s: d.withColumn("_step", F.coalesce(F.signum(F.col("close") - F.lag("close").over(s.w)), F.lit(0.0)) * F.col("volume"))
    return unsliced(running(windowed(rows, own, 1, step), own, {"obv": ("sum", F.col("_step"))}).drop("_step"), spec, own)


def momentum(df: DataFrame, spec: Series, period: int = 10, close: str = "close") -> DataFrame:
    return windowed(df, spec, period, lambda d, s: d.withColumn("momentum", F.col(close) - F.lag(close, period).over(s.w)))


def rate_of_change(df: DataFrame, spec: Series, period: int = 10, close: str = "close") -> DataFrame:
    def build(df: DataFrame, spec: Series) -> DataFrame:
        before = F.lag(close, period).over(spec.w)
        return df.withColumn("roc", 100 * safe_divide(F.col(close) - before, before))

    return windowed(df, spec, period, build)


def realized_volatility(df: DataFrame, spec: Series, returns: str = "log_return", period: int = 20, name: str = "realized_vol") -> DataFrame:
    return windowed(df, spec, period, lambda d, s: d.withColumn(name, full(s, period, F.stddev_samp(returns).over(s.frame(period)), F.col(returns)) * math.sqrt(YEAR)))


def parkinson(df: DataFrame, spec: Series, period: int = 20) -> DataFrame:
    def build(df: DataFrame, spec: Series) -> DataFrame:
        ratio = safe_divide(F.col("high"), F.col("low"))
        staged = df.withColumn("_x", F.when(ratio > 0, F.pow(F.ln(ratio), 2)))
        return staged.withColumn("parkinson_vol", F.sqrt(full(spec, period, F.avg("_x").over(spec.frame(period)), F.col("_x")) / (4 * math.log(2))) * math.sqrt(YEAR)).drop("_x")

    return windowed(df, spec, period, build)


def garman_klass(df: DataFrame, spec: Series, period: int = 20) -> DataFrame:
    def build(df: DataFrame, spec: Series) -> DataFrame:
        hl, co = safe_divide(F.col("high"), F.col("low")), safe_divide(F.col("close"), F.col("open"))
        staged = df.withColumn("_x", F.when((hl > 0) & (co > 0), 0.5 * F.pow(F.ln(hl), 2) - (2 * math.log(2) - 1) * F.pow(F.ln(co), 2)))
        mean = full(spec, period, F.avg("_x").over(spec.frame(period)), F.col("_x"))
        return staged.withColumn("garman_klass_vol", F.when(mean.isNotNull(), F.sqrt(F.greatest(mean, F.lit(0.0)))) * math.sqrt(YEAR)).drop("_x")

    return windowed(df, spec, period, build)


def ewma_volatility(df: DataFrame, spec: Series, returns: str = "log_return", span: int = 20) -> DataFrame:
    return ewm_std(df, spec, "_sd", returns, span).withColumn("ewma_vol", F.col("_sd") * math.sqrt(YEAR)).drop("_sd")


VOLATILITY_REGIMES, TREND_REGIMES, MOMENTUM_REGIMES = ("low", "normal", "high", "crisis"), ("downtrend", "sideways", "uptrend"), ("strong_negative", "neutral", "strong_positive")


def volatility_regime(volatility: Column, low: float = 0.10, high: float = 0.25, crisis: float = 0.40) -> Column:
    """A missing volatility is normal."""
    return F.when(volatility >= crisis, "crisis").when(volatility >= high, "high").when(volatility <= low, "low").otherwise("normal")


def trend_regime(df: DataFrame, spec: Series, price: str = "close", short: int = 20, long: int = 50, threshold: float = 0.02) -> DataFrame:
    def build(df: DataFrame, spec: Series) -> DataFrame:
        mean = lambda k: full(spec, k, F.avg(price).over(spec.frame(k)), F.col(price))
        gap = safe_divide(mean(short) - mean(long), mean(long))
        return df.withColumn("trend_regime", F.when(gap > threshold, "uptrend").when(gap < -threshold, "downtrend").otherwise("sideways"))

    return windowed(df, spec, max(short, long), build)


def momentum_regime(df: DataFrame, spec: Series, returns: str = "log_return", window: int = 20, threshold: float = 0.5) -> DataFrame:
    """The rolling sum of returns against its own deviation over twice the window."""

    def build(df: DataFrame, spec: Series) -> DataFrame:
        staged = df.withColumn("_sum", full(spec, window, F.sum(returns).over(spec.frame(window)), F.col(returns)))
        z = safe_divide(F.col("_sum"), full(spec, 2 * window, F.stddev_samp("_sum").over(spec.frame(2 * window)), F.col("_sum")))
        return staged.withColumn("momentum_regime", F.when(z > threshold, "strong_positive").when(z < -threshold, "strong_negative").otherwise("neutral")).drop("_sum")

    return windowed(df, spec, 3 * window, build)


def run_length(df: DataFrame, spec: Series, column: str, name: str) -> DataFrame:
    """How many rows in a row, this one included, have had the same value: places since the last change."""
    rows, own = sliced(df, spec)
    same = lambda d, s: d.withColumn("_same", F.coalesce(F.col(column) == F.lag(column).over(s.w), F.lit(False)))
    at = positions(windowed(rows, own, 1, same), own, "_at")
    out = running(at, own, {"_began": ("last", F.when(~F.col("_same"), F.col("_at")))})
    return unsliced(out.withColumn(name, (F.col("_at") - F.col("_began") + 1).cast("int")).drop("_same", "_at", "_began"), spec, own)


def one_hot(df: DataFrame, column: str, categories: tuple[str, ...]) -> DataFrame:
    """A 0/1 column for each category of a fixed list, so that the schema does not depend on the rows."""
    return df.withColumns({f"{column}_{c}": F.coalesce((F.col(column) == c).cast("int"), F.lit(0)) for c in categories})


def regime_features(df: DataFrame, spec: Series, price: str = "close", volatility: str | None = None, **bounds: float) -> DataFrame:
    """Log returns, volatility, three regimes, their one-hot columns and the durations of two."""
    rows, own = sliced(df, spec)
    out = windowed(rows, own, 1, lambda d, s: d.withColumn("log_return", log_return(s, price)))
    if volatility is None:
        volatility = "realized_vol_20"
        out = realized_volatility(out, own, name=volatility)
    out = out.withColumn("volatility_regime", volatility_regime(F.col(volatility), **bounds))
    out = momentum_regime(trend_regime(out, own, price), own)
    for column, categories in (("volatility_regime", VOLATILITY_REGIMES), ("trend_regime", TREND_REGIMES), ("momentum_regime", MOMENTUM_REGIMES)):
        out = one_hot(out, column, categories)
    out = run_length(out, own, "volatility_regime", "volatility_regime_duration")
    return unsliced(run_length(out, own, "trend_regime", "trend_regime_duration"), spec, own)
