"""Lags, rolling statistics, returns, calendar, order book and the full feature pack."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.series import Series, sliced, unsliced, windowed
from tidewright.operators.clean import fill_missing, safe_divide

LAGS, WINDOWS, RETURN_PERIODS = (1, 2, 3, 5, 10, 20), (5, 10, 20, 50), (1, 5, 10, 20)
STATISTICS = ("mean", "std", "min", "max")


def lag_features(df: DataFrame, spec: Series, columns: list[str] | None = None, lags=LAGS) -> DataFrame:
    """{column}_lag_{k}; unknown columns are left out."""
    names = [c for c in (columns or spec.numeric(df)) if c in df.columns]
    return windowed(df, spec, max(lags), lambda d, s: d.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(s.w) for c in names for k in lags}))


def rolling_statistic(spec: Series, c: str, statistic: str, size: int) -> Column:
    """A statistic over the last rows, from one present value on (std: two)."""
    w = spec.frame(size)
    plain = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}
    quantiles = {"median": 0.5, "q25": 0.25, "q75": 0.75}
    if statistic in plain:
        return plain[statistic](c).over(w)
    if statistic in quantiles:
        return F.percentile(c, F.lit(quantiles[statistic])).over(w)
    raise ValueError(f"unknown statistic {statistic!r}")


def rolling_features(df: DataFrame, spec: Series, columns: list[str] | None = None, windows=WINDOWS, statistics=STATISTICS) -> DataFrame:
    """{column}_rolling_{statistic}_{size}, all in one window stage."""
    names = [c for c in (columns or spec.numeric(df)) if c in df.columns]
    return windowed(df, spec, max(windows), lambda d, own: d.withColumns({f"{c}_rolling_{s}_{k}": rolling_statistic(own, c, s, k) for c in names for k in windows for s in statistics}))


def log_return(spec: Series, c: str, periods: int = 1) -> Column:
    """ln of the ratio to an earlier row; missing where the ratio is not positive."""
    ratio = safe_divide(F.col(c), F.lag(c, periods).over(spec.w))
    return F.when(ratio > 0, F.ln(ratio))


def price_returns(df: DataFrame, spec: Series, columns: list[str], periods=RETURN_PERIODS, log: bool = True, fill: bool = True) -> DataFrame:
    """{column}_log_return_{p}, or {column}_return_{p}, the change relative to p rows before (gaps filled forward first, if asked)."""
    if log:
        return windowed(df, spec, max(periods), lambda d, s: d.withColumns({f"{c}_log_return_{p}": log_return(s, c, p) for c in columns for p in periods}))
    name = (lambda c: f"_f_{c}") if fill else (lambda c: c)
    rows, own = sliced(df, spec)
    if fill:
        rows = fill_missing(rows.withColumns({name(c): F.col(c) for c in columns}), own, "forward_fill", [name(c) for c in columns])

    def build(rows: DataFrame, s: Series) -> DataFrame:
        before = lambda c, p: F.lag(name(c), p).over(s.w)
        return rows.withColumns({f"{c}_return_{p}": safe_divide(F.col(name(c)) - before(c, p), before(c, p)) for c in columns for p in periods})

    out = unsliced(windowed(rows, own, max(periods), build), spec, own)
    return out.select(*df.columns, *[f"{c}_return_{p}" for c in columns for p in periods])


def forward_return(spec: Series, c: str, steps: int = 1) -> Column:
    """The return that is still to come: a target, never a feature."""
    return safe_divide(F.lead(c, steps).over(spec.w), F.col(c)) - 1


def with_forward_return(df: DataFrame, spec: Series, c: str, steps: int = 1, name: str = "target") -> DataFrame:
    """Adds forward_return(), for series of any length."""
    return windowed(df, spec, 0, lambda d, s: d.withColumn(name, forward_return(s, c, steps)), lookahead=steps)


def with_log_return(df: DataFrame, spec: Series, c: str, periods: int = 1, name: str = "log_return") -> DataFrame:
    """Adds log_return(), for series of any length."""
    return windowed(df, spec, periods, lambda d, s: d.withColumn(name, log_return(s, c, periods)))


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Parts of the date (Monday 0, ISO weeks), flags as 0 and 1, and weekday and month on a circle."""
    if dict(df.dtypes)[ts] not in ("timestamp", "timestamp_ntz", "date"):
        raise ValueError(f"{ts} is no time column")
    t = F.col(ts)
    dow, month, dom = F.weekday(t), F.month(t), F.dayofmonth(t)
    last = F.to_date(t) == F.last_day(t)
    flag = lambda c: c.cast("int")
    tau = 6.283185307179586
    return df.withColumns({
        "day_of_week": dow, "day_of_month": dom, "month": month, "quarter": F.quarter(t), "year": F.year(t), "week_of_year": F.weekofyear(t),
        "is_weekend": flag(dow >= 5), "is_month_start": flag(dom == 1), "is_month_end": flag(last),
        "is_quarter_start": flag((dom == 1) & month.isin(1, 4, 7, 10)), "is_quarter_end": flag(last & month.isin(3, 6, 9, 12)),
        "dow_sin": F.sin(dow * tau / 7), "dow_cos": F.cos(dow * tau / 7), "month_sin": F.sin(month * tau / 12), "month_cos": F.cos(month * tau / 12),
    })


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th such weekday of a month; n = -1: the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def us_holidays(first: int, last: int, observed: bool = True) -> list[date]:
    """US federal holidays of some years, by the public rules; a weekend date is observed on the nearest weekday too."""
    found = set()
    for y in range(first, last + 1):
        fixed = [date(y, 1, 1), date(y, 7, 4), date(y, 11, 11), date(y, 12, 25), *([date(y, 6, 19)] if y >= 2021 else [])]
        moving = [_nth(y, 1, 0, 3), _nth(y, 2, 0, 3), _nth(y, 5, 0, -1), _nth(y, 9, 0, 1), _nth(y, 10, 0, 2), _nth(y, 11, 3, 4)]
        found.update(fixed + moving)
        if observed:
            found.update(d + timedelta({5: -1, 6: 1}[d.weekday()]) for d in fixed if d.weekday() >= 5)
    return sorted(found)


def holiday_calendar(spark: SparkSession, holidays: list[date], first: date, last: date) -> DataFrame:
    """One row a date: whether it is a holiday, the last one (itself included), the next one from it and after it."""
    days = [first + timedelta(k) for k in range((last - first).days + 1)]
    rows, before = [], None
    known = sorted(holidays)
    import bisect

    for d in days:
        at = bisect.bisect_left(known, d)
        is_one = at < len(known) and known[at] == d
        before = d if is_one else before
        previous = known[at] if is_one else (known[at - 1] if at else None)
        following = known[at + is_one] if at + is_one < len(known) else None
        rows.append((d, int(is_one), previous, known[at] if at < len(known) else None, following))
    return spark.createDataFrame(rows, "day date, is_holiday int, previous date, next_from date, next_after date")


def holiday_features(df: DataFrame, holidays: list[date], ts: str = "ts") -> DataFrame:
    """is_holiday, days_to_next_holiday, days_from_last_holiday, days_to_nearest_holiday: whole days, rounded down.

    The next holiday is the first that begins at the row's time or later, so within a holiday it is the one after it.
    Days are counted from the whole time, fractions of a second included (seconds as doubles, as SQL's epoch has them).
    Before the list there is only a next holiday, its first, and after it only a last one, its end, however far away; the
    nearest is then that one. A row without a time has nothing. The calendar has a row a day of the list and is broadcast.
    """
    if not holidays:
        return df.withColumns({"is_holiday": F.lit(0), **{c: F.lit(None).cast("int") for c in ("days_to_next_holiday", "days_from_last_holiday", "days_to_nearest_holiday")}})
    first, last = min(holidays), max(holidays)
    table = holiday_calendar(df.sparkSession, holidays, first, last)
    t, day = F.col(ts).cast("timestamp"), F.col("day")
    joined = df.withColumn("day", F.to_date(t)).join(F.broadcast(table), "day", "left")
    at_midnight = t == day.cast("timestamp")
    following = F.when(day < F.lit(first), F.lit(first)).when(at_midnight, F.col("next_from")).otherwise(F.col("next_after"))
    previous = F.when(day > F.lit(last), F.lit(last)).otherwise(F.col("previous"))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    to_next = F.floor((seconds(following) - seconds(t)) / 86400).cast("int")
    from_last = F.floor((seconds(t) - seconds(previous)) / 86400).cast("int")
    is_holiday = F.when(day.isNotNull(), F.coalesce("is_holiday", F.lit(0)))
    out = joined.withColumns({"is_holiday": is_holiday, "days_to_next_holiday": to_next, "days_from_last_holiday": from_last})
    return out.withColumn("days_to_nearest_holiday", F.least("days_to_next_holiday", "days_from_last_holiday")).drop("day", "previous", "next_from", "next_after")


def order_book_features(df: DataFrame, bid: str = "bid_price", ask: str = "ask_price", bid_size: str = "bid_size", ask_size: str = "ask_size") -> DataFrame:
    """mid_price, bid_ask_spread, relative_spread and, where sizes exist, wap (the mid where both sizes are zero)."""
    if bid not in df.columns or ask not in df.columns:
        return df
    b, a = F.col(bid), F.col(ask)
    out = df.withColumns({"mid_price": (b + a) / 2, "bid_ask_spread": a - b}).withColumn("relative_spread", safe_divide(F.col("bid_ask_spread"), F.col("mid_price")))
    if bid_size in df.columns and ask_size in df.columns:
        bs, as_ = F.col(bid_size), F.col(ask_size)
        out = out.withColumn("wap", F.coalesce(safe_divide(b * as_ + a * bs, as_ + bs), F.col("mid_price")))
    return out


def engineer_all(df: DataFrame, spec: Series, price: list[str], config: dict | None = None, holidays: list[date] | None = None) -> DataFrame:
    """Returns, lags, rolling statistics, calendar (with holidays, if any are given) and order book in a fixed order."""
    config = config or {}
    base = spec.numeric(df)
    rows, own = sliced(df, spec)
    out = price_returns(rows, own, [c for c in price if c in df.columns], config.get("return_periods", RETURN_PERIODS))
    out = lag_features(out, own, base, config.get("lag_periods", LAGS))
    out = rolling_features(out, own, base, config.get("rolling_windows", WINDOWS), config.get("rolling_statistics", STATISTICS))
    out = calendar_features(unsliced(out, spec, own), spec.ts)
    return order_book_features(holiday_features(out, holidays, spec.ts) if holidays else out)


#: Buckets of feature names, by what a name holds; spread columns stand in two.
CATALOGUE = {
    "lag": ("_lag_",), "rolling": ("_rolling_",), "returns": ("_return_",), "order_book": ("mid_price", "wap", "bid_ask_spread", "relative_spread"), "cross_asset": ("spread", "correlation"),
    "calendar": ("day_of", "month", "quarter", "year", "week", "dow_", "is_", "holiday"),
}


def feature_catalogue(names: list[str]) -> dict[str, list[str]]:
    """Which of the names fall into each bucket."""
    return {bucket: [n for n in names if any(p in n for p in parts)] for bucket, parts in CATALOGUE.items()}
