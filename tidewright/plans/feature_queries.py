"""Queries of lags, rolling windows, returns, calendar, order book, indicators, volatility and regimes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidewright.functions.series import running
from tidewright.operators import features, indicators
from tidewright.plans.catalog import register
from tidewright.plans.inputs import BARS, EVENTS, SQL_BARS, SQL_DAILY, SQL_EVENTS, SQL_GAPPY, TS, W, bars_daily, bars_hourly, events, fullw, gappy, out, rnd, table

K = ["series", "ts"]


def _bars(name: str, operator, values: dict[str, str], before: str = ""):
    """A query over hourly bars with an operator and, for each column it adds, an SQL expression over the bars."""
    ctes = f", {before}" if before else ""
    source = before.split(" AS ")[0].split(",")[-1].strip() if before.count(" AS (") == 1 else ("z" if before else "bars")

    @register(name, f"WITH {SQL_BARS}{ctes} SELECT series, {TS}, {', '.join(rnd(e, c) for c, e in values.items())} FROM {source}")
    def query(spark, sf_dir):
        return out(operator(bars_hourly(spark, sf_dir)), K, list(values))

    return query


_EV_W = "PARTITION BY series ORDER BY ts, event_id"
_LAGS = (1, 2, 3, 5, 10, 20)


@register("lags", f"WITH {SQL_EVENTS} SELECT series, event_id, {', '.join(rnd(f'lag(value, {k}) OVER ({_EV_W})', f'value_lag_{k}') for k in _LAGS)} FROM ev")
def lags(spark, sf_dir):
    return out(features.lag_features(events(spark, sf_dir), EVENTS, ["value"]), ["series", "event_id"], [f"value_lag_{k}" for k in _LAGS])


_ROLL = {f"value_rolling_{s}_{k}": f"{f}(value) OVER ({_EV_W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (5, 20) for s, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"), ("sum", "sum"))}


@register("rolling_basic", f"WITH {SQL_GAPPY} SELECT series, event_id, {', '.join(rnd(e, c) for c, e in _ROLL.items())} FROM ev")
def rolling_basic(spark, sf_dir):
    return out(features.rolling_features(gappy(spark, sf_dir), EVENTS, ["value"], (5, 20), ("mean", "std", "min", "max", "sum")), ["series", "event_id"], list(_ROLL))


@register("rolling_blocked", f"WITH {SQL_EVENTS} SELECT series, event_id, {', '.join(rnd(e, c) for c, e in _ROLL.items())} FROM ev")
def rolling_blocked(spark, sf_dir):
    """The same windows with each series cut into blocks that overlap, so that one long series is no single task."""
    spec = replace(EVENTS, longest=500)
    return out(features.rolling_features(events(spark, sf_dir), spec, ["value"], (5, 20), ("mean", "std", "min", "max", "sum")), ["series", "event_id"], list(_ROLL))


_QUANT = {f"value_rolling_{s}_10": f"quantile_cont(value, {q}) OVER ({_EV_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)" for s, q in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))}


@register("rolling_quantiles", f"WITH {SQL_EVENTS} SELECT series, event_id, {', '.join(rnd(e, c) for c, e in _QUANT.items())} FROM ev")
def rolling_quantiles(spark, sf_dir):
    return out(features.rolling_features(events(spark, sf_dir), EVENTS, ["value"], (10,), ("median", "q25", "q75")), ["series", "event_id"], list(_QUANT))


_PERIODS = (1, 5, 10, 20)
_LOGR = "CASE WHEN close / NULLIF(lag(close, {k}) OVER ({w}), 0) > 0 THEN ln(close / lag(close, {k}) OVER ({w})) END"
_bars("log_returns", lambda b: features.price_returns(b, BARS, ["close"]), {f"close_log_return_{k}": _LOGR.format(k=k, w=W) for k in _PERIODS})


@register("simple_returns", f"""WITH {SQL_GAPPY}, f AS (SELECT series, ts, event_id, last_value(value IGNORE NULLS) OVER ({_EV_W} ROWS UNBOUNDED PRECEDING) AS v FROM ev)
SELECT series, event_id, {', '.join(rnd(f'(v - lag(v, {k}) OVER ({_EV_W})) / NULLIF(lag(v, {k}) OVER ({_EV_W}), 0)', f'value_return_{k}') for k in _PERIODS)} FROM f""")
def simple_returns(spark, sf_dir):
    return out(features.price_returns(gappy(spark, sf_dir), EVENTS, ["value"], log=False), ["series", "event_id"], [f"value_return_{k}" for k in _PERIODS])




def _forward(b):
    for k in (1, 5):
        b = features.with_forward_return(b, BARS, "close", k, f"forward_{k}")
    return b


def _equity(b):
    r = features.with_log_return(b, BARS, "close", name="r")
    grown = running(r, BARS, {"equity": ("product", 1 + F.coalesce(F.col("r"), F.lit(0.0)) / 100)})
    return running(grown, BARS, {"peak": ("max", F.col("equity"))}).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


_bars("forward_returns", _forward, {f"forward_{k}": f"lead(close, {k}) OVER ({W}) / NULLIF(close, 0) - 1" for k in (1, 5)})
_bars("cumulative", _equity,
      {"equity": "equity", "drawdown": f"equity / max(equity) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1"},
      f"r AS (SELECT series, ts, coalesce({_LOGR.format(k=1, w=W)}, 0) / 100 AS r FROM bars), z AS (SELECT series, ts, product(1 + r) OVER ({W} ROWS UNBOUNDED PRECEDING) AS equity FROM r)")

_CAL = {
    "day_of_week": "isodow(ts) - 1", "day_of_month": "day(ts)", "month": "month(ts)", "quarter": "quarter(ts)", "year": "year(ts)", "week_of_year": "week(ts)", "is_weekend": "CAST(isodow(ts) >= 6 AS INTEGER)",
    "is_month_start": "CAST(day(ts) = 1 AS INTEGER)", "is_month_end": "CAST(CAST(ts AS DATE) = last_day(ts) AS INTEGER)", "is_quarter_start": "CAST(day(ts) = 1 AND month(ts) IN (1, 4, 7, 10) AS INTEGER)",
    "is_quarter_end": "CAST(CAST(ts AS DATE) = last_day(ts) AND month(ts) IN (3, 6, 9, 12) AS INTEGER)",
}
_CIRCLE = {"dow_sin": "sin((isodow(ts) - 1) * 6.283185307179586 / 7)", "dow_cos": "cos((isodow(ts) - 1) * 6.283185307179586 / 7)", "month_sin": "sin(month(ts) * 6.283185307179586 / 12)", "month_cos": "cos(month(ts) * 6.283185307179586 / 12)"}


@register("calendar", f"SELECT o_orderkey, {', '.join(f'CAST({e} AS INTEGER) AS {c}' for c, e in _CAL.items())}, {', '.join(rnd(e, c) for c, e in _CIRCLE.items())} FROM (SELECT o_orderkey, o_orderdate AS ts FROM orders)")
def calendar(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    return out(features.calendar_features(o), ["o_orderkey"], [*_CAL, *_CIRCLE])


_DAYS = features.us_holidays(1994, 2002) + features.us_holidays(2023, 2025)
_SQL_DAYS = "h AS (SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in _DAYS) + "]) AS d)"
_NEAR = "SELECT {k}, ts, (SELECT min(CAST(d AS TIMESTAMP)) FROM h WHERE CAST(d AS TIMESTAMP) >= x.ts) AS n, (SELECT max(CAST(d AS TIMESTAMP)) FROM h WHERE CAST(d AS TIMESTAMP) <= x.ts) AS p FROM x"
_SQL_HOLIDAYS = """SELECT {k}, CAST(CAST(ts AS DATE) IN (SELECT d FROM h) AS INTEGER) AS is_holiday, CAST(floor((epoch(n) - epoch(ts)) / 86400) AS INTEGER) AS days_to_next_holiday,
CAST(floor((epoch(ts) - epoch(p)) / 86400) AS INTEGER) AS days_from_last_holiday, CAST(least(floor((epoch(n) - epoch(ts)) / 86400), floor((epoch(ts) - epoch(p)) / 86400)) AS INTEGER) AS days_to_nearest_holiday FROM m"""


@register("holidays", f"WITH {_SQL_DAYS}, x AS (SELECT o_orderkey, o_orderdate AS ts FROM orders), m AS ({_NEAR.format(k='o_orderkey')}) {_SQL_HOLIDAYS.format(k='o_orderkey')}")
def holidays(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    return features.holiday_features(o, _DAYS).drop("ts")


@register("holidays_intraday", f"WITH {_SQL_DAYS}, x AS (SELECT event_id, ts FROM events), m AS ({_NEAR.format(k='event_id')}) {_SQL_HOLIDAYS.format(k='event_id')}")
def holidays_intraday(spark, sf_dir):
    return features.holiday_features(events(spark, sf_dir).select("event_id", "ts"), _DAYS).drop("ts")


_BOOK = "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS b, l_extendedprice AS a, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE l_quantity END AS bs, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE l_linenumber END AS s FROM lineitem"


@register("order_book", f"SELECT l_orderkey, l_linenumber, {rnd('(b + a) / 2 + 1e-9', 'mid_price')}, {rnd('a - b + 1e-9', 'bid_ask_spread')}, {rnd('(a - b) / NULLIF((b + a) / 2, 0) + 1e-9', 'relative_spread')}, {rnd('coalesce((b * s + a * bs) / NULLIF(s + bs, 0), (b + a) / 2) + 1e-9', 'wap')} FROM ({_BOOK})")
def order_book(spark, sf_dir):
    size = lambda c: F.when(F.col("l_linenumber") % 5 == 0, 0.0).otherwise(F.col(c).cast("double"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("bid_price"), F.col("l_extendedprice").alias("ask_price"), size("l_quantity").alias("bid_size"), size("l_linenumber").alias("ask_size"))
    names = ["mid_price", "bid_ask_spread", "relative_spread", "wap"]
    # many values end in a five at the seventh place; a nudge keeps two engines from rounding it differently
    book = features.order_book_features(li).withColumns({c: F.col(c) + 1e-9 for c in names})
    return out(book, ["l_orderkey", "l_linenumber"], names)


_bars("momentum", lambda b: indicators.momentum(b, BARS), {"momentum": f"close - lag(close, 10) OVER ({W})"})
_bars("roc", lambda b: indicators.rate_of_change(b, BARS), {"roc": f"100 * (close - lag(close, 10) OVER ({W})) / NULLIF(lag(close, 10) OVER ({W}), 0)"})
_bars("obv", lambda b: indicators.obv(b, BARS), {"obv": f"sum(s) OVER ({W} ROWS UNBOUNDED PRECEDING)"}, f"z AS (SELECT series, ts, coalesce(sign(close - lag(close) OVER ({W})), 0) * volume AS s FROM bars)")
_MEAN20, _SD20 = fullw(20, "close", "avg(close)"), fullw(20, "close", "stddev_samp(close)")
_bars("bollinger", lambda b: indicators.bollinger(b, BARS), {"bb_upper": f"{_MEAN20} + 2 * {_SD20}", "bb_middle": _MEAN20, "bb_lower": f"{_MEAN20} - 2 * {_SD20}"})
_HIGH, _LOW = fullw(14, "high", "max(high)"), fullw(14, "low", "min(low)")
_bars("stochastic", lambda b: indicators.stochastic(b, BARS), {"stoch_k": "k", "stoch_d": fullw(3, "k", "avg(k)")}, f"z AS (SELECT series, ts, 100 * (close - ({_LOW})) / NULLIF(({_HIGH}) - ({_LOW}), 0) AS k FROM bars)")
_bars("williams_r", lambda b: indicators.williams_r(b, BARS), {"williams_r": f"-100 * (({_HIGH}) - close) / NULLIF(({_HIGH}) - ({_LOW}), 0)"})
_bars("cci", lambda b: indicators.cci(b, BARS), {"cci": "CASE WHEN len(a) = 20 THEN (tp - list_avg(a)) / NULLIF(0.015 * list_sum(list_transform(a, lambda x: abs(x - list_avg(a)))) / 20, 0) END"},
      f"t AS (SELECT series, ts, (high + low + close) / 3 AS tp FROM bars), z AS (SELECT series, ts, tp, list(tp) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a FROM t)")


def _ewm(c: str, span: int) -> str:
    a = 2 / (span + 1)
    return f"list_reduce(list({c}) OVER ({W} ROWS UNBOUNDED PRECEDING), lambda z, v: z * {1 - a!r} + v * {a!r})"


_bars("rsi", lambda b: indicators.rsi(b, BARS), {"rsi": "CASE WHEN l = 0 THEN 50 ELSE 100 - 100 / (1 + g / l) END"},
      f"d AS (SELECT series, ts, close - lag(close) OVER ({W}) AS d FROM bars), e AS (SELECT series, ts, CASE WHEN d > 0 THEN d ELSE 0.0::DOUBLE END AS g, CASE WHEN d < 0 THEN -d ELSE 0.0::DOUBLE END AS l FROM d), z AS (SELECT series, ts, {_ewm('g', 14)} AS g, {_ewm('l', 14)} AS l FROM e)")
_bars("macd", lambda b: indicators.macd(b, BARS), {"macd": "m", "macd_signal": "s", "macd_histogram": "m - s"}, f"q AS (SELECT series, ts, {_ewm('close', 12)} - {_ewm('close', 26)} AS m FROM bars), z AS (SELECT series, ts, m, {_ewm('m', 9)} AS s FROM q)")
_bars("atr", lambda b: indicators.atr(b, BARS), {"atr": "a"}, f"t AS (SELECT series, ts, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr FROM bars), z AS (SELECT series, ts, {_ewm('tr', 14)} AS a FROM t)")

_RET = f"r AS (SELECT *, {_LOGR.format(k=1, w=W)} AS lr FROM bars)"
_YEAR = "sqrt(252)"
_with_return = lambda b: b.withColumn("log_return", features.log_return(BARS, "close"))
_VOL = f"({fullw(20, 'lr', 'stddev_samp(lr)')}) * {_YEAR}"
_bars("realized_vol", lambda b: indicators.realized_volatility(_with_return(b), BARS), {"realized_vol": _VOL}, _RET)
_D = 1 - 2 / 21
_bars("ewma_vol", lambda b: indicators.ewma_volatility(_with_return(b), BARS), {"ewma_vol": f"CASE WHEN n > 1 THEN sqrt(greatest(q / w - (m / w) * (m / w), 0) * w * w / (w * w - w2)) * {_YEAR} END"},
      f"r AS (SELECT series, ts, {_LOGR.format(k=1, w=W)} AS lr, row_number() OVER ({W}) AS k FROM bars), z AS (SELECT a.series, a.ts, count(b.lr) AS n, sum(pow({_D!r}, a.k - b.k)) AS w, sum(pow({_D!r}, 2 * (a.k - b.k))) AS w2, sum(b.lr * pow({_D!r}, a.k - b.k)) AS m, sum(b.lr * b.lr * pow({_D!r}, a.k - b.k)) AS q FROM r a LEFT JOIN r b ON a.series = b.series AND b.k <= a.k AND b.lr IS NOT NULL GROUP BY a.series, a.ts)")
_bars("parkinson", lambda b: indicators.parkinson(b.where("low > 0"), BARS), {"parkinson_vol": f"sqrt(({fullw(20, 'x', 'avg(x)')}) / (4 * ln(2))) * {_YEAR}"}, "z AS (SELECT series, ts, pow(ln(high / low), 2) AS x FROM bars WHERE low > 0)")
_bars("garman_klass", lambda b: indicators.garman_klass(b.where("low > 0"), BARS), {"garman_klass_vol": f"CASE WHEN ({fullw(20, 'x', 'avg(x)')}) IS NOT NULL THEN sqrt(greatest({fullw(20, 'x', 'avg(x)')}, 0)) END * {_YEAR}"}, "z AS (SELECT series, ts, 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) AS x FROM bars WHERE low > 0)")

_HOURLY = {"low": 20.0, "high": 32.0, "crisis": 36.0}
_REGIME = "CASE WHEN v >= {crisis} THEN 'crisis' WHEN v >= {high} THEN 'high' WHEN v <= {low} THEN 'low' ELSE 'normal' END"
_SQL_VOL = f"{SQL_BARS}, {_RET}, v AS (SELECT *, {_VOL} AS v FROM r)"


@register("hourly_regimes", f"WITH {_SQL_VOL} SELECT series, {TS}, {rnd('close', 'close')}, {rnd('lr', 'log_return')}, {rnd('v', 'realized_vol')}, {_REGIME.format(**_HOURLY)} AS volatility_regime FROM v")
def hourly_regimes(spark, sf_dir):
    b = indicators.realized_volatility(_with_return(bars_hourly(spark, sf_dir)), BARS)
    b = b.withColumn("volatility_regime", indicators.volatility_regime(F.col("realized_vol"), **_HOURLY))
    return out(b, K, ["close", "log_return", "realized_vol", "volatility_regime"])


_DAILY_BOUNDS = {"low": 14.0, "high": 25.0, "crisis": 30.0}


@register("daily_vol_regime", f"WITH {SQL_DAILY}, {_RET}, v AS (SELECT *, {_VOL} AS v FROM r) SELECT series, {TS}, {rnd('v', 'realized_vol')}, {_REGIME.format(**_DAILY_BOUNDS)} AS volatility_regime FROM v")
def daily_vol_regime(spark, sf_dir):
    b = indicators.realized_volatility(_with_return(bars_daily(spark, sf_dir)), BARS)
    return out(b.withColumn("volatility_regime", indicators.volatility_regime(F.col("realized_vol"), **_DAILY_BOUNDS)), K, ["realized_vol", "volatility_regime"])


_GAP = f"(({fullw(20, 'close', 'avg(close)')}) - ({fullw(50, 'close', 'avg(close)')})) / NULLIF({fullw(50, 'close', 'avg(close)')}, 0)"
_SQL_TREND = f"t AS (SELECT *, CASE WHEN {_GAP} > 0.02 THEN 'uptrend' WHEN {_GAP} < -0.02 THEN 'downtrend' ELSE 'sideways' END AS trend_regime FROM bars)"


@register("trend_regime", f"WITH {SQL_BARS}, {_SQL_TREND} SELECT series, {TS}, trend_regime FROM t")
def trend_regime(spark, sf_dir):
    return out(indicators.trend_regime(bars_hourly(spark, sf_dir), BARS), K, ["trend_regime"])


@register("momentum_regime", f"""WITH {SQL_BARS}, {_RET}, s AS (SELECT *, {fullw(20, 'lr', 'sum(lr)')} AS s FROM r), z AS (SELECT *, s / NULLIF({fullw(40, 's', 'stddev_samp(s)')}, 0) AS z FROM s)
SELECT series, {TS}, CASE WHEN z > 0.5 THEN 'strong_positive' WHEN z < -0.5 THEN 'strong_negative' ELSE 'neutral' END AS momentum_regime FROM z""")
def momentum_regime(spark, sf_dir):
    return out(indicators.momentum_regime(_with_return(bars_hourly(spark, sf_dir)), BARS), K, ["momentum_regime"])


@register("regime_duration", f"""WITH {SQL_BARS}, {_SQL_TREND}, c AS (SELECT *, CASE WHEN trend_regime = lag(trend_regime) OVER ({W}) THEN 0 ELSE 1 END AS c FROM t), i AS (SELECT *, sum(c) OVER ({W} ROWS UNBOUNDED PRECEDING) AS i FROM c)
SELECT series, {TS}, trend_regime, CAST(row_number() OVER (PARTITION BY series, i ORDER BY i.ts) AS INTEGER) AS duration FROM i""")
def regime_duration(spark, sf_dir):
    b = indicators.trend_regime(bars_hourly(spark, sf_dir), BARS)
    return out(indicators.run_length(b, BARS, "trend_regime", "duration"), [*K, "trend_regime"], ["duration"])


_HOT = ", ".join(f"CAST({_REGIME.format(**_HOURLY)} = '{c}' AS INTEGER) AS volatility_regime_{c}" for c in indicators.VOLATILITY_REGIMES)


@register("regime_onehot", f"WITH {_SQL_VOL} SELECT series, {TS}, {_HOT} FROM v")
def regime_onehot(spark, sf_dir):
    b = indicators.regime_features(bars_hourly(spark, sf_dir), BARS, **_HOURLY)
    return out(b, K, [f"volatility_regime_{c}" for c in indicators.VOLATILITY_REGIMES])


_PACK = {"value_return_1": "(value - lag(value, 1) OVER ({w})) / NULLIF(lag(value, 1) OVER ({w}), 0)"}


@register("feature_pack", f"""WITH {SQL_EVENTS} SELECT series, event_id, {rnd(f"CASE WHEN value / NULLIF(lag(value, 1) OVER ({_EV_W}), 0) > 0 THEN ln(value / lag(value, 1) OVER ({_EV_W})) END", "value_log_return_1")},
{rnd(f"lag(value, 2) OVER ({_EV_W})", "value_lag_2")}, {rnd(_ROLL["value_rolling_mean_5"], "value_rolling_mean_5")}, {rnd(_ROLL["value_rolling_std_5"], "value_rolling_std_5")}, isodow(ts) - 1 AS day_of_week FROM ev""")
def feature_pack(spark, sf_dir):
    config = {"return_periods": (1,), "lag_periods": (2,), "rolling_windows": (5,), "rolling_statistics": ("mean", "std")}
    # the catalogue's types of calendar parts follow the oracle's
    e = features.engineer_all(events(spark, sf_dir), EVENTS, ["value"], config).withColumn("day_of_week", F.col("day_of_week").cast("bigint"))
    return out(e, ["series", "event_id"], ["value_log_return_1", "value_lag_2", "value_rolling_mean_5", "value_rolling_std_5", "day_of_week"])
