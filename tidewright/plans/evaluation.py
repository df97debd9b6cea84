"""Queries of discretisation, splits, metrics, calibration, trading, ensembles and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions.series import Series
from tidewright.operators import metrics, models, splits, trading
from tidewright.operators.bins import Discretizer
from tidewright.operators.features import with_log_return
from tidewright.operators.indicators import volatility_regime
from tidewright.plans.catalog import register
from tidewright.plans.inputs import BARS, EVENTS, SQL_BARS, SQL_EVENTS, SQL_SCORES, TS, W, bars_hourly, events, fullw, out, rnd, scores, table

K = ["series", "ts"]
_RET = f"CASE WHEN close / NULLIF(lag(close) OVER ({W}), 0) > 0 THEN ln(close / lag(close) OVER ({W})) END"
_SQL_RET = f"{SQL_BARS}, r AS (SELECT series, ts, open, close, {_RET} AS ret FROM bars)"


def _returns(spark, sf_dir):
    return with_log_return(bars_hourly(spark, sf_dir), BARS, "close", name="ret")


@register("label_direction", f"WITH {_SQL_RET} SELECT series, {TS}, CASE WHEN ret > 0.1 THEN 1 WHEN ret < -0.1 THEN -1 ELSE 0 END AS label FROM r")
def label_direction(spark, sf_dir):
    return out(_returns(spark, sf_dir).withColumn("label", Discretizer("direction", threshold=0.1).transform(F.col("ret"))), K, ["label"])


_PLACE = "CASE WHEN value >= e[1] AND value <= e[2] THEN 0 WHEN value > e[2] AND value <= e[3] THEN 1 WHEN value > e[3] AND value <= e[4] THEN 2 ELSE -1 END"


@register("bins_quantile", f"WITH q AS (SELECT quantile_cont(value, [0, 1/3, 2/3, 1]) AS e FROM events) SELECT event_id, {_PLACE} AS label FROM events, q")
def bins_quantile(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", Discretizer("quantile", 3).fit(e, "value").transform(F.col("value")).alias("label"))


_UNIFORM = "SELECT [min(value) - 0.001 * (max(value) - min(value)), min(value) + (max(value) - min(value)) / 3, min(value) + (max(value) - min(value)) / 3 * 2, max(value)] AS e FROM events"


@register("bins_uniform", f"WITH q AS ({_UNIFORM}) SELECT event_id, {_PLACE} AS label FROM events, q")
def bins_uniform(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", Discretizer("uniform", 3).fit(e, "value").transform(F.col("value")).alias("label"))


@register("bins_fixed", f"WITH q AS (SELECT [10.0::DOUBLE, 20, 50, 80] AS e) SELECT event_id, {_PLACE} AS label FROM events, q")
def bins_fixed(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", Discretizer("fixed", edges=[10.0, 20.0, 50.0, 80.0]).fit(e, "value").transform(F.col("value")).alias("label"))


@register("bin_centers", f"WITH q AS (SELECT [10.0::DOUBLE, 20, 50, 80] AS e), l AS (SELECT event_id, {_PLACE} AS label FROM events, q) SELECT event_id, CASE label WHEN 0 THEN 15.0::DOUBLE WHEN 1 THEN 35.0::DOUBLE WHEN 2 THEN 65.0::DOUBLE END AS center FROM l")
def bin_centers(spark, sf_dir):
    d = Discretizer("fixed", edges=[10.0, 20.0, 50.0, 80.0])
    return events(spark, sf_dir).select("event_id", d.inverse(d.transform(F.col("value"))).alias("center"))


_SQL_AT = f"{SQL_EVENTS}, p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n FROM ev), s AS (SELECT *, CASE WHEN pos < floor(CAST(n AS DOUBLE) * 0.7) THEN 'train' WHEN pos < floor(CAST(n AS DOUBLE) * 0.85) THEN 'validation' ELSE 'test' END AS split FROM p)"


@register("split_sequential", f"WITH {_SQL_AT} SELECT series, event_id, split FROM s")
def split_sequential(spark, sf_dir):
    return splits.sequential_split(events(spark, sf_dir), EVENTS).select("series", "event_id", "split")


@register("leakage_check", f"""WITH {_SQL_AT} SELECT series, strftime(max(ts) FILTER (WHERE split = 'train'), '%Y-%m-%d %H:%M:%S') AS train_last, strftime(min(ts) FILTER (WHERE split = 'test'), '%Y-%m-%d %H:%M:%S') AS test_first,
max(ts) FILTER (WHERE split = 'train') < min(ts) FILTER (WHERE split = 'validation') AND max(ts) FILTER (WHERE split = 'validation') < min(ts) FILTER (WHERE split = 'test') AS no_leakage FROM s GROUP BY series""")
def leakage_check(spark, sf_dir):
    return out(splits.leakage_check(splits.sequential_split(events(spark, sf_dir), EVENTS), EVENTS), ["series", "train_last", "test_first"], ["no_leakage"])


def _folded(name: str, bounds: str, of: dict):
    """Folds over all rows of each series: ``bounds`` gives, for n rows, the folds' a (start), b, c (ends of training and validation), d."""
    sql = f"""WITH {SQL_EVENTS}, p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts, event_id) - 1 AS pos FROM ev), n AS (SELECT series, count(*) AS n FROM ev GROUP BY 1),
    s AS (SELECT *, CAST(floor(n * 0.3) AS BIGINT) AS t, CAST(floor(n * 0.1) AS BIGINT) AS v, n // 7 AS q FROM n), f AS ({bounds})
    SELECT p.series, event_id, CAST(fold AS INTEGER) AS fold, CASE WHEN pos < b THEN 'train' WHEN pos < c THEN 'validation' ELSE 'test' END AS split FROM p JOIN f ON p.series = f.series AND pos >= a AND pos < d"""

    @register(name, sql)
    def query(spark, sf_dir):
        return splits.whole_folds(events(spark, sf_dir), EVENTS, **of).select("series", "event_id", "fold", "split")


_SHARES = {"train": 0.3, "validation": 0.1, "test": 0.1}
_K = "(SELECT series, n, t, v, q, unnest(range(0, greatest((n - t - 2 * v) // v + 1, 0))) AS k FROM s)"
_folded("folds_rolling", f"SELECT series, k AS fold, k * v AS a, k * v + t AS b, k * v + t + v AS c, k * v + t + 2 * v AS d FROM {_K}", {"kind": "rolling", **_SHARES})
_folded("folds_expanding", f"SELECT series, k AS fold, 0 AS a, k * v + t AS b, k * v + t + v AS c, k * v + t + 2 * v AS d FROM {_K}", {"kind": "expanding", **_SHARES})
_folded("folds_time_series", "SELECT series, k AS fold, 0 AS a, n - q * (6 - k) AS b, n - q * (6 - k) AS c, n - q * (6 - k) + q AS d FROM (SELECT *, unnest(range(6)) AS k FROM s)", {"kind": "time_series", "splits": 6})


@register("sequences", f"""WITH {SQL_BARS}, s AS (SELECT series, ts, close, list(close) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l, lag(open, 5) OVER ({W}) AS o FROM bars)
SELECT series, {TS}, {rnd('list_sum(l)', 'total')}, {rnd('l[1]', 'oldest')}, {rnd('o', 'oldest_open')}, {rnd('close', 'target')} FROM s WHERE len(l) = 5""")
def sequences(spark, sf_dir):
    s = splits.sequences(bars_hourly(spark, sf_dir), BARS, ["close", "open"], "close", 5)
    s = s.withColumns({"total": F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[0]), "oldest": F.col("sequence")[0][0], "oldest_open": F.col("sequence")[0][1]})
    return out(s, K, ["total", "oldest", "oldest_open", "target"])


@register("standard_scale", f"WITH t AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(l_tax) AS n, stddev_pop(l_tax) AS u FROM lineitem WHERE l_orderkey % 5 <> 0) SELECT l_orderkey, l_linenumber, {rnd('(l_quantity - m) / CASE WHEN s = 0 THEN 1 ELSE s END', 'l_quantity')}, {rnd('(l_tax - n) / CASE WHEN u = 0 THEN 1 ELSE u END', 'l_tax')} FROM lineitem, t")
def standard_scale(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return out(splits.standard_scale(li, ["l_quantity", "l_tax"], li.where("l_orderkey % 5 <> 0")), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])


@register("support_recent", f"WITH {SQL_EVENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC, event_id DESC) AS k FROM ev) SELECT series, event_id FROM k WHERE k <= 60")
def support_recent(spark, sf_dir):
    return splits.support_set(events(spark, sf_dir), EVENTS, 60).select("series", "event_id")


_SUPPORT_VOL = fullw(20, "ret", "stddev_samp(ret)")


@register("support_volatility_match", f"WITH {_SQL_RET}, v AS (SELECT *, {_SUPPORT_VOL} AS v FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(abs(v - 1.5), 9) NULLS LAST, ts DESC) AS k FROM v) SELECT series, {TS} FROM k WHERE k <= 40")
def support_volatility_match(spark, sf_dir):
    return out(splits.support_set(_returns(spark, sf_dir), BARS, 40, "volatility", "ret", 1.5), K, [])


_CLS = f"""WITH {SQL_SCORES}, d AS (SELECT l_linestatus, y, CAST(p >= 0.5 AS INTEGER) AS g FROM sc)"""
_BIN_METRICS = ", ".join([rnd("avg(CAST(y = g AS DOUBLE))", "accuracy"), rnd("avg(CAST(y = g AS DOUBLE))", "hit_rate"), rnd("coalesce(count(*) FILTER (WHERE y = 1 AND g = 1) / NULLIF(count(*) FILTER (WHERE g = 1), 0), 0)", "precision"), rnd("coalesce(count(*) FILTER (WHERE y = 1 AND g = 1) / NULLIF(count(*) FILTER (WHERE y = 1), 0), 0)", "recall"), rnd("coalesce(2 * count(*) FILTER (WHERE y = 1 AND g = 1) / NULLIF(count(*) FILTER (WHERE g = 1) + count(*) FILTER (WHERE y = 1), 0), 0)", "f1")])
_CLS_OUT = ["accuracy", "hit_rate", "precision", "recall", "f1"]


def _guesses(spark, sf_dir):
    return scores(spark, sf_dir).withColumn("g", (F.col("p") >= 0.5).cast("int"))


@register("cls_metrics", f"{_CLS} SELECT {_BIN_METRICS} FROM d")
def cls_metrics(spark, sf_dir):
    return out(metrics.classification_metrics(_guesses(spark, sf_dir), "y", "g"), [], _CLS_OUT)


_THREE = "WITH d AS (SELECT CAST(l_linenumber % 3 AS INTEGER) AS y, CAST(l_quantity % 3 AS INTEGER) AS g FROM lineitem), c AS (SELECT k, count(*) FILTER (WHERE y = k) AS s, count(*) FILTER (WHERE g = k) AS u, count(*) FILTER (WHERE y = k AND g = k) AS t FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY k), m AS (SELECT *, t / u AS p, t / s AS q, 2 * t / (u + s) AS f FROM c)"


def _three(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).cast("int").alias("y"), (F.col("l_quantity") % 3).cast("int").alias("g"))


def _multi(average: str, agg: str):
    parts = ", ".join([rnd("sum(t) / sum(s)", "accuracy"), rnd("sum(t) / sum(s)", "hit_rate"), *(rnd(agg.format(c=c), n) for n, c in (("precision", "p"), ("recall", "q"), ("f1", "f")))])

    @register(f"cls_metrics_{average}", f"{_THREE} SELECT {parts} FROM m")
    def query(spark, sf_dir):
        return out(metrics.classification_metrics(_three(spark, sf_dir), "y", "g", average), [], _CLS_OUT)


_multi("macro", "avg({c})")
_multi("weighted", "sum({c} * s) / sum(s)")
_multi("micro", "sum(t) / sum(s)")


@register("log_loss", f"WITH {SQL_SCORES} SELECT {rnd('avg((p - y) * (p - y))', 'brier_score')}, {rnd('avg(CASE WHEN y = 1 THEN -ln(greatest(least(p, 1 - 1e-15), 1e-15)) ELSE -ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)) END)', 'log_loss')} FROM sc")
def log_loss(spark, sf_dir):
    return out(metrics.brier_and_log_loss(scores(spark, sf_dir), "y", "p"), [], ["brier_score", "log_loss"])


@register("roc_auc", f"WITH {SQL_SCORES}, k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS k FROM sc) SELECT {rnd('(sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))', 'roc_auc')} FROM k")
def roc_auc(spark, sf_dir):
    return out(metrics.roc_auc(scores(spark, sf_dir), "y", "p"), [], ["roc_auc"])


_REG = "WITH o AS (SELECT o_orderpriority, o_totalprice AS y, lag(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS p FROM orders), d AS (SELECT * FROM o WHERE p IS NOT NULL)"
_REG_AGG = ", ".join([rnd("avg((y - p) * (y - p))", "mse", 3), rnd("sqrt(avg((y - p) * (y - p)))", "rmse", 3), rnd("avg(abs(y - p))", "mae", 3), rnd("1 - avg((y - p) * (y - p)) / NULLIF(var_pop(y), 0)", "r2", 3), rnd("100 * avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END)", "mape", 3)])
_REG_OUT = ["mse", "rmse", "mae", "r2", "mape"]
_PRICES = Series(("o_orderpriority",), "o_orderdate", ("o_orderkey",))


def _pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("p", F.lag("o_totalprice").over(_PRICES.w))
    return o.select("o_orderpriority", F.col("o_totalprice").alias("y"), "p")


@register("reg_metrics", f"{_REG} SELECT {_REG_AGG} FROM d")
def reg_metrics(spark, sf_dir):
    return out(metrics.regression_metrics(_pairs(spark, sf_dir), "y", "p"), [], _REG_OUT, 3)


@register("regime_robustness", f"{_REG}, e AS (SELECT o_orderpriority, y, p FROM d UNION ALL SELECT o_orderpriority || '|flat', y, 150000 FROM d) SELECT split_part(o_orderpriority, '|', 1) AS o_orderpriority, CASE WHEN o_orderpriority LIKE '%|flat' THEN 'flat' ELSE 'last' END AS model, {_REG_AGG} FROM e GROUP BY o_orderpriority")
def regime_robustness(spark, sf_dir):
    d = _pairs(spark, sf_dir).where("p IS NOT NULL").withColumn("flat", F.lit(150000.0))
    return out(metrics.robustness_by_regime(d, "o_orderpriority", {"last": "p", "flat": "flat"}, "y"), ["o_orderpriority", "model"], _REG_OUT, 3)


_SIG = "CASE WHEN f > 0.05 THEN 1 WHEN f < -0.05 THEN -1 ELSE 0 END"
_SQL_TRADE = f"""WITH {SQL_BARS}, a AS (SELECT series, ts, close, (close - lag(close) OVER ({W})) / NULLIF(lag(close) OVER ({W}), 0) / 1000 AS ret, sin(close) AS f FROM bars),
b AS (SELECT series, ts, ret, {_SIG} AS s, {_SIG} * ret AS r FROM a WHERE ret IS NOT NULL), c AS (SELECT *, product(1 + r) OVER ({W} ROWS UNBOUNDED PRECEDING) AS e FROM b),
d AS (SELECT *, e / max(e) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM c)"""
_TRADE = ["sharpe_ratio", "max_drawdown", "direction_hit_rate", "win_rate", "profit_factor", "total_return", "sortino_ratio"]


@register("trading_metrics", f"""{_SQL_TRADE} SELECT series, {rnd("CASE WHEN count(r) > 1 AND stddev_pop(r - 0.02 / 252) > 0 THEN avg(r - 0.02 / 252) / stddev_pop(r - 0.02 / 252) * sqrt(252) ELSE 0 END", "sharpe_ratio")}, {rnd("min(dd)", "max_drawdown")},
{rnd("avg(CAST(sign(s) = sign(ret) OR s = 0 AS DOUBLE))", "direction_hit_rate")}, {rnd("coalesce(avg(CASE WHEN s <> 0 THEN CAST(r > 0 AS DOUBLE) END), 0)", "win_rate")},
{rnd("CASE WHEN sum(CASE WHEN r < 0 THEN -r ELSE 0 END) > 0 THEN sum(CASE WHEN r > 0 THEN r ELSE 0 END) / sum(CASE WHEN r < 0 THEN -r ELSE 0 END) ELSE 0 END", "profit_factor")}, {rnd("product(1 + r) - 1", "total_return")},
{rnd("CASE WHEN count(*) FILTER (WHERE r < 0) > 1 THEN avg(r) / stddev_pop(r) FILTER (WHERE r < 0) * sqrt(252) ELSE 0 END", "sortino_ratio")} FROM d GROUP BY series""")
def trading_metrics(spark, sf_dir):
    b = bars_hourly(spark, sf_dir)
    change = F.try_divide(F.col("close") - F.lag("close").over(BARS.w), F.lag("close").over(BARS.w)) / 1000
    f = F.sin("close")
    b = b.withColumns({"ret": change, "signal": F.when(f > 0.05, 1).when(f < -0.05, -1).otherwise(0)})
    return out(metrics.trading_metrics(b, BARS, "ret", "signal", 0.02), ["series"], _TRADE)


_EDGES = metrics.bin_edges(10)
_BIN = "CASE " + " ".join(f"WHEN p >= {_EDGES[k]!r}::DOUBLE AND p {'<=' if k == 9 else '<'} {_EDGES[k + 1]!r}::DOUBLE THEN {k}" for k in range(10)) + " END"
_GRID = " UNION ALL ".join(f"SELECT {k} AS bin, {(_EDGES[k] + _EDGES[k + 1]) / 2!r}::DOUBLE AS center" for k in range(10))
_CURVE = f"WITH {SQL_SCORES}, c AS (SELECT {_BIN} AS bin, count(*) AS n, avg(y) AS a, avg(p) AS q FROM sc GROUP BY 1), g AS ({_GRID})"


@register("calibration_curve", f"{_CURVE} SELECT g.bin, {rnd('center', 'center')}, coalesce(n, 0) AS n, {rnd('a', 'accuracy')}, {rnd('q', 'confidence')} FROM g LEFT JOIN c USING (bin)")
def calibration_curve(spark, sf_dir):
    return out(metrics.calibration_curve(scores(spark, sf_dir), "y", "p"), ["bin", "n"], ["center", "accuracy", "confidence"])


@register("ece_mce", f"{_CURVE} SELECT {rnd('sum(abs(a - q) * n) / sum(n)', 'ece')}, {rnd('max(abs(a - q))', 'mce')} FROM c WHERE bin IS NOT NULL")
def ece_mce(spark, sf_dir):
    return out(metrics.calibration_errors(scores(spark, sf_dir), "y", "p"), [], ["ece", "mce"])


@register("reliability", f"{_CURVE} SELECT g.bin, {rnd('center', 'center')}, n, {rnd('a', 'accuracy')}, {rnd('q', 'confidence')} FROM g JOIN c USING (bin)")
def reliability(spark, sf_dir):
    return out(metrics.reliability(scores(spark, sf_dir), "y", "p"), ["bin", "n"], ["center", "accuracy", "confidence"])


_SIGNAL_OUT = ["event_id", "signal_type", "confidence"]


@register("signals_threshold", f"SELECT event_id, CASE WHEN p >= 0.6 THEN 'buy' WHEN p <= 0.4 THEN 'sell' ELSE 'hold' END AS signal_type, {rnd('CASE WHEN p >= 0.6 THEN p WHEN p <= 0.4 THEN CASE WHEN p BETWEEN 0 AND 1 THEN 1 - p ELSE abs(p) END ELSE 0 END', 'confidence')} FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN sin(value) END AS p FROM events)")
def signals_threshold(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("p", F.when(F.col("event_id") % 11 != 0, F.sin("value")))
    return out(trading.generate_signals(e, "p"), _SIGNAL_OUT[:2], ["confidence"])


@register("signals_directional", f"SELECT event_id, CASE WHEN p > 0.2 THEN 'buy' WHEN p < -0.2 THEN 'sell' ELSE 'hold' END AS signal_type, {rnd('CASE WHEN abs(p) > 0.2 THEN abs(p) ELSE 0 END', 'confidence')} FROM (SELECT event_id, sin(value) AS p FROM events)")
def signals_directional(spark, sf_dir):
    return out(trading.generate_signals(events(spark, sf_dir).withColumn("p", F.sin("value")), "p", "directional", threshold=0.2), _SIGNAL_OUT[:2], ["confidence"])


@register("position_size", f"SELECT event_id, {rnd('CASE WHEN p > 0.4 AND p < 0.6 THEN 0 ELSE 10000 * least(0.2 * CASE WHEN p >= 0.6 THEN p WHEN p BETWEEN 0 AND 1 THEN 1 - p ELSE abs(p) END, 0.2) END', 'position')} FROM (SELECT event_id, sin(value) AS p FROM events)")
def position_size(spark, sf_dir):
    s = trading.generate_signals(events(spark, sf_dir).withColumn("p", F.sin("value")), "p")
    return out(s.withColumn("position", trading.position_value(F.col("signal_type"), F.col("confidence"), 10000.0)), ["event_id"], ["position"])


@register("backtest", f"""WITH {SQL_BARS}, j AS (SELECT series, ts, 1000 + close AS price, CASE WHEN hour(ts) % 3 = 0 THEN CASE WHEN sin(close) >= 0.6 THEN 1 WHEN sin(close) <= 0.4 THEN -1 ELSE 0 END ELSE 0 END AS position FROM bars),
s AS (SELECT *, lag(position) OVER ({W}) * (price - lag(price) OVER ({W})) / lag(price) OVER ({W}) AS sr FROM j)
SELECT series, {TS}, position, {rnd("sr", "strategy_return")}, {rnd(f"CASE WHEN sr IS NOT NULL THEN 10000 * product(1 + sr) OVER ({W} ROWS UNBOUNDED PRECEDING) END", "equity", 4)} FROM s""")
def backtest(spark, sf_dir):
    b = bars_hourly(spark, sf_dir).withColumn("price", 1000 + F.col("close"))
    signals = trading.generate_signals(b.where(F.hour("ts") % 3 == 0).withColumn("p", F.sin("close")), "p").select("series", "ts", "signal_type")
    t = trading.backtest(b, signals, BARS, "price")
    return out(t, K, ["position", "strategy_return"]).join(out(t, K, ["equity"], 4), K)


_SQL_MODELS = "m AS (SELECT event_id, CAST(event_id % 3 AS INTEGER) - 1 AS a, CAST(user_id % 3 AS INTEGER) - 1 AS b, CASE WHEN value > 50 THEN 1 ELSE -1 END AS c FROM events)"


def _models(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("event_id") % 3 - 1).cast("int").alias("a"), (F.col("user_id") % 3 - 1).cast("int").alias("b"), F.when(F.col("value") > 50, 1).otherwise(-1).alias("c"))


@register("ensemble_vote", f"WITH {_SQL_MODELS}, l AS (SELECT event_id, unnest([a, b, c]) AS v FROM m), n AS (SELECT event_id, v, count(*) AS n FROM l GROUP BY 1, 2) SELECT event_id, CAST(arg_max(v, n * 10 - v) AS INTEGER) AS vote FROM n GROUP BY 1")
def ensemble_vote(spark, sf_dir):
    return _models(spark, sf_dir).select("event_id", trading.vote(["a", "b", "c"]).alias("vote"))


@register("ensemble_weighted", f"WITH {_SQL_MODELS} SELECT event_id, {rnd('(a + b + c) / 3', 'average')}, {rnd('(a * 0.5 + b * 0.3 + CASE WHEN event_id % 5 <> 0 THEN c * 0.2 ELSE 0 END) / CASE WHEN event_id % 5 <> 0 THEN 1.0 ELSE 0.8 END', 'weighted')}, CASE WHEN (a + b + c) / 3 > 0.3 THEN 1 WHEN (a + b + c) / 3 < -0.3 THEN -1 ELSE 0 END AS signal FROM m")
def ensemble_weighted(spark, sf_dir):
    m = _models(spark, sf_dir).withColumn("d", F.when(F.col("event_id") % 5 != 0, F.col("c")))
    m = m.withColumns({"average": trading.weighted(["a", "b", "c"]), "weighted": trading.weighted(["a", "b", "d"], [0.5, 0.3, 0.2]), "signal": trading.mean_signal(["a", "b", "c"])})
    return out(m, ["event_id"], ["average", "weighted", "signal"])


_NB = ["l_quantity", "l_extendedprice", "l_discount"]
_NB_STATS = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) + 1e-9 * (SELECT greatest({', '.join(f'var_pop({x})' for x in _NB)}) FROM t) AS v_{c}" for c in _NB)
_NB_SCORE = "ln(n / CAST((SELECT count(*) FROM t) AS DOUBLE))" + "".join(f" - 0.5 * ln(2 * pi() * v_{c}) - pow({c} - m_{c}, 2) / (2 * v_{c})" for c in _NB)


@register("gaussian_nb_scores", f"""WITH t AS (SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem WHERE l_orderkey % 5 <> 0), k AS (SELECT y AS label, count(*) AS n, {_NB_STATS} FROM t GROUP BY y),
s AS (SELECT l_orderkey, l_linenumber, label, {_NB_SCORE} AS s FROM lineitem, k)
SELECT l_orderkey, l_linenumber, {rnd("max(s) FILTER (WHERE label = 0)", "score_0")}, {rnd("max(s) FILTER (WHERE label = 1)", "score_1")}, {rnd("1 / (1 + exp(max(s) FILTER (WHERE label = 0) - max(s) FILTER (WHERE label = 1)))", "probability_1")}, CASE WHEN max(s) FILTER (WHERE label = 0) >= max(s) FILTER (WHERE label = 1) THEN 0 ELSE 1 END AS prediction FROM s GROUP BY 1, 2, l_linenumber""".replace("GROUP BY 1, 2, l_linenumber", "GROUP BY l_orderkey, l_linenumber"))
def gaussian_nb_scores(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("y", F.expr("CAST(l_returnflag = 'R' AS INT)"))
    # the key of order lines is not unique in the tables: a line number may come twice in an order
    told = models.GaussianNB(_NB).fit(li.where("l_orderkey % 5 <> 0"), "y").transform(li)
    best = told.groupBy("l_orderkey", "l_linenumber").agg(F.max("score_0").alias("score_0"), F.max("score_1").alias("score_1"))
    best = best.withColumns({"probability_1": 1 / (1 + F.exp(F.col("score_0") - F.col("score_1"))), "prediction": F.when(F.col("score_0") >= F.col("score_1"), 0).otherwise(1)})
    return out(best, ["l_orderkey", "l_linenumber"], ["score_0", "score_1", "probability_1", "prediction"])


@register("regime_thresholds", "SELECT event_id, CASE WHEN value / 200 >= 0.40 THEN 'crisis' WHEN value / 200 >= 0.25 THEN 'high' WHEN value / 200 <= 0.10 THEN 'low' ELSE 'normal' END AS regime FROM events")
def regime_thresholds(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", volatility_regime(F.col("value") / 200).alias("regime"))


