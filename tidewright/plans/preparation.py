"""Queries of bars, resampling, filling, outliers, joins and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions.series import Series
from tidewright.operators import clean, quality, resample
from tidewright.operators.bins import top_correlated
from tidewright.plans.catalog import register
from tidewright.plans.inputs import BARS, EVENTS, SQL_BARS, SQL_DAILY, SQL_EVENTS, SQL_GAPPY, TS, bars_daily, bars_hourly, events, gappy, out, r, rnd, table

OHLCV = ["open", "high", "low", "close", "volume"]
_BARS_OUT = f"SELECT series, {TS}, {', '.join(rnd(c, c) for c in OHLCV)} FROM bars"


@register("hourly_ohlcv", f"WITH {SQL_BARS} {_BARS_OUT}")
def hourly_ohlcv(spark, sf_dir):
    return out(bars_hourly(spark, sf_dir), ["series", "ts"], OHLCV)


@register("daily_ohlcv", f"WITH {SQL_DAILY} {_BARS_OUT}")
def daily_ohlcv(spark, sf_dir):
    return out(bars_daily(spark, sf_dir), ["series", "ts"], OHLCV)


@register("weekly_ohlcv_of_bars", f"""WITH {SQL_DAILY}, w AS (SELECT series, date_trunc('week', ts) + INTERVAL 6 DAY AS b, * EXCLUDE (series) FROM bars)
SELECT series, strftime(b, '%Y-%m-%d %H:%M:%S') AS ts, {rnd("arg_min(open, ts)", "open")}, {rnd("max(high)", "high")}, {rnd("min(low)", "low")}, {rnd("arg_max(close, ts)", "close")}, {rnd("sum(volume)", "volume")} FROM w GROUP BY series, b""")
def weekly_ohlcv_of_bars(spark, sf_dir):
    return out(resample.resample_ohlcv(bars_daily(spark, sf_dir), BARS, "W"), ["series", "ts"], OHLCV)


def _resampled(how: str):
    agg = {"mean": "avg(value)", "sum": "sum(value)", "first": "arg_min(value, ts)", "last": "arg_max(value, ts)"}[how]
    value = "coalesce(v, 0)" if how == "sum" else "v"
    sql = f"""WITH {SQL_GAPPY}, b AS (SELECT series, date_trunc('hour', ts) AS ts, {agg} AS v FROM ev GROUP BY 1, 2),
    g AS (SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM b GROUP BY series)
    SELECT series, {TS}, {rnd(value, "value")} FROM g LEFT JOIN b USING (series, ts)"""
    if how in ("first", "last"):
        sql = sql.replace("FROM ev GROUP", "FROM ev WHERE value IS NOT NULL GROUP").replace("g AS (SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM b GROUP BY series)", "g AS (SELECT series, unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS ts FROM ev GROUP BY series)")

    @register(f"resample_{how}_gapfilled", sql)
    def query(spark, sf_dir):
        return out(resample.resample(gappy(spark, sf_dir), EVENTS, "h", how, ["value"]), ["series", "ts"], ["value"])


for _how in resample.SIMPLE:
    _resampled(_how)

_FILL_W = "(PARTITION BY series ORDER BY ts, event_id ROWS BETWEEN {} AND {})"
_BACK, _AHEAD = _FILL_W.format("UNBOUNDED PRECEDING", "CURRENT ROW"), _FILL_W.format("CURRENT ROW", "UNBOUNDED FOLLOWING")
_FILLS = {
    "ffill": ("forward_fill", f"last_value(value IGNORE NULLS) OVER {_BACK}"),
    "bfill": ("backward_fill", f"first_value(value IGNORE NULLS) OVER {_AHEAD}"),
    "fill_mean": ("mean", "coalesce(value, avg(value) OVER (PARTITION BY series))"),
    "fill_median": ("median", "coalesce(value, quantile_cont(value, 0.5) OVER (PARTITION BY series))"),
}


def _filled(name: str, strategy: str, expr: str):
    @register(name, f"WITH {SQL_GAPPY} SELECT series, event_id, {rnd(expr, 'value')} FROM ev")
    def query(spark, sf_dir):
        return out(clean.fill_missing(gappy(spark, sf_dir), EVENTS, strategy), ["series", "event_id"], ["value"])


for _name, (_strategy, _expr) in _FILLS.items():
    _filled(_name, _strategy, _expr)


@register("interpolate", f"""WITH {SQL_GAPPY}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts, event_id) AS rn FROM ev),
k AS (SELECT *, CASE WHEN value IS NOT NULL THEN rn END AS kn FROM n),
f AS (SELECT *, last_value(value IGNORE NULLS) OVER {_BACK} AS pv, last_value(kn IGNORE NULLS) OVER {_BACK} AS pr, first_value(value IGNORE NULLS) OVER {_AHEAD} AS nv, first_value(kn IGNORE NULLS) OVER {_AHEAD} AS nr FROM k)
SELECT series, event_id, {rnd("CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (rn - pr) / (nr - pr) END", "value")} FROM f""")
def interpolate(spark, sf_dir):
    return out(clean.fill_missing(gappy(spark, sf_dir), EVENTS, "interpolate"), ["series", "event_id"], ["value"])


_LINES = Series((), "l_shipdate", ("l_orderkey", "l_linenumber"))


def _lines(spark, sf_dir):
    """Order lines of which a few are far off."""
    far = F.when(F.col("l_orderkey") % 97 == 0, F.col("l_extendedprice") * 10).otherwise(F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", far.alias("price"), F.when(F.col("l_orderkey") % 89 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("quantity"))


_SQL_LINES = "li AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 10 ELSE l_extendedprice END AS price, CASE WHEN l_orderkey % 89 <> 0 THEN l_quantity END AS quantity FROM lineitem)"
_SQL_FENCE = "SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {t}"


@register("outliers_iqr", f"""WITH {_SQL_LINES}, a AS ({_SQL_FENCE.format(c="price", t="li")}), b AS ({_SQL_FENCE.format(c="quantity", t="li")})
SELECT l_orderkey, l_linenumber, coalesce(price < a.lo OR price > a.hi, false) OR coalesce(quantity < b.lo OR quantity > b.hi, false) AS is_outlier FROM li, a, b""")
def outliers_iqr(spark, sf_dir):
    return clean.detect_outliers(_lines(spark, sf_dir), _LINES, ["price", "quantity"]).select("l_orderkey", "l_linenumber", "is_outlier")


@register("outliers_zscore", f"""WITH {_SQL_LINES}, a AS (SELECT avg(price) AS m, stddev_samp(price) AS s, avg(quantity) AS n, stddev_samp(quantity) AS t FROM li)
SELECT l_orderkey, l_linenumber, coalesce(abs((price - m) / s) > 3, false) OR coalesce(abs((quantity - n) / t) > 3, false) AS is_outlier FROM li, a""")
def outliers_zscore(spark, sf_dir):
    return clean.detect_outliers(_lines(spark, sf_dir), _LINES, ["price", "quantity"], "zscore", 3.0).select("l_orderkey", "l_linenumber", "is_outlier")


@register("winsorize", f"""WITH {_SQL_LINES}, a AS ({_SQL_FENCE.format(c="price", t="li")}), b AS ({_SQL_FENCE.format(c="quantity", t="li")})
SELECT l_orderkey, l_linenumber, {rnd("CASE WHEN price IS NOT NULL THEN least(greatest(price, a.lo), a.hi) END", "price")}, {rnd("CASE WHEN quantity IS NOT NULL THEN least(greatest(quantity, b.lo), b.hi) END", "quantity")} FROM li, a, b""")
def winsorize(spark, sf_dir):
    return out(clean.winsorize(_lines(spark, sf_dir), _LINES, ["price", "quantity"]), ["l_orderkey", "l_linenumber"], ["price", "quantity"])


@register("remove_outliers", f"""WITH {_SQL_LINES}, a AS ({_SQL_FENCE.format(c="price", t="li")}), x AS (SELECT li.* FROM li, a WHERE price IS NULL OR price BETWEEN a.lo AND a.hi),
b AS ({_SQL_FENCE.format(c="quantity", t="x")}) SELECT l_orderkey, l_linenumber, {rnd("price", "price")}, {rnd("quantity", "quantity")} FROM x, b WHERE quantity IS NULL OR quantity BETWEEN b.lo AND b.hi""")
def remove_outliers(spark, sf_dir):
    return out(clean.remove_outliers(_lines(spark, sf_dir), _LINES, ["price", "quantity"]), ["l_orderkey", "l_linenumber"], ["price", "quantity"])


@register("drop_missing", f"WITH {SQL_GAPPY} SELECT series, event_id, {rnd('value', 'value')} FROM ev WHERE value IS NOT NULL")
def drop_missing(spark, sf_dir):
    return out(gappy(spark, sf_dir).na.drop(), ["series", "event_id"], ["value"])


@register("missing_summary", f"WITH {SQL_GAPPY} SELECT count(*) AS \"rows\", count(*) - count(series) AS missing_series, count(*) - count(event_id) AS missing_event_id, count(*) - count(value) AS missing_value FROM ev")
def missing_summary(spark, sf_dir):
    return clean.missing_summary(gappy(spark, sf_dir).drop("ts"))


@register("label_encode", "SELECT event_id, CASE s WHEN -1 THEN 0 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS code FROM (SELECT event_id, CAST(event_id % 4 AS INTEGER) - 1 AS s FROM events)")
def label_encode(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", clean.encode_labels((F.col("event_id") % 4 - 1).cast("int")).alias("code"))


@register("join_macro_ffill", f"""WITH {SQL_DAILY}, m AS (SELECT l_shipdate AS ts, avg(l_extendedprice) AS macro FROM lineitem WHERE day(l_shipdate) <= 3 GROUP BY 1),
j AS (SELECT bars.series, bars.ts, close, macro FROM bars LEFT JOIN m USING (ts))
SELECT series, {TS}, {rnd("close", "close")}, {rnd("last_value(macro IGNORE NULLS) OVER (PARTITION BY series ORDER BY j.ts ROWS UNBOUNDED PRECEDING)", "macro")} FROM j""")
def join_macro_ffill(spark, sf_dir):
    macro = table(spark, sf_dir, "lineitem").where(F.dayofmonth("l_shipdate") <= 3).groupBy(F.col("l_shipdate").cast("timestamp").alias("ts")).agg(F.avg("l_extendedprice").alias("macro"))
    return out(resample.left_join_fill(bars_daily(spark, sf_dir).select("series", "ts", "close"), macro, BARS), ["series", "ts"], ["close", "macro"])


def _frames(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("quantity"))
    return {"orders": o, "lines": li}


def _aligned(method: str, low: str, high: str):
    sql = f"""WITH a AS (SELECT date_trunc('day', o_orderdate) AS ts, avg(o_totalprice) AS p FROM orders GROUP BY 1), b AS (SELECT date_trunc('day', l_shipdate) AS ts, avg(l_quantity) AS q FROM lineitem GROUP BY 1),
    g AS (SELECT unnest(generate_series({low}((SELECT min(ts) FROM a), (SELECT min(ts) FROM b)), {high}((SELECT max(ts) FROM a), (SELECT max(ts) FROM b)), INTERVAL 1 DAY)) AS ts)
    SELECT strftime(g.ts, '%Y-%m-%d %H:%M:%S') AS ts, {rnd("p", "orders_price")}, {rnd("q", "lines_quantity")} FROM g LEFT JOIN a ON g.ts = a.ts LEFT JOIN b ON g.ts = b.ts"""

    @register(f"align_{method}", sql)
    def query(spark, sf_dir):
        return out(resample.align(_frames(spark, sf_dir), "ts", "D", method), ["ts"], ["orders_price", "lines_quantity"])


_aligned("outer", "least", "greatest")
_aligned("inner", "greatest", "least")


@register("intersect_features", f"WITH {SQL_BARS}, t AS (SELECT series, ts, close FROM bars WHERE hour(ts) % 2 = 0) SELECT series, strftime(bars.ts, '%Y-%m-%d %H:%M:%S') AS ts, {rnd('open', 'open')}, {rnd('t.close', 'target')} FROM bars JOIN t USING (series, ts)")
def intersect_features(spark, sf_dir):
    bars = bars_hourly(spark, sf_dir)
    target = bars.where(F.hour("ts") % 2 == 0).select("series", "ts", F.col("close").alias("target"))
    return out(resample.intersect(bars.select("series", "ts", "open"), target, ["series", "ts"]), ["series", "ts"], ["open", "target"])


def _metric_sql(t: str, columns: list[tuple[str, bool]]) -> str:
    parts = []
    for c, numeric in columns:
        stats = ", ".join(f"{rnd(f'coalesce(CAST({f}({c}) AS DOUBLE), 0)', n)}" if numeric else f"CAST(NULL AS DOUBLE) AS {n}" for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_samp")))
        parts.append(f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\", {stats} FROM {t}")
    return " UNION ALL ".join(parts)


@register("quality_metrics", f"WITH {SQL_GAPPY} {_metric_sql('ev', [('series', False), ('event_id', True), ('value', True)])}")
def quality_metrics(spark, sf_dir):
    return out(quality.quality_metrics(gappy(spark, sf_dir), ["series", "event_id", "value"]), ["column", "rows", "missing", "distinct"], ["min", "max", "mean", "std"])


@register("quality_issues", """WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN value END AS sparse, event_type, value FROM events),
m AS (SELECT count(*) AS n, count(*) - count(sparse) AS m1, count(DISTINCT sparse) AS d1, count(*) - count(event_type) AS m2, count(DISTINCT event_type) AS d2, count(*) - count(value) AS m3, count(DISTINCT value) AS d3 FROM e),
l AS (SELECT 'sparse' AS "column", n, m1 AS m, d1 AS d FROM m UNION ALL SELECT 'event_type', n, m2, d2 FROM m UNION ALL SELECT 'value', n, m3, d3 FROM m)
SELECT "column", 'missing' AS issue FROM l WHERE n > 0 AND m / n > 0.3 UNION ALL SELECT "column", 'few_distinct' FROM l WHERE n > 10 AND d / n < 0.01""")
def quality_issues(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("sparse"), "event_type", "value")
    return quality.quality_issues(e)


def _psi_sql(column: str, split: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", (SELECT CASE WHEN b > a AND n0 > 0 AND n1 > 0 THEN sum((s1 - s0) * ln(s1 / s0)) ELSE 0 END FROM (
      SELECT a, b, n0, n1, CASE WHEN coalesce(c0, 0) = 0 THEN 1e-10 ELSE c0 / n0 END AS s0, CASE WHEN coalesce(c1, 0) = 0 THEN 1e-10 ELSE c1 / n1 END AS s1 FROM
        (SELECT min({column}) AS a, max({column}) AS b, count(*) FILTER (WHERE {split}) AS n0, count(*) FILTER (WHERE NOT {split}) AS n1 FROM {source}) AS k,
        (SELECT unnest(range(10)) AS bin) AS g LEFT JOIN (SELECT least(floor(({column} - a) / ((b - a) / 10)), 9) AS bin, count(*) FILTER (WHERE {split}) AS c0, count(*) FILTER (WHERE NOT {split}) AS c1 FROM {source}, (SELECT min({column}) AS a, max({column}) AS b FROM {source}) GROUP BY 1) AS h ON g.bin = h.bin
    ) GROUP BY a, b, n0, n1) AS psi"""


def _halves(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_orderkey")
    shifted = F.when(F.col("l_orderkey") % 2 == 1, F.col("l_quantity") * 1.5).otherwise(F.col("l_quantity"))
    li = li.withColumn("l_quantity", shifted)
    return li.where("l_orderkey % 2 = 0"), li.where("l_orderkey % 2 = 1")


_SQL_HALVES = "li AS (SELECT l_extendedprice, CASE WHEN l_orderkey % 2 = 1 THEN l_quantity * 1.5 ELSE l_quantity END AS l_quantity, l_discount, l_orderkey FROM lineitem)"
_PSI_COLUMNS = ["l_extendedprice", "l_quantity", "l_discount"]
_PSI_ALL = " UNION ALL ".join(_psi_sql(c, "l_orderkey % 2 = 0", "li") for c in _PSI_COLUMNS)


@register("psi", f'WITH {_SQL_HALVES}, x AS ({_PSI_ALL}) SELECT "column", {rnd("psi", "psi")} FROM x')
def psi(spark, sf_dir):
    return out(quality.population_stability(*_halves(spark, sf_dir), _PSI_COLUMNS), ["column"], ["psi"])


@register("distribution_shift", f'WITH {_SQL_HALVES}, x AS ({_PSI_ALL}) SELECT "column", {rnd("psi", "psi")}, psi >= 0.25 AS shifted FROM x')
def distribution_shift(spark, sf_dir):
    return out(quality.distribution_shift(*_halves(spark, sf_dir), _PSI_COLUMNS), ["column"], ["psi", "shifted"])


@register("value_counts", f"SELECT o_orderpriority, count(*) AS n, {rnd('count(*) / sum(count(*)) OVER ()', 'share')} FROM orders GROUP BY 1")
def value_counts(spark, sf_dir):
    return out(quality.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority", share=True), ["o_orderpriority", "n"], ["share"])


_CORR = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@register("corr_topk_pearson", f"""WITH c AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS correlation FROM lineitem" for c in _CORR)})
SELECT feature, {rnd("correlation", "correlation")} FROM c ORDER BY c.correlation DESC, feature LIMIT 3""")
def corr_topk_pearson(spark, sf_dir):
    return out(top_correlated(table(spark, sf_dir, "lineitem"), "l_extendedprice", _CORR, 3), ["feature"], ["correlation"])


_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in [*_CORR, "l_extendedprice"])


@register("corr_topk_spearman", f"""WITH k AS (SELECT {_RANKS} FROM lineitem), c AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS correlation FROM k" for c in _CORR)})
SELECT feature, {rnd("correlation", "correlation")} FROM c ORDER BY c.correlation DESC, feature LIMIT 3""")
def corr_topk_spearman(spark, sf_dir):
    return out(top_correlated(table(spark, sf_dir, "lineitem"), "l_extendedprice", _CORR, 3, "spearman"), ["feature"], ["correlation"])


_PARTS = ["p_size", "p_retailprice"]
_PAIR = "SELECT '{c}' AS feature, abs(sum(sign(CAST(a.{c} AS DOUBLE) - b.{c}) * sign(CAST(a.p_partkey % 977 AS DOUBLE) - b.p_partkey % 977)) / sqrt(CAST(count(*) FILTER (WHERE a.{c} <> b.{c}) AS DOUBLE) * count(*) FILTER (WHERE a.p_partkey % 977 <> b.p_partkey % 977))) AS correlation FROM part a, part b"


@register("corr_topk_kendall", f"WITH c AS ({' UNION ALL '.join(_PAIR.format(c=c) for c in _PARTS)}) SELECT feature, {rnd('correlation', 'correlation')} FROM c")
def corr_topk_kendall(spark, sf_dir):
    """Counted by ranges of values; the oracle compares all pairs of rows."""
    p = table(spark, sf_dir, "part").select(*_PARTS, (F.col("p_partkey") % 977).alias("k"))
    return out(top_correlated(p, "k", _PARTS, 2, "kendall"), ["feature"], ["correlation"])


@register("profile_summary", f"""WITH e AS (SELECT event_type, user_id % 10 AS u, CASE WHEN event_id % 7 <> 0 THEN CAST(floor(value / 10) AS BIGINT) END AS v FROM events),
g AS (SELECT event_type, u, v, count(*) AS n FROM e GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS "rows", CAST(sum(CASE WHEN v IS NULL THEN n ELSE 0 END) AS BIGINT) AS missing_cells, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, 3 AS columns, 2 AS numeric_columns, {rnd("sum(CASE WHEN v IS NULL THEN n ELSE 0 END) / (sum(n) * 3)", "missing_share")} FROM g""")
def profile_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("u"), F.when(F.col("event_id") % 7 != 0, F.floor(F.col("value") / 10)).alias("v"))
    s = quality.profile(e)["summary"]
    return s.select("rows", "missing_cells", "duplicate_rows", "columns", "numeric_columns", r("missing_share").alias("missing_share"))
