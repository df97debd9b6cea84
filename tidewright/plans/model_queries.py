"""Queries of models: trees, sequences, in-context and walk-forward regression, importances, ensembles, recorded runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import metrics, models, splits
from tidewright.operators.ensemble import Ensemble, compare_runs, load_from_runs, save_model
from tidewright.operators.features import lag_features, with_forward_return, with_log_return
from tidewright.plans.catalog import register
from tidewright.plans.inputs import BARS, SQL_BARS, TS, W, bars_hourly, out, rnd, table
from tidewright.session import shared_dir
from tidewright.utils.operations import Tracker

K = ["series", "ts"]
_RET = f"CASE WHEN close / NULLIF(lag(close) OVER ({W}), 0) > 0 THEN ln(close / lag(close) OVER ({W})) END"
#: Rows that a model learns from: the return, two lags and what follows, numbered within their series.
_SQL_TRAIN = f"""{SQL_BARS}, r AS (SELECT series, ts, close, {_RET} AS ret FROM bars),
l AS (SELECT series, ts, ret, lag(ret) OVER ({W}) AS l1, lag(ret, 2) OVER ({W}) AS l2, lead(close) OVER ({W}) / NULLIF(close, 0) - 1 AS y FROM r),
t AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n FROM l WHERE ret IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL AND y IS NOT NULL)"""
_INPUTS = ["ret", "ret_lag_1", "ret_lag_2"]


def _training(spark, sf_dir):
    b = lag_features(with_log_return(bars_hourly(spark, sf_dir), BARS, "close", name="ret"), BARS, ["ret"], (1, 2))
    return with_forward_return(b, BARS, "close").na.drop().select("series", "ts", "ret", "ret_lag_1", "ret_lag_2", "target")


@register("gbt_forecast")
def gbt_forecast(spark, sf_dir):
    """Boosted trees on the first rows of each series, told on the last."""
    d = splits.sequential_split(_training(spark, sf_dir), BARS, 0.8, 0.0, 0.2)
    model = models.Trees(_INPUTS, trees=10, depth=3).fit(d.where("split = 'train'"), "target")
    return out(model.transform(d.where("split = 'test'")), K, ["target", "prediction"])


_STUMP = """WITH x AS (SELECT l_orderkey, l_linenumber, l_discount AS a, l_tax AS b, 100 * l_discount + l_quantity AS y FROM lineitem),
v AS (SELECT a, count(*) AS n, sum(y) AS s FROM x GROUP BY a), c AS (SELECT a, sum(n) OVER (ORDER BY a) AS n, sum(s) OVER (ORDER BY a) AS s, sum(n) OVER () AS m, sum(s) OVER () AS u FROM v),
e AS (SELECT arg_max(a, s * s / n + (u - s) * (u - s) / (m - n)) AS cut FROM c WHERE n < m),
p AS (SELECT avg(y) FILTER (WHERE a <= cut) AS lo, avg(y) FILTER (WHERE a > cut) AS hi, avg(y) AS base, any_value(cut) AS cut FROM x, e)"""


def _stump(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("y", 100 * F.col("l_discount") + F.col("l_quantity"))
    return li, models.Trees(["l_discount", "l_tax"], trees=1, depth=1).fit(li, "y")


@register("gbt_stump", f"{_STUMP} SELECT l_orderkey, l_linenumber, {rnd('CASE WHEN a <= cut THEN lo ELSE hi END', 'prediction')} FROM x, p")
def gbt_stump(spark, sf_dir):
    """One boosted tree of one split, whose best cut SQL can find as well."""
    li, model = _stump(spark, sf_dir)
    return out(model.transform(li), ["l_orderkey", "l_linenumber"], ["prediction"])


@register("shap_stump", f"{_STUMP} SELECT l_orderkey, l_linenumber, {rnd('CASE WHEN a <= cut THEN lo ELSE hi END - base', 'shap_l_discount')}, 0.0::DOUBLE AS shap_l_tax, {rnd('base', 'shap_base')} FROM x, p")
def shap_stump(spark, sf_dir):
    li, model = _stump(spark, sf_dir)
    return out(models.shap(li, model), ["l_orderkey", "l_linenumber"], ["shap_l_discount", "shap_l_tax", "shap_base"])


@register("gbt_importance", "SELECT 'l_discount' AS feature, 1.0::DOUBLE AS importance UNION ALL SELECT 'l_tax', 0.0")
def gbt_importance(spark, sf_dir):
    """A split's gain goes to its feature; one that no split takes has none."""
    _, model = _stump(spark, sf_dir)
    return out(spark.createDataFrame(list(model.importance().items()), "feature string, importance double"), ["feature"], ["importance"])


@register("gbt_multi", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber % 3 AS INTEGER) AS prediction, true AS surest FROM lineitem")
def gbt_multi(spark, sf_dir):
    """Boosted trees of three classes that a column decides."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).cast("double").alias("y"))
    told = models.Trees(["l_linenumber"], "multi", trees=2, depth=4).fit(li, "y").transform(li)
    surest = F.array_position("probability", F.array_max("probability")) - 1 == F.col("prediction")
    return told.select("l_orderkey", "l_linenumber", F.col("prediction").cast("int").alias("prediction"), surest.alias("surest"))


_SEQ = f"""WITH {SQL_BARS}, s AS (SELECT series, ts, lag(close, 2) OVER ({W}) AS a, lag(close) OVER ({W}) AS b, close AS y FROM bars), u AS (SELECT * FROM s WHERE a IS NOT NULL),
m AS (SELECT var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM u),
w AS (SELECT (cay * vb - cby * cab) / (va * vb - cab * cab) AS wa, (cby * va - cay * cab) / (va * vb - cab * cab) AS wb, ma, mb, my FROM m)"""


@register("sequence_regression", f"{_SEQ} SELECT series, {TS}, {rnd('y', 'target', 4)}, {rnd('my + wa * (a - ma) + wb * (b - mb)', 'prediction', 4)} FROM u, w")
def sequence_regression(spark, sf_dir):
    """A linear sequence regressor of two steps, told for each row with two rows before it."""
    s = splits.sequences(bars_hourly(spark, sf_dir), BARS, ["close"], "close", 2)
    return out(models.SequenceRegressor(2, 1).fit(s).transform(s), K, ["target", "prediction"], 4)


@register("sequence_boosted")
def sequence_boosted(spark, sf_dir):
    """A boosted sequence regressor that stops early."""
    s = splits.sequences(bars_hourly(spark, sf_dir), BARS, ["close", "open"], "close", 3)
    return out(models.SequenceRegressor(3, 2, "boosted", trees=8, depth=3).fit(s, "target", BARS).transform(s), K, ["target", "prediction"])


@register("walk_forward", f"""WITH {_SQL_TRAIN}, p AS (SELECT *, CAST(floor(n * 0.8) AS BIGINT) AS first FROM t), b AS (SELECT series, first, CAST(unnest(range(0, (n - 1 - first) // 7 + 1)) AS BIGINT) AS fold FROM (SELECT DISTINCT series, n, first FROM p)),
w AS (SELECT b.series, b.fold, regr_slope(p.y, p.ret) AS slope, regr_intercept(p.y, p.ret) AS start FROM b JOIN p ON p.series = b.series AND p.pos < b.first + 7 * b.fold AND p.pos >= b.first + 7 * b.fold - 60 GROUP BY 1, 2)
SELECT p.series, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(w.fold AS INTEGER) AS fold, {rnd('start + slope * ret', 'prediction', 4)} FROM p JOIN w ON p.series = w.series AND w.fold = (p.pos - p.first) // 7 WHERE p.pos >= p.first""")
def walk_forward(spark, sf_dir):
    """Every block of seven rows in the last fifth of each series, by the sixty rows before it."""
    return out(models.walk_forward(_training(spark, sf_dir), BARS, ["ret"], "target"), [*K, "fold"], ["prediction"], 4)


_FAR = "round(pow((q.ret - s.ret) / CASE WHEN m.sa > 0 THEN m.sa ELSE 1 END, 2) + pow((q.l1 - s.l1) / CASE WHEN m.sb > 0 THEN m.sb ELSE 1 END, 2), 9)"


@register("in_context", f"""WITH {_SQL_TRAIN}, h AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS k FROM t WHERE pos < floor(CAST(n AS DOUBLE) * 0.8)), s AS (SELECT * FROM h WHERE k <= 60),
m AS (SELECT series, stddev_pop(ret) AS sa, stddev_pop(l1) AS sb FROM s GROUP BY 1),
d AS (SELECT q.series, q.ts, s.y, row_number() OVER (PARTITION BY q.series, q.ts ORDER BY {_FAR}, s.ts DESC) AS k FROM t q JOIN s ON q.series = s.series JOIN m ON q.series = m.series WHERE q.pos >= floor(CAST(q.n AS DOUBLE) * 0.8))
SELECT series, {TS}, {rnd('avg(y)', 'prediction')} FROM d WHERE k <= 5 GROUP BY series, ts""")
def in_context(spark, sf_dir):
    """The nearest of each series' last training rows stand in for a pre-trained model."""
    d = splits.sequential_split(_training(spark, sf_dir), BARS, 0.8, 0.0, 0.2)
    model = models.InContext(["ret", "ret_lag_1"]).fit(d.where("split = 'train'").drop("split"), "target")
    return out(model.transform(d.where("split = 'test'").drop("split")), K, ["prediction"])


#: Gaussian naive Bayes on orders: f(label) of one feature a, or of two.
_ORDERS = "o AS (SELECT o_orderkey, o_orderpriority, o_totalprice AS a, CAST(o_custkey AS DOUBLE) AS b, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders)"


def _stats(name: str, columns: list[str]) -> str:
    widest = f"greatest({', '.join(f'var_pop({c})' for c in columns)})" if len(columns) > 1 else f"var_pop({columns[0]})"
    return f"{name} AS (SELECT y AS label, count(*) / CAST((SELECT count(*) FROM o) AS DOUBLE) AS p, " + ", ".join(f"avg({c}) AS m{c}, var_pop({c}) + 1e-9 * (SELECT {widest} FROM o) AS v{c}" for c in columns) + " FROM o GROUP BY y)"


def _score(t: str, columns: list[str]) -> str:
    return f"ln({t}.p)" + "".join(f" - 0.5 * ln(2 * pi() * {t}.v{c}) - pow({c} - {t}.m{c}, 2) / (2 * {t}.v{c})" for c in columns)


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumns({"y": F.expr("CAST(o_orderstatus = 'F' AS INT)"), "custkey": F.col("o_custkey").cast("double")})


_NB2 = ["o_totalprice", "custkey"]
_MIXED = "CASE WHEN f = {i} THEN coalesce(lead({c}) OVER w, first_value({c}) OVER w) ELSE {c} END AS {c}"


@register("permutation_importance", f"""WITH {_ORDERS}, {_stats('st', ['a', 'b'])}, r AS (SELECT unnest([0, 1]) AS f), k AS (SELECT unnest([0, 1]) AS k),
m AS (SELECT o_orderkey, y, f, k, {_MIXED.format(i=0, c='a')}, {_MIXED.format(i=1, c='b')} FROM o, r, k WINDOW w AS (PARTITION BY f, k ORDER BY md5('42|' || k || '|' || f || '|' || o_orderkey)) UNION ALL SELECT o_orderkey, y, -1, 0, a, b FROM o),
t AS (SELECT f, k, y, {_score('z', ['a', 'b'])} AS s0, {_score('u', ['a', 'b'])} AS s1 FROM m, (SELECT * FROM st WHERE label = 0) z, (SELECT * FROM st WHERE label = 1) u),
g AS (SELECT f, k, avg(CAST((CASE WHEN s0 >= s1 THEN 0 ELSE 1 END) = y AS DOUBLE)) AS s FROM t GROUP BY 1, 2), d AS (SELECT f, (SELECT s FROM g WHERE f = -1) - s AS d FROM g WHERE f >= 0)
SELECT CASE f WHEN 0 THEN 'o_totalprice' ELSE 'custkey' END AS feature, {rnd('avg(d)', 'importance')}, {rnd('stddev_pop(d)', 'deviation')} FROM d GROUP BY f""")
def permutation_importance(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", *_NB2, "y")
    nb = models.GaussianNB(_NB2).fit(o, "y")
    return out(models.permutation_importance(o, nb.transform, _NB2, "y", ["o_orderkey"], repeats=2), ["feature"], ["importance", "deviation"])


_E = f"WITH {_ORDERS}, {_stats('sa', ['a'])}, {_stats('sb', ['b'])}, " + "x AS (SELECT o_orderkey, " + ", ".join(f"1 / (1 + exp({_score(f'{t}0', [c])} - ({_score(f'{t}1', [c])}))) AS {n}" for t, c, n in (("sa", "a", "pa"), ("sb", "b", "pb"))) + " FROM o, " + ", ".join(f"(SELECT * FROM {t} WHERE label = {k}) {t}{k}" for t in ("sa", "sb") for k in (0, 1)) + ")"


def _two(spark, sf_dir, method: str, weights=None):
    o = _orders(spark, sf_dir).select("o_orderkey", *_NB2, "y")
    return o, Ensemble([models.GaussianNB([c]) for c in _NB2], method, weights, [{"n": 1.0, "loss": 0.5}, {"n": 2.0}]).fit(o, "y")


@register("ensemble_models", f"{_E} SELECT o_orderkey, {rnd('0.75 * CAST(pa > 0.5 AS INTEGER) + 0.25 * CAST(pb > 0.5 AS INTEGER)', 'prediction')}, {rnd('0.75 * pa + 0.25 * pb', 'probability_1')} FROM x")
def ensemble_models(spark, sf_dir):
    """Two classifiers weighted three to one; weights of 3 and 1 are made to add up to 1."""
    o, e = _two(spark, sf_dir, "weighted_average", [3.0, 1.0])
    return out(e.transform(o).withColumn("probability_1", F.col("probability")[1]), ["o_orderkey"], ["prediction", "probability_1"])


@register("ensemble_models_voting", f"{_E} SELECT o_orderkey, CAST(CASE WHEN pa > 0.5 AND pb > 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS prediction, {rnd('(pa + pb) / 2', 'probability_1')} FROM x")
def ensemble_models_voting(spark, sf_dir):
    """A tie of two votes goes to the smaller label; probabilities are averaged."""
    o, e = _two(spark, sf_dir, "voting")
    return out(e.transform(o).withColumn("probability_1", F.col("probability")[1]), ["o_orderkey"], ["prediction", "probability_1"])


@register("ensemble_summary", "SELECT 'mean_loss' AS name, 0.5::DOUBLE AS value UNION ALL SELECT 'mean_n', 1.5 UNION ALL SELECT 'l_discount', 1.0 UNION ALL SELECT 'l_tax', 0.0")
def ensemble_summary(spark, sf_dir):
    """Mean metrics of the parts, and mean importances over the parts that have some."""
    _, stump = _stump(spark, sf_dir)
    e = Ensemble([stump, models.GaussianNB(["l_tax"])], metrics=[{"n": 1.0, "loss": 0.5}, {"n": 2.0}])
    return out(spark.createDataFrame(list((e.mean_metrics() | e.importance()).items()), "name string, value double"), ["name"], ["value"])


_RUN = f"WITH {_ORDERS}, {_stats('st', ['a', 'b'])}, x AS (SELECT o_orderkey, o_orderpriority, y, {_score('z', ['a', 'b'])} AS s0, {_score('u', ['a', 'b'])} AS s1 FROM o, (SELECT * FROM st WHERE label = 0) z, (SELECT * FROM st WHERE label = 1) u)"


def _recorded(spark, sf_dir):
    o = _orders(spark, sf_dir)
    tracker = Tracker(shared_dir(spark), "orders")
    with tracker.run("nb") as run_id:
        save_model(models.GaussianNB(_NB2).fit(o, "y"), f"{tracker.artifact_path(run_id)}/model")
    return o, tracker, run_id


@register("models_from_runs", f"{_RUN} SELECT o_orderkey, {rnd('1 / (1 + exp(s0 - s1))', 'probability_1')}, CASE WHEN s0 >= s1 THEN 0 ELSE 1 END AS prediction FROM x")
def models_from_runs(spark, sf_dir):
    """A model that a run has stored, loaded by its run; a run that is not known is left out."""
    o, tracker, run_id = _recorded(spark, sf_dir)
    found = load_from_runs(tracker, ["none", run_id])
    return out(found[run_id].transform(o), ["o_orderkey"], ["probability_1", "prediction"])


_REGIME_AGG = ", ".join([rnd("avg(CAST(y = g AS DOUBLE))", "accuracy"), rnd("coalesce(count(*) FILTER (WHERE y = 1 AND g = 1) / NULLIF(count(*) FILTER (WHERE g = 1), 0), 0)", "precision")])


@register("compare_runs", f"{_RUN}, d AS (SELECT o_orderpriority, y, CASE WHEN s0 >= s1 THEN 0 ELSE 1 END AS g FROM x) SELECT o_orderpriority, {_REGIME_AGG} FROM d GROUP BY 1")
def compare_models(spark, sf_dir):
    o, tracker, run_id = _recorded(spark, sf_dir)
    return out(compare_runs(o, tracker, [run_id], "y", "o_orderpriority"), ["o_orderpriority"], ["accuracy", "precision"])


@register("hyperparameter_search", "SELECT -1.0::DOUBLE AS loss")
def hyperparameter_search(spark, sf_dir):
    """A seeded search over two expanding folds of all bars, for a class that one column decides: some trial is always right."""
    b = bars_hourly(spark, sf_dir).withColumn("y", (F.hour("ts") >= 12).cast("double")).withColumn("hour", F.hour("ts").cast("double"))
    _, loss = models.search(b, BARS, ["hour", "volume"], "y", splits=2, trials=2, metric="accuracy", objective="binary", space={"trees": (3, 4), "depth": (3, 4), "subsample": (1.0, 1.0), "columns": (1.0, 1.0), "least": (1, 2)})
    return spark.createDataFrame([(float(loss),)], "loss double")


_P3 = ["l_discount * 5 + 0.1", "l_tax * 5 + 0.1", "l_quantity / 60"]
_SQL_P3 = "WITH d AS (SELECT CAST(l_linenumber % 3 AS INTEGER) AS y, " + ", ".join(f"{e} AS p{k}" for k, e in enumerate(_P3)) + " FROM lineitem)"
_AREA = "(sum(k) FILTER (WHERE y = {c}) - count(*) FILTER (WHERE y = {c}) * (count(*) FILTER (WHERE y = {c}) + 1) / 2) / (count(*) FILTER (WHERE y = {c}) * count(*) FILTER (WHERE y <> {c}))"
_AREAS = " + ".join(f"(SELECT {_AREA.format(c=c)} FROM (SELECT y, rank() OVER (ORDER BY p{c}) + (count(*) OVER (PARTITION BY p{c}) - 1) / 2 AS k FROM d))" for c in range(3))
_HELD = "greatest(least(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1 - 1e-15), 1e-15)"
_BRIER = " + ".join(f"avg(pow(p{c} - CAST(y = {c} AS DOUBLE), 2))" for c in range(3))


@register("multi_class_scores", f"{_SQL_P3} SELECT {rnd(f'({_BRIER}) / 3', 'brier_score')}, {rnd(f'avg(-ln({_HELD}))', 'log_loss')}, {rnd(f'({_AREAS}) / 3', 'roc_auc')} FROM d")
def multi_class_scores(spark, sf_dir):
    """Scores of three classes, each against the rest."""
    d = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).cast("int").alias("y"), *[F.expr(e).alias(f"p{k}") for k, e in enumerate(_P3)])
    names = ["p0", "p1", "p2"]
    return out(metrics.brier_and_log_loss_multi(d, "y", names).crossJoin(F.broadcast(metrics.roc_auc_ovr(d, "y", names))), [], ["brier_score", "log_loss", "roc_auc"])
