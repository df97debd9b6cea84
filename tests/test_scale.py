"""Long series, exact order statistics and models against plain ways on small tables."""

import datetime as dt
import itertools
import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.functions import ranks
from tidewright.functions.ewm import ewm_mean, ewm_mean_gaps
from tidewright.functions.series import Series, running, sliced
from tidewright.operators import bins, clean, features, indicators, metrics, models, splits, trading
from tidewright.operators.ensemble import Ensemble, load_model, save_model

S = Series(("series",), "ts")
CUT = replace(S, longest=40)


@pytest.fixture(scope="module")
def bars(spark):
    """A long series in bursts, a short one and one without a key, with gaps."""
    rng = np.random.default_rng(3)
    rows = []
    for key, n in (("a", 230), (None, 90), ("b", 5)):
        t = dt.datetime(2024, 1, 1)
        for i in range(n):
            t += dt.timedelta(seconds=int(rng.integers(1, 5)) * (3600 if rng.random() < 0.1 else 1))
            c = float(rng.uniform(5, 10))
            rows.append((key, t, c, c + 1, c - 1, c + 0.5, float(rng.integers(1, 9)), None if rng.random() < 0.3 else float(rng.normal()), str(rng.integers(0, 2))))
    return spark.createDataFrame(rows, "series string, ts timestamp, close double, high double, low double, open double, volume double, gap double, kind string").cache()


WAYS = {
    "ffill": lambda d, s: clean.fill_missing(d, s, "forward_fill", ["gap"]),
    "interpolate": lambda d, s: clean.fill_missing(d, s, "interpolate", ["gap"]),
    "rsi": lambda d, s: indicators.rsi(d, s),
    "obv": lambda d, s: indicators.obv(d, s),
    "regimes": lambda d, s: indicators.regime_features(d, s),
    "gaps": lambda d, s: ewm_mean_gaps(d, s, "m", "gap", 3, block=30 if s.longest == 40 else 10_000),
    "ahead": lambda d, s: features.with_forward_return(d, s, "close", 4),
    "returns": lambda d, s: features.price_returns(d, s, ["gap"], (1, 3), log=False),
    "folds": lambda d, s: splits.whole_folds(d, s, "rolling", 0.3, 0.1, 0.1),
    "support": lambda d, s: splits.support_set(d, s, 9, "volatility", "close", 1.0, period=5),
    "trading": lambda d, s: metrics.trading_metrics(d.withColumn("r", F.col("close") / 100 - 0.07), s, "r", "kind"),
    "backtest": lambda d, s: trading.backtest(d, d.where("kind = '1'").withColumn("signal_type", F.lit("buy")), s, "close"),
    "aggregates": lambda d, s: running(d, s, {"a": ("first", F.col("gap")), "b": ("min", F.col("gap")), "c": ("max", F.col("gap")), "d": ("sum", F.col("gap")), "e": ("product", F.col("close") / 7)}),
}


@pytest.mark.parametrize("name", sorted(WAYS))
def test_long_series_equal_short_ones(bars, name):
    """Series cut into slices and blocks give what one window a series gives."""
    want, got = (WAYS[name](bars, s).toPandas() for s in (S, CUT))
    assert list(want.columns) == list(got.columns) and len(want) == len(got)
    keys = [c for c in ("series", "ts", "fold", "event_id") if c in want.columns]
    want, got = (x.sort_values(keys, kind="stable").reset_index(drop=True) for x in (want, got))
    for c in want.columns:
        if want[c].dtype.kind == "f":
            assert np.allclose(want[c], got[c], rtol=1e-9, atol=1e-9, equal_nan=True), c
        elif c != "metadata":
            assert [None if pd.isna(x) else x for x in want[c]] == [None if pd.isna(x) else x for x in got[c]], c


def test_slices_are_bounded(bars):
    rows, spec = sliced(bars, CUT)
    sizes = {(r.series, r["_slice"]): r.n for r in rows.groupBy("series", "_slice").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) > 6 and max(sizes.values()) <= 3 * 40 and spec.slice
    assert sliced(bars, S)[1].slice is None


def test_quantiles_and_areas_by_ranges(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(400) < 0.4, 3.0, rng.normal(size=400).round(2))
    df = spark.createDataFrame([("a" if i % 3 else None, float(v), int(rng.random() < 0.4)) for i, v in enumerate(x)], "k string, x double, y int").cache()
    pdf = df.toPandas()
    monkeypatch.setattr(ranks, "RANGE", 30)
    got = ranks.quantiles(df, [], ["x"], [0.0, 0.25, 1 / 3, 0.9]).first()
    assert np.allclose(list(got), np.quantile(x, [0.0, 0.25, 1 / 3, 0.9]))
    by = {r.k: r.x_q0 for r in ranks.quantiles(df, ["k"], ["x"], [0.5]).collect()}
    assert math.isclose(by["a"], pdf[pdf.k == "a"].x.median()) and math.isclose(by[None], pdf[pdf.k.isna()].x.median())
    pos, neg = pdf[pdf.y == 1].x.to_numpy(), pdf[pdf.y == 0].x.to_numpy()
    area = ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())
    assert math.isclose(metrics.roc_auc(df, "y", "x").first()[0], area)
    assert ranks.quantiles(df.where("x > 99"), [], ["x"], [0.5]).first()[0] is None
    assert metrics.roc_auc(df.where("y = 1"), "y", "x").first()[0] is None


@pytest.mark.parametrize("rows", [30, 10_000])
def test_rank_correlations(spark, monkeypatch, rows):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 30, 300) * (rng.random(300) < 0.6)
    y = (x + rng.integers(0, 12, 300)) * (rng.random(300) < 0.8)
    df = spark.createDataFrame([(None if i % 29 == 0 else float(a), float(b), 1.0) for i, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y double, c double")
    monkeypatch.setattr(bins, "KENDALL_RANGE", rows)
    monkeypatch.setattr(ranks, "RANGE", rows)
    pair = df.toPandas()[["x", "y"]].dropna()
    kendall = {r.feature: r.correlation for r in bins.correlation_with(df, "y", ["x", "c"], "kendall").collect()}
    a, b = pair.x.to_numpy(), pair.y.to_numpy()
    dx, dy = np.sign(a[:, None] - a[None]), np.sign(b[:, None] - b[None])
    assert math.isclose(kendall["x"], (dx * dy).sum() / math.sqrt((dx != 0).sum() * (dy != 0).sum())) and kendall["c"] is None
    spearman = {r.feature: r.correlation for r in bins.correlation_with(df, "y", ["x", "c"], "spearman").collect()}
    assert math.isclose(spearman["x"], pair.x.rank().corr(pair.y.rank())) and spearman["c"] is None


def test_outlier_removal_reads_its_source_once(spark, sf_dir):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    for spec in (Series((), "l_shipdate"), Series(("l_returnflag",), "l_shipdate")):
        plan = clean.remove_outliers(li, spec, names)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_comment") == 0 and plan.count("Relation [l_orderkey") == 1


def test_names_that_are_taken(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int").toDF("a", "a", "a_1", "a")
    assert clean.dedupe_names(df).columns == ["a", "a_2", "a_1", "a_3"]


def test_shapley_values(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3)).round(3)
    y = x[:, 0] * 2 + (x[:, 1] > 0) * x[:, 2]
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double").coalesce(1)
    m = models.Trees(["a", "b", "c"], trees=3, depth=3).fit(df, "y")
    got = models.shap(m.transform(df), m).toPandas()
    assert np.allclose(got[["shap_a", "shap_b", "shap_c", "shap_base"]].sum(axis=1), got["prediction"])
    leaves = [v for t, w in zip(m._forests()[0].trees, m._forests()[0].treeWeights, strict=True) for v in models._leaves(t._call_java("rootNode"), float(w))]

    def value(row, known):
        return sum(v.value * math.prod((v.low.get(k, -math.inf) < row[k] <= v.high.get(k, math.inf)) if k in known else s for k, s in v.share.items()) for v in leaves)

    for i in range(5):
        for k in range(3):
            rest = [j for j in range(3) if j != k]
            told = sum(math.factorial(n) * math.factorial(2 - n) / 6 * (value(x[i], {*c, k}) - value(x[i], {*c})) for n in range(3) for c in itertools.combinations(rest, n))
            assert math.isclose(told, got.iloc[i][f"shap_{'abc'[k]}"], abs_tol=1e-9)


def test_models_are_stored(spark, tmp_path):
    rows = [(float(i % 7), float(i % 3), i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    parts = [models.GaussianNB(["a", "b"]).fit(df, "y"), models.Trees(["a", "b"], "multi", trees=2, depth=2).fit(df, "y")]
    e = Ensemble(parts, "voting")
    save_model(e, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    want, got = (m.transform(df).select("a", "b", "prediction", "probability").collect() for m in (e, again))
    assert want == got and [r.prediction for r in want] == [r[2] for r in rows] and len(again.importance()) == 2
    with pytest.raises(TypeError):
        save_model(object(), str(tmp_path / "x"))
    with pytest.raises(ValueError):
        Ensemble(parts, "magic")
    with pytest.raises(ValueError):
        Ensemble(parts, "weighted_average", [1.0])


def test_one_estimator_of_ones_own(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1) + dt.timedelta(i), float(i), 2.0 * i) for i in range(50)], "series string, ts timestamp, x double, y double")
    own = models.InContext(["x"], support=10, estimator=lambda rows, label: models.SequenceRegressor(1, 1).fit(rows.select(F.array(F.array("x")).alias("sequence"), F.col(label).alias("target")))).fit(df, "y")
    told = own.transform(df.withColumn("sequence", F.array(F.array("x"))))
    assert told.where("abs(prediction - y) > 1e-6").count() == 0
    folds = models.walk_models(df, S, "y", lambda rows: models.GaussianNB(["x"]).fit(rows.withColumn("l", (F.col("x") % 2).cast("int")), "l"), 20, rounds=2)
    assert folds.count() == 14 and folds.select("fold").distinct().count() == 2
    walked = models.walk_forward(df.withColumn("twice", F.col("x") * 2), S, ["x", "twice"], "y", start=30, query=7, support=12)
    assert walked.count() == 20 and walked.where("abs(prediction - y) > 1e-5").count() == 0


def test_written_tables_are_removed(spark):
    from tidewright.session import clear_shared, staged
    from tidewright.sources import files

    path = staged(spark.range(3)).inputFiles()[0].rsplit("/", 1)[0]
    assert files.exists(path) and clear_shared(spark) >= 1 and not files.exists(path)


def test_ewm_of_rows_without_values(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1) + dt.timedelta(i), None) for i in range(3)], "series string, ts timestamp, x double")
    assert [r.m for r in ewm_mean(df, S, {"m": "x"}, 3).collect()] == [None] * 3
    assert [r.m for r in ewm_mean_gaps(df, S, "m", "x", 3).collect()] == [None] * 3
