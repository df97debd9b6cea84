"""Metrics of classifiers, regressions and trading; calibration; robustness by regime."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.ranks import counted
from tidewright.functions.series import Series, running, sliced
from tidewright.operators.clean import safe_divide

YEAR = 252


def confusion(df: DataFrame, y: str, p: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, y: str, p: str, average: str = "weighted", by: tuple[str, ...] = ()) -> DataFrame:
    """accuracy, hit_rate, precision, recall and f1 from the confusion counts; a zero denominator gives 0.

    With two true classes or fewer, those of class 1; else averaged: macro, micro or weighted.
    """
    if average not in ("binary", "macro", "micro", "weighted"):
        raise ValueError(f"unknown average {average!r}")
    cells = confusion(df, y, p, by)
    keys = list(by)
    as_truth = cells.groupBy(*keys, F.col("y").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    as_guess = cells.groupBy(*keys, F.col("p").alias("label")).agg(F.sum("n").alias("guessed"))
    each = as_truth.join(as_guess, [*keys, "label"], "full_outer").fillna(0, ["support", "tp", "guessed"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    each = each.withColumns({"_p": ratio(F.col("tp"), F.col("guessed")), "_r": ratio(F.col("tp"), F.col("support"))})
    each = each.withColumn("_f", ratio(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")))
    total, hits, classes = F.sum("support"), F.sum("tp"), F.count(F.when(F.col("support") > 0, 1))
    averaged = {"macro": lambda c: F.avg(c), "weighted": lambda c: ratio(F.sum(F.col(c) * F.col("support")), total), "micro": lambda c: ratio(hits, total), "binary": lambda c: F.lit(None).cast("double")}[average]
    one = lambda c: F.coalesce(F.max(F.when(F.col("label") == 1, F.col(c))), F.lit(0.0))
    pick = lambda c: F.when(classes <= 2, one(c)).otherwise(averaged(c))
    aggs = [ratio(hits, total).alias("accuracy"), ratio(hits, total).alias("hit_rate"), pick("_p").alias("precision"), pick("_r").alias("recall"), pick("_f").alias("f1")]
    return each.groupBy(*keys).agg(*aggs) if keys else each.agg(*aggs)


def brier_and_log_loss(df: DataFrame, y: str, proba: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Of a binary label and the probability of class 1; probabilities are held off 0 and 1 for the logarithm."""
    eps = 1e-15
    q = F.greatest(F.least(F.col(proba), F.lit(1 - eps)), F.lit(eps))
    loss = F.when(F.col(y) == 1, -F.ln(q)).otherwise(-F.ln(1 - q))
    aggs = [F.avg(F.pow(F.col(proba) - F.col(y), 2)).alias("brier_score"), F.avg(loss).alias("log_loss")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def brier_and_log_loss_multi(df: DataFrame, y: str, probas: list[str]) -> DataFrame:
    """Of class codes 0.. and a probability column for each: one-versus-rest scores averaged over the classes, and log loss."""
    eps = 1e-15
    brier = sum((F.avg(F.pow(F.col(c) - (F.col(y) == k).cast("double"), 2)) for k, c in enumerate(probas)), F.lit(0.0)) / len(probas)
    own = F.lit(None).cast("double")
    for k, c in enumerate(probas):
        own = F.when(F.col(y) == k, F.col(c)).otherwise(own)
    return df.agg(brier.alias("brier_score"), F.avg(-F.ln(F.greatest(F.least(own, F.lit(1 - eps)), F.lit(eps)))).alias("log_loss"))


def roc_auc(df: DataFrame, y: str, proba: str) -> DataFrame:
    """Area under the ROC curve, from counts by distinct score: ties count half; missing with a single class."""
    rows = df.where(F.col(proba).isNotNull() & F.col(y).isNotNull()).select(F.col(proba).alias("value"), F.col(y).alias("y"))
    counts = counted(rows, [], {"pos": (F.col("y") == 1).cast("long"), "neg": (F.col("y") != 1).cast("long")})
    return counts.agg(_area().alias("roc_auc"))


def _area() -> Column:
    """The share of pairs of a positive and a negative row that are in order, from counts by score."""
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg"))


def roc_auc_ovr(df: DataFrame, y: str, probas: list[str]) -> DataFrame:
    """(roc_auc): of class codes 0.. and a probability column for each, the mean area of each class against the rest.

    All classes go in one pass. Missing where a class, or its rest, has no row.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(c).cast("double").alias("value"), (F.col(y) == k).cast("long").alias("own")) for k, c in enumerate(probas)]))
    rows = df.where(F.col(y).isNotNull()).select(each.alias("e")).select("e.*").where("value IS NOT NULL")
    counts = counted(rows, ["class"], {"pos": F.col("own"), "neg": 1 - F.col("own")})
    areas = counts.groupBy("class").agg(_area().alias("a"))
    return areas.agg(F.when(F.count("a") == len(probas), F.avg("a")).alias("roc_auc"))


def regression_metrics(df: DataFrame, y: str, p: str, by: tuple[str, ...] = ()) -> DataFrame:
    """mse, rmse, mae, r2 and mape (over labels that are not 0, in percent)."""
    use = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    e = F.col(y) - F.col(p)
    mse = F.avg(e * e)
    aggs = [mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(mse, F.var_pop(y))).alias("r2"), (100 * F.avg(F.when(F.col(y) != 0, F.abs(F.try_divide(e, F.col(y)))))).alias("mape")]
    return use.groupBy(*by).agg(*aggs) if by else use.agg(*aggs)


def trading_metrics(df: DataFrame, spec: Series, returns: str, signal: str, risk_free: float = 0.0) -> DataFrame:
    """Per series, of signal times return: Sharpe, drawdown, direction hits, win rate, profit factor, total return, Sortino."""
    r = F.col(signal) * F.col(returns)
    at, own = sliced(df.where(F.col(returns).isNotNull()).withColumn("_r", r), spec)
    at = running(at, own, {"_equity": ("product", 1 + F.col("_r"))})
    at = running(at, own, {"_peak": ("max", F.col("_equity"))}).withColumn("_drawdown", F.try_divide(F.col("_equity") - F.col("_peak"), F.col("_peak")))
    excess = F.col("_r") - risk_free / YEAR
    n, sd = F.count("_r"), F.stddev_pop(excess)
    traded = F.col(signal) != 0
    gain = F.sum(F.when(traded & (F.col("_r") > 0), F.col("_r")).otherwise(0.0))
    loss = -F.sum(F.when(traded & (F.col("_r") < 0), F.col("_r")).otherwise(0.0))
    down = F.when(F.col("_r") < 0, F.col("_r"))
    sortino = F.coalesce(F.when(F.count(down) > 1, F.try_divide(F.avg("_r"), F.stddev_pop(down)) * math.sqrt(YEAR)), F.lit(0.0))
    hit = (F.signum(F.col(signal).cast("double")) == F.signum(returns)) | (F.col(signal) == 0)
    return at.groupBy(*spec.key).agg(
        F.when((n > 1) & (sd > 0), F.avg(excess) / sd * math.sqrt(YEAR)).otherwise(0.0).alias("sharpe_ratio"),
        F.min("_drawdown").alias("max_drawdown"),
        F.avg(hit.cast("double")).alias("direction_hit_rate"),
        F.coalesce(F.avg(F.when(traded, (F.col("_r") > 0).cast("double"))), F.lit(0.0)).alias("win_rate"),
        F.when(loss > 0, gain / loss).when(gain > 0, float("inf")).otherwise(0.0).alias("profit_factor"),
        (F.product(1 + F.col("_r")) - 1).alias("total_return"),
        sortino.alias("sortino_ratio"),
    )


def bin_edges(n: int) -> list[float]:
    """Edges of n equal bins of 0..1, as multiples of 1/n (the third of ten is 0.30000000000000004)."""
    return [k * (1.0 / n) for k in range(n)] + [1.0]


def probability_bin(p: Column, n: int) -> Column:
    """The bin of a probability: closed on the left, the last one on both sides."""
    edges = bin_edges(n)
    out = F.lit(None).cast("int")
    for k in range(n):
        top = p <= edges[k + 1] if k == n - 1 else p < edges[k + 1]
        out = F.when((p >= edges[k]) & top, k).otherwise(out)
    return out


def calibration_curve(df: DataFrame, y: str, proba: str, n: int = 10) -> DataFrame:
    """Every bin with its centre, count, share of class 1 and mean probability; the last two are missing in empty bins."""
    counted = df.withColumn("bin", probability_bin(F.col(proba), n)).groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("accuracy"), F.avg(proba).alias("confidence"))
    edges = bin_edges(n)
    grid = df.sparkSession.createDataFrame([(k, (edges[k] + edges[k + 1]) / 2) for k in range(n)], "bin int, center double")
    return grid.join(F.broadcast(counted), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_errors(df: DataFrame, y: str, proba: str, n: int = 10) -> DataFrame:
    """ece: the gaps between accuracy and confidence weighted by count; mce: the widest."""
    curve = calibration_curve(df, y, proba, n).where("n > 0")
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return curve.agg(F.coalesce(F.sum(gap * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("ece"), F.coalesce(F.max(gap), F.lit(0.0)).alias("mce"))


def reliability(df: DataFrame, y: str, proba: str, n: int = 10) -> DataFrame:
    """The bins of a reliability diagram: those that hold rows."""
    return calibration_curve(df, y, proba, n).where("n > 0").select("bin", "center", "n", "accuracy", "confidence")


def all_metrics(df: DataFrame, task: str, y: str, p: str, proba: str | None = None, average: str = "weighted") -> DataFrame:
    """One row of what a task's metrics are; with probabilities also their scores and calibration."""
    if task == "regression":
        return regression_metrics(df, y, p)
    if task != "classification":
        raise ValueError(f"unknown task {task!r}")
    out = classification_metrics(df, y, p, average)
    if proba:
        errors = calibration_errors(df, y, proba).select(F.col("ece").alias("calibration_ece"), F.col("mce").alias("calibration_mce"))
        for more in (brier_and_log_loss(df, y, proba), roc_auc(df, y, proba), errors):
            out = out.join(F.broadcast(more))  # one row each
    return out


def infer_task(df: DataFrame, y: str, declared: str | None = None) -> str:
    """The declared task, or regression for a numeric label of more than 20 distinct values."""
    if declared in ("regression", "classification"):
        return declared
    kind = dict(df.dtypes)[y]
    many = kind != "string" and df.select(y).distinct().limit(21).count() > 20
    return "regression" if many else "classification"


def robustness_by_regime(df: DataFrame, regime: str, models: dict[str, str], y: str, task: str | None = None) -> DataFrame:
    """A task's metrics of each model (name: prediction column) in each regime, in one job a model."""
    task = infer_task(df, y, task)
    parts = []
    for name, p in models.items():
        part = regression_metrics(df, y, p, (regime,)) if task == "regression" else classification_metrics(df, y, p, "weighted", (regime,))
        parts.append(part.withColumn("model", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def model_table(spark, metrics: dict[str, dict[str, float]], contains: str = "", train: bool = False) -> DataFrame:
    """(model, metric, value) of models whose name holds a text; metrics of training only if asked for."""
    rows = [(m, k, float(v)) for m, d in metrics.items() if contains in m for k, v in (d or {}).items() if k.startswith("train_") == train and isinstance(v, (int, float))]
    return spark.createDataFrame(rows, "model string, metric string, value double")
