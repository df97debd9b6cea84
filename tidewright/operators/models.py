"""Estimators: Gaussian naive Bayes in SQL, boosted trees, sequence and in-context regressors, search, importance, walk-forward.

All have fit(df, label) and transform(df), which adds ``prediction`` (and ``probability`` of each class, where they
have one); save(path) and load(path) go through ``operators.ensemble``.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from tidewright.functions.series import Series, beside
from tidewright.operators.metrics import classification_metrics, regression_metrics
from tidewright.operators.splits import Fold, apply_folds, support_set, whole_folds
from tidewright.session import staged
from tidewright.sources import files


def validate_input(df: DataFrame, features: list[str]) -> None:
    if not isinstance(df, DataFrame):
        raise TypeError("a DataFrame is needed")
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    if df.isEmpty():
        raise ValueError("no rows")


@dataclass
class GaussianNB:
    """Gaussian naive Bayes whose fit is one aggregate and whose scores are column expressions."""

    features: list[str]
    smoothing: float = 1e-9
    stats: dict[int, dict] = field(default_factory=dict)

    def fit(self, df: DataFrame, label: str) -> GaussianNB:
        validate_input(df, self.features)
        y = F.col(label).cast("int").alias("label")
        moments = [x for c in self.features for x in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))]
        rows = df.groupBy(y).agg(F.count("*").alias("n"), *moments).collect()  # a row a class
        spread = df.agg(*[F.var_pop(c).alias(c) for c in self.features]).first()
        floor = self.smoothing * max(spread)
        total = sum(r["n"] for r in rows)
        self.stats = {r["label"]: {"prior": r["n"] / total, "mean": [r[f"m_{c}"] for c in self.features], "var": [r[f"v_{c}"] + floor for c in self.features]} for r in sorted(rows, key=lambda r: r["label"])}
        return self

    def log_joint(self, label: int) -> Column:
        s = self.stats[label]
        out = F.lit(math.log(s["prior"]))
        for c, m, v in zip(self.features, s["mean"], s["var"], strict=True):
            out = out - 0.5 * math.log(2 * math.pi * v) - F.pow(F.col(c) - m, 2) / (2 * v)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds score_{class}, probability_{class}, probability (an array in the order of the classes) and prediction (ties: the smaller class)."""
        validate_input(df, self.features)
        labels = list(self.stats)
        out = df.withColumns({f"score_{k}": self.log_joint(k) for k in labels})
        top = F.greatest(*[F.col(f"score_{k}") for k in labels]) if len(labels) > 1 else F.col(f"score_{labels[0]}")
        total = sum((F.exp(F.col(f"score_{k}") - top) for k in labels), F.lit(0.0))
        out = out.withColumns({f"probability_{k}": F.exp(F.col(f"score_{k}") - top) / total for k in labels})
        out = out.withColumn("probability", F.array(*[F.col(f"probability_{k}") for k in labels]))
        guess = F.lit(None).cast("int")
        for k in reversed(labels):
            guess = F.when(F.col(f"score_{k}") == top, k).otherwise(guess)
        return out.withColumn("prediction", guess)

    def importance(self) -> dict[str, float]:
        """None of its own; see permutation_importance()."""
        return {}

    def save(self, path: str) -> None:
        files.write_text(path, json.dumps({"features": self.features, "smoothing": self.smoothing, "stats": self.stats}))

    @classmethod
    def load(cls, path: str) -> GaussianNB:
        d = json.loads(files.read_text(path))
        return cls(d["features"], d["smoothing"], {int(k): v for k, v in d["stats"].items()})


@dataclass
class Trees:
    """Gradient-boosted trees: of a number, of two classes, or of more, one against the rest each.

    columns: the share of features that each split looks at; least: rows of a node at least. With a column
    ``validation`` (true for rows kept out of training) boosting ends when those no longer gain.
    """

    features: list[str]
    objective: str = "regression"
    trees: int = 100
    depth: int = 6
    rate: float = 0.1
    subsample: float = 1.0
    columns: float = 1.0
    least: int = 1
    validation: str | None = None
    seed: int = 42
    model: PipelineModel | None = None

    def fit(self, df: DataFrame, label: str) -> Trees:
        validate_input(df, self.features)
        common = {"featuresCol": "_features", "labelCol": label, "predictionCol": "prediction", "maxDepth": self.depth, "maxIter": self.trees, "stepSize": self.rate, "seed": self.seed, "subsamplingRate": self.subsample, "minInstancesPerNode": self.least, "featureSubsetStrategy": "all" if self.columns >= 1 else str(self.columns)}
        if self.validation:
            common["validationIndicatorCol"] = self.validation
        assembler = VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="skip")
        if self.objective == "regression":
            self.model = Pipeline(stages=[assembler, GBTRegressor(**common)]).fit(df)
        elif self.objective == "binary":
            self.model = Pipeline(stages=[assembler, GBTClassifier(**common)]).fit(df)
        elif self.objective == "multi":
            classes = int(df.agg(F.max(label)).first()[0]) + 1
            rows = assembler.transform(df).withColumns({f"_is{k}": (F.col(label) == k).cast("double") for k in range(classes)})
            one = [GBTClassifier(**common | {"labelCol": f"_is{k}", "predictionCol": f"_guess{k}"}).setRawPredictionCol(f"_raw{k}").setProbabilityCol(f"_own{k}").fit(rows) for k in range(classes)]
            self.model = PipelineModel([assembler, *one])
        else:
            raise ValueError(f"unknown objective {self.objective!r}")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction and, of classes, probability: an array by class; of more than two, each against the rest, made to add up to 1."""
        out = self.model.transform(df)
        if self.objective == "multi":
            classes = range(len(self._forests()))
            own = [vector_to_array(f"_own{k}")[1] for k in classes]
            out = out.withColumn("probability", F.array(*[p / sum(own[1:], own[0]) for p in own]))
            best = F.array_position("probability", F.array_max("probability")) - 1
            out = out.withColumn("prediction", best.cast("double")).drop(*(f"_{n}{k}" for n in ("guess", "raw", "own") for k in classes))
        elif self.objective == "binary":
            out = out.withColumn("probability", vector_to_array("probability"))
        return out.drop("_features", "rawPrediction")

    def _forests(self) -> list:
        return list(self.model.stages[1:])

    def importance(self) -> dict[str, float]:
        """Gain of each feature as a share of all; of several classes the mean."""
        forests = self._forests()
        return {c: sum(float(m.featureImportances[k]) for m in forests) / len(forests) for k, c in enumerate(self.features)}

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> Trees:
        self.model = PipelineModel.load(path)
        return self


@dataclass
class _Leaf:
    """A leaf by its path: value, and of each feature on it the interval of values and the share of rows that take it."""

    value: float
    low: dict[int, float]
    high: dict[int, float]
    share: dict[int, float]


def _leaves(node, value: float = 1.0) -> list[_Leaf]:
    """All leaves of a fitted tree, its values multiplied by the tree's weight."""
    if not node.getClass().getSimpleName().startswith("Internal"):
        return [_Leaf(float(node.prediction()) * value, {}, {}, {})]
    split, total, out = node.split(), node.impurityStats().rawCount(), []
    at, k = float(split.threshold()), int(split.featureIndex())
    for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
        share = child.impurityStats().rawCount() / total
        for leaf in _leaves(child, value):
            leaf.share[k] = leaf.share.get(k, 1.0) * share
            if left:
                leaf.high[k] = min(leaf.high.get(k, math.inf), at)
            else:
                leaf.low[k] = max(leaf.low.get(k, -math.inf), at)
            out.append(leaf)
    return out


def shap_values(x: np.ndarray, leaves: list[_Leaf]) -> np.ndarray:
    """Exact Shapley values of a sum of trees, a feature out of the coalition following both branches by their rows.

    A leaf's share of a coalition is a product over the features on its path, so its Shapley sums are coefficients of
    a polynomial with as many factors.
    """
    out = np.zeros(x.shape)
    for leaf in leaves:
        on = sorted(leaf.share)
        m = len(on)
        take = {k: ((x[:, k] > leaf.low.get(k, -math.inf)) & (x[:, k] <= leaf.high.get(k, math.inf))).astype(float) for k in on}
        for k in on:
            poly = np.ones((1, len(x)))
            for j in on:
                if j != k:
                    grown = np.zeros((len(poly) + 1, len(x)))
                    grown[:-1] += poly * leaf.share[j]
                    grown[1:] += poly * take[j]
                    poly = grown
            weight = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
            out[:, k] += leaf.value * (take[k] - leaf.share[k]) * (weight[:, None] * poly).sum(axis=0)
    return out


def shap(df: DataFrame, model: Trees) -> DataFrame:
    """Adds shap_{feature} and shap_base to each row: their sum is the model's output (for two classes, the margin)."""
    forests = model._forests()
    if len(forests) != 1:
        raise ValueError("one output is needed: explain each class's trees by themselves")
    leaves = [x for tree, w in zip(forests[0].trees, forests[0].treeWeights, strict=True) for x in _leaves(tree._call_java("rootNode"), float(w))]
    base = sum(x.value * math.prod(x.share.values()) for x in leaves)
    features, names = list(model.features), [f"shap_{c}" for c in model.features]
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in [*names, "shap_base"]]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = shap_values(rows[features].to_numpy(float), leaves)
            yield rows.assign(**{n: found[:, k] for k, n in enumerate(names)}, shap_base=base)

    return df.mapInPandas(run, schema)


@dataclass
class SequenceRegressor:
    """A regressor of arrays of arrays as splits.sequences() makes them: flattened, then linear, or boosted with early stopping.

    patience is the least gain on the last rows of each series (``held`` of them) for which boosting goes on.
    """

    length: int
    width: int
    kind: str = "linear"
    regularization: float = 0.0
    trees: int = 100
    depth: int = 4
    held: float = 0.2
    model: object | None = None

    @property
    def inputs(self) -> list[str]:
        return [f"x{i}_{j}" for i in range(self.length) for j in range(self.width)]

    def _flat(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"x{i}_{j}": F.col("sequence")[i][j] for i in range(self.length) for j in range(self.width)})

    def fit(self, df: DataFrame, label: str = "target", spec: Series | None = None) -> SequenceRegressor:
        flat = self._flat(df)
        if self.kind == "linear":
            assembler = VectorAssembler(inputCols=self.inputs, outputCol="_features", handleInvalid="skip")
            self.model = Pipeline(stages=[assembler, LinearRegression(featuresCol="_features", labelCol=label, regParam=self.regularization, solver="normal")]).fit(flat)
        elif self.kind == "boosted":
            from tidewright.operators.splits import sequential_split

            parted = sequential_split(flat, spec or Series(), 1 - self.held, 0.0, self.held).withColumn("_held", F.col("split") == "test")
            self.model = Trees(self.inputs, trees=self.trees, depth=self.depth, validation="_held").fit(parted, label)
        else:
            raise ValueError(f"unknown kind {self.kind!r}")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._flat(df)).drop("_features", *self.inputs)


def lag_regressor(df: DataFrame, sequence: str, label: str, length: int, width: int, regularization: float = 0.0) -> SequenceRegressor:
    """A linear SequenceRegressor fitted on a column of sequences."""
    return SequenceRegressor(length, width, regularization=regularization).fit(df.withColumn("sequence", F.col(sequence)), label)


@dataclass
class InContext:
    """Predictions from a bounded support set instead of weights: an estimator of one's own, or the nearest support rows.

    support rows of each series are chosen by support_set(); ``estimator(support rows, label)`` returns a model with
    transform(). Without one, the mean label of the k nearest support rows by their scaled features is the prediction,
    nearest first, ties to the later row. A series' support is an array beside its rows, bounded by ``support``.
    """

    features: list[str]
    support: int = 60
    k: int = 5
    strategy: str = "recent"
    estimator: Callable | None = None
    options: dict = field(default_factory=dict)
    spec: Series = field(default_factory=Series)
    known: DataFrame | None = None
    model: object | None = None

    def fit(self, df: DataFrame, label: str) -> InContext:
        validate_input(df, self.features)
        rows = support_set(df, self.spec, self.support, self.strategy, **self.options)
        if self.estimator is not None:
            self.model = self.estimator(rows, label)
            return self
        keys = list(self.spec.key)
        moments = [x for c in self.features for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
        one = F.struct(F.struct(*self.spec.order).alias("at"), F.array(*[F.col(c).cast("double") for c in self.features]).alias("x"), F.col(label).cast("double").alias("y"))
        self.known = staged(rows.groupBy(*keys).agg(F.collect_list(one).alias("_support"), *moments) if keys else rows.agg(F.collect_list(one).alias("_support"), *moments))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is not None:
            return self.model.transform(df)
        validate_input(df, self.features)
        both = beside(df, self.known, list(self.spec.key))
        scale = [F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in self.features]
        far = lambda r: sum((F.pow((F.col(c).cast("double") - r["x"][i]) / scale[i], 2) for i, c in enumerate(self.features)), F.lit(0.0))
        met = F.array_sort(F.transform("_support", lambda r: F.struct(F.round(far(r), 9).alias("d"), (-F.unix_micros(r["at"][self.spec.ts].cast("timestamp"))).alias("t"), r["y"].alias("y"))))
        near = F.slice(met, 1, self.k)
        mean = F.aggregate(near, F.lit(0.0), lambda a, r: a + r["y"]) / F.size(near)
        return both.withColumn("prediction", F.when(F.size("_support") > 0, mean)).select(*df.columns, "prediction")


def permutation_importance(df: DataFrame, predict: Callable[[DataFrame], DataFrame], features: list[str], label: str, key: list[str], repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, importance, deviation): how much accuracy falls when a column's values change places.

    In each repeat a feature's values move on by one row in the order of a seeded hash of ``key``, which must tell rows
    apart; the last one's goes to the first. All features and repeats go in one job, within parts of about a million
    rows by the key's hash, so that no task orders all rows.
    """
    parts = max(1, -(-df.count() // 1_000_000))
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    runs = F.array(F.struct(F.lit(-1).alias("f"), F.lit(0).alias("k")), *[F.struct(F.lit(f).alias("f"), F.lit(k).alias("k")) for f in range(len(features)) for k in range(repeats)])
    rows = df.select(*key, *[c for c in dict.fromkeys([*features, label]) if c not in key]).withColumn("_part", F.pmod(F.crc32(name), F.lit(parts))).withColumn("_r", F.explode(runs))
    own = F.struct(F.element_at(F.array(*[F.col(c).cast("double") for c in features]), F.greatest(F.col("_r")["f"] + 1, F.lit(1))).alias("v"))
    w = Window.partitionBy("_r", "_part").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_r")["k"].cast("string"), F.col("_r")["f"].cast("string"), name)))
    least = F.first(own).over(w.rowsBetween(Window.unboundedPreceding, 0))
    moved = rows.withColumn("_moved", F.coalesce(F.lead(own).over(w), least)["v"])
    types = dict(df.dtypes)
    mixed = moved.withColumns({c: F.when(F.col("_r")["f"] == i, F.col("_moved").cast(types[c])).otherwise(F.col(c)) for i, c in enumerate(features)})
    told = predict(mixed.select(*features, label, F.col("_r")["f"].alias("_f"), F.col("_r")["k"].alias("_k")))
    scores = told.groupBy("_f", "_k").agg(F.avg((F.col(label) == F.col("prediction")).cast("double")).alias("score"))
    base = scores.where("_f = -1").select(F.col("score").alias("base"))
    drops = scores.where("_f >= 0").crossJoin(F.broadcast(base)).withColumn("drop", F.col("base") - F.col("score"))
    names = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("_f") + 1)
    return drops.groupBy("_f").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("deviation")).select(names.alias("feature"), "importance", "deviation")


#: The space that search() draws from.
SPACE = {"depth": (3, 10), "rate": (1e-3, 0.3), "trees": (50, 500), "subsample": (0.5, 1.0), "columns": (0.5, 1.0), "least": (1, 10)}


def search(df: DataFrame, spec: Series, features: list[str], label: str, splits: int = 5, trials: int = 10, metric: str = "rmse", objective: str = "regression", seed: int = 42, space: dict | None = None, at_once: int = 2) -> tuple[dict, float]:
    """A seeded random search over expanding folds of all rows: the parameters of the least mean loss, and that loss.

    Folds are written once; ``at_once`` trials train at the same time, each a distributed job.
    """
    space = SPACE | (space or {})
    draw = random.Random(seed)
    rows = staged(whole_folds(df, spec, "time_series", splits=splits))
    drawn = [{"depth": draw.randint(*map(int, space["depth"])), "trees": draw.randint(*map(int, space["trees"])), "subsample": draw.uniform(*space["subsample"]), "columns": draw.uniform(*space["columns"]), "least": draw.randint(*map(int, space["least"])), "rate": math.exp(draw.uniform(*map(math.log, space["rate"])))} for _ in range(trials)]

    def loss(p: dict) -> float:
        losses = []
        for k in range(splits):
            fold = rows.where(F.col("fold") == k)
            model = Trees(features, objective, **p).fit(fold.where("split = 'train'"), label)
            told = model.transform(fold.where("split = 'test'"))
            if metric == "accuracy":
                losses.append(-classification_metrics(told, label, "prediction").first()["accuracy"])
            elif metric == "logloss":
                own = F.greatest(F.element_at("probability", F.col(label).cast("int") + 1), F.lit(1e-15))
                losses.append(told.agg(F.avg(-F.ln(own))).first()[0])
            else:
                losses.append(regression_metrics(told, label, "prediction").first()["rmse"])
        return sum(losses) / len(losses)

    with ThreadPoolExecutor(at_once) as pool:
        found = list(pool.map(loss, drawn))
    best = min(range(trials), key=found.__getitem__)
    return drawn[best], found[best]


def walk_forward(df: DataFrame, spec: Series, features: list[str], label: str, start: float = 0.8, query: int = 7, support: int = 60, regularization: float = 0.0) -> DataFrame:
    """Rows in blocks of ``query`` from ``start`` (a position, or a share of a series) to the end of each series, each
    predicted by the linear regression of the ``support`` rows before its block: ``fold`` and ``prediction``.

    All blocks of all series are fitted in one job: a row adds its products to the sums of the blocks it supports, at
    most ceil(support / query) + 1, and a block's small system is solved from its sums. The regularization adds to the
    diagonal (not to the intercept's). Rows with a missing value take no part in a fit. A block without a unique
    solution takes the least-squares one of least norm.
    """
    from tidewright.operators.splits import _placed

    at = _placed(df, spec)
    first = F.floor(F.col("_rows") * F.lit(float(start))) if 0 < start < 1 else F.lit(int(start)).cast("bigint")
    at = at.withColumn("_first", first)
    keys, p, block = list(spec.key), F.col("_at") - F.col("_first"), F.lit(query)
    d = len(features) + 1
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    present = F.col(label).isNotNull()
    for c in features:
        present = present & F.col(c).isNotNull()
    # a block b begins at p = b * query; the rows from there back to support rows before belong to its support
    lower = F.greatest(F.floor(p / block) + 1, F.lit(0))
    upper = F.least(F.floor((p + support) / block), F.floor((F.col("_rows") - 1 - F.col("_first")) / block))
    feeding = at.where(present).withColumns({"_lo": lower, "_hi": upper}).where("_lo <= _hi").withColumn("fold", F.explode(F.sequence("_lo", "_hi")))
    sums = [F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(d) for j in range(i, d)] + [F.sum(terms[i] * F.col(label)).alias(f"b{i}") for i in range(d)]
    grouped = feeding.groupBy(*keys, "fold").agg(*sums)
    names = [f"w{i}" for i in range(d)]
    schema = StructType([*grouped.select(*keys, "fold").schema.fields, *[StructField(n, DoubleType()) for n in names]])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            a, b = np.zeros((len(rows), d, d)), rows[[f"b{i}" for i in range(d)]].to_numpy(float)
            for i in range(d):
                for j in range(i, d):
                    a[:, i, j] = a[:, j, i] = rows[f"a{i}_{j}"].to_numpy(float)
            a[:, range(1, d), range(1, d)] += regularization
            w = np.stack([np.linalg.lstsq(x, y, rcond=1e-13)[0] for x, y in zip(a, b, strict=True)]) if len(rows) else np.zeros((0, d))
            yield rows[[*keys, "fold"]].assign(**{n: w[:, i] for i, n in enumerate(names)})

    told = at.where("_at >= _first").withColumn("fold", F.floor(p / block)).drop("_at", "_rows", "_first")
    fitted = beside(told, grouped.mapInPandas(solve, schema), [*keys, "fold"])
    prediction = sum((F.col(f"w{i}") * t for i, t in enumerate(terms)), F.lit(0.0))
    return fitted.withColumn("prediction", prediction).withColumn("fold", F.col("fold").cast("int")).drop(*names)


def walk_models(df: DataFrame, spec: Series, label: str, fit: Callable[[DataFrame], object], start: int, query: int = 7, support: int = 60, rounds: int = 5, strategy: str = "recent") -> DataFrame:
    """As walk_forward(), with a model of one's own for each of ``rounds`` blocks: fit(support rows) has transform()."""
    folds = [Fold(k, 0, start + k * query, start + k * query, start + (k + 1) * query) for k in range(rounds)]
    rows = apply_folds(df, spec, folds)
    out = None
    for f in folds:
        fold = rows.where(F.col("fold") == f.fold)
        known = support_set(fold.where("split = 'train'"), spec, support, strategy)
        told = fit(known).transform(fold.where("split = 'test'")).drop("_features", "split")
        out = told if out is None else out.unionByName(told)
    return out
