"""Several models as one, their store, and loading them from recorded runs."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.models import GaussianNB, Trees
from tidewright.operators.trading import vote, weighted
from tidewright.sources import files

METHODS = ("average", "weighted_average", "voting")
LOG = logging.getLogger(__name__)


def _times(w: float) -> Callable[[Column], Column]:
    return lambda p: p * w


@dataclass
class Ensemble:
    """Models that are told as one: the mean of their predictions, the weighted mean, or the commonest one.

    Weights are made to add up to 1; without any, weighted_average weighs alike. metrics: {model's place: {name: value}}.
    """

    models: list
    method: str = "average"
    weights: list[float] | None = None
    metrics: list[dict[str, float]] = field(default_factory=list)

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}; one of {', '.join(METHODS)}")
        if not self.models:
            raise ValueError("an ensemble needs models")
        if self.weights is not None:
            if len(self.weights) != len(self.models) or min(self.weights) < 0 or sum(self.weights) <= 0:
                raise ValueError("a weight for each model is needed, and a positive sum")
            self.weights = [w / sum(self.weights) for w in self.weights]

    def fit(self, df: DataFrame, label: str) -> Ensemble:
        for m in self.models:
            m.fit(df, label)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction and, where a model has probabilities, probability: an array by class.

        Models without probabilities drop out of it, and the weights of the others are made to add up to 1. Voting
        averages probabilities; votes that tie go to the smallest label.
        """
        out, probable = df, []
        for k, m in enumerate(self.models):
            told = m.transform(out)
            new = {"prediction": f"_p{k}"}
            if "probability" in told.columns:
                new["probability"] = f"_q{k}"
                probable.append(k)
            out = told.select(*out.columns, *[F.col(a).cast("double" if a == "prediction" else "array<double>").alias(b) for a, b in new.items()])
        names = [f"_p{k}" for k in range(len(self.models))]
        use = self.weights if self.method == "weighted_average" else None
        combined = vote(names) if self.method == "voting" else weighted(names, use)
        out = out.withColumn("prediction", combined)
        if probable:
            out = out.withColumn("probability", self._probability([f"_q{k}" for k in probable], [use[k] for k in probable] if use else None))
        return out.drop(*names, *(f"_q{k}" for k in probable))

    def _probability(self, names: list[str], weights: list[float] | None) -> Column:
        if not weights or sum(weights) <= 0:
            weights = [1.0] * len(names)
        first = F.transform(F.col(names[0]), _times(weights[0]))
        for n, w in zip(names[1:], weights[1:], strict=True):
            own = F.transform(F.col(n), _times(w))
            first = F.zip_with(first, own, lambda a, p: a + p)
        return F.transform(first, lambda p: p / sum(weights))

    def importance(self) -> dict[str, float]:
        """The mean over the models that have importances; a feature that one of them lacks counts 0 there."""
        found = [d for m in self.models if (d := m.importance())]
        names = sorted({c for d in found for c in d})
        return {c: sum(d.get(c, 0.0) for d in found) / len(found) for c in names}

    def mean_metrics(self) -> dict[str, float]:
        """mean_{name} of each metric over the models that have it."""
        names = sorted({n for d in self.metrics for n in d})
        return {f"mean_{n}": sum(d[n] for d in self.metrics if n in d) / sum(n in d for d in self.metrics) for n in names}


def _save_trees(m: Trees, path: str) -> dict:
    m.save(f"{path}/trees")
    return {"features": m.features, "objective": m.objective}


def _save_ensemble(m: Ensemble, path: str) -> dict:
    for k, part in enumerate(m.models):
        save_model(part, f"{path}/model{k}")
    return {"method": m.method, "weights": m.weights, "metrics": m.metrics, "n": len(m.models)}


#: Models that can be stored: name: (class, save(model, folder) -> what to note, load(folder, notes) -> model).
STORED: dict[str, tuple[type, Callable, Callable]] = {
    "gaussian_nb": (GaussianNB, lambda m, path: m.save(f"{path}/model.json") or {}, lambda path, d: GaussianNB.load(f"{path}/model.json")),
    "trees": (Trees, _save_trees, lambda path, d: Trees(d["features"], d["objective"]).load(f"{path}/trees")),
    "ensemble": (Ensemble, _save_ensemble, lambda path, d: Ensemble([load_model(f"{path}/model{k}") for k in range(d["n"])], d["method"], d["weights"], d["metrics"])),
}


def register_model(name: str, kind: type, save: Callable, load: Callable) -> None:
    """Adds a class of one's own to those that are stored."""
    STORED[name] = kind, save, load


def save_model(model, path: str, **notes) -> None:
    """A folder with the model and metadata.json, which names its type."""
    name = next((n for n, (kind, _, _) in STORED.items() if type(model) is kind), None)
    if name is None:
        raise TypeError(f"{type(model).__name__} is not registered")
    files.write_text(f"{path}/metadata.json", json.dumps({"model_type": name, "model": STORED[name][1](model, path), **notes}))


def load_model(path: str):
    about = json.loads(files.read_text(f"{path}/metadata.json"))
    if about.get("model_type") not in STORED:
        raise ValueError(f"{path}: unknown model type {about.get('model_type')!r}")
    return STORED[about["model_type"]][2](path, about["model"])


def load_from_runs(tracker, run_ids: list[str]) -> dict[str, object]:
    """The models that runs have stored under ``model`` of their artifacts; runs without one, or unknown, are told and left out."""
    out = {}
    for run_id in run_ids:
        path = f"{tracker.artifact_path(run_id)}/model"
        if not tracker.known(run_id) or not files.exists(f"{path}/metadata.json"):
            LOG.warning("run %s has no model", run_id)
            continue
        try:
            out[run_id] = load_model(path)
        except (ValueError, KeyError) as e:
            LOG.warning("run %s: %s", run_id, e)
    return out


def compare_runs(df: DataFrame, tracker, run_ids: list[str], label: str, regime: str | None = None) -> DataFrame:
    """Metrics of runs' models, by regime if there is such a column: a row a model and regime."""
    from tidewright.operators.metrics import robustness_by_regime

    out = df if regime else df.withColumn("_all", F.lit("global"))
    names = {}
    for run_id, model in load_from_runs(tracker, run_ids).items():
        told = model.transform(out)
        out = told.select(*out.columns, F.col("prediction").alias(f"_{run_id}"))
        names[run_id] = f"_{run_id}"
    return robustness_by_regime(out, regime or "_all", names, label)
