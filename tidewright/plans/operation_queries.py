"""Queries of what runs around the engine: configuration, retries, failure records, steps, runs, alerts, logs, catalogue."""

from __future__ import annotations

import json
import logging

from pyspark.sql import functions as F

from tidewright.operators import features
from tidewright.plans.catalog import register
from tidewright.plans.inputs import EVENTS, events, table
from tidewright.session import shared_dir
from tidewright.sources import readers
from tidewright.utils import config, operations


@register("config", "SELECT * FROM (VALUES ('model.depth', '8'), ('model.rate', '0.1'), ('data.path', 'x'), ('data.new', '1'), ('valid', 'True'), ('wrong', 'False')) AS v(name, value)")
def configuration(spark, sf_dir):
    """Merged over a base, addressed by dotted names, changed in a copy, and held against a schema."""
    path = f"{shared_dir(spark)}/config.json"
    readers.save_json({"model": {"depth": 6, "rate": 0.1}, "data": {"path": "x"}}, path)
    merged = config.merge(config.load(path), {"model": {"depth": 8}})
    changed = config.put(merged, "data.new", 1)
    schema = {"type": "object", "required": ["model"], "properties": {"model": {"type": "object", "properties": {"depth": {"type": "integer", "maximum": 10}}}}}
    rows = [(n, str(config.get(changed, n))) for n in ("model.depth", "model.rate", "data.path", "data.new")]
    rows += [("valid", str(not config.errors(changed, schema))), ("wrong", str(not config.errors(config.put(changed, "model.depth", 11), schema)))]
    return spark.createDataFrame(rows, "name string, value string")


@register("retries", "SELECT count(*) AS n, 3 AS attempts, [2.0, 3.0] AS waits FROM orders")
def retries(spark, sf_dir):
    """A read that fails twice, tried again after longer and longer waits."""
    waits, tries = [], []

    @operations.retry(times=5, wait=2.0, longest=3.0, on=(OSError,), sleep=waits.append)
    def read():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not yet")
        return table(spark, sf_dir, "orders").count()

    return spark.createDataFrame([(read(), len(tries), [float(w) for w in waits])], "n bigint, attempts int, waits array<double>")


@register("failure_record", "SELECT 'run' AS run, 'ValueError(''15'')' AS error, '15' AS rows_seen")
def failure_record(spark, sf_dir):
    """What a failed step leaves: its error and its values."""
    folder = shared_dir(spark)
    try:
        with operations.recovery(folder, "run"):
            _fail(15)
    except ValueError:
        pass
    told = readers.load_json(f"{folder}/run_failure.json")
    return spark.createDataFrame([(told["run"], told["error"], told["locals"]["rows_seen"])], "run string, error string, rows_seen string")


def _fail(rows_seen: int) -> None:
    raise ValueError(str(rows_seen))


@register("steps", "SELECT o_orderstatus, count(*) AS n, 1 AS made FROM orders GROUP BY 1")
def steps(spark, sf_dir):
    """A step's table is made once; run again, it is read."""
    folder, made = shared_dir(spark), []

    def make():
        made.append(1)
        return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))

    for _ in range(2):
        found = operations.Steps(spark, folder, "run").table("counts", make)
    return found.withColumn("made", F.lit(len(made)))


@register("tracked_runs", "SELECT 'good' AS name, 'finished' AS status, 2 AS points, CAST(avg(o_totalprice) AS INTEGER) AS last FROM orders UNION ALL SELECT 'bad', 'failed', 0, NULL")
def tracked_runs(spark, sf_dir):
    """Runs with parameters and metrics; one that fails is recorded as such; the oldest goes when two are kept."""
    t = operations.Tracker(shared_dir(spark), "orders")
    with t.run("old"):
        pass
    mean = table(spark, sf_dir, "orders").agg(F.avg("o_totalprice")).first()[0]
    with t.run("good", kind="a") as run_id:
        t.params(run_id, depth=3)
        t.metric(run_id, "mean", 0.0)
        t.metric(run_id, "mean", mean, 1)
    try:
        with t.run("bad"):
            raise KeyError("x")
    except KeyError:
        pass
    t.cleanup(2)
    rows = [(r["name"], r["status"], len(r["metrics"].get("mean", [])), round(r["metrics"]["mean"][-1][1]) if r["metrics"] else None) for r in t.list()]
    return spark.createDataFrame(rows, "name string, status string, points int, last int")


@register("alerts", "SELECT event_type AS metric, max(value) AS value FROM events GROUP BY 1 HAVING max(value) > 50")
def alerts(spark, sf_dir):
    """Rules on the largest value of each kind of event; a second look within a minute is silent."""
    found = {r[0]: r[1] for r in table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("value")).collect()}
    now = [0.0]
    watch = operations.Alerts([(name, ">", 50.0) for name in found], clock=lambda: now[0])
    first = watch.check(found)
    now[0] = 30.0
    assert not watch.check(found)
    return spark.createDataFrame([(a["metric"], float(a["value"])) for a in first], "metric string, value double")


@register("json_logs", "SELECT 'engine' AS logger, 'WARNING' AS level, 'rows: ' || count(*) AS message FROM orders")
def json_logs(spark, sf_dir):
    record = logging.LogRecord("engine", logging.WARNING, "p", 1, "rows: %s", (table(spark, sf_dir, "orders").count(),), None)
    d = json.loads(operations.JsonFormatter().format(record))
    return spark.createDataFrame([(d["logger"], d["level"], d["message"])], "logger string, level string, message string")


_BUCKETS = {"lag": ["value_lag_1"], "rolling": ["value_rolling_mean_5"], "returns": ["value_log_return_1"], "order_book": ["bid_ask_spread", "mid_price"], "cross_asset": ["bid_ask_spread"], "calendar": ["day_of_week", "is_weekend"]}


@register("feature_catalogue", f"SELECT * FROM (VALUES {', '.join(f'(\'{b}\', \'{n}\')' for b, ns in _BUCKETS.items() for n in ns)}) AS v(bucket, name)")
def feature_catalogue(spark, sf_dir):
    """Which features of a table fall into each bucket; a spread is in two."""
    e = features.lag_features(events(spark, sf_dir), EVENTS, ["value"], (1,))
    e = features.rolling_features(e, EVENTS, ["value"], (5,), ("mean",))
    e = features.price_returns(e, EVENTS, ["value"], (1,))
    names = [c for c in e.columns if "_" in c and c != "event_id"] + ["bid_ask_spread", "mid_price", "day_of_week", "is_weekend"]
    return spark.createDataFrame([(b, n) for b, found in features.feature_catalogue(names).items() for n in found], "bucket string, name string")
