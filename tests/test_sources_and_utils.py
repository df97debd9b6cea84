"""Scans, sinks, configuration, operations and streams."""

import datetime as dt
import json
import logging

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tidewright.functions.series import Series
from tidewright.operators import quality
from tidewright.operators.indicators import obv, rsi
from tidewright.plans.inputs import bars_hourly
from tidewright.sources import readers
from tidewright.streaming import bars as streams
from tidewright.utils import config, operations


@pytest.fixture()
def assets(spark, tmp_path):
    rows = [(dt.datetime(2023, 1, 1 + k), 1.0 + k, 10.0) for k in range(5)]
    for name in ("btc", "eth"):
        spark.createDataFrame(rows, "timestamp timestamp, close double, volume double").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


SCHEMA = {"timestamp": "datetime64[ns]", "close": "float64"}


def test_scan_and_schema(spark, assets):
    df = readers.load_parquet(spark, f"{assets}/btc.parquet", SCHEMA)
    assert df.count() == 5
    report = readers.validate_schema(df, SCHEMA)
    assert report["valid"] and report["warnings"] == ["extra column volume"]
    with pytest.raises(FileNotFoundError):
        readers.load_parquet(spark, f"{assets}/none.parquet")
    with pytest.raises(ValueError):
        readers.load_parquet(spark, f"{assets}/btc.parquet", {"open": "float64"})
    with pytest.raises(ValueError):
        readers.load_parquet(spark, f"{assets}/btc.parquet", {"close": "int64"})


@pytest.mark.parametrize("a,b,same", [("float", "float64", True), ("tinyint", "int64", True), ("bigint", "float64", False), ("boolean", "bool", True), ("timestamp_ntz", "datetime64[ns]", True), ("date", "datetime64[ns]", False), ("decimal(3,1)", "decimal(3,1)", True), ("array<int>", "int64", False)])
def test_type_families(a, b, same):
    assert readers.types_agree(DataType.fromDDL(a), b) is same


def test_assets_and_config(spark, assets, tmp_path):
    status = {}
    df = readers.load_assets(spark, assets, ["btc", "eth", "xrp"], SCHEMA, status=status)
    assert df.groupBy("asset").count().count() == 2
    assert status["loaded_assets"] == ["btc", "eth"] and status["failed_assets"][0]["asset"] == "xrp"
    with pytest.raises(FileNotFoundError):
        readers.load_assets(spark, assets, ["xrp"], strict=True)
    both = readers.load_from_config(spark, {"sources": {"crypto": {"path": assets, "assets": ["btc"]}, "macro": {"path": assets}}})
    assert [r[0] for r in both.select("category").distinct().collect()] == ["crypto"]
    at = readers.write_report({"valid": True, "when": dt.datetime(2024, 1, 1)}, str(tmp_path / "r"), "run1")
    assert json.load(open(at))["when"].startswith("2024")


def test_bundle_and_signature(spark, assets, tmp_path):
    df = spark.read.parquet(f"{assets}/btc.parquet")
    b = readers.Bundle({"features": df.select("close"), "timestamp": df.select("timestamp")}, {"n": 5}, {"train": [0, 3], "test": [4], "bad": ["x", 1]})
    b.save(str(tmp_path / "bundle"))
    again = readers.Bundle.load(spark, str(tmp_path / "bundle"))
    assert again.metadata == {"n": 5} and again.splits == {"train": [0, 3]} and again.tables["features"].count() == 5
    path = str(tmp_path / "x.json")
    readers.save_json({"a": 1}, path)
    sign = readers.sign_file(path, b"key")
    assert readers.verify_file(path, sign, b"key") and not readers.verify_file(path, sign, b"other") and readers.verify_file(path)
    with pytest.raises(ValueError):
        readers.verify_file(path, sign)
    with pytest.raises(TypeError):
        readers.save_parquet([1], path)
    readers.append_csv(df, str(tmp_path / "csv"))
    readers.append_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 10


def test_profile_page(spark, assets, tmp_path):
    summary = quality.write_profile(spark.read.parquet(f"{assets}/btc.parquet"), str(tmp_path / "p.html"))
    assert summary["rows"] == 5 and "<table>" in (tmp_path / "p.html").read_text()


def test_config():
    base = {"a": {"b": 1, "c": 2}, "d": [1]}
    merged = config.merge(base, {"a": {"b": 5}, "e": 1})
    assert merged == {"a": {"b": 5, "c": 2}, "d": [1], "e": 1} and base["a"]["b"] == 1
    assert config.get(base, "a.c") == 2 and config.get(base, "a.x", 7) == 7
    assert config.put(base, "a.z.y", 3)["a"]["z"]["y"] == 3 and "z" not in base["a"]
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1}, "k": {"enum": ["x"]}}, "additionalProperties": False}
    config.validate({"n": 2, "k": "x"}, schema)
    for wrong in ({}, {"n": 0}, {"n": True}, {"n": 1, "k": "y"}, {"n": 1, "q": 1}):
        with pytest.raises(ValueError):
            config.validate(wrong, schema)


def test_retry_and_recovery(tmp_path):
    waits, calls = [], []

    @operations.retry(times=3, wait=2, longest=3, on=(OSError,), sleep=waits.append)
    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert flaky() == "ok" and waits == [2, 3]
    with pytest.raises(ZeroDivisionError), operations.recovery(str(tmp_path), "r1"):
        1 / 0  # noqa: B018
    assert "ZeroDivisionError" in json.load(open(tmp_path / "r1_failure.json"))["error"]


def test_steps_tracker_alerts_logs(spark, tmp_path):
    steps = operations.Steps(spark, str(tmp_path), "run")
    made = []
    for _ in range(2):
        assert steps.table("t", lambda: made.append(1) or spark.range(3)).count() == 3
        assert steps.value("v", lambda: made.append(1) or {"a": 1}) == {"a": 1}
    assert len(made) == 2 and steps.done() == ["t", "v"]
    t = operations.Tracker(str(tmp_path / "x"), "exp")
    with t.run("one", kind="a") as r:
        t.params(r, depth=3)
        t.metric(r, "loss", 0.5)
        t.metric(r, "loss", 0.4, 1)
        t.artifact(r, "m.json")
    with pytest.raises(KeyError), t.run("two"):
        raise KeyError
    assert t.get(r)["metrics"]["loss"] == [[0, 0.5], [1, 0.4]] and t.get(r)["status"] == "finished"
    assert [x["name"] for x in t.list(kind="a")] == ["one"] and t.cleanup(1) == 1 and len(t.list()) == 1
    now = [0.0]
    alerts = operations.Alerts([("cpu", ">", 0.9)], clock=lambda: now[0])
    assert len(alerts.check({"cpu": 1.0})) == 1 and not alerts.check({"cpu": 1.0})
    now[0] = 61
    assert alerts.check({"cpu": 1.0}) and len(alerts.history) == 2
    line = operations.JsonFormatter().format(logging.LogRecord("n", 20, "p", 1, "hi %s", ("x",), None))
    assert json.loads(line)["message"] == "hi x"


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    source = streams.read_events(spark, str(tmp_path / "in"), e.schema)
    bars = streams.stream_bars(source, "event_type", "ts", "value", late="1 hour")
    q = bars.writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.series, r.ts): r.close for r in bars_hourly(spark, sf_dir).collect()}
    got = {(r.series, r.ts): r.close for r in spark.table("bars").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) < 20

    b = bars_hourly(spark, sf_dir)
    b.repartition(1).write.parquet(str(tmp_path / "bars"))
    running = streams.running_indicators(spark.readStream.schema(b.schema).parquet(str(tmp_path / "bars")))
    q = running.writeStream.format("memory").queryName("run").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    s = Series()
    want = {(r.series, r.ts): (r.rsi, r.obv) for r in obv(rsi(b, s), s).collect()}
    got = {(r.series, r.ts): (r.rsi, r.obv) for r in spark.table("run").collect()}
    assert set(got) == set(want) and all(abs(got[k][0] - want[k][0]) < 1e-8 and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    assert streams.stream_sessions(source, "event_type", "ts").isStreaming and F is not None
