"""Running things: retries, failure contexts, checkpoints of steps, experiment records, alerts and logs."""

from __future__ import annotations

import functools
import json
import logging
import threading
import time
import traceback
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidewright.sources import files
from tidewright.sources.readers import encode, load_json, save_json


def retry(times: int = 5, wait: float = 2.0, factor: float = 2.0, longest: float = 60.0, on: tuple = (Exception,), sleep: Callable = time.sleep) -> Callable:
    """Calls again after an error, waiting ever longer; the last error is raised."""

    def around(function: Callable) -> Callable:
        @functools.wraps(function)
        def run(*args, **kwargs):
            pause = wait
            for left in range(times, -1, -1):
                try:
                    return function(*args, **kwargs)
                except on:
                    if not left:
                        raise
                    sleep(min(pause, longest))
                    pause *= factor

        return run

    return around


@contextmanager
def recovery(folder: str, run_id: str, longest: int = 200) -> Iterator[None]:
    """Writes what failed, with shortened local values, before the error goes on."""
    try:
        yield
    except Exception as e:
        frame = e.__traceback__
        while frame.tb_next:
            frame = frame.tb_next
        values = {k: repr(v)[:longest] for k, v in frame.tb_frame.f_locals.items()}
        save_json({"run": run_id, "error": repr(e), "trace": traceback.format_exc(), "locals": values}, f"{folder}/{run_id}_failure.json")
        raise


class Steps:
    """Tables and values of a run's steps; a step that is there is read, not made again."""

    def __init__(self, spark: SparkSession, folder: str, run_id: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/{run_id}"

    def table(self, step: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{step}.parquet"
        if not files.exists(f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def value(self, step: str, make: Callable[[], object]) -> object:
        path = f"{self.folder}/{step}.json"
        if not files.exists(path):
            save_json(make(), path)
        return load_json(path)

    def done(self) -> list[str]:
        return [n.rsplit(".", 1)[0] for n in files.listed(self.folder)]


class Tracker:
    """Runs of an experiment as JSON files, wherever the folder lies: parameters, metrics by step, tags, artifacts."""

    def __init__(self, folder: str, experiment: str):
        self.folder = f"{folder.rstrip('/')}/{experiment}"
        self.lock = threading.RLock()

    @contextmanager
    def run(self, name: str = "", **tags: str) -> Iterator[str]:
        run_id = uuid.uuid4().hex[:12]
        self._write(run_id, {"run": run_id, "name": name, "tags": tags, "params": {}, "metrics": {}, "artifacts": [], "status": "running", "start": time.time()})
        try:
            yield run_id
        except BaseException:
            self._update(run_id, status="failed", end=time.time())
            raise
        self._update(run_id, status="finished", end=time.time())

    def _write(self, run_id: str, record: dict) -> None:
        files.write_text(f"{self.folder}/{run_id}.json", json.dumps(record, default=encode))

    def _update(self, run_id: str, **changes) -> None:
        with self.lock:
            self._write(run_id, self.get(run_id) | changes)

    def get(self, run_id: str) -> dict:
        return load_json(f"{self.folder}/{run_id}.json")

    def known(self, run_id: str) -> bool:
        return files.exists(f"{self.folder}/{run_id}.json")

    def artifact_path(self, run_id: str) -> str:
        """Where a run's own files go."""
        return f"{self.folder}/artifacts/{run_id}"

    def params(self, run_id: str, **values) -> None:
        with self.lock:
            self._update(run_id, params=self.get(run_id)["params"] | values)

    def metric(self, run_id: str, name: str, value: float, step: int = 0) -> None:
        with self.lock:
            record = self.get(run_id)
            record["metrics"].setdefault(name, []).append([step, value])
            self._write(run_id, record)

    def artifact(self, run_id: str, path: str) -> None:
        with self.lock:
            self._update(run_id, artifacts=[*self.get(run_id)["artifacts"], path])

    def list(self, **tags: str) -> list[dict]:
        runs = [load_json(f"{self.folder}/{n}") for n in files.listed(self.folder) if n.endswith(".json")]
        return sorted((r for r in runs if all(r["tags"].get(k) == v for k, v in tags.items())), key=lambda r: r["start"])

    def cleanup(self, keep: int) -> int:
        """Removes the oldest runs beyond a number; returns how many."""
        old = self.list()[: -keep or None]
        for r in old:
            files.remove(f"{self.folder}/{r['run']}.json")
        return len(old)


_TESTS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b}


@dataclass
class Alerts:
    """Rules (name, test, bound) on metrics; a rule is silent for a while after it has spoken."""

    rules: list[tuple[str, str, float]]
    cooldown: float = 60.0
    history: deque = field(default_factory=lambda: deque(maxlen=1000))
    clock: Callable[[], float] = time.time
    last: dict = field(default_factory=dict)

    def check(self, metrics: dict[str, float]) -> list[dict]:
        now, out = self.clock(), []
        for name, test, bound in self.rules:
            if name in metrics and _TESTS[test](metrics[name], bound) and now - self.last.get((name, test, bound), -1e18) >= self.cooldown:
                self.last[name, test, bound] = now
                out.append({"metric": name, "value": metrics[name], "test": test, "bound": bound, "time": now})
        self.history.extend(out)
        return out


class Monitor:
    """Calls a function of measurements at intervals in a background thread until it is stopped."""

    def __init__(self, measure: Callable[[], dict], told: Callable[[dict], None], interval: float = 5.0):
        self.measure, self.told, self.interval = measure, told, interval
        self.ended = threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self.ended.wait(self.interval):
            self.told(self.measure())

    def __enter__(self) -> Monitor:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.ended.set()
        self.thread.join()


class JsonFormatter(logging.Formatter):
    """A log line as one JSON object."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out, default=encode)
