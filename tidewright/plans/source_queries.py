"""Queries of scans, sinks, bundles, profiles and of small operators on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions.series import Series
from tidewright.operators import bins, clean, metrics, quality, resample, splits
from tidewright.plans.catalog import register
from tidewright.plans.inputs import BARS, EVENTS, SQL_BARS, SQL_EVENTS, SQL_SCORES, bars_daily, bars_hourly, events, out, rnd, scores, table
from tidewright.session import prepare, shared_dir
from tidewright.sources import files, readers

_ORDERS = {"o_orderkey": "int32", "o_custkey": "int64", "o_orderstatus": "object", "o_totalprice": "float32", "o_orderdate": "datetime64[ns]", "o_orderpriority": "object"}
_CELLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_ORDER_SQL = f"SELECT {', '.join(_CELLS)}, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders"


def _shown(df):
    return df.select(*_CELLS, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"))


@register("scan_parquet", _ORDER_SQL)
def scan_parquet(spark, sf_dir):
    return _shown(readers.load_parquet(prepare(spark), f"{sf_dir}/orders.parquet", _ORDERS))


_ASSETS = "SELECT 'region' AS asset, r_regionkey, r_name, NULL::INTEGER AS n_nationkey, NULL::VARCHAR AS n_name FROM region UNION ALL SELECT 'nation', NULL, NULL, n_nationkey, n_name FROM nation"
_GEO = ["r_regionkey", "r_name", "n_nationkey", "n_name"]


@register("scan_assets", f"SELECT *, 'none' AS failed FROM ({_ASSETS})")
def scan_assets(spark, sf_dir):
    """Two assets as one table; a third that is not there is told in the status."""
    status: dict = {}
    df = readers.load_assets(spark, sf_dir, ["region", "nation", "none"], status=status)
    return df.select("asset", *_GEO, F.lit(status["failed_assets"][0]["asset"]).alias("failed"))


@register("scan_config", f"SELECT 'geo' AS category, * FROM ({_ASSETS}) UNION ALL SELECT 'again', * FROM ({_ASSETS}) WHERE asset = 'region'")
def scan_config(spark, sf_dir):
    """Categories of a configuration; one without assets is left out."""
    config = {"sources": {"geo": {"path": sf_dir, "assets": ["region", "nation"]}, "again": {"path": sf_dir, "assets": ["region"]}, "empty": {"path": sf_dir}, "odd": 3}}
    return readers.load_from_config(spark, config).select("category", "asset", *_GEO)


#: A schema with a column that is not there, two of other types, and two that say less than the table.
_DECLARED = {"o_orderkey": "int8", "o_custkey": "float64", "o_orderstatus": "object", "o_totalprice": "int64", "o_orderdate": "datetime64", "o_nothing": "float64"}
_KINDS = "CASE column_type WHEN 'BIGINT' THEN 'int' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'object' WHEN 'TIMESTAMP' THEN 'datetime64' END"
_REPORT = f"""WITH f AS (SELECT column_name AS name, {_KINDS} AS kind FROM (DESCRIBE orders)),
d AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{t.rstrip('0123456789') if not t.startswith('datetime') else t}')" for c, t in _DECLARED.items())}) AS v(name, kind))
SELECT coalesce(d.name, f.name) AS name, CASE WHEN f.name IS NULL THEN 'missing' WHEN d.name IS NULL THEN 'extra' ELSE 'type' END AS problem FROM d FULL JOIN f ON d.name = f.name WHERE f.name IS NULL OR d.name IS NULL OR d.kind <> f.kind"""


def _problems(report: dict) -> list[tuple[str, str]]:
    found = [(c, "missing" if v["found"] is None else "type") for c, v in report["schema_violations"].items()]
    return found + [(w.split()[-1], "extra") for w in report["warnings"]]


@register("schema_report", _REPORT)
def schema_report(spark, sf_dir):
    """What a table violates of a declared schema: found from its schema alone."""
    return spark.createDataFrame(_problems(readers.validate_schema(table(spark, sf_dir, "orders"), _DECLARED)), "name string, problem string")


@register("schema_report_logged", _REPORT)
def schema_report_logged(spark, sf_dir):
    """The same from the report that is written for a run."""
    at = readers.write_report(readers.validate_schema(table(spark, sf_dir, "orders"), _DECLARED), shared_dir(spark), "run")
    return spark.createDataFrame(_problems(readers.load_json(at)), "name string, problem string")


@register("sink_parquet", _ORDER_SQL)
def sink_parquet(spark, sf_dir):
    """Written by status, read back."""
    path = shared_dir(spark)
    readers.save_parquet(table(spark, sf_dir, "orders"), path, ("o_orderstatus",))
    return _shown(readers.load_parquet(spark, path, _ORDERS))


@register("sink_json", "SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events")
def sink_json(spark, sf_dir):
    """Rows with missing values as JSON lines, read back under a schema."""
    path = shared_dir(spark)
    readers.save_table_json(table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value")), path)
    return readers.load_table_json(spark, path, "event_id bigint, event_type string, value double")


@register("json_values", "SELECT 'day' AS name, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS value FROM orders UNION ALL SELECT 'n', CAST(count(*) AS VARCHAR) FROM orders")
def json_values(spark, sf_dir):
    """Times and counts of the driver through a JSON file."""
    path = f"{shared_dir(spark)}/x.json"
    row = table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("day"), F.count("*").alias("n")).first()
    readers.save_json(row.asDict(), path)
    return spark.createDataFrame([(k, str(v)) for k, v in readers.load_json(path).items()], "name string, value string")


@register("sink_csv", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def sink_csv(spark, sf_dir):
    """Two appends to one CSV folder, headers not counted as rows."""
    path, n = shared_dir(spark), table(spark, sf_dir, "nation")
    readers.append_csv(n.select("n_nationkey", "n_name"), path)
    readers.append_csv(n.where("n_regionkey = 1").select("n_nationkey", "n_name"), path)
    return spark.read.schema("n_nationkey int, n_name string").option("header", True).csv(path)


@register("bundle", "SELECT o_orderkey, o_totalprice, CAST(o_orderstatus = 'F' AS INTEGER) AS y, 'orders' AS name, 'status' AS target, CASE WHEN o_orderkey < 100 THEN 'train' ELSE 'test' END AS split FROM orders WHERE o_orderkey < 300")
def bundle(spark, sf_dir):
    """Features and targets of a dataset, its metadata and its splits, written and read back; a split that is no pair of positions goes."""
    o = table(spark, sf_dir, "orders")
    parts = {"features": o.select("o_orderkey", "o_totalprice"), "targets": o.select("o_orderkey", F.expr("CAST(o_orderstatus = 'F' AS INT)").alias("y"))}
    folder = shared_dir(spark)
    readers.Bundle(parts, {"name": "orders"}, {"train": [0, 100], "test": [100, 300], "wrong": [5, "x"]}, {"target": "status"}).save(folder)
    b = readers.Bundle.load(spark, folder)
    key, split = F.col("o_orderkey"), F.lit(None)
    for name, (start, stop) in b.splits.items():
        split = F.when((key >= start) & (key < stop), name).otherwise(split)
    both = b.tables["features"].join(b.tables["targets"], "o_orderkey").withColumn("split", split).where("split IS NOT NULL")
    return both.select("o_orderkey", "o_totalprice", "y", F.lit(b.metadata["name"]).alias("name"), F.lit(b.target_meta["target"]).alias("target"), "split")


@register("signed_object", "SELECT n_regionkey, count(*) AS n, true AS signed, false AS forged FROM nation GROUP BY 1")
def signed_object(spark, sf_dir):
    """A driver's object through a signed file; another key does not open it."""
    path = f"{shared_dir(spark)}/counts.bin"
    counts = {r[0]: r[1] for r in table(spark, sf_dir, "nation").groupBy("n_regionkey").count().collect()}
    signature = readers.save_object(counts, path, b"key")
    again = readers.load_object(path, signature, b"key")
    ok = [readers.verify_file(path, signature, k) for k in (b"key", b"other")]
    return spark.createDataFrame([(k, v, *ok) for k, v in again.items()], "n_regionkey int, n bigint, signed boolean, forged boolean")


_AT = f"{SQL_EVENTS}, p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n FROM ev), s AS (SELECT *, CASE WHEN pos < floor(CAST(n AS DOUBLE) * 0.7) THEN 'train' WHEN pos < floor(CAST(n AS DOUBLE) * 0.85) THEN 'validation' ELSE 'test' END AS split FROM p)"


@register("split_parts", f"WITH {_AT} SELECT split AS part, series, event_id FROM s")
def split_parts(spark, sf_dir):
    """The three tables of a split."""
    parts = splits.split_parts(splits.sequential_split(events(spark, sf_dir), EVENTS))
    return parts["train"].withColumn("part", F.lit("train")).unionAll(parts["validation"].withColumn("part", F.lit("validation"))).unionAll(parts["test"].withColumn("part", F.lit("test"))).select("part", "series", "event_id")


@register("split_saved", f"WITH {_AT} SELECT series, CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS train, CAST(count(*) FILTER (WHERE split <> 'test') AS BIGINT) AS upto FROM s GROUP BY 1")
def split_saved(spark, sf_dir):
    """Split boundaries of each series through their JSON file."""
    sizes = splits.sequential_split(events(spark, sf_dir), EVENTS).groupBy("series").agg(F.count(F.when(F.col("split") == "train", 1)).alias("a"), F.count(F.when(F.col("split") != "test", 1)).alias("b"))
    at = splits.save_split(shared_dir(spark), "events", {r.series: [r.a, r.b] for r in sizes.collect()})  # a row a series
    return spark.createDataFrame([(k, *v) for k, v in splits.load_split(at).items()], "series string, train bigint, upto bigint")


@register("standard_unscale", f"SELECT l_orderkey, l_linenumber, {rnd('l_quantity', 'l_quantity')}, {rnd('l_tax', 'told')} FROM lineitem")
def standard_unscale(spark, sf_dir):
    """Scaled by the statistics of some rows, and back."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    train = li.where("l_orderkey % 5 <> 0")
    scaled = splits.standard_scale(li, ["l_quantity", "l_tax"], train).withColumnRenamed("l_tax", "told")
    return out(splits.standard_unscale(scaled, {"l_quantity": "l_quantity", "told": "l_tax"}, train), ["l_orderkey", "l_linenumber"], ["l_quantity", "told"])


@register("support_random", f"WITH {SQL_EVENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY md5('42|' || epoch_us(ts) || '|' || event_id), ts DESC, event_id DESC) AS k FROM ev) SELECT series, event_id FROM k WHERE k <= 60")
def support_random(spark, sf_dir):
    return splits.support_set(events(spark, sf_dir), EVENTS, 60, "random").select("series", "event_id")


_STEP = "WITH s AS (SELECT epoch(ts) - epoch(lag(ts) OVER ({w})) AS s FROM {t}), c AS (SELECT s, count(*) AS n FROM s WHERE s > 0 GROUP BY s), m AS (SELECT CAST(arg_max(s, n * 1e9 - s) AS BIGINT) AS s FROM c) SELECT '{name}' AS name, CASE s WHEN 60 THEN 'min' WHEN 3600 THEN 'h' WHEN 86400 THEN 'D' WHEN 604800 THEN 'W' ELSE CASE WHEN s BETWEEN 2419200 AND 2678400 THEN 'ME' ELSE 'D' END END AS frequency FROM m"
_DAYS = "(SELECT o_orderpriority AS series, o_orderdate AS ts FROM orders GROUP BY 1, 2)"


@register("infer_frequency", " UNION ALL ".join(f"SELECT * FROM ({_STEP.format(w='PARTITION BY series ORDER BY ts', t=t, name=n)})" for n, t in (("hourly", f"(WITH {SQL_BARS} SELECT * FROM bars)"), ("daily", _DAYS))))
def infer_frequency(spark, sf_dir):
    rows = [("hourly", resample.infer_frequency(bars_hourly(spark, sf_dir), BARS)), ("daily", resample.infer_frequency(bars_daily(spark, sf_dir), BARS))]
    return spark.createDataFrame(rows, "name string, frequency string")


_MEASURES = [("rows", "count(*)"), ("missing", "count(*) - count({c})"), ("distinct", "count(DISTINCT {c})"), ("min", "min({c})"), ("max", "max({c})"), ("mean", "avg({c})"), ("std", "stddev_samp({c})")]
_SIDE = ", ".join(f"{rnd(f'CAST({e} AS DOUBLE)', n + '_{k}')}" for n, e in _MEASURES)
_COMPARED = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", a.*, b.* FROM (SELECT {_SIDE.format(c=c, k='a')} FROM lineitem WHERE l_orderkey % 2 = 0) a, (SELECT {_SIDE.format(c=c, k='b')} FROM lineitem WHERE l_orderkey % 2 = 1) b" for c in ("l_quantity", "l_tax"))


@register("compare_profiles", _COMPARED)
def compare_profiles(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a, b = (li.where(f"l_orderkey % 2 = {k}").select("l_quantity", "l_tax") for k in (0, 1))
    names = [f"{n}_{k}" for k in "ab" for n, _ in _MEASURES]
    found = quality.compare_profiles(a, b)
    return out(found.select("column", *[F.col(n).cast("double").alias(n) for n in names]), ["column"], names)


_PC = ["p_partkey", "p_size", "p_retailprice"]


@register("profile_full", " UNION ALL ".join(f"SELECT '{t}' AS target, '{c}' AS feature, {rnd(f'corr({c}, {t})', 'correlation')} FROM part" for t in _PC for c in _PC if c != t))
def profile_full(spark, sf_dir):
    """The full level has correlations beside what the minimal one has."""
    p = table(spark, sf_dir, "part")
    assert "correlations" not in quality.profile(p, "minimal")
    return out(quality.profile(p, "full")["correlations"], ["target", "feature"], ["correlation"])


@register("profile_page", "SELECT CAST(count(*) AS BIGINT) AS \"rows\", 6 AS columns, CAST(0 AS BIGINT) AS missing_cells, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM part)) AS BIGINT) AS duplicate_rows, true AS page FROM part")
def profile_page(spark, sf_dir):
    """A profile made, written as a page and summed up in one call."""
    path = f"{shared_dir(spark)}/part.html"
    s = quality.write_profile(table(spark, sf_dir, "part"), path)
    page = files.read_text(path)
    row = (s["rows"], s["columns"], s["missing_cells"], s["duplicate_rows"], page.startswith("<!DOCTYPE html>") and "p_retailprice" in page)
    return spark.createDataFrame([row], "rows bigint, columns int, missing_cells bigint, duplicate_rows bigint, page boolean")


@register("unknown_names", "SELECT unnest(['fill', 'resample', 'outliers', 'folds', 'task', 'scheme']) AS operator, true AS refused")
def unknown_names(spark, sf_dir):
    """Operators refuse strategies that they do not know."""
    e = events(spark, sf_dir)
    calls = {
        "fill": lambda: clean.fill_missing(e, EVENTS, "magic"), "resample": lambda: resample.resample(e, EVENTS, "h", "magic"), "outliers": lambda: clean.detect_outliers(e, EVENTS, ["value"], "magic"),
        "folds": lambda: splits.whole_folds(e, EVENTS, "magic"), "task": lambda: metrics.all_metrics(e, "magic", "value", "value"), "scheme": lambda: bins.Discretizer("magic").fit(e, "value"),
    }
    rows = []
    for name, call in calls.items():
        try:
            call()
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "operator string, refused boolean")


@register("dedupe_names", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS k_1, r_name AS name_2, 1 AS name_1 FROM nation JOIN region ON n_regionkey = r_regionkey")
def dedupe_names(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("k"), F.col("r_name").alias("name"), F.lit(1).alias("name_1"))
    return clean.dedupe_names(both)


@register("bin_names", "SELECT event_id, CASE WHEN value >= 10 AND value <= 20 THEN '[10.0000, 20.0000)' WHEN value > 20 AND value <= 50 THEN '[20.0000, 50.0000)' WHEN value > 50 AND value <= 80 THEN '[50.0000, 80.0000)' END AS name, CASE WHEN value > 50 THEN 'up' WHEN value < -50 THEN 'down' ELSE 'neutral' END AS direction FROM events")
def bin_names(spark, sf_dir):
    fixed, direction = bins.Discretizer("fixed", edges=[10.0, 20.0, 50.0, 80.0]), bins.Discretizer("direction", threshold=50.0)

    def named(d):
        return F.create_map(*[x for k, v in d.names().items() for x in (F.lit(k), F.lit(v))])[d.transform(F.col("value"))]

    return events(spark, sf_dir).select("event_id", named(fixed).alias("name"), named(direction).alias("direction"))


_ALL_CLS = "WITH {s}, d AS (SELECT y, p, CAST(p >= 0.5 AS INTEGER) AS g FROM sc), c AS (SELECT CASE {w} END AS bin, count(*) AS n, avg(y) AS a, avg(p) AS q FROM sc GROUP BY 1), k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS k FROM sc)"
_EDGES = metrics.bin_edges(10)
_WHEN = " ".join(f"WHEN p >= {_EDGES[k]!r}::DOUBLE AND p {'<=' if k == 9 else '<'} {_EDGES[k + 1]!r}::DOUBLE THEN {k}" for k in range(10))
# five digits: the sixth of the mean squared error is a half on one of the tables, and sums differ in their last bits
_DISPATCH = ", ".join([
    rnd("(SELECT avg(CAST(y = g AS DOUBLE)) FROM d)", "accuracy", 5), rnd("(SELECT avg((p - y) * (p - y)) FROM d)", "brier_score", 5),
    rnd("(SELECT sum(abs(a - q) * n) / sum(n) FROM c WHERE bin IS NOT NULL)", "calibration_ece", 5), rnd("(SELECT max(abs(a - q)) FROM c WHERE bin IS NOT NULL)", "calibration_mce", 5),
    rnd("(SELECT (sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) FROM k)", "roc_auc", 5),
    rnd("(SELECT avg((o_totalprice - 150000) * (o_totalprice - 150000)) FROM orders)", "mse", 3), rnd("(SELECT avg(abs(o_totalprice - 150000)) FROM orders)", "mae", 3),
])


@register("metric_dispatch", f"{_ALL_CLS.format(s=SQL_SCORES, w=_WHEN)} SELECT {_DISPATCH}")
def metric_dispatch(spark, sf_dir):
    """All metrics of a classifier with probabilities, and those of a regression."""
    told = scores(spark, sf_dir).withColumn("g", (F.col("p") >= 0.5).cast("int"))
    a = metrics.all_metrics(told, "classification", "y", "g", "p")
    b = metrics.all_metrics(table(spark, sf_dir, "orders").withColumn("flat", F.lit(150000.0)), "regression", "o_totalprice", "flat")
    both = out(a, [], ["accuracy", "brier_score", "calibration_ece", "calibration_mce", "roc_auc"], 5)
    return both.crossJoin(F.broadcast(out(b, [], ["mse", "mae"], 3)))


_TABLE = "SELECT 'flat' AS model, 'mae' AS metric, " + rnd("avg(abs(o_totalprice - 150000))", "value", 3) + " FROM orders UNION ALL SELECT 'flat', 'mse', " + rnd("avg((o_totalprice - 150000) * (o_totalprice - 150000))", "value", 3) + " FROM orders"


@register("model_table", _TABLE)
def model_table(spark, sf_dir):
    """Metrics of models by name; those of training and of other models are left out, and a model without any is none."""
    o = table(spark, sf_dir, "orders").withColumn("flat", F.lit(150000.0))
    found = metrics.regression_metrics(o, "o_totalprice", "flat").select("mse", "mae").first().asDict()
    told = metrics.model_table(spark, {"flat": found | {"train_mse": 1.0}, "other": {"mse": 2.0}, "flat_failed": None}, "flat")
    return out(told, ["model", "metric"], ["value"], 3)


@register("ffill_null_key", "SELECT o_orderkey, last_value(s IGNORE NULLS) OVER (PARTITION BY k ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 3 END AS k, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS s FROM orders)")
def ffill_null_key(spark, sf_dir):
    """Rows of a missing key are a series as well; here every series is cut into slices of its time."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 3).alias("k"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("s"))
    return clean.fill_missing(o, Series(("k",), "ts", ("o_orderkey",), longest=300), "forward_fill", ["s"]).select("o_orderkey", "s")
