"""Quality metrics, distribution shift and profiles."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidewright.sources import files

EPSILON = 1e-10


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def quality_metrics(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row a column: rows, missing, distinct, and of numeric columns min, max, mean and sample deviation (0 if all is missing)."""
    names = columns or df.columns
    numeric = set(_numeric(df))
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    aggs = [F.count("*").alias("rows")]
    for c in names:
        aggs += [F.count(c).alias(f"{c}|present"), distinct(c).alias(f"{c}|distinct")]
        if c in numeric:
            aggs += [F.coalesce(f(c).cast("double"), F.lit(0.0)).alias(f"{c}|{k}") for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))]
    row = df.agg(*aggs)
    stat = lambda c, k: F.col(f"`{c}|{k}`") if c in numeric else F.lit(None).cast("double")
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), (F.col("rows") - F.col(f"`{c}|present`")).alias("missing"), F.col(f"`{c}|distinct`").alias("distinct"), *[stat(c, k).alias(k) for k in ("min", "max", "mean", "std")]) for c in names])
    return row.select(F.explode(each).alias("m")).select("m.*")


def quality_issues(df: DataFrame, columns: list[str] | None = None, max_missing: float = 0.3, min_distinct: float = 0.01) -> DataFrame:
    """(column, issue) of columns with too many missing values, or too few distinct ones in more than 10 rows (times are exempt)."""
    times = {f.name for f in df.schema.fields if f.dataType.typeName() in ("timestamp", "timestamp_ntz", "date")}
    m = quality_metrics(df, columns).withColumn("is_time", F.col("column").isin(*times) if times else F.lit(False))
    n = F.col("rows")
    issues = F.array(
        F.when((n > 0) & (F.col("missing") / F.greatest(n, F.lit(1)) > max_missing), "missing"),
        F.when((n > 10) & ~F.col("is_time") & (F.col("distinct") / F.greatest(n, F.lit(1)) < min_distinct), "few_distinct"),
    )
    return m.select("column", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))


def population_stability(baseline: DataFrame, current: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """(column, psi) over equal-width bins of both tables' common range; 0 where a side is empty or the range is none.

    One pass finds the ranges, one counts; only bins by columns leave the executors.
    """
    long = lambda df, side: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r"), F.lit(side).alias("side")).select("r.column", "r.x", "side").where("x IS NOT NULL")
    rows = long(baseline, 0).unionAll(long(current, 1))
    spans = rows.groupBy("column").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count(F.when(F.col("side") == 0, 1)).alias("n0"), F.count(F.when(F.col("side") == 1, 1)).alias("n1"))
    step = (F.col("b") - F.col("a")) / bins
    place = F.least(F.floor(F.try_divide(F.col("x") - F.col("a"), step)), F.lit(bins - 1))
    counts = rows.join(F.broadcast(spans), "column").groupBy("column", place.alias("bin")).agg(F.count(F.when(F.col("side") == 0, 1)).alias("c0"), F.count(F.when(F.col("side") == 1, 1)).alias("c1"))
    grid = spans.select("column", "a", "b", "n0", "n1", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")).alias("bin")).join(counts, ["column", "bin"], "left")
    share = lambda c, n: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, EPSILON).otherwise(F.try_divide(F.col(c), F.col(n)))
    term = (share("c1", "n1") - share("c0", "n0")) * F.ln(share("c1", "n1") / share("c0", "n0"))
    usable = (F.col("n0") > 0) & (F.col("n1") > 0) & (F.col("b") > F.col("a"))
    found = grid.groupBy("column").agg(F.sum(F.when(usable, term).otherwise(0.0)).alias("psi"))
    every = baseline.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(found, "column", "left").select("column", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def distribution_shift(baseline: DataFrame, current: DataFrame, columns: list[str] | None = None, threshold: float = 0.25, bins: int = 10) -> DataFrame:
    """population_stability() with a flag from the threshold on."""
    names = columns or [c for c in _numeric(baseline) if c in current.columns]
    return population_stability(baseline, current, names, bins).withColumn("shifted", F.col("psi") >= threshold)


def value_counts(df: DataFrame, column: str, share: bool = False) -> DataFrame:
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    if share:
        total = out.agg(F.sum("n").alias("_total"))
        out = out.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")
    return out


def profile(df: DataFrame, level: str = "minimal") -> dict[str, DataFrame]:
    """Tables of a profile: summary (rows, columns, missing cells, duplicate rows, types), columns, and if full, correlations."""
    if level not in ("minimal", "full"):
        raise ValueError("level is minimal or full")
    names, numeric = df.columns, _numeric(df)
    groups = df.groupBy(*names).agg(F.count("*").alias("_n"))
    missing: Column = sum((F.when(F.col(c).isNull(), F.col("_n")).otherwise(0) for c in names), F.lit(0))
    counted = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    summary = counted.withColumns({"columns": F.lit(len(names)), "numeric_columns": F.lit(len(numeric)), "missing_share": F.coalesce(F.try_divide(F.col("missing_cells"), F.col("rows") * len(names)), F.lit(0.0))})
    out = {"summary": summary, "columns": quality_metrics(df), "alerts": quality_issues(df)}
    if level == "full" and len(numeric) > 1:
        from tidewright.operators.bins import correlation_with

        parts = [correlation_with(df, t, [c for c in numeric if c != t]).withColumn("target", F.lit(t)) for t in numeric]
        table = parts[0]
        for p in parts[1:]:
            table = table.unionAll(p)
        out["correlations"] = table
    return out


def compare_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Column metrics of two tables beside each other."""
    names = ["rows", "missing", "distinct", "min", "max", "mean", "std"]
    left, right = (quality_metrics(df).select("column", *[F.col(n).alias(f"{n}_{k}") for n in names]) for df, k in ((a, "a"), (b, "b")))
    return left.join(right, "column", "full_outer")


def write_profile(df: DataFrame, path: str, level: str = "minimal") -> dict:
    """Writes a profile as a page of tables and returns its summary."""
    tables = {k: [r.asDict() for r in t.collect()] for k, t in profile(df, level).items()}  # a row a column at most
    parts = ["<!DOCTYPE html><meta charset=utf-8><title>Profile</title>"]
    for name, rows in tables.items():
        heads = list(rows[0]) if rows else []
        cells = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[h]))}</td>" for h in heads) + "</tr>" for r in rows)
        parts.append(f"<h2>{name}</h2><table><tr>{''.join(f'<th>{html.escape(h)}</th>' for h in heads)}</tr>{cells}</table>")
    files.write_text(path, "\n".join(parts))
    return json.loads(json.dumps(tables["summary"][0], default=str))
