"""Filling, outliers, summaries and naming."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.ranks import quantiles
from tidewright.functions.series import Series, beside, positions, running, sliced, unsliced
from tidewright.session import staged

FILLS = ("forward_fill", "backward_fill", "mean", "median", "interpolate")


def fill_missing(df: DataFrame, spec: Series, strategy: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Fills missing values of each series; mean and median fill numeric columns only.

    interpolate is linear by position: leading gaps stay, trailing ones take the last value.
    """
    if strategy not in FILLS:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(FILLS)}")
    numeric = spec.numeric(df)
    if strategy in ("forward_fill", "backward_fill"):
        names = list(columns) if columns is not None else [c for c in df.columns if c not in (*spec.key, *spec.order, spec.slice)]
        return running(df, spec, {c: ("last", F.col(c)) for c in names}, ahead=strategy == "backward_fill").select(*df.columns)
    names = [c for c in (columns if columns is not None else numeric) if c in numeric]
    if strategy in ("mean", "median"):
        # an aggregate joined back: the series' rows stay spread, only its one value travels
        keys = list(spec.key)
        if strategy == "median":
            values = quantiles(df, keys, names, [0.5])
        else:
            aggs = [F.avg(c).alias(f"{c}_q0") for c in names]
            values = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
        return beside(df, values, keys).withColumns({c: F.coalesce(F.col(c), F.col(f"{c}_q0")) for c in names}).select(*df.columns)
    rows, own = sliced(df, spec)
    at = positions(rows, own, "_at")
    # each present value with its place, so that one frame finds both
    point = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("v"), F.col("_at").alias("r"))) for c in names}
    at = running(at, own, {f"_p_{c}": ("last", x) for c, x in point.items()})
    at = running(at, own, {f"_n_{c}": ("last", x) for c, x in point.items()}, ahead=True)
    p, n = (lambda c, k: F.col(f"_p_{c}")[k]), (lambda c, k: F.col(f"_n_{c}")[k])
    between = lambda c: p(c, "v") + (n(c, "v") - p(c, "v")) * (F.col("_at") - p(c, "r")) / (n(c, "r") - p(c, "r"))
    line = {c: F.coalesce(F.col(c), F.when(F.col(f"_p_{c}").isNotNull() & F.col(f"_n_{c}").isNotNull(), between(c)).otherwise(p(c, "v"))) for c in names}
    return unsliced(at.withColumns(line), spec, own).select(*df.columns)


def _fences(df: DataFrame, keys: list[str], columns: list[str], factor: float) -> DataFrame:
    """_low_{c} and _high_{c} of each group: its quartiles, widened by their distance."""
    q = quantiles(df, keys, columns, [0.25, 0.75])
    a, b = (lambda c: F.col(f"{c}_q0")), (lambda c: F.col(f"{c}_q1"))
    return q.select(*keys, *[x for c in columns for x in ((a(c) - factor * (b(c) - a(c))).alias(f"_low_{c}"), (b(c) + factor * (b(c) - a(c))).alias(f"_high_{c}"))])


def detect_outliers(df: DataFrame, spec: Series, columns: list[str], method: str = "iqr", threshold: float = 1.5, name: str = "is_outlier") -> DataFrame:
    """Flags rows beyond the fences of any column: quartiles (iqr) or sample deviations (zscore)."""
    keys = list(spec.key)
    if method == "iqr":
        seen = beside(df, _fences(df, keys, columns, threshold), keys)
        flag = [(F.col(c) < F.col(f"_low_{c}")) | (F.col(c) > F.col(f"_high_{c}")) for c in columns]
    elif method == "zscore":
        aggs = [x for c in columns for x in (F.avg(c).alias(f"_mean_{c}"), F.stddev_samp(c).alias(f"_sd_{c}"))]
        seen = beside(df, df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs), keys)
        flag = [F.when(F.col(f"_sd_{c}") > 0, F.abs((F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_sd_{c}")) > threshold) for c in columns]
    else:
        raise ValueError(f"unknown method {method!r}")
    total = F.lit(False)
    for f in flag:
        total = total | F.coalesce(f, F.lit(False))
    return seen.withColumn(name, total).select(*df.columns, name)


def winsorize(df: DataFrame, spec: Series, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Clips each column to its own quartile fences; missing values stay."""
    keys = list(spec.key)
    seen = beside(df, _fences(df, keys, columns, factor), keys)
    return seen.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_low_{c}")), F.col(f"_high_{c}"))) for c in columns}).select(*df.columns)


clip_outliers = winsorize


def remove_outliers(df: DataFrame, spec: Series, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Drops rows outside the fences, column by column: each column's fences come from the rows that are left.

    Fences are found one column after the other and stand as numbers (without a key) or as a small written table in
    the plan, which so reads its source once however many columns there are.
    """
    keys, names = list(spec.key), df.columns
    for c in columns:
        fences = _fences(df, keys, [c], factor)
        if keys:
            seen, low, high = beside(df, staged(fences), keys), F.col(f"_low_{c}"), F.col(f"_high_{c}")
        else:
            seen, (low, high) = df, (F.lit(x).cast("double") for x in fences.first())
        df = seen.where(F.col(c).isNull() | low.isNull() | F.col(c).between(low, high)).select(*names)
    return df


def missing_summary(df: DataFrame) -> DataFrame:
    """One row: the rows, and the missing values of each column."""
    return df.agg(F.count("*").alias("rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"missing_{c}") for c in df.columns])


def safe_divide(a: Column, b: Column) -> Column:
    """A zero denominator gives a missing value."""
    return F.try_divide(a, b)


def dedupe_names(df: DataFrame) -> DataFrame:
    """Repeated column names get _1, _2 and so on, passing over names that are taken."""
    taken, seen = set(df.columns), set()
    names = []
    for c in df.columns:
        name, k = c, 0
        while name in seen or (k and name in taken):
            k += 1
            name = f"{c}_{k}"
        seen.add(name)
        names.append(name)
    return df.toDF(*names)


def encode_labels(c: Column, mapping: dict[int, int] | None = None) -> Column:
    """Class labels to consecutive codes; others become missing."""
    mapping = mapping or {-1: 0, 0: 1, 1: 2}
    out = F.lit(None).cast("int")
    for k, v in mapping.items():
        out = F.when(c == k, v).otherwise(out)
    return out
