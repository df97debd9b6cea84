"""Exponentially weighted means and deviations by window sums alone.

The recursion y = a*x + (1-a)*y' is a weighted sum with weights (1-a)**age. Rows are numbered from the first present
value and cut into blocks so long that a weight one block old is below 1e-17. Within a block the sum is a running sum
of x * (1-a)**-place, which stays in range; from the block before only its last sum counts. For the same reason a series
too long for one task is computed in blocks that overlap by reach(span) rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from tidewright.functions.series import Series, blocked, owned, positions, running, sliced, unsliced, windowed


def alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def reach(span: float) -> int:
    """Rows after which a weight is below 1e-17."""
    decay = 1.0 - alpha(span)
    return max(2, math.ceil(math.log(1e-17) / math.log(decay))) if 0 < decay < 1 else 2


def _weighted_sums(df: DataFrame, spec: Series, values: dict[str, Column], a: float) -> DataFrame:
    """Adds, for each named column, the sum of value * (1-a)**age over the past; and _n, the count of present rows."""
    decay = 1.0 - a
    block = reach(2 / a - 1)
    block = min(block, int(300 / max(1e-9, -math.log10(decay)))) if 0 < decay < 1 else block
    present = None
    for c in values.values():
        present = c.isNotNull() if present is None else present & c.isNotNull()
    df = df.withColumn("_n", F.count(F.when(present, 1)).over(spec.past))
    df = df.withColumn("_b", F.floor((F.col("_n") - 1) / block)).withColumn("_j", (F.col("_n") - 1) % block)
    inside = Window.partitionBy(*spec.key, "_b").orderBy(*spec.order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_s_{k}": F.sum(F.when(present, c * F.pow(F.lit(decay), -F.col("_j").cast("double")))).over(inside) * F.pow(F.lit(decay), F.col("_j").cast("double")) for k, c in values.items()})
    last = {k: F.last(F.when(F.col("_j") == block - 1, F.col(f"_s_{k}")), True).over(spec.w.rowsBetween(Window.unboundedPreceding, -1)) for k in values}
    df = df.withColumns({f"_p_{k}": v for k, v in last.items()})
    return df.withColumns({k: F.when(F.col("_n") > 0, F.col(f"_s_{k}") + F.coalesce(F.col(f"_p_{k}") * F.pow(F.lit(decay), (F.col("_j") + 1).cast("double")), F.lit(0.0))) for k in values}).drop("_b", "_j", *(f"_s_{k}" for k in values), *(f"_p_{k}" for k in values))


def ewm_mean(df: DataFrame, spec: Series, columns: dict[str, str | Column], span: float) -> DataFrame:
    """Adds ewm means (adjust=False) under the given names; values may be missing only before the first present one.

    The first value has the weight of all that would have come before it. For interior gaps see ewm_mean_gaps().
    Values given as columns hold no window; add those as columns first.
    """
    a = alpha(span)

    def build(df: DataFrame, spec: Series) -> DataFrame:
        for name, c in columns.items():
            c = F.col(c) if isinstance(c, str) else c
            df = df.withColumn("_x", c)
            df = df.withColumn("_x0", F.first("_x", True).over(spec.past))
            df = _weighted_sums(df, spec, {"_sum": F.col("_x")}, a)
            df = df.withColumn(name, F.lit(a) * F.col("_sum") + F.pow(F.lit(1 - a), F.col("_n").cast("double")) * F.col("_x0")).drop("_x", "_x0", "_sum", "_n")
        return df

    return windowed(df, spec, reach(span), build)


def ewm_std(df: DataFrame, spec: Series, name: str, column: str | Column, span: float) -> DataFrame:
    """Adds the bias-corrected ewm deviation (adjust=True); missing for fewer than two values."""
    a = alpha(span)
    r = 1 - a
    c = F.col(column) if isinstance(column, str) else column

    def build(df: DataFrame, spec: Series) -> DataFrame:
        df = _weighted_sums(df.withColumn("_x", c), spec, {"_m": F.col("_x"), "_q": F.col("_x") * F.col("_x")}, a)
        n = F.col("_n").cast("double")
        w, w2 = (1 - F.pow(F.lit(r), n)) / (1 - r), (1 - F.pow(F.lit(r * r), n)) / (1 - r * r)
        variance = F.greatest(F.col("_q") / w - F.pow(F.col("_m") / w, 2), F.lit(0.0)) * F.try_divide(w * w, w * w - w2)
        return df.withColumn(name, F.when(F.col("_n") > 1, F.sqrt(variance))).drop("_x", "_m", "_q", "_n")

    return windowed(df, spec, reach(span), build)


def ewm_mean_gaps(df: DataFrame, spec: Series, name: str, column: str, span: float, block: int = 1_000_000) -> DataFrame:
    """As ewm_mean(), with missing values between present ones: weights go on decaying across a gap.

    Present values are taken in blocks of ``block`` that overlap by reach(span) of them, since each weighs the one
    before by (1-a) at most; between them the mean stays what it was.
    """
    a = alpha(span)
    rows, own = sliced(df, spec)
    at = positions(rows, own, "_at")
    keys, order = list(own.key), list(own.order)
    parts, inner = blocked(at.where(F.col(column).isNotNull()).select(*keys, *order, *([own.slice] if own.slice else []), "_at", F.col(column).cast("double").alias("_x")), own, reach(span), block)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_at")
        x, place = frame["_x"].to_numpy(float), frame["_at"].to_numpy(np.int64)
        old = (1 - a) ** np.diff(place, prepend=place[0]).astype(float)
        mean, out = x[0], np.empty(len(x))
        for k, (v, w) in enumerate(zip(x.tolist(), old.tolist(), strict=True)):
            mean = (w * mean + a * v) / (w + a) if k else v
            out[k] = mean
        frame[name] = out
        return frame

    schema = StructType([*parts.schema.fields, StructField(name, DoubleType())])
    told = owned(parts.groupBy(*inner.key).applyInPandas(run, schema)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_at").alias("_ka"), name)
    on = F.col("_at") == F.col("_ka")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = at.join(told, on, "left").drop("_ka", *(f"_k{i}" for i in range(len(keys))))
    return unsliced(running(joined, own, {name: ("last", F.col(name))}).drop("_at"), spec, own)
