"""Discretisation of targets and correlation-based selection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.ranks import counted, quantiles
from tidewright.operators.clean import safe_divide
from tidewright.session import staged


@dataclass
class Discretizer:
    """Labels of a numeric target: direction, or bins that are quantile, uniform or fixed.

    Bins are right-closed, the lowest edge belonging to the first; what lies outside, and missing values, get -1.
    """

    strategy: str = "direction"
    n_bins: int = 3
    threshold: float = 0.0
    edges: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, column: str) -> Discretizer:
        """Finds the edges; one aggregate, of which the driver gets the edges alone."""
        if self.strategy == "quantile":
            found = quantiles(df, [], [column], [k / self.n_bins for k in range(self.n_bins + 1)]).first()
            self.edges = sorted({x for x in found if x is not None})
        elif self.strategy == "uniform":
            low, high = df.agg(F.min(column), F.max(column)).first()
            step = (high - low) / self.n_bins
            self.edges = [low - 0.001 * (high - low), *(low + step * k for k in range(1, self.n_bins)), high]
        elif self.strategy == "fixed":
            if not self.edges:
                raise ValueError("fixed bins need edges")
        elif self.strategy != "direction":
            raise ValueError(f"unknown strategy {self.strategy!r}")
        return self

    def transform(self, c: Column) -> Column:
        if self.strategy == "direction":
            return F.when(c > self.threshold, 1).when(c < -self.threshold, -1).otherwise(0)
        out = F.lit(-1)
        for k in range(len(self.edges) - 2, -1, -1):
            low = c >= self.edges[k] if k == 0 else c > self.edges[k]
            out = F.when(low & (c <= self.edges[k + 1]), k).otherwise(out)
        return out

    def inverse(self, label: Column) -> Column:
        """The centre of a bin; missing for labels without one. A direction stands for itself."""
        if self.strategy == "direction" or not self.edges:
            return label.cast("double")
        out = F.lit(None).cast("double")
        for k, (a, b) in enumerate(zip(self.edges, self.edges[1:], strict=False)):
            out = F.when(label == k, (a + b) / 2).otherwise(out)
        return out

    def names(self) -> dict[int, str]:
        if self.strategy == "direction":
            return {-1: "down", 0: "neutral", 1: "up"}
        return {k: f"[{a:.4f}, {b:.4f})" for k, (a, b) in enumerate(zip(self.edges, self.edges[1:], strict=False))}


def _pairs(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(column, x, y, n): how often each pair of present values of a column and the target occurs; written, for it is read several times."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"), F.col(target).cast("double").alias("y")) for c in columns]))
    present = df.select(each.alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL")
    return staged(present.groupBy("column", "x", "y").agg(F.count("*").alias("n")))


def _side(pairs: DataFrame, side: str) -> DataFrame:
    """Counts of one side's values of each column, running ones beside them."""
    return counted(pairs.select("column", F.col(side).alias("value"), "n"), ["column"], {"n": F.col("n")}).withColumnRenamed("value", side)


def _all(df: DataFrame, columns: list[str], found: DataFrame) -> DataFrame:
    """A row for each column, also those that have no correlation."""
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(F.broadcast(found), "feature", "left").select("feature", "correlation")


def _spearman(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Correlation of average ranks, taken over the rows where both are present, from counts of pairs of values."""
    pairs = _pairs(df, target, columns)
    # less the mean rank, so that sums of products stay small
    rank = F.col("n_below") + (F.col("n") + 1) / 2 - (F.col("n_all") + 1) / 2
    for side in "xy":
        pairs = pairs.join(_side(pairs, side).select("column", side, rank.alias(f"r{side}")), ["column", side])
    rx, ry, n = F.col("rx"), F.col("ry"), F.col("n")
    found = pairs.groupBy(F.col("column").alias("feature")).agg(safe_divide(F.sum(n * rx * ry), F.sqrt(F.sum(n * rx * rx)) * F.sqrt(F.sum(n * ry * ry))).alias("correlation"))
    return _all(df, columns, found)


def correlation_with(df: DataFrame, target: str, columns: list[str], method: str = "pearson") -> DataFrame:
    """(feature, correlation) of each column with the target; a constant column has none."""
    if method == "kendall":
        return _kendall(df, target, columns)
    if method == "spearman":
        return _spearman(df, target, columns)
    if method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    both = lambda c: F.col(c).isNotNull() & F.col(target).isNotNull()
    x = lambda c: F.when(both(c), F.col(c).cast("double"))
    y = lambda c: F.when(both(c), F.col(target).cast("double"))
    # sums leave a constant column a deviation of a few ulps: bounds tell it exactly
    varied = lambda c: (F.min(x(c)) < F.max(x(c))) & (F.min(y(c)) < F.max(y(c)))
    r = lambda c: F.when(varied(c), safe_divide(F.covar_samp(x(c), y(c)), F.stddev_samp(x(c)) * F.stddev_samp(y(c))))
    row = df.agg(*[r(c).alias(c) for c in columns])
    return row.select(F.explode(F.create_map(*[v for c in columns for v in (F.lit(c), F.col(c))])).alias("feature", "correlation"))


#: Distinct pairs that a range of either side is meant to hold for Kendall's tau, and the most ranges of a side.
KENDALL_RANGE, KENDALL_MOST = 500_000, 1000


def _below(at: Column) -> Callable[[Column], Column]:
    return lambda v: v < at


def concordance(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """Sum over pairs of sign(difference in a) * sign(difference in b) * both weights, by counting while halves merge."""
    keys, place = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
    a, b = keys
    w = np.bincount(place.ravel(), w).astype(np.float64)
    rank = np.unique(b, return_inverse=True)[1].astype(np.int64)
    n, wide, total = len(w), int(rank.max(initial=0)) + 1, 0.0
    at = np.arange(n)
    size = 1
    while size < n:
        block, right = at // (2 * size), (at // size) % 2 == 1
        left = np.flatnonzero(~right)
        left = left[np.lexsort((rank[left], block[left]))]
        key, upto = block[left] * wide + rank[left], np.concatenate([[0.0], np.cumsum(w[left])])
        one = np.flatnonzero(right)
        own = block[one] * wide + rank[one]
        first, last = np.searchsorted(key, block[one] * wide), np.searchsorted(key, (block[one] + 1) * wide)
        less, more = np.searchsorted(key, own), np.searchsorted(key, own, side="right")
        total += float((w[one] * ((upto[less] - upto[first]) - (upto[last] - upto[more]))).sum())
        size *= 2
    # pairs with equal a stand in the order of b and were counted as rising
    group = np.unique(a, return_inverse=True)[1]
    same = np.bincount(group, w)
    return total - float((same**2).sum() - (w**2).sum()) / 2


def _kendall(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Kendall's tau-b, exactly, by counting over ranges of values.

    Both sides are cut into ranges; a value that is frequent enough to be a cut point is a range of its own. Pairs of
    rows in different ranges on both sides follow from counts by cell, those that share a range are counted within it
    in one task. Sums are exact while the number of pairs of rows fits 53 bits.
    """
    pairs = _pairs(df, target, columns)
    most = pairs.groupBy("column").count().agg(F.max("count")).first()[0] or 0
    ranges = min(KENDALL_MOST, -(-most // KENDALL_RANGE))
    placed = pairs
    for side in "xy":
        if ranges > 1:
            cuts = pairs.groupBy("column").agg(F.array_distinct(F.percentile_approx(side, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 100 * ranges)).alias("_cuts"))
            at = F.col(side)
            below, among = F.size(F.filter("_cuts", _below(at))), F.array_contains("_cuts", at).cast("int")
            placed = placed.join(F.broadcast(cuts), "column").withColumn(f"r{side}", 2 * below + among).drop("_cuts")  # ranges of each column, at most KENDALL_MOST
        else:
            placed = placed.withColumn(f"r{side}", F.lit(0))
    placed = staged(placed)
    out = "column string, s double"

    def count(first: str, second: str):
        def run(key, rows):
            return pd.DataFrame({"column": [key[0]], "s": [concordance(rows[first].to_numpy(float), rows[second].to_numpy(float), rows["n"].to_numpy(float))]})

        return run

    cells = placed.groupBy("column", "rx", "ry").agg(F.sum("n").alias("n"))  # at most the square of twice KENDALL_MOST a column
    sums = cells.groupBy("column").applyInPandas(count("rx", "ry"), out)
    # a range of one value holds ties only
    sums = sums.unionAll(placed.where("rx % 2 = 0").groupBy("column", "rx").applyInPandas(count("x", "y"), out))
    sums = sums.unionAll(placed.where("ry % 2 = 0").groupBy("column", "ry").applyInPandas(count("rx", "y"), out))
    untied = {}
    for side in "xy":
        ties = pairs.groupBy("column", side).agg(F.sum("n").cast("double").alias("t"))
        untied[side] = ties.groupBy("column").agg(((F.pow(F.sum("t"), 2) - F.sum(F.col("t") * F.col("t"))) / 2).alias(f"u{side}"))
    found = sums.groupBy("column").agg(F.sum("s").alias("s")).join(untied["x"], "column").join(untied["y"], "column")
    return _all(df, columns, found.select(F.col("column").alias("feature"), safe_divide(F.col("s"), F.sqrt("ux") * F.sqrt("uy")).alias("correlation")))


def top_correlated(df: DataFrame, target: str, columns: list[str], k: int = 10, method: str = "pearson") -> DataFrame:
    """The k features of the highest absolute correlation, ties by name."""
    found = correlation_with(df, target, columns, method).withColumn("correlation", F.abs("correlation"))
    return found.where("correlation IS NOT NULL").orderBy(F.desc("correlation"), "feature").limit(k)
