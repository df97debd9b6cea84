"""Exact order statistics from counts by value: no task holds all values of a column, and no order of all rows is made.

Equal values become one row with their count. Of each group's values, as many cut points as its size asks for split
the rest into ranges; running counts go within the ranges, and what the ranges before add up to is joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions.series import beside

#: Rows whose distinct values a range is meant to hold, and ranges at most (larger ones are sorted on disk).
RANGE, MOST = 2_000_000, 10_000


def long(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, value) of the present values of some columns."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    return df.select(*keys, each.alias("_v")).select(*keys, "_v.column", "_v.value").where("value IS NOT NULL")


def counted(values: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """Sums of rows by (keys, value), each beside its running sum below the value and its total: {name}, {name}_below, {name}_all.

    ``counts`` says what a row adds to each sum.
    """
    by = values.groupBy(*keys, "value").agg(*[F.sum(c).cast("bigint").alias(n) for n, c in counts.items()])
    ranges = min(MOST, -(-(values.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) // RANGE))
    if ranges <= 1:
        order, whole = Window.partitionBy(*keys).orderBy("value"), Window.partitionBy(*keys)
        return by.withColumns({f"{n}_{k}": v for n in counts for k, v in (("below", F.sum(n).over(order) - F.col(n)), ("all", F.sum(n).over(whole)))})
    cuts = F.percentile_approx("value", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 100 * ranges)
    placed = beside(by, by.groupBy(*keys).agg(cuts.alias("_cuts")), keys)
    placed = placed.withColumn("_range", F.size(F.filter("_cuts", lambda x: x < F.col("value")))).drop("_cuts")
    sums = placed.groupBy(*keys, "_range").agg(*[F.sum(n).alias(f"_s_{n}") for n in counts])
    before, whole = Window.partitionBy(*keys).orderBy("_range"), Window.partitionBy(*keys)
    offsets = sums.select(*keys, "_range", *[x for n in counts for x in ((F.sum(f"_s_{n}").over(before) - F.col(f"_s_{n}")).alias(f"_o_{n}"), F.sum(f"_s_{n}").over(whole).alias(f"{n}_all"))])
    inside = Window.partitionBy(*keys, "_range").orderBy("value")
    found = beside(placed, offsets, [*keys, "_range"])
    return found.withColumns({f"{n}_below": F.col(f"_o_{n}") + F.sum(n).over(inside) - F.col(n) for n in counts}).drop("_range", *(f"_o_{n}" for n in counts))


def quantiles(df: DataFrame, keys: list[str], columns: list[str], shares: list[float]) -> DataFrame:
    """One row a group (one row if there are no keys): {column}_q{i}, the i-th share's quantile by linear interpolation; missing without values."""
    found = counted(long(df, keys, columns), [*keys, "column"], {"n": F.lit(1)})
    place = [F.lit(float(p)) * (F.col("n_all") - 1) for p in shares]
    aggs = []
    for i, at in enumerate(place):
        for side, rank in (("a", F.floor(at)), ("b", F.ceil(at))):
            aggs.append(F.max(F.when((F.col("n_below") <= rank) & (rank < F.col("n_below") + F.col("n")), F.col("value"))).alias(f"{side}{i}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"f{i}"))
    per = found.groupBy(*keys, "column").agg(*aggs)
    value = {i: F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"f{i}") for i in range(len(shares))}
    wide = [F.max(F.when(F.col("column") == c, v)).alias(f"{c}_q{i}") for c in columns for i, v in value.items()]
    return per.groupBy(*keys).agg(*wide) if keys else per.agg(*wide)
