"""Series: rows with a key, ordered by time and a tie-breaker; windows, positions, slices and blocks over them.

A window brings a whole series into one task. That is the fastest plan while series are short, and none where one of
them holds a third of all rows. So operators ask for the longest series first (a count by key) and beyond
``Series.longest`` rows go another way to the same result:

* frames of bounded size run over blocks of rows that overlap by the frame (``windowed``);
* frames from a series' first row on are aggregated within slices of its time, and what all slices before one add up
  to, a row a slice, is joined to it (``running``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window, WindowSpec

from tidewright.session import staged


@dataclass(frozen=True)
class Series:
    """Names of the columns that make rows a set of series; ``seq`` breaks ties so that order is unique.

    longest: rows of a series that one task windows over. slice and measured are set by sliced().
    """

    key: tuple[str, ...] = ("series",)
    ts: str = "ts"
    seq: tuple[str, ...] = ()
    longest: int = 4_000_000
    slice: str | None = None
    measured: bool = False

    @property
    def order(self) -> tuple[str, ...]:
        return (self.ts, *self.seq)

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.key).orderBy(*self.order)

    def frame(self, size: int) -> WindowSpec:
        """The last ``size`` rows, this one included."""
        return self.w.rowsBetween(1 - size, 0)

    @property
    def past(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def future(self) -> WindowSpec:
        """This row and those after it, from the last one back: a frame that grows, so each row is looked at once.

        The nearest present value ahead is F.last(c, True) over it.
        """
        return Window.partitionBy(*self.key).orderBy(*[F.desc(c) for c in self.order]).rowsBetween(Window.unboundedPreceding, 0)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.key)

    def numeric(self, df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
        """Numeric columns beside key, time and tie-breaker."""
        own = {*self.key, *self.order, *without, self.slice}
        return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in own]


BARS = Series()


def clean(c: Column) -> Column:
    """NaN as NULL: NULL stands for a missing value everywhere in the engine."""
    return F.nanvl(c, F.lit(None).cast("double"))


def full(spec: Series, size: int, value: Column, counted: Column) -> Column:
    """A window value that is missing until the frame holds ``size`` present values."""
    return F.when(F.count(counted).over(spec.frame(size)) == size, value)


def beside(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics beside every row: by key (a null key is one, too), or the one row of the whole table."""
    if not keys:
        return df.crossJoin(F.broadcast(stats))
    named = stats.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & df[k].eqNullSafe(named[f"_key_{i}"])
    return df.join(named, on, "left").drop(*(f"_key_{i}" for i in range(len(keys))))


_SLICE, _FINE = "_slice", 16


def sliced(df: DataFrame, spec: Series) -> tuple[DataFrame, Series]:
    """The rows and the spec to go on with: as they are if every series fits a task, else with a slice of time a row.

    A series is cut into many equal spans of its time, which are counted and joined again to slices of about
    ``longest`` rows: what one span holds beyond that, a burst in time, stays together.
    """
    if spec.measured:
        return df, spec
    measured = replace(spec, measured=True)
    kind = dict(df.dtypes)[spec.ts]
    at = F.unix_micros(F.col(spec.ts).cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else F.col(spec.ts).cast("double")
    counts = df.groupBy(*spec.key).agg(F.count("*").alias("_n"))
    if (counts.agg(F.max("_n")).first()[0] or 0) <= spec.longest:
        return df, measured
    bounds = staged(df.groupBy(*spec.key).agg(F.count("*").alias("_n"), F.min(at).alias("_a"), F.max(at).alias("_b")))
    spans = _FINE * F.ceil(F.col("_n") / spec.longest)
    span = F.least(F.floor((at - F.col("_a")) / (F.col("_b") - F.col("_a") + 1) * spans), spans - 1)
    placed = beside(df, bounds, list(spec.key)).withColumn("_span", F.coalesce(span, F.lit(0)).cast("bigint")).drop("_n", "_a", "_b")
    before = F.sum("_m").over(Window.partitionBy(*spec.key).orderBy("_span")) - F.col("_m")
    slices = staged(placed.groupBy(*spec.key, "_span").agg(F.count("*").alias("_m")).withColumn(_SLICE, F.floor(before / spec.longest)).drop("_m"))
    return beside(placed, slices, [*spec.key, "_span"]).drop("_span"), replace(measured, slice=_SLICE)


def unsliced(df: DataFrame, given: Series, used: Series) -> DataFrame:
    """Without the slices that sliced() added on the way from one spec to the other."""
    return df.drop(used.slice) if used.slice and not given.slice else df


def _sum(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


#: Aggregates over a growing frame: (over rows, over a whole slice given the value and its place, of all before and here).
RUNNING: dict[str, tuple[Callable, Callable, Callable]] = {
    "last": (lambda c: F.last(c, True), lambda c, at: F.max_by(c, F.when(c.isNotNull(), at)), lambda before, here: F.coalesce(here, before)),
    "first": (lambda c: F.first(c, True), lambda c, at: F.min_by(c, F.when(c.isNotNull(), at)), lambda before, here: F.coalesce(before, here)),
    "sum": (F.sum, lambda c, at: F.sum(c), _sum),
    "count": (F.count, lambda c, at: F.count(c), _sum),
    "max": (F.max, lambda c, at: F.max(c), lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda c, at: F.min(c), lambda a, b: F.least(a, b)),
    "product": (F.product, lambda c, at: F.product(c), lambda a, b: F.coalesce(a * b, a, b)),
}
#: How slices' totals add up: counts by their sum, the others by themselves.
_OVER = {k: v[0] for k, v in RUNNING.items()} | {"count": F.sum}


def running(df: DataFrame, spec: Series, values: dict[str, tuple[str, Column]], ahead: bool = False) -> DataFrame:
    """Adds aggregates of all rows of a series up to each one, or from it on if ``ahead``: {name: (kind of RUNNING, column)}.

    last and first take present values; ahead, "last" is the nearest present one from the row on.
    """
    rows, own = sliced(df, spec)
    if own.slice is None:
        frame = own.future if ahead else own.past
        return df.withColumns({name: RUNNING[kind][0](c).over(frame) for name, (kind, c) in values.items()})
    keys = [*own.key, own.slice]
    order = [F.desc(c) if ahead else F.asc(c) for c in own.order]
    rows = rows.withColumns({f"_v_{name}": c for name, (_, c) in values.items()})
    # a place that grows along the frame: ahead, the nearest value stands at the least
    place, turned = F.struct(*own.order), {"last": "first", "first": "last"} if ahead else {}
    totals = rows.groupBy(*keys).agg(*[RUNNING[turned.get(kind, kind)][1](F.col(f"_v_{name}"), place).alias(f"_t_{name}") for name, (kind, _) in values.items()])
    carried = Window.partitionBy(*own.key).orderBy(F.desc(own.slice) if ahead else own.slice).rowsBetween(Window.unboundedPreceding, -1)
    carry = staged(totals.select(*keys, *[(F.last(f"_t_{n}", True) if kind == "last" else F.first(f"_t_{n}", True) if kind == "first" else _OVER[kind](f"_t_{n}")).over(carried).alias(f"_c_{n}") for n, (kind, _) in values.items()]))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = beside(rows.withColumns({f"_h_{n}": RUNNING[kind][0](F.col(f"_v_{n}")).over(inside) for n, (kind, _) in values.items()}), carry, keys)
    out = here.withColumns({n: RUNNING[kind][2](F.col(f"_c_{n}"), F.col(f"_h_{n}")) for n, (kind, _) in values.items()})
    return unsliced(out.drop(*(f"_{p}_{n}" for n in values for p in "vhc")), spec, own)


def positions(df: DataFrame, spec: Series, name: str = "position") -> DataFrame:
    """Numbers the rows of each series from 0."""
    return running(df, spec, {name: ("count", F.lit(1))}).withColumn(name, F.col(name) - 1)


def blocked(df: DataFrame, spec: Series, lookback: int, block: int = 1_000_000, lookahead: int = 0) -> tuple[DataFrame, Series]:
    """Series cut into blocks of rows, each with copies of the ``lookback`` rows before it and the ``lookahead`` after it.

    Any window within these gives the same over (key, block) as over the series, and no task holds more than
    ``block + lookback + lookahead`` rows of one. Returns the rows and the spec to window over; drop the copies with
    ``owned()`` afterwards.
    """
    at = positions(df, spec, "_position")
    block = max(block, lookback, lookahead, 1)
    own, inside = F.floor(F.col("_position") / block), F.col("_position") % block
    none = F.array().cast("array<bigint>")
    held = F.concat(F.array(own), F.when(inside >= block - lookback, F.array(own + 1)).otherwise(none), F.when((inside < lookahead) & (own > 0), F.array(own - 1)).otherwise(none))
    return at.withColumn("_own", own).withColumn("_block", F.explode(held)), replace(spec, key=(*spec.key, "_block"), slice=None, measured=True)


def owned(df: DataFrame) -> DataFrame:
    """Drops the copies that blocked() made (and blocks that hold nothing else), and its columns."""
    return df.where("_own = _block").drop("_own", "_block", "_position")


def windowed(df: DataFrame, spec: Series, lookback: int, build: Callable[[DataFrame, Series], DataFrame], lookahead: int = 0) -> DataFrame:
    """What ``build`` adds by windows of no more than ``lookback`` rows before and ``lookahead`` after each row, however long a series is.

    build(rows, spec) must keep every row and use the spec it is given.
    """
    rows, own = sliced(df, spec)
    if own.slice is None:
        return build(df, own)
    cut, inner = blocked(rows, own, lookback, own.longest, lookahead)
    return unsliced(owned(build(cut, inner)), spec, own)
