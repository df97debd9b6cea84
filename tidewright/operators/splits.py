"""Splits by position, folds, leakage checks, sequences, support sets and scaling."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions.series import Series, beside, positions, sliced, unsliced, windowed
from tidewright.sources import files


@dataclass(frozen=True)
class Fold:
    """Positions of a fold: training from ``start``, then validation, then test; each end is exclusive."""

    fold: int
    start: int
    train_end: int
    validation_end: int
    test_end: int


def sequential_cuts(n: int, train: float = 0.7, validation: float = 0.15, test: float = 0.15) -> tuple[int, int]:
    if abs(train + validation + test - 1) > 1e-6:
        raise ValueError("ratios must add up to 1")
    return int(n * train), int(n * (train + validation))


def sequential_split(df: DataFrame, spec: Series, train: float = 0.7, validation: float = 0.15, test: float = 0.15) -> DataFrame:
    """Adds ``split``: each series' first rows train, the next validate, the last test."""
    sequential_cuts(0, train, validation, test)
    at = _placed(df, spec)
    cut = lambda share: F.floor(F.col("_rows").cast("double") * F.lit(share))
    return at.withColumn("split", F.when(F.col("_at") < cut(train), "train").when(F.col("_at") < cut(train + validation), "validation").otherwise("test")).drop("_at", "_rows")


def _placed(df: DataFrame, spec: Series) -> DataFrame:
    """Each row's position and its series' number of rows, as _at and _rows."""
    n = F.count("*").alias("_rows")
    return beside(positions(df, spec, "_at"), df.groupBy(*spec.key).agg(n) if spec.key else df.agg(n), list(spec.key))


def rolling_folds(n: int, train: int, validation: int, test: int, step: int | None = None) -> list[Fold]:
    """Windows of fixed size that move by ``step`` (a test's length if none is given)."""
    size = train + validation + test
    if size > n:
        raise ValueError(f"a window of {size} rows does not fit {n}")
    step = step or test
    return [Fold(k, s, s + train, s + train + validation, s + size) for k, s in enumerate(range(0, n - size + 1, step))]


def expanding_folds(n: int, first: int, validation: int, test: int, step: int | None = None) -> list[Fold]:
    """Training from the first row on, longer by ``step`` in each fold."""
    if first + validation + test > n:
        raise ValueError(f"the first fold does not fit {n} rows")
    step = step or test
    return [Fold(k, 0, t, t + validation, t + validation + test) for k, t in enumerate(range(first, n - validation - test + 1, step))]


def time_series_folds(n: int, splits: int) -> list[Fold]:
    """Expanding folds whose tests, of n // (splits + 1) rows, end with the last row."""
    size = n // (splits + 1)
    if size == 0:
        raise ValueError("too few rows for so many folds")
    return [Fold(k, 0, t, t, t + size) for k, t in enumerate(n - size * (splits - i) for i in range(splits))]


def apply_folds(df: DataFrame, spec: Series, folds: list[Fold]) -> DataFrame:
    """Each row once for every fold of a list that holds it, with ``fold`` and ``split``; the list stands in the plan.

    For folds to the end of each series, however many, see whole_folds().
    """
    at = positions(df, spec, "_at")
    every = F.array(*[F.struct(*[F.lit(v).cast("int" if k == "fold" else "bigint").alias(k) for k, v in asdict(f).items()]) for f in folds])
    held = at.withColumn("_f", F.explode(F.filter(every, lambda f: (F.col("_at") >= f["start"]) & (F.col("_at") < f["test_end"]))))
    return _named(held, F.col("_f")["train_end"], F.col("_f")["validation_end"], F.col("_f")["fold"], ["_f", "_at"])


def _named(held: DataFrame, train_end, validation_end, fold, drop: list[str]) -> DataFrame:
    split = F.when(F.col("_at") < train_end, "train").when(F.col("_at") < validation_end, "validation").otherwise("test")
    return held.withColumns({"fold": fold.cast("int"), "split": split}).drop(*drop)


FOLDS = ("rolling", "expanding", "time_series")


def whole_folds(df: DataFrame, spec: Series, kind: str, train: float = 0, validation: float = 0, test: float = 0, step: float | None = None, splits: int = 5) -> DataFrame:
    """Each row once for every fold that holds it, over all rows of each series: ``fold`` and ``split``.

    Sizes are rows, or shares of a series' rows if below 1. rolling: windows of fixed size moved by ``step`` (a test's
    length if none is given); expanding: training from the first row on, longer by ``step``; time_series: ``splits``
    expanding folds whose tests end with the last row. Which folds hold a row follows from its position; a series too
    short for a fold has none.
    """
    if kind not in FOLDS:
        raise ValueError(f"unknown folds {kind!r}; one of {', '.join(FOLDS)}")
    at = _placed(df, spec)
    p, n = F.col("_at"), F.col("_rows")
    size = lambda x: F.floor(n * F.lit(float(x))) if 0 < x < 1 else F.lit(int(x)).cast("bigint")
    if kind == "time_series":
        length = F.floor(n / (splits + 1))
        first, validated, tested, moved = n - length * splits, F.lit(0).cast("bigint"), length, length
    else:
        first, validated, tested = size(train), size(validation), size(test)
        moved = size(step) if step else tested
    total = first + validated + tested
    last = F.floor((n - total) / moved)  # the last fold that fits
    upper = F.least(F.floor(p / moved), last) if kind == "rolling" else last
    lower = F.greatest(F.ceil((p + 1 - total) / moved), F.lit(0))
    usable = (moved > 0) & (total <= n)
    at = at.withColumns({"_lo": F.when(usable, lower), "_hi": F.when(usable, upper), "_m": moved, "_train": first, "_validation": first + validated})
    held = at.where("_lo <= _hi").withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
    shift = F.col("_k") * F.col("_m")
    return _named(held, F.col("_train") + shift, F.col("_validation") + shift, F.col("_k"), ["_at", "_rows", "_lo", "_hi", "_m", "_train", "_validation", "_k"])


def split_parts(df: DataFrame) -> dict[str, DataFrame]:
    return {s: df.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test")}


def leakage_check(df: DataFrame, spec: Series) -> DataFrame:
    """Per series: the time bounds of each split, and whether they follow one another strictly."""
    t = lambda s: F.when(F.col("split") == s, F.col(spec.ts))
    bounds = df.groupBy(*spec.key).agg(*[f(t(s)).alias(f"{s}_{k}") for s in ("train", "validation", "test") for k, f in (("first", F.min), ("last", F.max))])
    ok = (F.col("train_last") < F.coalesce("validation_first", "test_first")) & (F.col("validation_last").isNull() | (F.col("validation_last") < F.col("test_first")))
    return bounds.withColumn("no_leakage", F.coalesce(ok, F.lit(False)))


def save_split(path: str, name: str, bounds: dict) -> str:
    """Writes a split's boundaries (never its rows) as JSON."""
    at = f"{path.rstrip('/')}/{name}_split.json"
    files.write_text(at, json.dumps(bounds, default=str))
    return at


def load_split(path: str) -> dict:
    return json.loads(files.read_text(path))


def sequences(df: DataFrame, spec: Series, features: list[str], target: str, length: int) -> DataFrame:
    """Each row with the ``length`` rows before it as an array of arrays, and its target; rows with fewer before are left out."""
    before = lambda s: F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(s.w.rowsBetween(-length, -1))
    made = windowed(df, spec, length, lambda d, s: d.withColumns({"sequence": before(s), "target": F.col(target)}))
    return made.where(F.size("sequence") == length).select(*spec.key, *spec.order, "sequence", "target")


def scale_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: _mean_{c} and _sd_{c}, the population deviation; a deviation of 0 counts as 1."""
    sd = lambda c: F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c))
    return df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_mean_{c}"), sd(c).alias(f"_sd_{c}"))])


def standard_scale(df: DataFrame, columns: list[str], train: DataFrame | None = None) -> DataFrame:
    """Columns less the mean over the population deviation of the training rows; a deviation of 0 counts as 1."""
    stats = scale_statistics(train if train is not None else df, columns)
    return df.crossJoin(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_sd_{c}") for c in columns}).select(*df.columns)


def standard_unscale(df: DataFrame, columns: dict[str, str], train: DataFrame) -> DataFrame:
    """Scaled columns, such as predictions, back on the scale of the training rows: {column: which column it was scaled as}."""
    stats = scale_statistics(train, sorted(set(columns.values())))
    return df.crossJoin(F.broadcast(stats)).withColumns({c: F.col(c) * F.col(f"_sd_{was}") + F.col(f"_mean_{was}") for c, was in columns.items()}).select(*df.columns)


SUPPORT = ("recent", "random", "volatility")


def support_set(df: DataFrame, spec: Series, n: int, strategy: str = "recent", returns: str | None = None, target_volatility: float | None = None, period: int = 20, seed: int = 42) -> DataFrame:
    """n rows of each series, in order: the last, a seeded draw, or those whose rolling volatility is nearest to a target.

    All rows where there are no more than n; the last n where no target, or too few volatilities, are known.
    """
    if strategy not in SUPPORT:
        raise ValueError(f"unknown strategy {strategy!r}")
    if n <= 0:
        raise ValueError("n must be positive")
    recent = [F.desc(c) for c in spec.order]
    if strategy == "random":
        kind = dict(df.dtypes)
        text = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("string") if kind[c].startswith("timestamp") else F.col(c).cast("string")
        order = [F.md5(F.concat_ws("|", F.lit(str(seed)), *[text(c) for c in spec.order])), *recent]
    elif strategy == "volatility" and returns and target_volatility is not None:
        rows, own = sliced(df, spec)
        vol = lambda s: F.when(F.count(returns).over(s.frame(period)) == period, F.stddev_samp(returns).over(s.frame(period)))
        rows = unsliced(windowed(rows, own, period, lambda d, s: d.withColumn("_vol", vol(s))), spec, own)
        known = F.count("_vol").alias("_known")
        df = beside(rows, rows.groupBy(*spec.key).agg(known) if spec.key else rows.agg(known), list(spec.key))
        df = df.withColumn("_gap", F.when(F.col("_known") >= n, F.abs(F.col("_vol") - target_volatility)))
        order = [F.asc_nulls_last("_gap"), *recent]
    else:
        order = recent
    # the first n of a series are taken before rows are dealt, so no task sees a whole one
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*spec.key).orderBy(*order)))
    return ranked.where(F.col("_r") <= n).drop("_r", "_vol", "_known", "_gap")
