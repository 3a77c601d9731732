"""Time series per key: windows, returns, robust scaling, normalisation, splits, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def sliding_windows(df: DataFrame, by: list[str], order: list[str], value: str, size: int, stride: int = 1) -> DataFrame:
    """(by, win_id, values) of full windows of ``size`` rows, one every ``stride`` rows of each series."""
    if size < 1 or stride < 1:
        raise ValueError("size and stride must be positive")
    w = ordered(by, order)
    held = F.collect_list(F.col(value)).over(w.rowsBetween(0, size - 1))
    row = df.select(*by, (F.row_number().over(w) - 1).alias("i"), held.alias("values"))
    return row.filter((F.col("i") % stride == 0) & (F.size("values") == size)).select(*by, (F.col("i") / stride).cast("long").alias("win_id"), "values")


def log_returns(value: Column, w, most: float = 10.0) -> Column:
    """ln(p_t / p_(t-1)); 0 for the first row; within +-``most``."""
    before = F.lag(value).over(w)
    r = F.ln(value / (before + 1e-10) + 1e-10)
    return F.when(before.isNull(), F.lit(0.0)).otherwise(F.least(F.lit(most), F.greatest(F.lit(-most), r)))


def rolling_mean(value: Column, w, rows: int = 20) -> Column:
    return F.avg(value).over(w.rowsBetween(-(rows - 1), 0))


def robust_volume(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``robust``: log ratio to the rolling mean, less its median, by its quartile distance, within +-5."""
    w = ordered(by, order)
    ratio = F.ln(F.col(value) / (rolling_mean(F.col(value), w) + 1e-10) + 1e-10)
    rows = df.withColumn("ratio", ratio)
    q = Window.partitionBy(*by)
    cut = {p: F.percentile("ratio", F.lit(p)).over(q) for p in (0.25, 0.5, 0.75)}
    scaled = (F.col("ratio") - cut[0.5]) / (cut[0.75] - cut[0.25] + 2e-10)
    return rows.withColumn("robust", F.least(F.lit(5.0), F.greatest(F.lit(-5.0), scaled))).drop("ratio")


def inverse_returns(first: Column, returns: Column, w) -> Column:
    """Values from returns and the first value of the series."""
    return first * F.exp(F.sum(returns).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def normalise(value: Column, part, most: float | None = None, floor: float = 1e-8) -> Column:
    """(value - mean) / (deviation + floor) within a window partition."""
    z = (value - F.avg(value).over(part)) / (F.stddev_pop(value).over(part) + floor)
    return z if most is None else F.least(F.lit(most), F.greatest(F.lit(-most), z))


def fit(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, lo, hi, mean, std) of a value."""
    v = F.col(value)
    return df.groupBy(*(by or [])).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def zscore(value: Column, mean: Column, std: Column, most: float = 5.0) -> Column:
    z = (value - mean) / F.greatest(std, F.lit(1e-8))
    return z if not most else F.least(F.lit(most), F.greatest(F.lit(-most), z))


def minmax(value: Column, lo: Column, hi: Column) -> Column:
    return (value - lo) / F.greatest(hi - lo, F.lit(1e-8))


def split(df: DataFrame, by: list[str], order: list[str], train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """``part``: train, valid or test by place in each series, earlier rows first."""
    i = F.row_number().over(ordered(by, order)) - 1
    n = F.count("*").over(Window.partitionBy(*by))
    cut1, cut2 = F.floor(n * train), F.floor(n * F.lit(train)) + F.floor(n * F.lit(valid))
    return df.withColumn("part", F.when(i < cut1, "train").when(i < cut2, "valid").otherwise("test"))


def regimes(df: DataFrame, by: list[str], order: list[str], label: str, least: int = 1) -> DataFrame:
    """(by, label, start, end, size): maximal runs of one label, end exclusive; runs shorter than ``least`` are dropped."""
    w = ordered(by, order)
    i = F.row_number().over(w) - 1
    changed = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    runs = df.select(*by, F.col(label).alias("label"), i.alias("i"), changed.alias("c")).withColumn("run", F.sum("c").over(Window.partitionBy(*by).orderBy("i")))
    out = runs.groupBy(*by, "run", "label").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"), F.count("*").alias("size"))
    return out.filter(F.col("size") >= least).drop("run")


def chunks(df: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """(by, chunk, n): consecutive groups of ``size`` rows of each series; the last may be short."""
    i = F.row_number().over(ordered(by, order)) - 1
    return df.select(*by, F.floor(i / size).cast("long").alias("chunk")).groupBy(*by, "chunk").agg(F.count("*").alias("n"))


def elbow(inertia: DataFrame, centred: bool = True) -> DataFrame:
    """(k): where the inertia (k, inertia) bends most; the first k for fewer than three values."""
    w = Window.orderBy("k")  # a handful of rows
    bend = F.lag("inertia").over(w) - 2 * F.col("inertia") + F.lead("inertia").over(w)
    at = F.col("k") if centred else F.coalesce(F.lead("k").over(w), F.col("k"))
    rows = inertia.select("k", bend.alias("bend"), at.alias("at"))
    return rows.agg(F.coalesce(F.max_by("at", F.struct(F.col("bend"), -F.col("k"))), F.min("k")).alias("k"))


def unzscore(z: Column, mean: Column, std: Column) -> Column:
    """Inverse of ``zscore``; what was clipped stays at the clip."""
    return z * F.greatest(std, F.lit(1e-8)) + mean


def unminmax(x: Column, lo: Column, hi: Column) -> Column:
    return x * F.greatest(hi - lo, F.lit(1e-8)) + lo


def instance_norm(value: Column, part, weight: float = 1.0, bias: float = 0.0, floor: float = 1e-5) -> tuple[Column, Column, Column]:
    """(normalised, mean, scale) of a value within a window partition, with an affine step."""
    mean, scale = F.avg(value).over(part), F.sqrt(F.var_pop(value).over(part) + floor)
    return (value - mean) / scale * weight + bias, mean, scale


def restore_instance(z: Column, mean: Column, scale: Column, weight: float = 1.0, bias: float = 0.0) -> Column:
    """Inverse of ``instance_norm``; ``mean`` and ``scale`` may be those of another series."""
    return (z - bias) / weight * scale + mean


#: Fixed value: the largest finite number of 32 bits.
LARGEST = 3.4028234663852886e38


def finite(value: Column) -> Column:
    """NaN as 0, infinities as the largest numbers of 32 bits."""
    v = F.nanvl(value, F.lit(0.0))
    return F.least(F.lit(LARGEST), F.greatest(F.lit(-LARGEST), v))


def reshaped(df: DataFrame, values: str, steps: int, features: int) -> DataFrame:
    """A row a value of flat arrays: window w, step t, feature f and x, row by row."""
    at = F.col("_at")
    rows = df.select(*(c for c in df.columns if c != values), F.posexplode(values).alias("_at", "x"))
    size = steps * features
    return rows.withColumns({"w": F.floor(at / size), "t": F.floor(at % size / features), "f": at % features}).drop("_at")


def unreshaped(df: DataFrame, by: list[str], values: str = "v") -> DataFrame:
    """Inverse of ``reshaped``."""
    held = F.array_sort(F.collect_list(F.struct("w", "t", "f", "x")))
    return df.groupBy(*by).agg(F.transform(held, lambda r: r["x"]).alias(values))
