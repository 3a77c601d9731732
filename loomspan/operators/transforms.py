"""Reversible integer transforms per series, on exact integers."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.bits import unzigzag, wrap32, zigzag
from loomspan.tables import materialize


def delta(x: Column, w, order: int, place: Column) -> Column:
    """Difference of an order, wrapped to 32 bits; row t of a series uses order min(t, ``order``)."""
    out = None
    for o in range(order, -1, -1):
        total = x.cast("long")
        for j in range(1, o + 1):
            total = total + F.lit((-1) ** j * comb(o, j)) * F.lag(x, j).over(w).cast("long")
        value = wrap32(total)
        out = value if out is None else F.when(place < o + 1, value).otherwise(out)
    return out


def with_delta(df: DataFrame, by: list[str], order: list[str], value: str, k: int, name: str = "d") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("__t", F.row_number().over(w) - 1)
    return rows.withColumn(name, delta(F.col(value), w, k, F.col("__t"))).drop("__t")


def undelta(df: DataFrame, by: list[str], order: list[str], value: str, k: int, name: str = "x") -> DataFrame:
    """Inverse of ``with_delta``: running sums in k stages, stage j over rows t >= k - j."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("__t", F.row_number().over(w) - 1).withColumn(name, F.col(value).cast("long"))
    for j in range(1, k + 1):
        summed = F.sum(F.when(F.col("__t") >= k - j, F.col(name)).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn(name, F.when(F.col("__t") >= k - j, wrap32(summed)).otherwise(F.col(name)))
    return rows.drop("__t")


def xor_delta(x: Column, w) -> Column:
    return x.bitwiseXOR(F.coalesce(F.lag(x).over(w), F.lit(0)))


def unxor(x: Column, w) -> Column:
    return F.bit_xor(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def adaptive_order(df: DataFrame, by: list[str], order: list[str], value: str, most: int = 4) -> DataFrame:
    """(by, best_order): the order 0 to ``most`` of least absolute sum of differences, the smallest of equals."""
    rows = df
    for k in range(most + 1):
        rows = with_delta(rows, by, order, value, k, f"__d{k}")
    sums = rows.groupBy(*by).agg(*(F.sum(F.abs(F.col(f"__d{k}"))).alias(f"s{k}") for k in range(most + 1)))
    best = F.array_min(F.array(*(F.struct(F.col(f"s{k}").alias("s"), F.lit(k).alias("k")) for k in range(most + 1))))
    return sums.select(*by, best["k"].alias("best_order"))


def zigzag_delta(df: DataFrame, by: list[str], order: list[str], value: str, k: int = 1) -> DataFrame:
    return with_delta(df, by, order, value, k).withColumn("d", zigzag(F.col("d")))


def code_delta(df: DataFrame, by: list[str], order: list[str], code: str, name: str = "d") -> DataFrame:
    """Differences of 8-bit codes along a series, as signed bytes and then zigzag: small numbers 0 to 255."""
    w = Window.partitionBy(*by).orderBy(*order)
    signed = F.pmod(F.col(code) - F.coalesce(F.lag(code).over(w), F.lit(0)) + 128, F.lit(256)) - 128
    return df.withColumn(name, zigzag(signed).bitwiseAND(255).cast("int"))


def uncode_delta(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "x") -> DataFrame:
    """Inverse of ``code_delta``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.pmod(F.sum(unzigzag(F.col(value))).over(w), F.lit(256)).cast("int"))


def cross_feature_delta(df: DataFrame, by: list[str], order: list[str], features: list[str]) -> DataFrame:
    """Each feature less the one before it, the first less its own row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.col(features[0]) - F.coalesce(F.lag(features[0]).over(w), F.lit(0))
    return df.withColumns({features[0]: first, **{b: F.col(b) - F.col(a) for a, b in zip(features, features[1:], strict=False)}})


def uncross_feature_delta(df: DataFrame, by: list[str], order: list[str], features: list[str]) -> DataFrame:
    """Inverse of ``cross_feature_delta``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn(features[0], F.sum(features[0]).over(w))
    total, out = F.col(features[0]), {}
    for f in features[1:]:
        total = total + F.col(f)
        out[f] = total
    return rows.withColumns(out) if out else rows


def window_time_delta(df: DataFrame, by: list[str], window: str, step: str, value: str, name: str = "d") -> DataFrame:
    """Difference to the same step of the window before, then along the steps of a window."""
    across = Window.partitionBy(*by, step).orderBy(window)
    rows = df.withColumn(name, F.col(value) - F.coalesce(F.lag(value).over(across), F.lit(0)))
    along = Window.partitionBy(*by, window).orderBy(step)
    return rows.withColumn(name, F.col(name) - F.coalesce(F.lag(name).over(along), F.lit(0)))


def unwindow_time_delta(df: DataFrame, by: list[str], window: str, step: str, value: str, name: str = "x") -> DataFrame:
    """Inverse of ``window_time_delta``."""
    along = Window.partitionBy(*by, window).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*by, step).orderBy(window).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(along)).withColumn(name, F.sum(name).over(across))


def _ranges(df: DataFrame, order: list[str], part: str) -> DataFrame:
    """``df`` in sorted ranges, written, with the number of its range: the same rows have it in every later plan."""
    return materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")


def delta_across(df: DataFrame, order: list[str], value: str, name: str = "d") -> DataFrame:
    """Differences along all rows in one order; ranges work apart, and each takes over the last value before it.

    The one window without a key is over a row a range.
    """
    rows = _ranges(df, order, "_part")
    last = rows.groupBy("_part").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    before = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_before"))
    w = Window.partitionBy("_part").orderBy(*order)
    joined = rows.join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.col(value) - F.coalesce(F.lag(value).over(w), "_before", F.lit(0))).drop("_part", "_before")


def undelta_across(df: DataFrame, order: list[str], value: str, name: str = "x") -> DataFrame:
    """Inverse of ``delta_across``: running sums of ranges, each from the sum of those before it."""
    rows = _ranges(df, order, "_part")
    whole = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = whole.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.sum(value).over(w) + F.col("_before")).drop("_part", "_before")
