"""Entropy, uniformity and code lengths of symbol streams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _entropy(counts: DataFrame, by: list[str], name: str) -> DataFrame:
    n = Window.partitionBy(*by)
    p = F.col("c") / F.sum("c").over(n)
    return counts.withColumn("p", p).groupBy(*by).agg((-F.sum(F.col("p") * F.log2("p"))).alias(name))


def entropy(symbols: DataFrame, by: list[str], symbol: str = "s", name: str = "h0") -> DataFrame:
    """Bits a symbol of each group; 0 for one constant symbol."""
    return _entropy(symbols.groupBy(*by, symbol).agg(F.count("*").alias("c")), by, name)


def block_entropy(symbols: DataFrame, by: list[str], order: str, n: int, symbol: str = "s", name: str = "h") -> DataFrame:
    """Entropy of runs of ``n`` symbols that follow each other."""
    w = Window.partitionBy(*by).orderBy(order)
    lags = [F.lag(symbol, j).over(w).alias(f"l{j}") for j in range(1, n)]
    rows = symbols.select(*by, F.col(symbol).alias("l0"), *lags).dropna(subset=[f"l{n - 1}"])
    return _entropy(rows.groupBy(*by, *(f"l{j}" for j in range(n))).agg(F.count("*").alias("c")), by, name)


def conditional_entropy(symbols: DataFrame, by: list[str], order: str, symbol: str = "s", name: str = "h1") -> DataFrame:
    """Bits of a symbol when the one before is known."""
    w = Window.partitionBy(*by).orderBy(order)
    pairs = symbols.select(*by, F.col(symbol).alias("s"), F.lag(symbol).over(w).alias("b")).dropna(subset=["b"])
    counts = pairs.groupBy(*by, "b", "s").agg(F.count("*").alias("c"))
    ctx = F.sum("c").over(Window.partitionBy(*by, "b"))
    rows = counts.withColumn("ctx", ctx).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    return rows.groupBy(*by).agg((-F.sum(F.col("c") / F.col("n") * F.log2(F.col("c") / F.col("ctx")))).alias(name))


def uniformity(symbols: DataFrame, symbol: str = "s", kinds: int = 256) -> DataFrame:
    """(chi2, n) against the uniform distribution over ``kinds`` symbols, absent ones included."""
    total = _squares(symbols.groupBy(symbol).agg(F.count("*").alias("c")))
    return total.select(_chi2(kinds).alias("chi2"), "n")


def _squares(counts: DataFrame) -> DataFrame:
    """(n, q): the sums of c and of its square; squares pass 64 bits from a few hundred megabytes of symbols on."""
    wide = F.col("c").cast("decimal(19,0)")
    return counts.agg(F.sum("c").alias("n"), F.sum(wide * wide).alias("q"))


def _chi2(kinds: int) -> Column:
    return (F.col("q") * kinds).cast("double") / F.col("n") - F.col("n")


#: The rational approximation of the error function (Abramowitz and Stegun 7.1.26).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def p_value(chi2: Column, kinds: int = 256) -> Column:
    """Upper tail of a chi-squared value by the Wilson-Hilferty cube root."""
    k = float(kinds - 1)
    x = (F.pow(chi2 / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(F.lit(2 / (9 * k))) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = reduce(lambda acc, a: t * (a + acc), reversed(ERF_A), F.lit(0.0))
    erf = F.signum(x) * (1 - poly * F.exp(-x * x))
    return 0.5 * (1 - erf)


def adaptive_bits(symbols: DataFrame, by: list[str], order: str, symbol: str = "s", kinds: int = 256, rate: float = 1.0) -> DataFrame:
    """Bits of an adaptive code whose counts start at one: sum of -log2((1 + rate c) / (kinds + rate t))."""
    before = F.row_number().over(Window.partitionBy(*by, symbol).orderBy(order)) - 1
    t = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    rows = symbols.select(*by, ((1 + rate * before) / (kinds + rate * t)).alias("p"))
    return rows.groupBy(*by).agg((-F.sum(F.log2("p"))).alias("bits"))


def perplexity(symbols: DataFrame, by: list[str], symbol: str = "s") -> DataFrame:
    counts = symbols.groupBy(*by, symbol).agg(F.count("*").alias("c"))
    p = counts.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(*by)))
    return p.groupBy(*by).agg(F.exp(-F.sum(F.col("p") * F.ln(F.col("p") + 1e-10))).alias("perplexity"))


def _bits(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum()) + 0.0


def byte_entropy(data: np.ndarray) -> float:
    """Bits a byte; 0 for no bytes."""
    return _bits(np.bincount(data, minlength=256)) if len(data) else 0.0


def byte_runs_entropy(data: np.ndarray, n: int) -> float | None:
    """Entropy of runs of ``n`` bytes (up to 7); None where there is no such run."""
    if len(data) < n:
        return None
    code = np.zeros(len(data) - n + 1, np.int64)
    for j in range(n):
        code = code << 8 | data[j : j + len(code)]
    return _bits(np.unique(code, return_counts=True)[1])


def byte_context_entropy(data: np.ndarray) -> float | None:
    """Bits of a byte when the one before is known; None for fewer than two bytes."""
    if len(data) < 2:
        return None
    return max(0.0, byte_runs_entropy(data, 2) - byte_entropy(data[:-1]))


def adaptive_byte_bits(data: np.ndarray) -> float:
    """Bits of the adaptive code of ``adaptive_bits`` at rate 1, in closed form: it depends on the counts alone."""
    counts = np.bincount(data, minlength=256)
    ways = math.lgamma(256 + len(data)) - math.lgamma(256) - sum(math.lgamma(c + 1) for c in counts[counts > 1].tolist())
    return ways / math.log(2)


def static_byte_bits(data: np.ndarray) -> float:
    """Bits of a static code whose probabilities are the counts plus one."""
    counts = np.bincount(data, minlength=256)
    return float(-(counts * np.log2((counts + 1) / (len(data) + 256))).sum()) + 0.0


def byte_profile(df: DataFrame, key: str, data: str, with_p: bool = False) -> DataFrame:
    """Per row: key, n bytes, h0, h1 (known byte before), h3 (runs of three), adaptive_bits, static_bits; one pass, no shuffle.

    ``data`` is text (as UTF-8) or binary; null counts as empty, which has 0 bits and no runs. ``with_p`` adds p_value,
    of the bytes against the uniform distribution.
    """
    more = ", p_value double" if with_p else ""
    kind = StructType([df.schema[key], *StructType.fromDDL(f"n long, h0 double, h1 double, h3 double, adaptive_bits double, static_bits double{more}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x or b"", np.uint8) for x in batch.column(1).to_pylist()]
            made = [(len(x), byte_entropy(x), byte_context_entropy(x), byte_runs_entropy(x, 3), adaptive_byte_bits(x), static_byte_bits(x), *([chi_squared_p(x)] if with_p else [])) for x in rows]
            cols = [pa.array(c, type=t) for c, t in zip(zip(*made, strict=True), [pa.int64(), *[pa.float64()] * (5 + with_p)], strict=True)] if made else []
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=kind.names)

    return df.select(key, F.col(data).cast("binary")).mapInArrow(run, kind)


def byte_counts(df: DataFrame, data: str) -> DataFrame:
    """(s, c): how often each byte stands in all rows, absent ones left out; tasks send 256 rows a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = sum((np.bincount(np.frombuffer(x or b"", np.uint8), minlength=256) for x in batch.column(0).to_pylist()), np.zeros(256, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(counts)], names=["s", "c"])

    return df.select(F.col(data).cast("binary")).mapInArrow(run, "s int, c long").groupBy("s").agg(F.sum("c").alias("c")).filter("c > 0")


def counted_uniformity(counts: DataFrame, kinds: int = 256) -> DataFrame:
    """(chi2, n, p_value) of (s, c) against the uniform distribution; p is 0 for fewer than ``kinds`` symbols."""
    total, chi2 = _squares(counts), _chi2(kinds)
    return total.select(chi2.alias("chi2"), "n", F.when(F.col("n") < kinds, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p_value(chi2, kinds)))).alias("p_value"))


def gap(h0: Column, h1: Column, n_in: Column, n_out: Column) -> dict[str, Column]:
    """Certificate columns: the lower of the entropies, bits achieved a byte, and the gap in bits and percent."""
    floor = F.least(h0, F.coalesce(h1, h0))
    achieved = n_out * 8.0 / F.greatest(n_in, F.lit(1))
    over = F.greatest(achieved - floor, F.lit(0.0))
    return {"entropy": floor, "achieved_bpb": achieved, "gap_bpb": over, "gap_pct": F.when(floor > 0, over / floor * 100).otherwise(0.0)}


def chi_squared_p(data: np.ndarray) -> float:
    """p-value of bytes against the uniform distribution by the Wilson-Hilferty cube root; 0 for fewer than 256."""
    if len(data) < 256:
        return 0.0
    even, k = len(data) / 256, 255.0
    chi2 = float(((np.bincount(data, minlength=256) - even) ** 2 / even).sum())
    z = ((chi2 / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    x = abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_P * x)
    erf = math.copysign(1 - reduce(lambda acc, a: t * (a + acc), reversed(ERF_A), 0.0) * math.exp(-x * x), z)
    return min(1.0, max(0.0, 0.5 * (1 - erf)))
