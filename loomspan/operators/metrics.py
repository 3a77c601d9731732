"""Losses, sizes and prices: aggregates over reconstructions, codes and compressed tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Monthly price of a stored GB, price of a GB read, and reads a month.
STORED, READ, READS = 0.023, 0.004, 4


def costs(df: DataFrame, raw: str, small: str) -> DataFrame:
    """``df`` with raw_gb, compressed_gb, monthly (price of the raw bytes), monthly_savings and yearly_savings."""
    price = STORED + READS * READ
    raw_gb, small_gb = F.col(raw) / 1e9, F.col(small) / 1e9
    saved = (raw_gb - small_gb) * price
    return df.withColumns({"raw_gb": raw_gb, "compressed_gb": small_gb, "monthly": raw_gb * price, "monthly_savings": saved, "yearly_savings": 12 * saved})


def ratio(raw: Column, small: Column) -> Column:
    """How many times smaller; nothing counts as one byte."""
    return raw / F.greatest(small, F.lit(1))


def compression_ratios(df: DataFrame, by: list[str], raw: Column, blob: str = "blob", model_bytes: int = 0, blob_bytes: Column | None = None) -> DataFrame:
    """(by, raw_bytes, blob_bytes, ratio, system_ratio): the latter with a model's bytes counted too.

    ``blob_bytes`` gives the bytes themselves, where there is no column of blobs.
    """
    size = F.octet_length(blob) if blob_bytes is None else blob_bytes
    out = df.groupBy(*by).agg(F.sum(raw).alias("raw_bytes"), F.sum(F.coalesce(size, F.lit(0))).alias("blob_bytes"))
    return out.withColumns({"ratio": ratio(F.col("raw_bytes"), F.col("blob_bytes")), "system_ratio": ratio(F.col("raw_bytes"), F.col("blob_bytes") + model_bytes)})


def huber(error: Column, delta: float = 1.0) -> Column:
    """Squared for small errors, linear beyond ``delta``."""
    size = F.abs(error)
    return F.when(size <= delta, 0.5 * error * error).otherwise(delta * (size - 0.5 * delta))


def weighted_loss(df: DataFrame, error: Column, weight: Column, kind: str = "mse") -> DataFrame:
    """(loss): mean of the squared or Huber errors, weights brought to a mean of one."""
    if kind not in ("mse", "huber"):
        raise ValueError("kind is 'mse' or 'huber'")
    each = error * error if kind == "mse" else huber(error)
    return df.agg((F.sum(weight * each) / F.sum(weight)).alias("loss"))


def kl_terms(mean: Column, log_variance: Column) -> Column:
    """Divergence of a normal distribution from the standard one, in one dimension."""
    return -0.5 * (1 + log_variance - mean * mean - F.exp(log_variance))


def sparsity(long: DataFrame, value: str = "x") -> DataFrame:
    """(sparsity): mean absolute coordinate."""
    return long.agg(F.avg(F.abs(value)).alias("sparsity"))


def warmed(step: int, warm_up: int, most: float = 1.0) -> float:
    """Weight that rises linearly from 0 to ``most`` over the first ``warm_up`` steps."""
    return most if warm_up <= 0 else most * min(1.0, step / warm_up)


def combined_loss(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of weighted parts; a part without a weight counts once."""
    out = F.lit(0.0)
    for name, part in parts.items():
        out = out + weights.get(name, 1.0) * part
    return out


def learning_rate(step: int, total: int, warm_up: int, top: float, least: float = 0.0) -> float:
    """Linear rise, then half a cosine down to ``least``."""
    if step < warm_up:
        return top * (step + 1) / max(warm_up, 1)
    done = min(1.0, (step - warm_up) / max(total - warm_up, 1))
    return least + 0.5 * (top - least) * (1 + float(np.cos(np.pi * done)))


def spectral_mse(df: DataFrame, x: str, y: str) -> DataFrame:
    """(mse): mean squared difference of the magnitudes of real Fourier transforms of two arrays a row.

    Tasks send a sum and a count a batch. Rows with a null or empty array count for nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n = 0.0, 0
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if a and b:
                    d = np.abs(np.fft.rfft(a)) - np.abs(np.fft.rfft(b))
                    total, n = total + float((d * d).sum()), n + len(d)
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n])], names=["total", "n"])

    sums = df.select(F.col(x).cast("array<double>"), F.col(y).cast("array<double>")).mapInArrow(run, "total double, n long")
    return sums.agg((F.sum("total") / F.sum("n")).alias("mse"))


def evaluate(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, rmse, range_pct): error of a reconstruction, and as a share of the range of the values."""
    error = F.sqrt(F.avg(F.pow(F.col(x) - F.col(y), 2)))
    span = F.max(x) - F.min(x)
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), error.alias("rmse"), F.when(span > 0, 100 * error / span).otherwise(0.0).alias("range_pct"))


def report(entries: DataFrame, name: str, score: str) -> DataFrame:
    """``entries`` by falling score with place and medal (the first three)."""
    place = F.row_number().over(Window.orderBy(F.desc(score), name))  # a report's rows
    medal = F.when(F.col("place") == 1, "gold").when(F.col("place") == 2, "silver").when(F.col("place") == 3, "bronze")
    return entries.withColumn("place", place).withColumn("medal", medal)


def html_report(entries: DataFrame, title: str) -> str:
    """A page with one table of a report's rows."""
    from html import escape

    rows = entries.collect()
    cells = lambda tag, xs: "<tr>" + "".join(f"<{tag}>{escape(str(x))}</{tag}>" for x in xs) + "</tr>"
    body = "".join(cells("td", ("" if x is None else x for x in r)) for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table>{cells('th', entries.columns)}{body}</table></body></html>"


def human_bytes(n: Column) -> Column:
    """Bytes as text with a unit."""
    out = F.concat(F.format_number(n / 1024.0**4, 1), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024.0 ** (power + 1), F.concat(F.format_number(n / 1024.0**power, 1), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)
