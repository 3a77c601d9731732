"""Made-up tables for tests and benchmarks.

A series has a random stream of its own, from the seed and its number, so the same rows come out however the series are
dealt over tasks. Tables are (series, win_id, values): windows of steps x features, row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOWS = "series long, win_id long, values array<float>"


def _walk(rng: np.random.Generator, n: int, start: float, spread: np.ndarray | float, drift: float = 0.0) -> np.ndarray:
    """Prices whose logarithms take independent steps."""
    return start * np.exp(np.cumsum(drift + spread * rng.standard_normal(n)))


def _clustered(rng: np.random.Generator, n: int, base: float, memory: float = 0.9) -> np.ndarray:
    """Spreads that stay high for a while after a large step."""
    shocks, out, level = np.abs(rng.standard_normal(n)), np.empty(n), 1.0
    for i in range(n):
        out[i] = level
        level = memory * level + (1 - memory) * shocks[i]
    return base * out


def prices(rng, n: int) -> np.ndarray:
    """Open, high, low, close and volume; calm and wild spells, volume rising with the size of a step."""
    close = _walk(rng, n, 100.0, _clustered(rng, n, 0.02))
    step = np.abs(np.diff(np.log(close), prepend=np.log(close[0])))
    high, low = close * (1 + 0.005 * np.abs(rng.standard_normal(n))), close * (1 - 0.005 * np.abs(rng.standard_normal(n)))
    return np.stack([low + rng.random(n) * (high - low), high, low, close, np.exp(10 + 0.5 * rng.standard_normal(n) + 20 * step)], axis=1)


def waves(rng, n: int, features: int = 4) -> np.ndarray:
    """Sines of a frequency, phase and size of their own, with noise."""
    t = np.linspace(0, 2 * np.pi, n)[:, None]
    freq, phase, size = rng.uniform(0.5, 5, features), rng.uniform(0, 2 * np.pi, features), rng.uniform(0.5, 2, features)
    return size * np.sin(freq * t + phase) + 0.05 * rng.standard_normal((n, features))


def sensors(rng, n: int) -> np.ndarray:
    """Temperature with days and rare spikes, humidity against it, and slowly drifting pressure."""
    t = np.arange(n)
    warm = 20 + 5 * np.sin(2 * np.pi * t / 1440) + 1e-4 * t + 0.3 * rng.standard_normal(n)
    warm += (rng.random(n) < 1e-3) * 10 * rng.standard_normal(n)
    damp = np.clip(60 - (warm - 20) / 2 + 2 * rng.standard_normal(n), 0, 100)
    return np.stack([warm, damp, 1013.25 + 0.01 * np.cumsum(rng.standard_normal(n))], axis=1)


def weather(rng, n: int) -> np.ndarray:
    """Temperature with seasons, wind with gusts, rain on some days, and clouds that come with it."""
    t, wet = np.arange(n), rng.random(n) < 0.15
    warm = 15 + 10 * np.sin(2 * np.pi * t / 365) + 2 * rng.standard_normal(n)
    wind = np.abs(5 + 3 * rng.standard_normal(n)) * np.where(rng.random(n) < 0.02, rng.uniform(2, 4, n), 1)
    rain = np.where(wet, np.abs(5 * rng.standard_normal(n)), 0)
    return np.stack([warm, wind, rain, np.clip(30 + 40 * wet + 15 * rng.standard_normal(n), 0, 100)], axis=1)


#: Place, height and squared width of the waves of a heart beat, as parts of it.
BEAT = ((0.1, 0.1, 0.001), (0.2, -0.1, 0.0005), (0.25, 1.0, 0.0003), (0.3, -0.2, 0.0005), (0.5, 0.3, 0.003))


def beats(rng, n: int) -> np.ndarray:
    """One heart beat, a little faster or slower, with noise."""
    t = np.linspace(0, 1, n) * rng.uniform(0.8, 1.2)
    return (sum(h * np.exp(-((t - at) ** 2) / w) for at, h, w in BEAT) + 0.02 * rng.standard_normal(n))[:, None]


def spectra(rng, n: int, bins: int = 16) -> np.ndarray:
    """A tone and its overtones that rise, last and fade, over a background that falls with the frequency."""
    rise, fall = rng.uniform(1, max(n / 4, 2)), rng.uniform(n / 2, n)
    t = np.arange(n)
    loud = np.clip(np.minimum(t / rise, (n - t) / max(n - fall, 1)), 0, 1)
    out = 0.1 * np.exp(-np.arange(bins) / 5) + 0.02 * np.abs(rng.standard_normal((n, bins)))
    tone = int(rng.integers(0, bins // 2))
    for k in range(1, int(rng.integers(2, 5))):
        out[:, min(tone * k, bins - 1)] += loud / k
    return out


def ticks(rng, n: int) -> np.ndarray:
    """Open, running high, running low and close of a bar, volume, bid and ask, prices in cents."""
    close = np.round(_walk(rng, n, 185.5, 0.2 / np.sqrt(252 * 390), -0.5 * 0.04 / (252 * 390)), 2)
    half = np.maximum(np.round(close * np.clip(3e-4 * np.exp(0.5 * rng.standard_normal(n)), 1e-4, 1e-2) / 2, 2), 0.01)
    day = np.arange(n) % 23_400 / 23_400
    volume = np.round(500 * np.exp(0.8 * rng.standard_normal(n)) * (1 + 2 * (2 * day - 1) ** 2))
    return np.stack([close, np.maximum.accumulate(close), np.minimum.accumulate(close), close, volume, close - half, close + half], axis=1)


def order_book(rng, n: int, levels: int = 10) -> np.ndarray:
    """Prices and sizes of bids, then of asks, level by level around a wandering middle."""
    middle, gap = np.round(150 + np.cumsum(0.01 * rng.standard_normal(n)), 2)[:, None], np.maximum(0.01, np.abs(0.02 + 0.01 * rng.standard_normal((n, 1))))
    away, size = gap * np.arange(1, levels + 1), lambda: np.exp(6 + rng.standard_normal((n, levels)))
    return np.concatenate([np.round(middle - away, 2), size(), np.round(middle + away, 2), size()], axis=1)


def risk(rng, n: int) -> np.ndarray:
    """Value at risk, expected shortfall, five sensitivities, implied and realised volatility, and profit of a position."""
    price, vol = _walk(rng, n, rng.uniform(20, 500), 0.02), rng.uniform(0.15, 0.6) * np.exp(0.05 * np.cumsum(rng.standard_normal(n)) / np.sqrt(n))
    at_risk = price * vol * 2.326 / np.sqrt(252) * (1 + 0.05 * rng.standard_normal(n))
    greeks = [rng.uniform(a, b) + s * rng.standard_normal(n) for a, b, s in ((-1, 1, 0.01), (0, 0.1, 0.001), (-50, 50, 0.5), (-5, 0, 0.1), (-20, 20, 0.2))]
    shown = [at_risk, at_risk * 1.3 * (1 + 0.03 * rng.standard_normal(n)), *greeks, np.maximum(vol + 0.01 * rng.standard_normal(n), 0.01), vol * (1 + 0.1 * rng.standard_normal(n))]
    return np.stack([*(np.round(x, 4) for x in shown), np.round(0.02 * price * rng.standard_normal(n), 2)], axis=1)


def counters(rng, n: int, features: int = 4) -> np.ndarray:
    """Counts that only rise."""
    return np.cumsum(rng.poisson(rng.uniform(1, 50, features), (n, features)), axis=0)


def tiles(rng, n: int, width: int = 32) -> np.ndarray:
    """Smooth pictures of 8-bit shades as parts of one."""
    y, x = np.mgrid[0:n, 0:width] / max(n, width)
    shade = 0.5 + 0.3 * np.sin(rng.uniform(2, 12) * x + rng.uniform(2, 12) * y) + 0.05 * rng.standard_normal((n, width))
    return np.round(np.clip(shade, 0, 1) * 255) / 255


def tones(rng, n: int) -> np.ndarray:
    """A chord as 16-bit samples."""
    t = np.arange(n) / 16_000
    x = sum(rng.uniform(0.1, 0.3) * np.sin(2 * np.pi * f * t) for f in rng.uniform(100, 2000, 3))
    return (np.round((x + 0.01 * rng.standard_normal(n)) * 32_767) / 32_768)[:, None]


def noise(rng, n: int, features: int = 8) -> np.ndarray:
    return rng.standard_normal((n, features))


def field(rng, n: int) -> np.ndarray:
    """Three damped oscillations, nearly without noise."""
    t = np.arange(n)[:, None] / n
    return np.exp(-rng.uniform(0.5, 3, 3) * t) * np.cos(2 * np.pi * rng.uniform(2, 9, 3) * t) + 1e-4 * rng.standard_normal((n, 3))


def rare(rng, n: int, features: int = 4) -> np.ndarray:
    """Mostly zeros."""
    return np.where(rng.random((n, features)) < 0.02, np.round(rng.exponential(10, (n, features)), 2), 0)


def steps(rng, n: int, features: int = 6) -> np.ndarray:
    """Readings of sensors in tenths."""
    return np.round(20 + np.cumsum(rng.choice([-0.1, 0, 0, 0.1], (n, features)), axis=0), 1)


#: Generators of one series by name: (steps of a window, values of n steps).
DOMAINS: dict[str, tuple[int, Callable]] = {
    "prices": (64, prices), "waves": (32, waves), "sensors": (32, sensors), "weather": (32, weather), "beats": (64, beats), "spectra": (32, spectra),
    "ticks": (64, ticks), "order_book": (64, order_book), "risk": (64, risk),
    "counters": (64, counters), "tiles": (32, tiles), "tones": (1024, tones), "noise": (64, noise), "field": (128, field), "rare": (64, rare), "steps": (64, steps),
}
#: Domains by what they are made for.
SUITES = {
    "domains": ("prices", "waves", "sensors", "weather", "beats", "spectra"),
    "finance": ("ticks", "order_book", "risk"),
    "standard": ("prices", "sensors", "counters", "tiles", "tones", "noise", "field", "rare"),
    "comprehensive": ("counters", "field", "steps", "noise", "tiles", "prices", "rare"),
}


def domain(spark: SparkSession, name: str, n_series: int, windows: int = 16, seed: int = 42) -> DataFrame:
    """``windows`` windows of each of ``n_series`` series of a domain, each series in one piece."""
    size, make = DOMAINS[name]
    number = sorted(DOMAINS).index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                x = make(np.random.default_rng([seed, number, s]), size * windows).astype(np.float32)
                cols = [pa.array([s] * windows), pa.array(range(windows), pa.int64()), pa.array(list(x.reshape(windows, -1)), pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["series", "win_id", "values"])

    return spark.range(n_series).mapInArrow(run, WINDOWS)


def suite(spark: SparkSession, name: str, n_series: int, windows: int = 16, seed: int = 42) -> DataFrame:
    """The windows of all domains of a suite, with their domain."""
    out = None
    for d in SUITES[name]:
        part = domain(spark, d, n_series, windows, seed).withColumn("domain", F.lit(d))
        out = part if out is None else out.unionByName(part)
    return out


def with_crash(windows: DataFrame, series: int, win_id: int, fall: float = 0.3, features: int = 5) -> DataFrame:
    """Price windows in which one falls by up to ``fall`` towards its end; the last feature, the volume, stays."""
    n = F.size("values")
    fallen = F.transform("values", lambda x, i: F.when(i % features == features - 1, x).otherwise((x * (1 - fall * i / n)).cast("float")))
    return windows.withColumn("values", F.when((F.col("series") == series) & (F.col("win_id") == win_id), fallen).otherwise(F.col("values")))


def _projected(spark: SparkSession, n: int, hidden: int, dimension: int, seed: int, make: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            z = np.stack([np.random.default_rng([seed, i]).standard_normal(hidden) for i in ids]) if ids else np.empty((0, hidden))
            rest = np.stack([np.random.default_rng([seed, i, 1]).standard_normal(dimension) for i in ids]) if ids else np.empty((0, dimension))
            v = make(np.random.default_rng([seed, 1 << 40]), z, rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(v), pa.list_(pa.float64()))], names=["id", "v"])

    return spark.range(n).mapInArrow(run, "id long, v array<double>")


def sine_manifold(spark: SparkSession, n: int, hidden: int = 5, dimension: int = 320, noise_: float = 0.01, seed: int = 42) -> DataFrame:
    """(id, v): points of few hidden coordinates, bent into many dimensions by a sine and a plane."""

    def make(fixed, z, rest):
        flat = z @ (fixed.standard_normal((hidden, dimension)) / np.sqrt(hidden))
        return np.sin(flat) + flat / 2 + noise_ * rest

    return _projected(spark, n, hidden, dimension, seed, make)


def folded_manifold(spark: SparkSession, n: int, hidden: int = 10, steps_: int = 64, features: int = 5, noise_: float = 1e-3, seed: int = 42) -> DataFrame:
    """(id, v): windows of steps x features from few hidden coordinates through two layers."""
    dimension = steps_ * features

    def make(fixed, z, rest):
        first, second = fixed.standard_normal((hidden, 64)) / np.sqrt(hidden), fixed.standard_normal((64, dimension)) / 8
        return np.tanh(z @ first) @ second + noise_ * rest

    return _projected(spark, n, hidden, dimension, seed, make)


def with_anomalies(spark: SparkSession, normal: int, odd: int, hidden: int = 10, dimension: int = 320, scale: float = 5.0, seed: int = 42) -> DataFrame:
    """(id, v, label): points of a sine manifold (0) and points off it (1), ids in no order of the labels."""
    far = _projected(spark, odd, hidden, dimension, seed + 1, lambda fixed, z, rest: scale * rest)
    both = sine_manifold(spark, normal, hidden, dimension, seed=seed).withColumn("label", F.lit(0)).unionByName(far.withColumn("label", F.lit(1)))
    return both.withColumn("id", F.xxhash64("id", "label", F.lit(seed)))
