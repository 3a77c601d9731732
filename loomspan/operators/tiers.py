"""Two tiers of a table of windows: codes to search by, and blobs that give the values back.

The encoder is trained here without gradients: windows are brought to mean 0 and scale 1 by feature, the nearest of a
codebook of windows is their top code, and what it leaves is cut into patches that several small codebooks quantise one
after another. Codebooks are k-means centres of a bounded sample; every window is encoded in one pass over the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspan.operators import codec, similarity
from loomspan.operators.codes import pack_codes

#: Windows that codebooks are fitted on at most.
SAMPLE = 20_000
CODES = "top int, bottom array<array<int>>, means array<float>, scales array<float>"


@dataclass(frozen=True)
class Model:
    """Codebooks of windows of ``steps`` x ``features`` with patches of ``patch`` steps; sent to all tasks."""

    steps: int
    features: int
    patch: int
    top: np.ndarray
    levels: tuple[np.ndarray, ...]

    def normalised(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean, scale = x.mean(axis=1), np.sqrt(x.var(axis=1) + 1e-5)
        return (x - mean[:, None]) / scale[:, None], mean, scale

    def _patches(self, z: np.ndarray) -> np.ndarray:
        return z.reshape(len(z), self.steps // self.patch, self.patch * self.features)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """top (n), bottom (n, patches, levels), means and scales (n, features) of windows (n, steps, features)."""
        z, mean, scale = self.normalised(x.astype(np.float64))
        top = _nearest(z.reshape(len(z), -1), self.top)
        rest = self._patches(z.reshape(len(z), -1) - self.top[top])
        bottom = np.empty((*rest.shape[:2], len(self.levels)), np.int64)
        for i, book in enumerate(self.levels):
            code = _nearest(rest.reshape(-1, rest.shape[2]), book).reshape(rest.shape[:2])
            bottom[..., i], rest = code, rest - book[code]
        return top, bottom, mean.astype(np.float32), scale.astype(np.float32)

    def decode(self, top: np.ndarray, bottom: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Windows (n, steps, features) that the codes stand for; a code of -1 adds nothing."""
        z = _looked_up(self.top, top)
        patches = sum((_looked_up(book, bottom[..., i]) for i, book in enumerate(self.levels)), np.zeros((*bottom.shape[:2], self.patch * self.features)))
        z = (z + patches.reshape(len(z), -1)).reshape(len(z), self.steps, self.features)
        return (z * scale.astype(np.float64)[:, None] + mean.astype(np.float64)[:, None]).astype(np.float32)

    def to_json(self) -> str:
        return json.dumps({"steps": self.steps, "features": self.features, "patch": self.patch, "top": self.top.tolist(), "levels": [x.tolist() for x in self.levels]})

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        return cls(d["steps"], d["features"], d["patch"], np.array(d["top"]), tuple(np.array(x) for x in d["levels"]))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return cls.from_json(spark.read.text(path).first().value)


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Nearest row of ``book`` to each row, the first of equals."""
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = ((book * book).sum(axis=1) - 2 * x[i : i + 4096] @ book.T).argmin(axis=1)
    return out


def _looked_up(book: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.where((code >= 0)[..., None], book[np.maximum(code, 0)], 0.0)


def _centres(spark: SparkSession, x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` centres of the rows of a sample, in a fixed order; distinct rows themselves where there are no more."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").select(array_to_vector("v").alias("f"))
    found = KMeans(k=k, seed=seed, featuresCol="f", maxIter=15).fit(rows).clusterCenters()
    return np.array(sorted(c.tolist() for c in found))


def fit(windows: DataFrame, steps: int, features: int, patch: int, top_codes: int = 32, codes: int = 64, levels: int = 3, sample: int = SAMPLE, seed: int = 42, values: str = "values", key: str = "win_id") -> Model:
    """A model of ``windows`` (key, values: steps x features, row by row), fitted on ``sample`` of them by a hash of the key."""
    if steps % patch:
        raise ValueError(f"patches of {patch} steps do not fill windows of {steps}")
    spark = windows.sparkSession
    some = windows.filter(F.size(values) == steps * features).orderBy(F.xxhash64(key, F.lit(seed))).limit(sample).select(values).toArrow()
    if not some.num_rows:
        raise ValueError("no window of that size")
    x = np.array(some[values].to_pylist(), np.float64).reshape(-1, steps, features)
    empty = Model(steps, features, patch, np.zeros((1, steps * features)), ())
    z = empty.normalised(x)[0].reshape(len(x), -1)
    top = _centres(spark, z, top_codes, seed)
    rest = empty._patches(z - top[_nearest(z, top)]).reshape(-1, patch * features)
    books = []
    for i in range(levels):
        books.append(_centres(spark, rest[:: max(1, len(rest) // sample)], codes, seed + i + 1))
        rest = rest - books[-1][_nearest(rest, books[-1])]
    return Model(steps, features, patch, top, tuple(books))


def _mapped(df: DataFrame, model: Model, kind: StructType, make) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for batch in batches:
            if batch.num_rows:
                cols = make(shared.value, {n: batch.column(n) for n in batch.schema.names})
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def _windows(column: pa.Array, model: Model) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, model.steps, model.features)


def _codes(cols: dict, model: Model) -> tuple:
    top = cols["top"].to_numpy(zero_copy_only=False)
    bottom = np.array(cols["bottom"].to_pylist(), np.int64).reshape(len(top), model.steps // model.patch, len(model.levels))
    mean, scale = (np.array(cols[c].to_pylist(), np.float32).reshape(len(top), model.features) for c in ("means", "scales"))
    return top, bottom, mean, scale


def encode(windows: DataFrame, model: Model, values: str = "values", key: str = "win_id") -> DataFrame:
    """(key, top, bottom, means, scales) of windows; those of another size or null are left out."""
    kind = StructType([windows.schema[key], *StructType.fromDDL(CODES).fields])

    def make(m: Model, cols: dict) -> list:
        top, bottom, mean, scale = m.encode(_windows(cols[values], m))
        return [cols[key], top.tolist(), bottom.tolist(), mean.tolist(), scale.tolist()]

    whole = windows.filter(F.size(values) == model.steps * model.features).select(key, F.col(values).cast("array<float>").alias(values))
    return _mapped(whole, model, kind, make)


def decode_search(codes: DataFrame, model: Model, key: str = "win_id") -> DataFrame:
    """(key, values): the windows that the codes stand for."""
    kind = StructType([codes.schema[key], *StructType.fromDDL("values array<float>").fields])

    def make(m: Model, cols: dict) -> list:
        out = m.decode(*_codes(cols, m))
        return [cols[key], list(out.reshape(len(out), -1))]

    return _mapped(codes.select(key, "top", "bottom", "means", "scales"), model, kind, make)


def tiered(windows: DataFrame, model: Model, mode: str = "lossless", values: str = "values", key: str = "win_id") -> tuple[DataFrame, DataFrame]:
    """(search tier: codes, storage tier: key, mode, raw_bytes, blob); windows of another size are in neither."""
    whole = windows.filter(F.size(values) == model.steps * model.features)
    storage = codec.compress(whole.select(key, values), mode, model.features, values)
    return encode(windows, model, values, key), storage


def encode_lossless(windows: DataFrame, model: Model, values: str = "values", key: str = "win_id") -> DataFrame:
    """Codes with blob: the bits in which each window differs from what its codes stand for."""
    kind = StructType([windows.schema[key], *StructType.fromDDL(f"{CODES}, raw_bytes long, blob binary").fields])

    def make(m: Model, cols: dict) -> list:
        x = _windows(cols[values], m)
        made = m.encode(x)
        near = m.decode(*made)
        top, bottom, mean, scale = made
        return [cols[key], top.tolist(), bottom.tolist(), mean.tolist(), scale.tolist(), [a.nbytes for a in x], [codec.xor_residual(a, b) for a, b in zip(x, near, strict=True)]]

    whole = windows.filter(F.size(values) == model.steps * model.features).select(key, F.col(values).cast("array<float>").alias(values))
    return _mapped(whole, model, kind, make)


def decode_lossless(coded: DataFrame, model: Model, key: str = "win_id") -> DataFrame:
    """(key, values) with every bit of the windows."""
    kind = StructType([coded.schema[key], *StructType.fromDDL("values array<float>").fields])

    def make(m: Model, cols: dict) -> list:
        near = m.decode(*_codes(cols, m))
        return [cols[key], [codec.xor_restore(b, x).ravel() for b, x in zip(cols["blob"].to_pylist(), near, strict=True)]]

    return _mapped(coded.select(key, "top", "bottom", "means", "scales", "blob"), model, kind, make)


def pack_search(codes: DataFrame, model: Model, key: str = "win_id") -> DataFrame:
    """(n, packed): the codes of each batch of windows packed together, without their keys."""

    def make(m: Model, cols: dict) -> list:
        top, bottom, *_ = _codes(cols, m)
        return [[len(top)], [pack_codes(top, bottom)]]

    return _mapped(codes.select(key, "top", "bottom", "means", "scales"), model, StructType.fromDDL("n long, packed binary"), make)


def tier_stats(codes: DataFrame, storage: DataFrame, model: Model, key: str = "win_id") -> DataFrame:
    """(n_windows, raw_bytes, search_bytes, storage_bytes, and the ratios and bytes a window of each tier and of both)."""
    packed = pack_search(codes, model, key).agg(F.sum("n").alias("n_windows"), F.sum(F.octet_length("packed")).alias("search_bytes"))
    kept = storage.agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum(F.octet_length("blob")).alias("storage_bytes"))
    both = packed.join(kept).withColumn("total_bytes", F.col("search_bytes") + F.col("storage_bytes"))  # one row each
    out = {}
    for tier in ("search", "storage", "total"):
        out[f"{tier}_ratio"] = F.col("raw_bytes") / F.greatest(F.col(f"{tier}_bytes"), F.lit(1))
        out[f"{tier}_bytes_a_window"] = F.col(f"{tier}_bytes") / F.greatest(F.col("n_windows"), F.lit(1))
    return both.withColumns(out)


def search(codes: DataFrame, queries: DataFrame, model: Model, k: int = 10, by: str = "codes", key: str = "win_id") -> DataFrame:
    """(qid, id, score, rnk): windows nearest to the coded ``queries`` by squared distance.

    ``by`` codes compares the code numbers themselves, ``values`` what they stand for.
    """
    if by not in ("codes", "values"):
        raise ValueError("by is 'codes' or 'values'")

    def placed(df: DataFrame) -> DataFrame:
        if by == "values":
            return decode_search(df, model, key).select(F.col(key).alias("id"), F.col("values").cast("array<double>").alias("v"))
        return df.select(F.col(key).alias("id"), F.concat(F.array("top"), F.flatten("bottom")).cast("array<double>").alias("v"))

    asked = placed(queries).select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return similarity.knn(placed(codes), asked, k, "euclidean")
