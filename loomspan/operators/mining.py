"""Clustering, density clusters, projections and isolation scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StructField, StructType

from loomspan.functions import vectors as V
from loomspan.operators.components import components
from loomspan.tables import materialize


def kmeans(vectors: DataFrame, k: int, seeds: int = 10, seed: int = 42) -> tuple[DataFrame, float]:
    """((id, label, d2), inertia) of the best of some starts; labels are ordered by the centres."""
    data = vectors.select("id", "v", array_to_vector("v").alias("f"))
    models = [KMeans(k=k, seed=seed + i, featuresCol="f", predictionCol="raw").fit(data) for i in range(seeds)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    centres = [c.tolist() for c in model.clusterCenters()]
    order = sorted(range(len(centres)), key=centres.__getitem__)
    names = F.array(*(F.lit(order.index(i)) for i in range(len(centres))))
    points = F.array(*(F.array(*map(F.lit, c)) for c in centres))
    placed = model.transform(data)
    out = placed.select("id", names[F.col("raw")].alias("label"), V.squared_distance(F.col("v"), points[F.col("raw")]).alias("d2"))
    return out, float(model.summary.trainingCost)


#: Pairs of points whose distances are in memory at once.
TILE = 1 << 20


def _placed(vectors: DataFrame, eps: float) -> DataFrame:
    """(id, v, n, cx, cy): vectors with their dimension and their cell of width eps on the first two dimensions."""
    cell = lambda i: F.coalesce(F.floor(F.try_element_at("v", F.lit(i + 1)) / eps).cast("long"), F.lit(0))
    return vectors.filter("v is not null").select("id", "v", F.size("v").alias("n"), cell(0).alias("cx"), cell(1).alias("cy"))


def _around(placed: DataFrame, run: Callable, kind: StructType) -> DataFrame:
    """``run`` on each cell: (ids, points, own, the further columns) of its points (``own``) and of those around it.

    A point is sent to nine cells, so what is shuffled grows with the points, not with the pairs of near ones.
    """
    more = [c for c in placed.columns if c not in ("id", "v", "n", "cx", "cy")]
    names = [f.name for f in kind]
    arrow = to_arrow_schema(kind)
    near = F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), F.lit(i == j == 0).alias("own")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("c")
    rows = placed.select("id", "v", "n", *more, near).select("id", "v", "n", *more, "c.cx", "c.cy", "c.own")

    def of_cell(table: pa.Table) -> pa.Table:
        own = table["own"].to_numpy()
        if not own.any():
            return arrow.empty_table()
        flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        found = run(table["id"].combine_chunks(), flat.reshape(len(own), -1), own, *(table[c].combine_chunks() for c in more))
        return pa.table(dict(zip(names, found, strict=True))).cast(arrow)

    return rows.groupBy("n", "cx", "cy").applyInArrow(of_cell, kind)


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Matrix of whether points are within ``eps``, summed dimension by dimension."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[:, j]) ** 2
    return total <= eps * eps


def dbscan(vectors: DataFrame, eps: float, least: int) -> DataFrame:
    """(id, label): clusters of core points (``least`` points within ``eps``, itself counted), named by their smallest
    core id; -1 is noise. A border point goes to the cluster of least name among its core neighbours.

    Pairs of neighbours are never kept: each cell counts its points' neighbours up to ``least``, then links the core
    points in and around it to one of each local cluster; clusters are the connected components of those links.
    """
    id_ = vectors.schema["id"]
    kind = lambda *more: StructType([StructField("id", id_.dataType), *more])

    def counted(ids, v, own, *_):
        mine, n = np.flatnonzero(own), np.zeros(len(own), np.int64)
        others, left = np.concatenate([mine, np.flatnonzero(~own)]), mine
        for i in range(0, len(others), 1024):
            part = others[i : i + 1024]
            for j in range(0, len(left), TILE // 1024):
                some = left[j : j + TILE // 1024]
                n[some] += _near(v[some], v[part], eps).sum(axis=1)
            left = left[n[left] < least]
            if not len(left):
                break
        return ids.take(pa.array(mine)), n[mine] >= least

    def linked(ids, v, own):
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        rest, nodes, roots = np.argsort(place), [], []
        while len(rest):
            found, todo, rest = [rest[0]], [rest[0]], rest[1:]
            while todo and len(rest):
                step = max(1, min(64, TILE // len(rest)))
                some, todo = todo[:step], todo[step:]
                hit = np.zeros(len(rest), bool)
                for i in range(0, len(rest), TILE // 64):
                    hit[i : i + TILE // 64] = _near(v[some], v[rest[i : i + TILE // 64]], eps).any(axis=0)
                new, rest = rest[hit].tolist(), rest[~hit]
                found += new
                todo += new
            nodes += found
            roots += [found[0]] * len(found)
        return ids.take(pa.array(nodes)), ids.take(pa.array(roots))

    def bordered(ids, v, own, label):
        known = label.is_valid().to_numpy(zero_copy_only=False)
        core, mine = np.flatnonzero(known), np.flatnonzero(own & ~known)
        core = core[pc.sort_indices(label.take(pa.array(core))).to_numpy()]  # the first that is near has the least name
        first = np.full(len(own), -1)
        for i in range(0, len(core), 1024):
            part, left = core[i : i + 1024], mine[first[mine] < 0]
            for j in range(0, len(left), TILE // 1024):
                some = left[j : j + TILE // 1024]
                hit = _near(v[some], v[part], eps)
                first[some] = np.where(hit.any(axis=1), part[hit.argmax(axis=1)], -1)
        mine = mine[first[mine] >= 0]
        return ids.take(pa.array(mine)), label.take(pa.array(first[mine]))

    placed = materialize(_placed(vectors, eps), "placed")
    core = materialize(_around(placed, counted, kind(StructField("core", BooleanType()))).filter("core").select("id"), "core")
    of_core = placed.join(core, "id", "left_semi")
    links = _around(of_core, linked, StructType([StructField("a", id_.dataType), StructField("b", id_.dataType)]))
    comp = components(links).select(F.col("node").alias("id"), "root")
    own = materialize(core.join(comp, "id", "left").select("id", F.coalesce("root", "id").alias("label")), "own")
    labelled = placed.join(own, "id", "left").select("id", "v", "n", "cx", "cy", "label")
    border = _around(labelled, bordered, kind(StructField("label", id_.dataType)))
    named = own.unionByName(border)
    return vectors.select("id").join(named, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def cluster_centres(vectors: DataFrame, labels: DataFrame, noise: int = -1) -> DataFrame:
    """(label, pos, x): the mean vector of each cluster, noise left out."""
    rows = vectors.select("id", "v").join(labels.filter(F.col("label") != noise), "id").select("label", F.posexplode("v").alias("pos", "x"))
    return rows.groupBy("label", "pos").agg(F.avg("x").alias("x"))


def inertia(vectors: DataFrame, labels: DataFrame, noise: int = -1) -> DataFrame:
    """(inertia): squared distances to the centres of the clusters, noise left out."""
    rows = vectors.select("id", "v").join(labels.filter(F.col("label") != noise), "id").select("label", F.posexplode("v").alias("pos", "x"))
    return rows.groupBy("label", "pos").agg((F.var_pop("x") * F.count("*")).alias("part")).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("inertia"))


def inertias(vectors: DataFrame, ks: list[int], seeds: int = 1, seed: int = 42) -> DataFrame:
    """(k, inertia) of a k-means fit for each k; ``series.elbow`` names the bend."""
    return vectors.sparkSession.createDataFrame([(k, kmeans(vectors, k, seeds, seed)[1]) for k in ks], "k int, inertia double")


def pca(vectors: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """((id, z), explained variance by component)."""
    data = vectors.select("id", array_to_vector("v").alias("f"))
    model = PCA(k=k, inputCol="f", outputCol="z").fit(data)
    return model.transform(data).select("id", vector_to_array("z").alias("z")), model.explainedVariance.tolist()


@dataclass(frozen=True)
class Projection:
    """Principal axes (components x dimensions) and the mean; projects vectors and brings them back."""

    mean: tuple[float, ...]
    axes: tuple[tuple[float, ...], ...]

    def project(self, v: Column) -> Column:
        axes, mean = np.array(self.axes).reshape(len(self.axes), -1), np.array(self.mean)
        return _by_matrix(lambda x: (x - mean) @ axes.T, len(mean))(v)

    def restore(self, z: Column) -> Column:
        """Vectors from projections."""
        axes, mean = np.array(self.axes).reshape(len(self.axes), -1), np.array(self.mean)
        return _by_matrix(lambda x: x @ axes + mean, len(axes))(z)


def _by_matrix(f: Callable[[np.ndarray], np.ndarray], width: int):
    """A column function of arrays: ``f`` on the rows of a batch as a matrix; null for null and for another length."""

    @arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        good = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(v), width), False).to_numpy(zero_copy_only=False))
        made = f(v.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(good), width))
        ends = np.zeros(len(v) + 1, np.int32)
        ends[good + 1] = made.shape[1]
        missing = np.ones(len(v), bool)
        missing[good] = False
        return pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), pa.array(made.ravel()), mask=pa.array(missing))

    return run


def fit_projection(vectors: DataFrame, share: float = 0.99, most: int | None = None) -> Projection:
    """The fewest principal axes that explain ``share`` of the variance, ``most`` at most.

    The covariance is summed in tasks; its size is the square of the dimension, whatever the number of rows.
    """
    dimension = len(vectors.select("v").first()["v"])
    data = vectors.select(array_to_vector("v").alias("f"))
    model = PCA(k=dimension, inputCol="f", outputCol="z").fit(data)
    explained = np.cumsum(model.explainedVariance.toArray())
    k = min(int(np.searchsorted(explained, share - 1e-12)) + 1, most or dimension, dimension)
    mean = data.select(Summarizer.mean(F.col("f")).alias("m")).first()["m"]
    return Projection(tuple(map(float, mean)), tuple(tuple(map(float, axis)) for axis in model.pc.toArray().T[:k]))


def isolation(vectors: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """(id, score): isolation depth score in (0, 1], high for outliers.

    Every tree has a sample of its own, drawn from all rows: each row gets a hash for each tree, and the ``sample`` rows
    of least hash make the tree.
    """
    draws = vectors.select("id", "v", F.posexplode(F.array(*(F.xxhash64("id", F.lit(seed + t)) for t in range(trees)))).alias("tree", "h"))
    w = Window.partitionBy("tree").orderBy("h", "id")
    rows = draws.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= sample).select("tree", "rnk", "v").collect()  # trees * sample rows
    drawn: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.tree, r.rnk)):
        drawn.setdefault(r.tree, []).append(r.v)
    rng = np.random.default_rng(seed)
    size = min(sample, max(map(len, drawn.values()), default=0))
    limit = int(np.ceil(np.log2(max(size, 2))))

    def usual(m: int) -> float:
        return 0.0 if m < 2 else 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m if m > 2 else 1.0

    def grow(part: np.ndarray, depth: int):
        spread = np.ptp(part, axis=0) if len(part) else np.zeros(1)
        if depth >= limit or len(part) < 2 or not spread.any():
            return depth + usual(len(part))
        j = int(rng.choice(np.flatnonzero(spread)))
        cut = rng.uniform(part[:, j].min(), part[:, j].max())
        left = part[:, j] < cut
        return j, cut, grow(part[left], depth + 1), grow(part[~left], depth + 1)

    forest = [grow(np.array(drawn[t], np.float64), 0) for t in sorted(drawn)]

    def depth(tree, points: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(points), tree)
        j, cut, a, b = tree
        out, left = np.empty(len(points)), points[:, j] < cut
        out[left], out[~left] = depth(a, points[left]), depth(b, points[~left])
        return out

    @pandas_udf("double")
    def score(v):
        import pandas as pd

        points = np.stack(v.to_numpy())
        return pd.Series(2 ** (-np.mean([depth(t, points) for t in forest], axis=0) / max(usual(size), 1e-9)))

    return vectors.select("id", score("v").alias("score"))


def scaled_isolation(scores: DataFrame) -> DataFrame:
    """(id, score): isolation scores spread over 0 to 1 among the rows that are scored together."""
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return scores.join(F.broadcast(ends)).select("id", ((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8)).alias("score"))


def thresholded(rows: DataFrame, score: str, contamination: float = 0.05) -> DataFrame:
    """``rows`` with cut, the value that a ``contamination`` share exceeds, and flag."""
    cut = rows.agg(F.percentile(score, F.lit(1 - contamination)).alias("cut"))
    return rows.join(F.broadcast(cut)).withColumn("flag", (F.col(score) > F.col("cut")).cast("int"))


def combined(scores: dict[str, DataFrame], threshold: float = 0.5) -> DataFrame:
    """(id, score, flag): the mean of the scores (id, score) of all detectors; rows that one lacks are left out."""
    if not scores:
        raise ValueError("no detector")
    out = None
    for name, df in scores.items():
        part = df.select("id", F.col("score").alias(name))
        out = part if out is None else out.join(part, "id")
    mean = sum((F.col(n) for n in scores), F.lit(0.0)) / len(scores)
    return out.select("id", mean.alias("score")).withColumn("flag", (F.col("score") > threshold).cast("int"))
