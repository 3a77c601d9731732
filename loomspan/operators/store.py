"""A vector store over partitioned Parquet: indexes, namespaces, upsert, query, fetch, delete, statistics."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import vectors as V
from loomspan.operators.similarity import knn

SCHEMA = "id string, values array<float>, metadata map<string,string>"
#: Parts of a namespace that are written apart.
BUCKETS = 64


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def upsert(current: DataFrame, incoming: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """``current`` with rows of ``incoming`` put in by key; of rows with one key the last by ``order`` counts.

    Rows of equal key and order are told apart by their own text, so that a run repeated gives the same rows.
    """
    fields = [c for c in incoming.columns if c not in (key, order)]
    place = F.struct(F.col(order), F.to_json(F.struct(*fields)))
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*fields), place).alias("r")).select(key, "r.*")
    return current.join(last.select(key), key, "left_anti").unionByName(last)


def fetch(current: DataFrame, keys: Iterable, key: str = "id") -> DataFrame:
    """Rows of the given keys; absent keys are left out."""
    return current.filter(F.col(key).isin(list(keys)))


def delete(current: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return current.join(keys.select(key), key, "left_anti")


def count_present(current: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """(deleted): how many rows ``delete`` takes away."""
    return current.join(keys.select(key), key, "left_semi").agg(F.count("*").alias("deleted"))


def statistics(vectors: DataFrame, by: str = "namespace") -> DataFrame:
    """(by, vectors, dimension, raw_bytes) with a total row (by null)."""
    size = F.size("v")
    return vectors.rollup(by).agg(F.count("*").alias("vectors"), F.max(size).alias("dimension"), F.sum(size * 4).alias("raw_bytes"))


class VectorStore:
    """Snapshots of namespaces below ``root``: rows lie in ``BUCKETS`` by a hash of their id, a version names the files of
    each bucket.

    A write makes new files for the buckets it touches and then a new version file by renaming, so readers always see a
    whole namespace and a crash leaves the version before. Old files stay until ``vacuum``. Of two writers that start
    from one version the second fails. Reads create nothing; deleting an index removes its files.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _settings(self) -> DataFrame | None:
        fs, p = self._fs(f"{self.root}/_indexes")
        return self.spark.read.parquet(f"{self.root}/_indexes") if fs.exists(p) else None

    def list_indexes(self) -> list[str]:
        known = self._settings()
        if known is None:
            return []
        last = known.groupBy("name").agg(F.max_by("alive", "step").alias("alive")).filter("alive")
        return sorted(r.name for r in last.collect())

    def describe(self, index: str) -> tuple[int, str]:
        if index not in self.list_indexes():
            raise KeyError(index)
        r = self._settings().filter(F.col("name") == index).orderBy(F.desc("step")).first()
        return r.dimension, r.metric

    def _note(self, name: str, dimension: int, metric: str, alive: bool) -> None:
        known = self._settings()
        step = 0 if known is None else known.filter(F.col("name") == name).count()
        row = self.spark.createDataFrame([(name, dimension, metric, alive, step)], "name string, dimension int, metric string, alive boolean, step long")
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/_indexes")

    def create_index(self, name: str, dimension: int, metric: str = "cosine") -> None:
        if metric not in V.METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        if name in self.list_indexes():
            raise ValueError(f"index {name!r} is already there")
        self._note(name, dimension, metric, True)

    def delete_index(self, name: str) -> None:
        dimension, metric = self.describe(name)
        self._note(name, dimension, metric, False)
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)

    def namespaces(self, index: str) -> list[str]:
        """Namespaces that were written; the one without a name is 'default'."""
        self.describe(index)
        return self._names(f"{self.root}/{index}")

    def _version(self, index: str, namespace: str) -> tuple[int, dict[str, str]]:
        """Number of the live version, and the files of its buckets."""
        base = f"{self.root}/{index}/{namespace or 'default'}/versions"
        names = [x for x in self._names(base) if x.startswith("v")]
        if not names:
            return -1, {}
        return int(names[-1][1:]), json.loads(self.spark.read.text(f"{base}/{names[-1]}", wholetext=True).first().value)

    def vectors(self, index: str, namespace: str = "") -> DataFrame:
        """id, values, metadata of a namespace; one that was never written is empty."""
        self.describe(index)
        return self._read(list(self._version(index, namespace)[1].values()))

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def _replace(self, index: str, namespace: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Write the buckets that hold ``keys`` (id) anew, as ``change`` makes them, and make that the live version."""
        base = f"{self.root}/{index}/{namespace or 'default'}"
        at, files = self._version(index, namespace)
        touched = {str(r.b) for r in keys.select(_bucket("id").alias("b")).distinct().collect()}  # BUCKETS at most
        path = f"{base}/data-{uuid.uuid4().hex}"
        rows = change(self._read([p for b, p in files.items() if b in touched]))
        rows.select("id", "values", "metadata", _bucket("id").alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(path)
        new = {x.removeprefix("bucket="): f"{path}/{x}" for x in self._names(path) if x.startswith("bucket=")}
        live = {b: p for b, p in files.items() if b not in touched} | new
        fs, made = self._fs(f"{base}/versions/_{uuid.uuid4().hex}")
        out = fs.create(made)
        out.write(bytearray(json.dumps(live).encode()))
        out.close()
        final = self._fs(f"{base}/versions/v{at + 1:012d}")[1]
        if fs.exists(final) or not fs.rename(made, final):
            fs.delete(made, False)
            raise RuntimeError(f"{index}/{namespace or 'default'} was written by another")

    def vacuum(self, index: str, namespace: str = "") -> None:
        """Remove files and versions that the live version does not need; readers of older ones must have ended."""
        base = f"{self.root}/{index}/{namespace or 'default'}"
        at, files = self._version(index, namespace)
        for x in self._names(base):
            for part in self._names(f"{base}/{x}") if x.startswith("data-") else ():
                if f"{base}/{x}/{part}" not in files.values():
                    fs, p = self._fs(f"{base}/{x}/{part}")
                    fs.delete(p, True)
        for x in self._names(f"{base}/versions"):
            if x != f"v{at:012d}":
                fs, p = self._fs(f"{base}/versions/{x}")
                fs.delete(p, True)

    def upsert(self, index: str, rows: DataFrame, namespace: str = "", order: str = "seq") -> None:
        """Put rows (id, values, metadata, seq) in; all dimensions are checked before anything is written."""
        dimension, _ = self.describe(index)
        if bad := rows.filter(F.coalesce(F.size("values"), F.lit(-1)) != dimension).limit(1).collect():
            raise ValueError(f"{bad[0].id}: not of dimension {dimension}")
        self._replace(index, namespace, rows, lambda current: upsert(current, rows, order=order))

    def delete(self, index: str, ids: list[str], namespace: str = "") -> int:
        keys = self.spark.createDataFrame([(i,) for i in ids], "id string")
        current = self.vectors(index, namespace)
        n = count_present(current, keys).first().deleted
        if n:
            self._replace(index, namespace, keys, lambda held: delete(held, keys))
        return n

    def fetch(self, index: str, ids: list[str], namespace: str = "") -> DataFrame:
        return fetch(self.vectors(index, namespace), ids)

    def query(self, index: str, queries: DataFrame, k: int = 10, namespace: str = "", where: Mapping | None = None, filter_mode: str = "pre", include_values: bool = False, include_metadata: bool = True) -> DataFrame:
        """Best k of queries (qid, q). ``where`` compares metadata as text, and as numbers for number operands."""
        _, metric = self.describe(index)
        rows = self.vectors(index, namespace).withColumn("v", V.doubles(F.col("values")))
        numeric = {f for f, w in (where or {}).items() if any(isinstance(x, int | float) for x in (w.values() if isinstance(w, Mapping) else [w]))}
        named = rows.withColumns({f"m_{f}": F.try_element_at("metadata", F.lit(f)).try_cast("double") if f in numeric else F.try_element_at("metadata", F.lit(f)) for f in where or {}})
        found = knn(named, queries, k, metric, {f"m_{f}": w for f, w in (where or {}).items()}, filter_mode)
        dropped = [*(f"m_{f}" for f in where or {}), *([] if include_values else ["values"]), *([] if include_metadata else ["metadata"])]
        return found.drop(*dropped)

    def stats(self, index: str, namespaces: list[str] | None = None) -> DataFrame:
        """Rows, dimension and bytes of each namespace (all that were written), and of all together."""
        out = self.spark.createDataFrame([], "namespace string, v array<float>")
        for n in self.namespaces(index) if namespaces is None else namespaces:
            out = out.unionByName(self.vectors(index, n).select(F.lit(n).alias("namespace"), F.col("values").alias("v")))
        return statistics(out)
