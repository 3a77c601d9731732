"""Named models and decoders in a small table: the last row of a name counts."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KIND = "step long, name string, domain string, facts map<string,string>, alive boolean"


def parameters_hash(parameters: dict[str, np.ndarray]) -> str:
    """SHA-256 over names, shapes and bytes of parameters, in the order of their names."""
    out = hashlib.sha256()
    for name in sorted(parameters):
        a = np.ascontiguousarray(parameters[name])
        out.update(f"{name} {a.dtype.str} {a.shape}".encode())
        out.update(a.tobytes())
    return out.hexdigest()


class Registry:
    """Entries by name below ``path``; a write adds a row, so readers always see whole entries."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(KIND).parquet(self.path) if there else self.spark.createDataFrame([], KIND)

    def _add(self, name: str, domain: str | None, facts: dict, alive: bool) -> None:
        step = (self._rows().agg(F.max("step")).first()[0] or 0) + 1
        row = [(step, name, domain, {k: str(v) for k, v in facts.items()}, alive)]
        self.spark.createDataFrame(row, KIND).coalesce(1).write.mode("append").parquet(self.path)

    def put(self, name: str, domain: str, facts: dict) -> None:
        self._add(name, domain, facts, True)

    def remove(self, name: str) -> None:
        self.get(name)
        self._add(name, None, {}, False)

    def list(self, domain: str | None = None) -> DataFrame:
        """(name, domain, facts) of the entries, or of those of a domain."""
        last = self._rows().groupBy("name").agg(F.max_by(F.struct("domain", "facts", "alive"), "step").alias("e"))
        rows = last.filter("e.alive").select("name", "e.domain", "e.facts")
        return rows if domain is None else rows.filter(F.col("domain") == domain)

    def names(self) -> list[str]:
        return sorted(r.name for r in self.list().select("name").collect())

    def get(self, name: str) -> dict:
        found = self.list().filter(F.col("name") == name).first()
        if found is None:
            raise KeyError(name)
        return found.asDict()
