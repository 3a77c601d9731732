"""Requests to a vector store as plain values: what a web front would pass on, checked and answered."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import SparkSession

from loomspan.functions import vectors as V
from loomspan.operators.store import VectorStore


class Refused(ValueError):
    """A request that cannot be answered, with the status of the answer."""

    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status = status


def _numbers(x: Any) -> list[float]:
    if not isinstance(x, list) or not x or not all(isinstance(v, int | float) and not isinstance(v, bool) for v in x):
        raise Refused(400, "a vector is a list of numbers")
    return [float(v) for v in x]


@dataclass(frozen=True)
class CreateIndex:
    name: str
    dimension: int
    metric: str = "cosine"

    def __post_init__(self):
        if not self.name or "/" in self.name or self.name.startswith("_"):
            raise Refused(400, f"no name for an index: {self.name!r}")
        if not isinstance(self.dimension, int) or self.dimension < 1:
            raise Refused(400, "the dimension is a positive integer")
        if self.metric not in V.METRICS:
            raise Refused(400, f"unknown metric {self.metric!r}")


@dataclass(frozen=True)
class Vector:
    id: str
    values: list[float]
    metadata: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        _numbers(self.values)


@dataclass(frozen=True)
class Upsert:
    vectors: list[dict]
    namespace: str = ""

    def rows(self) -> list[Vector]:
        return [_request(Vector, v) for v in self.vectors]


@dataclass(frozen=True)
class Query:
    vector: list[float]
    top_k: int = 10
    namespace: str = ""
    filter: dict | None = None
    include_values: bool = False
    include_metadata: bool = True

    def __post_init__(self):
        _numbers(self.vector)
        if not isinstance(self.top_k, int) or self.top_k < 1:
            raise Refused(400, "top_k is a positive integer")


@dataclass(frozen=True)
class Fetch:
    ids: list[str]
    namespace: str = ""


@dataclass(frozen=True)
class Delete:
    ids: list[str]
    namespace: str = ""


def _request(kind: type, body: Any):
    """A request of a kind from a parsed body; unknown and missing fields are refused."""
    known = {f.name for f in fields(kind)}
    if not isinstance(body, dict) or (extra := set(body) - known):
        raise Refused(400, f"{kind.__name__} takes {sorted(known)}" + ("" if not isinstance(body, dict) else f", not {sorted(extra)}"))
    try:
        return kind(**body)
    except TypeError as e:
        raise Refused(400, str(e)) from e


class Service:
    """Answers (status, body) to requests (method, path, body) over the store below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, VectorStore(spark, root)

    def handle(self, method: str, path: str, body: Any = None) -> tuple[int, dict]:
        try:
            return 200, self._answer(method, [p for p in path.split("/") if p], body)
        except Refused as e:
            return e.status, {"error": str(e)}
        except KeyError as e:
            return 404, {"error": f"no index {e.args[0]!r}"}
        except ValueError as e:
            return 400, {"error": str(e)}

    def _answer(self, method: str, path: list[str], body: Any) -> dict:
        match method, path:
            case "GET", []:
                return {"name": "loomspan", "indexes": len(self.store.list_indexes())}
            case "GET", ["health"]:
                return {"status": "ok"}
            case "GET", ["indexes"]:
                return {"indexes": [self._described(n) for n in self.store.list_indexes()]}
            case "POST", ["indexes"]:
                r = _request(CreateIndex, body)
                if r.name in self.store.list_indexes():
                    raise Refused(409, f"index {r.name!r} is already there")
                self.store.create_index(r.name, r.dimension, r.metric)
                return self._described(r.name)
            case "GET", ["indexes", name]:
                return self._described(name)
            case "DELETE", ["indexes", name]:
                self.store.delete_index(name)
                return {"deleted": name}
            case "POST", ["indexes", name, "upsert"]:
                return self._upsert(name, _request(Upsert, body))
            case "POST", ["indexes", name, "query"]:
                return self._query(name, _request(Query, body))
            case "POST", ["indexes", name, "fetch"]:
                r = _request(Fetch, body)
                rows = self.store.fetch(name, r.ids, r.namespace).collect()  # the ids asked for
                return {"vectors": {x.id: {"values": x["values"], "metadata": x.metadata} for x in rows}}
            case "POST", ["indexes", name, "delete"]:
                r = _request(Delete, body)
                return {"deleted": self.store.delete(name, r.ids, r.namespace)}
            case "GET", ["indexes", name, "stats"]:
                return {"namespaces": {x.namespace: {"vectors": x.vectors, "raw_bytes": x.raw_bytes} for x in self.store.stats(name).collect() if x.namespace is not None}}
            case "POST", ["indexes", name, "vacuum"]:
                for n in self.store.namespaces(name):
                    self.store.vacuum(name, n)
                return {"status": "ok"}
        raise Refused(404, f"nothing at {method} /{'/'.join(path)}")

    def _described(self, name: str) -> dict:
        dimension, metric = self.store.describe(name)
        return {"name": name, "dimension": dimension, "metric": metric, "namespaces": self.store.namespaces(name)}

    def _upsert(self, name: str, r: Upsert) -> dict:
        rows = r.rows()
        if not rows:
            return {"upserted": 0}
        kind = "id string, values array<float>, metadata map<string,string>, seq int"
        data = [(v.id, _numbers(v.values), {k: str(x) for k, x in v.metadata.items()}, i) for i, v in enumerate(rows)]
        self.store.upsert(name, self.spark.createDataFrame(data, kind), r.namespace)
        return {"upserted": len({v.id for v in rows})}

    def _query(self, name: str, r: Query) -> dict:
        dimension, _ = self.store.describe(name)
        if len(r.vector) != dimension:
            raise Refused(400, f"the index has {dimension} dimensions, the vector {len(r.vector)}")
        asked = self.spark.createDataFrame([(0, _numbers(r.vector))], "qid int, q array<double>")
        found = self.store.query(name, asked, r.top_k, r.namespace, r.filter, include_values=r.include_values, include_metadata=r.include_metadata)
        kept = ["id", "score", *(["values"] if r.include_values else []), *(["metadata"] if r.include_metadata else [])]
        return {"matches": [x.asDict() for x in found.orderBy("rnk").select(*kept).collect()]}  # top_k rows
