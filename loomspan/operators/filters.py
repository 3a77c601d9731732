"""Metadata filters compiled to columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {
    "$eq": lambda c, v: c == F.lit(v),
    "$ne": lambda c, v: c != F.lit(v),
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
}


def compile_filter(spec: Mapping | None, column=F.col) -> Column:
    """All conditions of ``spec`` at once; a row without the field fails every one of them.

    ``{"color": "red"}`` is equality; ``{"n": {"$gt": 1, "$lte": 5}}`` names operators. Unknown operators raise, as
    a filter that silently passes rows is worse than an error.
    """
    parts = [F.lit(True)]
    for field, wanted in (spec or {}).items():
        c = column(field)
        for op, value in (wanted if isinstance(wanted, Mapping) else {"$eq": wanted}).items():
            if op not in OPERATORS:
                raise ValueError(f"unknown filter operator {op!r}; known: {sorted(OPERATORS)}")
            parts.append(c.isNotNull() & OPERATORS[op](c, value))
    return reduce(lambda a, b: a & b, parts)


def to_metadata(columns: list[str]) -> Column:
    """Columns as one JSON text; null ones are left out."""
    return F.to_json(F.struct(*columns))


def from_metadata(text: Column, schema: str) -> Column:
    """The fields of a JSON text; absent and unfit ones are null."""
    return F.from_json(text, schema)
