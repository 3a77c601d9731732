"""What the operators share: scratch tables, row streams through Arrow, label folds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspan.tables import forget, materialize, scratch_path

__all__ = ["PART_ROWS", "fold", "forget", "give_back", "materialize", "scratch_path", "slices", "stream", "table", "unused"]

#: Rows of a batch that are Python objects at one time.
PART_ROWS = 2048


def give_back() -> None:
    """Return memory that the worker has freed to the system; workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def stream(df: DataFrame, schema: StructType | str, rows: Callable[[Iterator[dict]], Iterable[pa.RecordBatch | dict]]) -> DataFrame:
    """``mapInArrow`` in which ``rows`` gets batches as dicts of Python lists and yields dicts of columns."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(0, batch.num_rows, PART_ROWS):
                b = batch.slice(i, PART_ROWS)
                yield {n: b.column(j).to_pylist() for j, n in enumerate(b.schema.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows(parts(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(out[n], type=t) for n, t in arrow], names=[n for n, _ in arrow])
            del out
        give_back()

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = [(f.name, f.type) for f in to_arrow_schema(kind)]
    return df.mapInArrow(run, kind)


def slices(batch: dict, weight: str, most: int = 2 << 20) -> Iterator[dict]:
    """Parts of a batch whose ``weight`` column holds about ``most`` characters, one row at least."""
    n, begin, held = len(batch[weight]), 0, 0
    for i, value in enumerate(batch[weight]):
        held += len(value or "")
        if held >= most or i == n - 1:
            yield {k: v[begin : i + 1] for k, v in batch.items()}
            begin, held = i + 1, 0


def unused(df: DataFrame, name: str) -> str:
    """``name``, with marks before it until no column of ``df`` is named so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of a key as text, modulo ``parts``; a null key counts as empty text."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
