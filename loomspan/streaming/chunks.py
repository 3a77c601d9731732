"""Count-based chunks of a stream, their blobs, and windowed sums with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Chunker(StatefulProcessor):
    """Holds rows of a key until there are ``size`` and then emits them as one chunk."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "value double")
        self.done = handle.getValueState("done", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = [r[0] for r in self.rows.get()] if self.rows.exists() else []
        n = self.done.get()[0] if self.done.exists() else 0
        out = []
        for part in rows:
            held += part["value"].tolist()
        while len(held) >= self.size:
            out.append((key[0], n, self.size, held[: self.size]))
            held, n = held[self.size :], n + 1
        self.rows.clear()
        if held:
            self.rows.put([(v,) for v in held])
        self.done.update((n,))
        if out:
            yield pd.DataFrame(out, columns=["key", "chunk", "n", "values"])

    def close(self) -> None:
        pass


def chunked(stream: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """(key, chunk, n, values) of full chunks of a streaming ``stream``; the rest waits in the state store.

    Needs the RocksDB state store provider. A query started from its checkpoint goes on with the rows it held.
    """
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(value).alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(Chunker(size), "key long, chunk long, n long, values array<double>", "append", "none")


def windowed(stream: DataFrame, ts: str, by: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(by, start, n, total) in tumbling event-time windows; rows later than the watermark are left out."""
    w = F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(by, F.col("w.start").alias("start"), "n", "total")


def encoded(chunks: DataFrame, mode: str = "lossless", values: str = "values") -> DataFrame:
    """Chunks with a blob in place of their values; each can be decoded alone, of a stream or a batch."""
    import numpy as np

    from loomspan.operators import codec

    pack = pandas_udf(lambda s: s.map(lambda v: codec.encode(np.array(v, np.float32), mode)), "binary")
    return chunks.withColumn("blob", pack(F.col(values))).drop(values)


def decoded(chunks: DataFrame, blob: str = "blob") -> DataFrame:
    """Chunks with their values in place of the blob."""
    from loomspan.operators import codec

    return codec.decompress(chunks, blob)


def joined(chunks: DataFrame, key: str = "key", chunk: str = "chunk", values: str = "values") -> DataFrame:
    """(key, i, value): the values of all chunks of each key, one chunk after another."""
    rows = chunks.select(key, chunk, F.posexplode(values).alias("_at", "value"))
    w = Window.partitionBy(key).orderBy(chunk, "_at")
    return rows.select(key, (F.row_number().over(w) - 1).alias("i"), "value")


def rest(rows: DataFrame, by: str, order: list[str], value: str, size: int) -> DataFrame:
    """(key, chunk, n, values): the last, short chunk of each key of a bounded table, which a stream still holds back."""
    w = Window.partitionBy(by).orderBy(*order)
    placed = rows.select(F.col(by).alias("key"), F.col(value).alias("value"), (F.row_number().over(w) - 1).alias("i"))
    total = F.count("*").over(Window.partitionBy("key"))
    short = placed.withColumn("total", total).filter(F.col("i") >= F.floor(F.col("total") / size) * size)
    held = F.array_sort(F.collect_list(F.struct("i", "value")))["value"]
    return short.groupBy("key").agg(F.floor(F.first("total") / size).alias("chunk"), F.count("*").alias("n"), held.alias("values"))
