"""Compression of whole DataFrames, a blob a column and block, in the column's own type."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import NumericType, StructType

from loomspan.operators.codec import deltas, pack_bytes, planes, undeltas, unpack_bytes, unplanes

KIND = "part int, block int, pos int, column string, n long, raw_bytes long, blob binary"


def numeric_columns(df: DataFrame) -> DataFrame:
    """``df`` with its number columns alone."""
    return df.select(*(f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)))


def _plain(kind: pa.DataType) -> bool:
    return pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_timestamp(kind) or pa.types.is_date(kind)


def _packed(column: pa.Array) -> bytes:
    """Numbers and times as differences by byte planes with the places of nulls; other types as Arrow buffers."""
    if _plain(column.type):
        width = column.type.bit_width // 8
        nulls = np.packbits(column.is_null().to_numpy(zero_copy_only=False)).tobytes()
        bits = column.view(pa.int64() if width == 8 else pa.int32() if width == 4 else pa.int16() if width == 2 else pa.int8())
        u = bits.fill_null(0).to_numpy(zero_copy_only=False).view(f"u{width}").reshape(-1, 1)
        tried = [bytes([order]) + pack_bytes(planes(deltas(u, order).ravel()) + nulls) for order in (0, 1)]
        return b"n" + min(tried, key=len)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("c", column.type)])) as w:
        w.write_batch(pa.RecordBatch.from_arrays([column], names=["c"]))
    return b"a" + pack_bytes(sink.getvalue().to_pybytes())


def _unpacked(blob: bytes, kind: pa.DataType, n: int) -> pa.Array:
    if blob[:1] == b"a":
        return pa.ipc.open_stream(unpack_bytes(blob[1:])).read_all()["c"].combine_chunks()
    order, raw = blob[1], unpack_bytes(blob[2:])
    width = kind.bit_width // 8
    u = undeltas(unplanes(raw[: n * width], f"u{width}").reshape(-1, 1), order).ravel()
    nulls = np.unpackbits(np.frombuffer(raw[n * width :], np.uint8), count=n).astype(bool)
    return pa.array(u.view(f"i{width}"), mask=nulls).view(kind)


def compress_frame(df: DataFrame) -> DataFrame:
    """(part, block, pos, column, n, raw_bytes, blob): the columns of each Arrow batch, where it lies.

    Every type comes back as it was; raw_bytes are those of the Arrow buffers.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            cols = [batch.column(j) for j in range(len(names))]
            made = [(part, i, j, n, batch.num_rows, c.nbytes, _packed(c)) for j, (n, c) in enumerate(zip(names, cols, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*made, strict=True), kind.types, strict=True)], schema=kind)

    kind = to_arrow_schema(StructType.fromDDL(KIND))
    return df.mapInArrow(run, KIND) if names else df.sparkSession.createDataFrame([], KIND)


def decompress_frame(blobs: DataFrame, schema: StructType) -> DataFrame:
    """The rows of ``compress_frame`` again; columns of one block meet by its number."""
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
        return pa.Table.from_arrays([_unpacked(r["blob"], f.type, r["n"]).cast(f.type) for r, f in zip(rows, arrow, strict=True)], schema=arrow)

    return blobs.groupBy("part", "block").applyInArrow(run, schema)


def write_frame(df: DataFrame, path: str) -> None:
    """Blobs and schema below ``path``."""
    spark = df.sparkSession
    compress_frame(df).write.mode("overwrite").parquet(f"{path}/blobs")
    spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def read_frame(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first().value))
    return decompress_frame(spark.read.parquet(f"{path}/blobs"), schema)


def frame_ratio(df: DataFrame, by_column: bool = False) -> DataFrame:
    """(column), raw_bytes, blob_bytes and ratio of ``df`` as it would be compressed."""
    made = compress_frame(df)
    sums = (made.groupBy("column") if by_column else made.groupBy()).agg(F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"), F.coalesce(F.sum(F.octet_length("blob")), F.lit(0)).alias("blob_bytes"))
    return sums.withColumn("ratio", F.col("raw_bytes") / F.greatest("blob_bytes", F.lit(1)))
