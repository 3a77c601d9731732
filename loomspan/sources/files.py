"""Readers and writers: price tables, binary arrays, pictures, sound, raw files, containers and chunk lists."""

import io
import json
import math
import struct
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomspan.operators import codec

PRICES = ("open", "high", "low", "close", "volume")


def read_prices(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """ts and the five price columns of a CSV with a header whose first column is the time; rows with gaps go."""
    raw = spark.read.csv(path, header=True)
    named = raw.toDF("ts", *(c.strip().lower() for c in raw.columns[1:]))
    if missing := [c for c in PRICES if c not in named.columns]:
        raise ValueError(f"columns not there: {missing}")
    out = named.select(F.to_timestamp("ts").alias("ts"), *(F.col(c).try_cast("double").alias(c) for c in PRICES)).na.drop()
    return out if symbol is None else out.withColumn("symbol", F.lit(symbol))


def combine(frames: dict[str, DataFrame]) -> DataFrame:
    """All frames with their symbol."""
    out = None
    for symbol, df in frames.items():
        part = df.withColumn("symbol", F.lit(symbol))
        out = part if out is None else out.unionByName(part)
    return out


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """path, shape, values of .npy files."""

    @pandas_udf("struct<shape: array<int>, values: array<float>>")
    def load(content: pd.Series) -> pd.DataFrame:
        arrays = [np.load(io.BytesIO(bytes(b)), allow_pickle=False) for b in content]
        return pd.DataFrame({"shape": [list(a.shape) for a in arrays], "values": [a.astype(np.float32).ravel() for a in arrays]})

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", load("content").alias("a")).select("path", "a.shape", "a.values")


def _float_samples(raw: bytes) -> tuple[int, np.ndarray] | None:
    """Rate and samples of a sound file whose samples are floats; None for others."""
    at, kind = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            kind = (channels, rate, bits) if form == 3 and bits in (32, 64) else None
        elif name == b"data":
            return (kind[1], np.frombuffer(body, f"<f{kind[2] // 8}").astype(np.float32).reshape(-1, kind[0])) if kind else None
        at += 8 + size + size % 2
    return None


def wav_samples(raw: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples in [-1, 1], channels by column."""
    if raw[:4] == b"RIFF" and (found := _float_samples(raw)):
        return found
    with wave.open(io.BytesIO(raw)) as w:
        width, data = w.getsampwidth(), w.readframes(w.getnframes())
        if width == 1:
            x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
        elif width in (2, 4):
            x = np.frombuffer(data, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
        else:
            raise ValueError(f"samples of {width} bytes")
        return w.getframerate(), x.reshape(-1, w.getnchannels())


def to_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_wav(spark: SparkSession, path: str, window: int = 1024) -> DataFrame:
    """path, win_id, values: full windows of the first channel; a shorter file is padded with zeros."""

    @pandas_udf("array<array<float>>")
    def cut(content: pd.Series) -> pd.Series:
        def one(b):
            x = wav_samples(bytes(b))[1][:, 0]
            if len(x) < window:
                x = np.pad(x, (0, window - len(x)))
            return list(x[: len(x) // window * window].reshape(-1, window))

        return content.map(one)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.posexplode(cut("content")).alias("win_id", "values"))


def swiss_roll(spark: SparkSession, n: int, seed: int = 42, noise: float = 0.0) -> DataFrame:
    """id and v (three coordinates) of points on a rolled sheet."""
    t = 1.5 * math.pi * (1 + 2 * F.rand(seed))
    rows = spark.range(n).select("id", t.alias("t"), (21 * F.rand(seed + 1)).alias("h"), *((F.randn(seed + 2 + i) * noise).alias(f"e{i}") for i in range(3)))
    return rows.select("id", F.array(F.col("t") * F.cos("t") + F.col("e0"), F.col("h") + F.col("e1"), F.col("t") * F.sin("t") + F.col("e2")).alias("v"))


def sine_series(spark: SparkSession, n_series: int, length: int, seed: int = 42, noise: float = 0.05) -> DataFrame:
    """series, t, value: a sine of its own frequency a series, with noise."""
    rows = spark.range(n_series).select(F.col("id").alias("series"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("t"))
    return rows.withColumn("value", F.sin((F.col("series") + 1) * F.col("t") * 2 * math.pi / length) + noise * F.randn(seed))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by the ending of its path: CSV, tab-separated text or Parquet, types inferred."""
    end = path.rsplit(".", 1)[-1].lower()
    if end == "parquet":
        return spark.read.parquet(path)
    if end in ("csv", "tsv", "txt"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="," if end == "csv" else "\t")
    raise ValueError(f"no table: {path}")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """path, content of files as they are."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, channels (1, 3 or 4; red first) and values in [0, 1], row by row; unreadable files are left out.

    Pictures are decoded by Spark's own image source.
    """
    found = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    @pandas_udf("array<float>")
    def scale(data: pd.Series, n: pd.Series) -> pd.Series:
        def one(raw, channels: int) -> np.ndarray:
            x = np.frombuffer(bytes(raw), np.uint8).reshape(-1, channels)
            order = [2, 1, 0, 3][:channels] if channels >= 3 else [0]
            return (x[:, order].astype(np.float32) / 255).ravel()

        return pd.Series([one(raw, channels) for raw, channels in zip(data, n, strict=True)])

    return found.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), scale("data", "nChannels").alias("values"))


def to_png(values: np.ndarray) -> bytes:
    """A picture (height x width x 1, 3 or 4 channels in [0, 1]) as a PNG file; shades are cut to 8 bits."""
    height, width, channels = values.shape
    kind = {1: 0, 3: 2, 4: 6}[channels]
    pixels = np.clip(values * 255, 0, 255).astype(np.uint8).reshape(height, -1)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels], axis=1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_files(df: DataFrame, root: str, name: str = "name", content: str = "content") -> DataFrame:
    """Each row's content as a file below ``root``; gives (file, bytes) once they are all written.

    A file is written under another name and then moved, so a task that runs again leaves whole files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            files, sizes = batch.column(0).to_pylist(), []
            for file, raw in zip(files, batch.column(1).to_pylist(), strict=True):
                if ".." in file.split("/"):
                    raise ValueError(f"{file} leaves the folder")
                fs.create_dir(f"{base}/{file}".rsplit("/", 1)[0], recursive=True)
                part = f"{base}/{file}.{zlib.crc32(raw):08x}.part"
                with fs.open_output_stream(part) as out:
                    out.write(raw)
                fs.move(part, f"{base}/{file}")
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(sizes, pa.int64())], names=["file", "bytes"])

    made = df.select(name, content).mapInArrow(run, "file string, bytes long")
    return df.sparkSession.createDataFrame(made.toPandas(), "file string, bytes long")  # a row a file, names only


def _made(df: DataFrame, make, *columns: str) -> DataFrame:
    udf = pandas_udf(lambda *cols: pd.Series([make(*row) for row in zip(*cols, strict=True)]), "binary")
    return df.withColumn("content", udf(*columns))


def write_images(images: DataFrame, root: str) -> DataFrame:
    """Pictures (name, height, width, channels, values) as PNG files below ``root``."""
    return write_files(_made(images, lambda h, w, c, v: to_png(np.array(v).reshape(h, w, c)), "height", "width", "channels", "values"), root)


def write_sounds(sounds: DataFrame, root: str) -> DataFrame:
    """Sounds (name, rate, channels, values in [-1, 1]) as 16-bit files below ``root``."""
    return write_files(_made(sounds, lambda r, c, v: to_wav(np.array(v).reshape(-1, c), r), "rate", "channels", "values"), root)


def write_arrays(arrays: DataFrame, root: str) -> DataFrame:
    """Arrays (name, shape, values) as .npy files below ``root``."""

    def make(shape, values) -> bytes:
        out = io.BytesIO()
        np.save(out, np.array(values, np.float32).reshape(shape))
        return out.getvalue()

    return write_files(_made(arrays, make, "shape", "values"), root)


def compress_files(spark: SparkSession, path: str, mode: str = "lossless_zstd") -> DataFrame:
    """path, kind, shape, mode, raw_bytes and blob of files: numbers of .npy and sound files by the codec, others as bytes.

    Tables go through ``frames`` instead.
    """

    def one(path_: str, raw: bytes) -> tuple:
        end = path_.rsplit(".", 1)[-1].lower()
        if end == "npy":
            a = np.load(io.BytesIO(raw), allow_pickle=False)
            if a.size:
                return "npy", list(a.shape), codec.encode(a.astype(np.float32), mode)
        if end == "wav":
            rate, x = wav_samples(raw)
            if x.size:
                return f"wav {rate}", list(x.shape), codec.encode(x, mode)
        return "raw", [len(raw)], codec.pack_bytes(raw)

    @pandas_udf("struct<kind: string, shape: array<int>, blob: binary>")
    def pack(paths: pd.Series, content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p, bytes(c)) for p, c in zip(paths, content, strict=True)], columns=["kind", "shape", "blob"])

    found = read_raw(spark, path).select("path", F.octet_length("content").cast("long").alias("raw_bytes"), pack("path", "content").alias("p"))
    return found.select("path", "p.kind", "p.shape", F.lit(mode).alias("mode"), "raw_bytes", "p.blob")


def decompress_files(packed: DataFrame, root: str) -> DataFrame:
    """The files of ``compress_files`` below ``root``, under their own names; gives (file, bytes)."""

    def one(kind: str, shape, blob) -> bytes:
        raw = bytes(blob)
        if kind == "raw":
            return codec.unpack_bytes(raw)
        x = codec.decode(raw).reshape([int(n) for n in shape])
        if kind == "npy":
            out = io.BytesIO()
            np.save(out, x)
            return out.getvalue()
        return to_wav(x, int(kind.split()[1]))

    named = _made(packed, one, "kind", "shape", "blob").withColumn("name", F.element_at(F.split("path", "/"), -1))
    return write_files(named, root)


#: Columns of a container besides its key, in order; each may be left out.
CONTAINER = ("coordinates", "chart", "confidence", "codes", "blob", "scales")


def write_container(df: DataFrame, path: str, key: str = "id", **header) -> None:
    """``df`` (key and any of ``CONTAINER``) as Parquet with a header of its blocks and of ``header``."""
    kept = [c for c in CONTAINER if c in df.columns]
    if not kept:
        raise ValueError(f"none of {CONTAINER}")
    spark = df.sparkSession
    df.select(key, *kept).repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows").count()
    head = {"key": key, "blocks": kept, "rows": rows, **header}
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def read_header(spark: SparkSession, path: str) -> dict:
    """The header alone; no row is read."""
    return json.loads(spark.read.text(f"{path}/header").first().value)


def read_container(spark: SparkSession, path: str, blocks: list[str] | None = None, keys: list | None = None) -> DataFrame:
    """Rows of a container: some blocks, some keys; only those columns and row groups are read."""
    head = read_header(spark, path)
    if missing := [b for b in blocks or [] if b not in head["blocks"]]:
        raise ValueError(f"blocks not there: {missing}")
    rows = spark.read.parquet(f"{path}/rows").select(head["key"], *(blocks or head["blocks"]))
    return rows if keys is None else rows.filter(F.col(head["key"]).isin(keys))


def pack_chunks(chunks: list[bytes]) -> bytes:
    """Chunks one after another, each behind its length."""
    return b"".join(struct.pack("<I", len(c)) + c for c in chunks)


def unpack_chunks(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        if at + 4 > len(raw) or at + 4 + (n := struct.unpack_from("<I", raw, at)[0]) > len(raw):
            raise ValueError("a chunk list that is cut short")
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def chunk_lists(chunks: DataFrame, by: list[str], order: str, blob: str = "blob") -> DataFrame:
    """(by, packed): the chunks of each key in order as one list."""
    udf = pandas_udf(lambda s: s.map(lambda x: pack_chunks([bytes(b) for b in x])), "binary")
    held = chunks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(blob).alias("b"))))["b"].alias("held"))
    return held.select(*by, udf("held").alias("packed"))


def listed_chunks(lists: DataFrame, packed: str = "packed") -> DataFrame:
    """A row a chunk of each list: its columns, chunk and blob."""
    udf = pandas_udf(lambda s: s.map(lambda b: unpack_chunks(bytes(b))), "array<binary>")
    return lists.select(*(c for c in lists.columns if c != packed), F.posexplode(udf(packed)).alias("chunk", "blob"))
