"""Command line: ``spark-submit`` or ``python -m loomspan`` with a verb."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import codec, frames, metrics, tiers
from loomspan.session import build_session
from loomspan.sources import files, synthetic


def _windows(spark: SparkSession, path: str) -> DataFrame:
    """win_id and values of a table of windows."""
    return spark.read.parquet(path).select("win_id", F.col("values").cast("array<float>").alias("values"))


def _print(df: DataFrame, rows: int = 50) -> None:
    df.show(rows, truncate=False)


def compress(spark: SparkSession, a: argparse.Namespace) -> None:
    """A table (CSV, text, Parquet) column by column, other files by their kind."""
    if a.path.rsplit(".", 1)[-1].lower() in ("csv", "tsv", "txt", "parquet"):
        frames.write_frame(files.read_table(spark, a.path), a.out)
    else:
        files.compress_files(spark, a.path, a.mode).write.mode("overwrite").parquet(a.out)


def decompress(spark: SparkSession, a: argparse.Namespace) -> None:
    try:
        back = frames.read_frame(spark, a.path)
    except Exception as e:  # noqa: BLE001  no packed table, so packed files
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files.decompress_files(spark.read.parquet(a.path), a.out)
        return
    back.write.mode("overwrite").parquet(a.out)


def ratio(spark: SparkSession, a: argparse.Namespace) -> None:
    _print(frames.frame_ratio(files.read_table(spark, a.path), by_column=True))


def info(spark: SparkSession, a: argparse.Namespace) -> None:
    print(json.dumps(files.read_header(spark, a.path), indent=1))


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    tiers.fit(_windows(spark, a.path), a.steps, a.features, a.patch).save(spark, a.model)


def encode(spark: SparkSession, a: argparse.Namespace) -> None:
    search, storage = tiers.tiered(_windows(spark, a.path), tiers.Model.load(spark, a.model), a.mode)
    search.write.mode("overwrite").parquet(f"{a.out}/search")
    storage.write.mode("overwrite").parquet(f"{a.out}/storage")


def decode(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.tier == "search":
        back = tiers.decode_search(spark.read.parquet(f"{a.path}/search"), tiers.Model.load(spark, a.model))
    else:
        back = codec.decompress(spark.read.parquet(f"{a.path}/storage")).select("win_id", "values")
    back.write.mode("overwrite").parquet(a.out)


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    coded = spark.read.parquet(f"{a.path}/search")
    _print(tiers.search(coded, coded.filter(F.col("win_id") == a.window), tiers.Model.load(spark, a.model), a.k, a.by).orderBy("rnk"))


def stats(spark: SparkSession, a: argparse.Namespace) -> None:
    _print(tiers.tier_stats(spark.read.parquet(f"{a.path}/search"), spark.read.parquet(f"{a.path}/storage"), tiers.Model.load(spark, a.model)))


def benchmark(spark: SparkSession, a: argparse.Namespace) -> None:
    """Ratios of the modes over made-up windows, as a table or a page."""
    rows = synthetic.suite(spark, a.suite, a.series, a.windows).select("domain", "values").cache()
    parts = [codec.compress(rows, m).select("domain", "mode", "raw_bytes", "blob") for m in a.modes.split(",")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    entries = metrics.compression_ratios(out, ["domain", "mode"], F.col("raw_bytes"), "blob").withColumn("entry", F.concat_ws(" ", "domain", "mode"))
    shown = metrics.report(entries, "entry", "ratio").select("place", "medal", "domain", "mode", "raw_bytes", "blob_bytes", F.round("ratio", 3).alias("ratio")).orderBy("place")
    if a.html:
        with open(a.html, "w", encoding="utf-8") as f:
            f.write(metrics.html_report(shown, f"Ratios of {a.suite}"))
    _print(shown, 200)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomspan")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(f, *paths: str, **options) -> None:
        v = verbs.add_parser(f.__name__, help=(f.__doc__ or "").split("\n")[0])
        for x in paths:
            v.add_argument(x)
        for name, (kind, default) in options.items():
            v.add_argument(f"--{name}", type=kind, default=default, required=default is ...)
        v.set_defaults(run=f)

    verb(compress, "path", "out", mode=(str, "lossless_zstd"))
    verb(decompress, "path", "out")
    verb(ratio, "path")
    verb(info, "path")
    verb(train, "path", "model", steps=(int, 64), features=(int, 1), patch=(int, 16))
    verb(encode, "path", "model", "out", mode=(str, "lossless"))
    verb(decode, "path", "model", "out", tier=(str, "storage"))
    verb(search, "path", "model", window=(int, 0), k=(int, 10), by=(str, "codes"))
    verb(stats, "path", "model")
    verb(benchmark, suite=(str, "standard"), series=(int, 4), windows=(int, 8), modes=(str, "lossless,lossless_zstd,lossless_fast,near_lossless,quantized_8,optimal_fast"), html=(str, ""))
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(spark or SparkSession.getActiveSession() or build_session(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
