"""Tables in the folder that all executors share: they end a plan's lineage and outlive executors."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_LIVE: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or one below the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver process ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _LIVE.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._scratch = path
    return again


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and no plan still needs."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path:
            delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _LIVE:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may already have ended
            pass
