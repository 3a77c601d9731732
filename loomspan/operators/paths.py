"""Interpolation between vectors and along way points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import vectors as V


def path(pairs: DataFrame, steps: int, how: str = "linear") -> DataFrame:
    """``pairs`` (a, b, ...) as one row for each of ``steps`` points from a to b: step, p."""
    move = {"linear": V.lerp, "spherical": V.slerp}[how]
    t: Column = F.col("step") / F.lit(float(max(steps - 1, 1)))
    return pairs.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("p", move(F.col("a"), F.col("b"), t)).drop("a", "b")


def multi_path(points: DataFrame, steps: int, by: list[str], order: str = "ord", how: str = "linear") -> DataFrame:
    """A path over way points (by, order, v) of each group; where two segments meet the point comes once."""
    w = Window.partitionBy(*by).orderBy(order)
    n = F.max(order).over(Window.partitionBy(*by))
    pairs = points.select(*by, F.col(order).alias("segment"), F.col("v").alias("a"), F.lead("v").over(w).alias("b"), (F.lead(order, 2).over(w).isNull() & (n > F.col(order))).alias("final"))
    made = path(pairs.filter("b is not null"), steps, how)
    return made.filter(F.col("final") | (F.col("step") < steps - 1)).drop("final")
