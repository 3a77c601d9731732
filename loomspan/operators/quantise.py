"""Vector quantisation with small codebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import vectors as V

#: Codewords of a codebook that is sent to all tasks.
MOST_CODES = 65_536


def assign(vectors: DataFrame, codebook: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``vectors`` (id, v) with the nearest codeword (code, cv) and its squared distance; ties to the smaller code."""
    if (n := codebook.count()) > MOST_CODES:
        raise ValueError(f"{n} codewords; at most {MOST_CODES}")
    every = codebook.agg(F.array_sort(F.collect_list(F.struct("code", "cv"))).alias("book"))
    best = F.array_min(F.transform("book", lambda c: F.struct(V.squared_distance(F.col("v"), c["cv"]).alias("d2"), c["code"].alias("code"), c["cv"].alias("cv"))))
    return vectors.join(F.broadcast(every)).withColumn("b", best).drop("book").select("*", "b.code", "b.cv", "b.d2").drop("b")


def residual(vectors: DataFrame, codebooks: list[DataFrame]) -> DataFrame:
    """(id, code_0, code_1, ..., approx): each level quantises what the levels before left."""
    rows = vectors.select("id", "v", F.transform("v", lambda x: x * 0.0).alias("approx"))
    for i, book in enumerate(codebooks):
        got = assign(rows, book)
        rows = got.select(*(c for c in rows.columns if c not in ("v", "approx")), V.subtract(F.col("v"), F.col("cv")).alias("v"), V.add(F.col("approx"), F.col("cv")).alias("approx"), F.col("code").alias(f"code_{i}"))
    return rows.drop("v")


def finite_scalar(z, levels: list[int]):
    """Mixed-radix code of bounded and rounded dimensions."""
    out, base = F.lit(0), 1
    for i, n in enumerate(levels):
        half = (n - 1) / 2
        out = out + (F.round(F.tanh(z[i]) * half + half)).cast("int") * base
        base *= n
    return out


def ema_step(assigned: DataFrame, codebook: DataFrame, decay: float = 0.99) -> DataFrame:
    """(code, pos, value): one moving-average step of every codeword towards the mean of its vectors."""
    parts = assigned.select("code", F.posexplode("v").alias("pos", "x")).groupBy("code", "pos").agg(F.avg("x").alias("m"))
    old = codebook.select("code", F.posexplode("cv").alias("pos", "x"))
    return old.join(parts, ["code", "pos"], "left").select("code", "pos", F.when(F.col("m").isNull(), F.col("x")).otherwise(decay * F.col("x") + (1 - decay) * F.col("m")).alias("value"))


def gated(long: DataFrame, gates: DataFrame, hard: bool = False) -> DataFrame:
    """(id, pos, x) of the dimensions whose gate (pos, gate) is open, that is sigmoid(10 gate) > 0.5; x is weighted by
    it, or as it was with ``hard``."""
    open_ = gates.select("pos", (1 / (1 + F.exp(-10 * F.col("gate")))).alias("_g")).filter("_g > 0.5")
    kept = long.join(open_, "pos")
    return kept.select(*long.columns, "_g").withColumn("x", F.col("x") if hard else F.col("x") * F.col("_g")).drop("_g")


def masked_lookup(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """``codes`` (.., code) with cv of the codebook (code, cv); a code of -1, or one that is not there, gives zeros."""
    zeros = codebook.agg(F.max(F.size("cv")).alias("_n"))
    found = codes.join(codebook.select("code", "cv"), "code", "left").join(F.broadcast(zeros))
    return found.withColumn("cv", F.coalesce("cv", F.array_repeat(F.lit(0.0), F.col("_n")))).drop("_n")


def first_codebook(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(code, cv): ``k`` vectors drawn by a hash of their id, a start for a codebook."""
    drawn = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k)
    w = Window.orderBy("id")  # k rows
    return drawn.select((F.row_number().over(w) - 1).alias("code"), F.col("v").alias("cv"))


def revive(assigned: DataFrame, codebook: DataFrame, least: int = 1, seed: int = 42) -> DataFrame:
    """(code, cv): codewords that fewer than ``least`` vectors have are replaced by vectors far from their own codeword."""
    used = assigned.groupBy("code").agg(F.count("*").alias("_n"))
    book = codebook.select("code", "cv").join(used, "code", "left").withColumn("_dead", F.coalesce("_n", F.lit(0)) < least)
    w = Window.orderBy("code")  # the codebook's rows
    dead = book.filter("_dead").select("code", F.row_number().over(w).alias("_r"))
    n = dead.count()
    far = assigned.orderBy(F.desc("d2"), F.xxhash64("id", F.lit(seed)), "id").limit(n)
    drawn = far.select(F.col("v").alias("_v"), F.row_number().over(Window.orderBy(F.desc("d2"), "id")).alias("_r"))
    new = dead.join(drawn, "_r", "left").select("code", "_v")
    return book.join(new, "code", "left").select("code", F.coalesce("_v", "cv").alias("cv"))
