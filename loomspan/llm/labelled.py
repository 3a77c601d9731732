"""Labelled rows for fitting: joined by key, held-out rows left out, bounded in number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import fold

#: Labelled rows that a classifier is fitted on at most; which ones is decided by a hash of the key.
SAMPLE = 20_000


def is_held_out(key: str = "doc_id", parts: int = 3, which: int = 1) -> Column:
    return fold(key, parts) == which


def sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", most: int = SAMPLE) -> DataFrame:
    """(key, text, label) of at most ``most`` labelled rows that are not held out.

    A key with several labels counts with the greatest and one with several texts with the least; null labels and
    keys are left out. The chosen keys are ``most`` at most, so they are sent to the documents.
    """
    known = labels.select(key, F.col(label).cast("int").alias("label")).dropna().groupBy(key).agg(F.max("label").alias("label"))
    chosen = known.filter(~is_held_out(key)).orderBy(F.xxhash64(key), key).limit(most)
    found = docs.select(key, F.coalesce(text, F.lit("")).alias(text)).join(F.broadcast(chosen), key)
    return found.groupBy(key, "label").agg(F.min(text).alias(text)).select(key, text, "label")
