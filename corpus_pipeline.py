"""From raw documents to token ids: toxicity, near-duplicates, repeated passages, benchmark passages, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return
documents with the columns they came with; the last returns ids with their digests. An empty table passes through
every stage as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import alike, bpe, decontaminate, substrings, toxicity
from loomspan.llm.common import materialize, table
from loomspan.llm.queries import VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is fitted on labelled documents outside the held-out fold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.harmless(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of documents with like five-word shingles.

    SimHash with wide fingerprints: the 64 bits and radius of op8 would leave most copies at a similarity of 0.8 in.
    """
    return alike.representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words of passages that start earlier elsewhere; n_chars follows the text."""
    kept = substrings.remove_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = found.filter("contaminated").select(F.col("doc_id").alias("__hit"))
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["__hit"]), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


#: The classifier, XXH64 and BPE are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
