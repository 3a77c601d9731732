"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import bpe, decontaminate, html_text, idstore, media, ppm, quality, simhash, substrings, toxicity
from loomspan.llm.common import table

#: Name of the vocabulary file and the end id of binary output.
VOCABULARY, END_ID = "byte_bpe_50k.json", 2


def bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = idstore.write(docs, public_tokenizers.path(VOCABULARY), END_ID)
    return idstore.read(manifest, docs.schema["doc_id"].dataType.simpleString()).drop("file")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), ppm.is_held_out())


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def media_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(table(spark, sf_dir, "documents"))


QUERIES = {"op1_toxicity": toxicity_scores, "op2_bpe": bpe_codec, "op3_ppm": language_scores, "op4_html": page_text, "op5_substrings": repeated_passages, "op6_quality": quality_scores, "op7_decontaminate": contamination, "op8_simhash": near_duplicates, "op9_media": media_features, "op10_token_store": token_store}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op5_substrings": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20),
k as (select doc_id, i, row_number() over (partition by array_to_string(w[i:i + 19], ' ') order by doc_id, i) as rn from p),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as i from k where rn > 1),
word as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from d),
kept as (select doc_id, string_agg(x, ' ' order by i) as t, count(*) as n from word anti join gone using (doc_id, i) group by doc_id)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)""",
    "op7_decontaminate": f"""
with d as (select doc_id, {_TERMS} as w from documents),
b as (select distinct item_id::varchar as id, {_TERMS} as w from benchmark),
q as (select distinct id, least(10, len(w)) as n, array_to_string(w[i:i + 9], ' ') as k from (select id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
p as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from q) where len(w) >= n)),
h as (select doc_id, i, p.n as n, id from p join q on p.k = q.k and p.n = q.n),
hit as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(i, i + n)) as x from h) group by doc_id),
item as (select doc_id, count(*) as n, string_agg(id, ',' order by id) as ids from (select distinct doc_id, id from h) group by doc_id)
select doc_id, len(w) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(item.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit using (doc_id) left join item using (doc_id)""",
}
