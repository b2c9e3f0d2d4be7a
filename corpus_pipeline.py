"""From raw documents to shuffled training shards, in five stages.

Each stage takes all that its predecessor kept, and its decisions take effect: language ID drops texts without a language,
the Jaccard join leaves one document of each group of near copies (that with the smallest doc_id), decontamination drops
documents with benchmark items, mixing repeats and drops documents so that sources get their weights, and sharding gives
every row its shard and slot.

A null or empty text has no language and goes at the first stage, however long the other texts are; a null source is a source
of its own, a row with a null doc_id a document like any other. Of rows equal in doc_id and text one stays; rows that share a
doc_id alone are documents of their own. Ties in the queue and in the shuffle go by hashes of doc_id and text. Empty tables
give empty results. Columns of documents keep their names and values through all stages, also those named like an operator's
results; only beside the results of the last stage (size, text_crc32, shard, slot) such a column gets underscores after its
name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, decontamination, jaccard_join, language_id, mixing, sharding

#: Columns that the stages' operators give, and would replace in their input.
RESULTS = {
    "held_out", "lang_pred", "score", "contaminated", "item_ids", "errors", "size", "source_size", "target", "taken",
    "virtual_finish", "text_crc32", "shard", "slot",
}


def put_aside(docs: DataFrame, results: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns named like results under other names, and the columns' names by the new ones."""
    clash = [c for c in docs.columns if c.lower() in results]
    names = common.own_names([*docs.columns, *results], *clash)
    return docs.withColumnsRenamed(dict(zip(clash, names, strict=True))), dict(zip(names, clash, strict=True))


def decided(docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that decide(docs) keeps, with the columns of docs as they were."""
    own, back = put_aside(docs, RESULTS)
    return decide(own).select(own.columns).withColumnsRenamed(back)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decided(docs, lambda own: language_id.identify(own).where("lang_pred <> 'und'"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words, similarity 0.8; one document of each group stays."""
    return decided(docs, lambda own: jaccard_join.drop_near_copies(own, words=5, percent=80))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = common.table(spark, sf_dir, "benchmark")
    return decided(docs, lambda own: decontamination.decontaminate(own, items).where("not contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decided(docs, mixing.mixed_queue)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(put_aside(docs, sharding.OWN)[0])


STAGES = [
    ("language_id", keep_languages),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: No stage but the exact ones can be put in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return docs
