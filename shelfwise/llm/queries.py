"""Registered queries of the operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import (
    bpe,
    decontaminate,
    hnsw,
    html_text,
    jaccard,
    mixing,
    quality,
    quotations,
    repeats,
    secrets,
    sharding,
    token_links,
    unigram,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_hnsw_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest neighbours of every fiftieth embedding."""
    vectors = _table(spark, folder, "embeddings")
    return hnsw.nearest(vectors, hnsw.every_fiftieth(vectors))


def op2_quotation_linking(spark: SparkSession, folder: str) -> DataFrame:
    """All messages without quotes, with what they reply to."""
    return quotations.conversations(_table(spark, folder, "conversations"))


def op3_html_text_density(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.extracted(_table(spark, folder, "pages"))


def op4_count_viterbi(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents."""
    return unigram.counted(_table(spark, folder, "documents"))


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.scanned(_table(spark, folder, "documents"))


def op6_poisson_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """One epoch of all documents in which every source weighs the same."""
    return mixing.mixed(_table(spark, folder, "documents"))


def op7_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """The documents kept for their likeness to those labelled good."""
    return quality.sampled(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_qgram_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in all documents."""
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op9_lookup_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their shards."""
    return sharding.placed(_table(spark, folder, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-copy components of all documents."""
    return jaccard.jaccard_components(_table(spark, folder, "documents"))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """How the tokens of two tokenizers line up in all documents."""
    return token_links.measured(_table(spark, folder, "documents"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The periodic runs of all documents, a tenth of which get a planted one."""
    return repeats.digests(repeats.periodic_runs(_table(spark, folder, "documents"), repeats.planted))


def op13_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return bpe.digests(bpe.encoded(_table(spark, folder, "documents"), again=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_hnsw_neighbours,
        op2_quotation_linking,
        op3_html_text_density,
        op4_count_viterbi,
        op5_secret_scan,
        op6_poisson_mixing,
        op7_importance_resampling,
        op8_qgram_decontamination,
        op9_lookup_sharding,
        op10_ngram_jaccard_join,
        op11_token_alignment,
        op12_periodic_runs,
        op13_tree_bpe,
    )
}

#: What SQL can state; the others are tested against plain versions.
ORACLES: dict[str, str] = {
    "op2_quotation_linking": quotations.QUOTE_SQL,
    "op6_poisson_mixing": mixing.MIX_SQL,
    "op9_lookup_sharding": sharding.SHARD_SQL,
}
