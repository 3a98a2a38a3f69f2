"""One registered query per operator: the operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from attrix.llm import oracles
from attrix.llm import url_filter as urls
from attrix.llm.column_bwt_dedup import column_bwt_dedup
from attrix.llm.conversation_repair import repair_report
from attrix.llm.embedding_dedup import embedding_dedup
from attrix.llm.importance_resampling import resample
from attrix.llm.packing import pack
from attrix.llm.pii_boost import find_pii
from attrix.llm.quality_votes import quality_votes
from attrix.llm.rule_ensemble import held_out, rule_ensemble
from attrix.llm.sentencepiece_scan import encode
from attrix.llm.shingle_join import shingle_join
from attrix.llm.substring_dedup import substring_dedup
from attrix.llm.toxicity_grammar import toxicity_grammar
from attrix.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The other queries fit models, tokenise, or compare all byte strings, which takes SQL minutes on the smallest tables.
ORACLE: dict[str, str] = {"op1_substring_dedup": oracles.SUBSTRING_DEDUP, "op2_embedding_dedup": oracles.EMBEDDING_DEDUP, "op6_shingle_join": oracles.SHINGLE_JOIN,
                          "op11_importance_resampling": oracles.RESAMPLE, "op12_conversation_repair": oracles.CONVERSATION_REPAIR,
                          "op13_url_filter": oracles.url_filter(urls.STRICT_TERMS, urls.SOFT_TERMS, urls.LIMIT)}
#: Host and path rules of the URL filter.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in 50-word windows which an earlier document has, too."""
    return substring_dedup(read_table(spark, sf_dir, "documents"), with_text=False)


@_query
def op4_column_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that lie in 200-byte strings which occur again anywhere."""
    return column_bwt_dedup(read_table(spark, sf_dir, "documents"), with_text=False)


@_query
def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 4-word shingles agree to 85 percent."""
    return shingle_join(read_table(spark, sf_dir, "documents"))


@_query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of 2,048."""
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


@_query
def op7_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and the posterior's verdict for every document."""
    return quality_votes(read_table(spark, sf_dir, "documents"))


@_query
def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by rules learned from the labels that are not held out."""
    scored = rule_ensemble(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


@_query
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors whose cosine is at least 0.98 within a label."""
    return embedding_dedup(read_table(spark, sf_dir, "embeddings"))


@_query
def op10_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by clauses, learned from the labels that are not held out."""
    scored = toxicity_grammar(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


@_query
def op5_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the base spans and those that the boosted trees add."""
    return find_pii(read_table(spark, sf_dir, "documents"), with_text=False)


@_query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by the public piece model, as counts and a digest."""
    return encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


@_query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five percent of all documents drawn toward the benchmark's n-grams."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and repaired text of every conversation, after damage by the hash of its turns."""
    return repair_report(read_table(spark, sf_dir, "conversations"))


@_query
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by the rules on hosts and paths, else by the weighted vocabulary."""
    return urls.url_filter(read_table(spark, sf_dir, "pages"), URL_RULES).drop("terms")
