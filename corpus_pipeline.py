"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on every document its predecessor kept and returns the columns of
``documents``; the last returns the packed pieces. Between stages the documents are written as Parquet to shared storage
and read again, so a lost executor costs one stage at most.

All stages treat odd rows alike. A null text counts as empty; empty texts are scored like
any other by the first stage and pass the others. Texts of any length are judged whole. Rows without an id are kept by the
deduplicating stages, as nothing can refer to them. Repeated rows are rows of their own, except that near_duplicates keeps
all rows of the least id of a group. An empty table gives an empty result. Further columns are kept up to the last stage,
whatever their names; the last one returns pieces of tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from attrix.llm.common import release, restored, stored
from attrix.llm.packing import pack
from attrix.llm.pii_boost import find_pii
from attrix.llm.rule_ensemble import rule_ensemble
from attrix.llm.shingle_join import matching_ids, shingle_join
from attrix.llm.substring_dedup import substring_dedup
from attrix.sources.tables import read_table

#: The tokenizer's file; a path that every executor has.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from the quality labels, does not reject."""
    scored = rule_ensemble(docs, read_table(spark, sf_dir, "labels"), keep=True)
    return scored.where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of every group of near copies; rows without an id stay.

    Near copies share 80 percent of their five-word shingles.
    """
    others = stored(shingle_join(docs, words=5, percent=80).where("doc_id != component_id").select("doc_id").distinct(), "duplicates")
    return matching_ids(docs, others, "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    return restored(substring_dedup(docs), "kept")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the names of their kinds."""
    return restored(find_pii(docs), "redacted")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in sequences."""
    return pack(docs, TOKENIZER, with_ids=False)


STAGES = [("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("personal_data", personal_data), ("packing", packing)]

#: Trained models and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = read_table(spark, sf_dir, "documents")
    before = []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        # What a stage wrote is read by the next one only.
        release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
