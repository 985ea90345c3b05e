"""A pipeline from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept: toxic documents go, one document of
each group of near-duplicates stays, documents with benchmark passages go, personal data is replaced by its kind, and
the texts become ids. Null and empty texts pass the filters; an empty table gives an empty table at every stage. Texts
of any length are taken whole. Rows that repeat are judged alike and go or stay together; of near-duplicates that tie, the
least doc_id stays, with all its rows, and rows without a doc_id are no one's duplicates. Every stage but the last gives
back the columns that it got, with their values, whatever their names; the last puts n_tokens and ids in place of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linewright.llm._common import table
from linewright.llm.bpe import bpe_encode
from linewright.llm.near_dups import drop_near_duplicates
from linewright.llm.pii import redact_pii
from linewright.llm.toxicity import drop_toxic
from linewright.llm.winnow import drop_contaminated
from linewright.plans.lineage import Table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_pii(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_encode(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("byte_bpe", byte_bpe)]

#: SQL expresses none of a trained classifier, components of near-duplicates and byte-pair merges; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        written = Table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            before.drop()
        docs, before = written.df, written
    return docs
