"""A corpus from raw documents to token ids: quality classifier, quality rules, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a
DataFrame; all but the last return the columns of ``docs``, whatever their names, texts of any length are
taken whole, and no rows give no rows. ``run`` writes each stage's rows as Parquet
in the shared folder and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrelgrid.llm import bpe_tree, mixing, quality_gam, quality_llr, simhash_covering
from kestrelgrid.llm.common import materialise, table
from kestrelgrid.llm.queries import TOKENIZER


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model of the labels in ``sf_dir`` predicts to be good; null texts count as empty, keys play no part but in learning."""
    return quality_gam.keep_predicted(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the log-likelihood ratio; null and empty texts go, a repeated row stays or goes with its like."""
    return quality_llr.keep_good(docs, table(spark, sf_dir, "labels").where("quality = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies, by texts alone: rows with null or repeated keys are in groups like all others."""
    return simhash_covering.keep_one_row(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each row as often as it is taken, the last time perhaps cut; rows without words aren't taken, a null source is a source."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of every row's ids and decoded text; a null text is empty, repeated rows stay."""
    return bpe_tree.encoding_digests(docs, TOKENIZER)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("source_mix", source_mix), ("encode", encode)]
#: The classifier, the hash-based scores and BPE have no SQL form; tests/llm/test_pipeline.py holds each stage against a version written without its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage, applied to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
