"""From raw documents to token ids in five stages; every stage works on all rows the one before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents (the
last adds ids, n_tokens and decoded).  ``run`` writes each stage's rows as Parquet to the shared folder
and reads them again for the next.  Models and searches look at the tables in ``sf_dir``; corpus
statistics come from the documents the stage is given.
"""

from __future__ import annotations

import catalog.scratch  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from tempora.llm import common, decontaminate, line_dedup, near_dedup, sentencepiece, toxicity
from tempora.llm.queries import model_file


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labelled ones among them."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def boilerplate_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on too many documents of their source go; every document stays."""
    return line_dedup.drop_boilerplate(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays."""
    return near_dedup.one_of_each(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with begin and end, and the text they decode to."""
    return sentencepiece.encode(docs, model_file())


STAGES = [
    ("toxicity", toxic_out),
    ("line dedup", boilerplate_out),
    ("minhash near-dedup", near_copies_out),
    ("benchmark decontamination", benchmark_out),
    ("sentencepiece", tokens),
]

# Stages 1, 3, 4 and 5 have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
