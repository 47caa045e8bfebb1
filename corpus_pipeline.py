"""The corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages are cut out,
sources are mixed to target weights, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the shared folder and
reads again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortflow.llm import jaccard, mixing, packing, substrings, toxicity
from cohortflow.llm.common import cut_lineage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go; the rest are unchanged. The model is fitted on the labelled part of docs."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that links of five-word Jaccard similarity 0.8 or more connect, one row of the smallest id stays."""
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that a document with a smaller id has too are cut out of the text; n_chars follows."""
    return _counted(substrings.without_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of words, chosen to meet the sources' targets; a document taken twice comes as two rows; n_chars follows."""
    return _counted(mixing.mixed(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document, with its place in a sequence of at most 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("repeated_passages", cut_repeats),
          ("source_mix", mix_sources), ("packing", pack_sequences)]

#: No SQL: the first stage's model and the search of the last can't be written in it. tests/llm holds brute-force checks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
