"""Corpus pipeline: from raw documents to packed training sequences.

Toxic documents go, then those whose language is not known, then all but one
of each group of near duplicates; personal data in the rest is masked; what
remains is packed.  Each stage works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareflow.llm import jaccard_join, language_id, packing, pii, toxicity
from fareflow.llm.common import scratch_table, table, unused_prefix
from fareflow.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a toxicity score below 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    column = unused_prefix(docs.columns, "toxicity") + "toxicity"
    return toxicity.score(docs, model, out_col=column).where(F.col(column) < 0.5).select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the table's languages."""
    prefix = unused_prefix(docs.columns, "language", "confidence", "rejected")
    return language_id.identify(docs, prefix=prefix).where(~F.col(f"{prefix}rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return jaccard_join.keep_first(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows the new text."""
    return pii.redact(docs, length_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("best-fit packing", pack_sequences),
]

#: No stage but the last table scan can be written in SQL; tests compare the rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is kept as a table and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
