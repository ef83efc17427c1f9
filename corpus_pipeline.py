"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, PII, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import exact_dedup, jaccard_join, language_id, packing, pii
from ledgerloom.llm.common import discard, held_out, read, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the classifier rejects (`und`: null or no letter) go.

    Here as in all stages rows that repeat or have no doc_id are decided each by its own text, empty tables give
    empty results, and other columns, whatever their names, stay as they are.
    """
    model = language_id.train(docs.where(~held_out()))
    return language_id.keep_recognised(docs, model)


def one_of_each_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct content, white space aside: the longest, then the least doc_id, a null one last.

    Null and empty texts are one content; of rows that tie in all this one stays.
    """
    return exact_dedup.keep_first_copies(docs)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links: the least doc_id, a null one last.

    Texts of fewer than five words, null ones too, are linked with nothing; rows equal in doc_id and text stay once.
    """
    return jaccard_join.keep_one_of_each_class(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by the name of its kind. Null texts stay null."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens. A null text is one end token, a repeated row packed again."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", one_of_each_content),
    ("jaccard_join", one_of_each_class),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: Naive Bayes and the join can't be stated in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
