"""Documents to training tokens in five stages: quality, near-duplicates, benchmark leaks, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Filtering stages keep whole rows of documents, with or without an id; a null text counts as empty and stays null; repeated rows share
one fate; an empty table gives no rows; very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontamination, minhash_dedup, pii, piece_model, quality_classifier, sentencepieces
from quarry.llm.common import Scratch, read, result


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows among them, does not reject. Without labels all documents score alike and stay."""
    return quality_classifier.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id or, where none has an id, that of the least text hash. Empty texts are no duplicates."""
    return minhash_dedup.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. An empty benchmark drops nothing."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redacted(docs, pii.train(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their tokens, whether decoding gives the text back, and whether the original library gives the same ids."""
    return sentencepieces.tokenised(docs, piece_model.load(sentencepieces.MODEL_PATH))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", token_ids),
]

#: The stages hold trained models and hashes, which SQL can't express; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written to the shared folder and read again, so that a lost executor costs one stage's task. A stage's input is deleted as soon as its output is written."""
    docs = read(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for _, stage in STAGES:
            docs = scratch.keep(stage(spark, docs, sf_dir), drop_last=True)
        return result(docs)
