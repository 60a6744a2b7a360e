"""Operator 4: quality score of each document by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boost
from .common import arrow_ready, as_bytes, held_out, map_batches, read, training_row
from .textstats import FEATURES, stats

#: At most so many labelled rows are fitted on, those of the lowest id hashes; everything else covers all rows.
SAMPLE = 20_000


def labelled_sample(labels: DataFrame, column: str, limit: int = SAMPLE) -> DataFrame:
    """At most limit (doc_id, y) of the rows that may be learnt from, one for an id (the larger label), spread evenly by hash. Rows with a null id or label are left out."""
    rows = labels.select("doc_id", F.col(column).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & training_row())
    return rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, **params) -> boost.Forest:
    """Trees fitted on at most limit labelled rows. No label or a single class gives a constant score."""
    spark = docs.sparkSession
    arrow_ready(spark)
    sample = F.broadcast(labelled_sample(labels, "quality", limit))  # at most limit rows of an id and a label
    rows = map_batches(docs.select("doc_id", as_bytes().alias("text")).join(sample, "doc_id"), _features, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return boost.fit(x, np.array(rows["y"].to_pylist(), np.float64), **params)


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    x = [stats(t.as_py())[1] for t in batch["text"]]
    return pa.record_batch([batch["doc_id"].cast(pa.int64()), batch["y"], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def score(docs: DataFrame, model: boost.Forest, cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row: a null or empty text is scored as a text without words, repeated rows each give a row, a null id stays null, very long texts are
    scored whole, further columns of docs are ignored, an empty table gives no rows."""
    arrow_ready(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([stats(t.as_py())[1] for t in batch["text"]]).reshape(-1, len(FEATURES))
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array(model.predict(x), pa.float64())], ["doc_id", "score"])

    out = map_batches(docs.select("doc_id", as_bytes().alias("text")), run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns, of whatever names. A null or empty text is scored as one without words, very long ones whole; repeated rows share one fate; an empty table gives
    no rows."""
    arrow_ready(docs.sparkSession)
    model = fit(docs, labels)
    schema = docs.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].cast(pa.binary())
        x = np.array([stats(t.as_py() or b"")[1] for t in texts]).reshape(-1, len(FEATURES))
        return batch.filter(pa.array(model.predict(x) >= cut))

    return map_batches(docs, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
