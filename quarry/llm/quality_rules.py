"""Operator 6: quality rules as a learned decision list, applied as Spark conditional expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_ready, as_bytes, map_batches, read
from .quality_classifier import SAMPLE, labelled_sample
from .textstats import COUNTS, stats

#: Ratios that the rules test, each a Spark expression of the counts, so that the list stays readable and runs in the JVM.
RATIOS = ("n_words", "mean_word", "symbols_a_word", "repeat_share", "dup_lines_a_word", "upper_share", "mark_share", "top_word_share", "pipe_words", "distinct_share")
EXTRA = ("upper_share", "mark_share", "top_word_share", "pipe_words", "distinct_share")
_AT = {"upper_share": 3, "mark_share": 5, "top_word_share": 12, "pipe_words": 14, "distinct_share": 10}
Rule = tuple[list[tuple[str, str, float]], int]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts and five shares of each row. A null or empty text has zeros; very long texts are counted whole; repeated rows each give a row; further columns are ignored."""
    arrow_ready(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [stats(t.as_py()) for t in batch["text"]]
        counts = [pa.array([c[k] for c, _ in both], pa.int64()) for k in range(len(COUNTS))]
        shares = [pa.array([x[_AT[k]] for _, x in both], pa.float64()) for k in EXTRA]
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), *counts, *shares], ["doc_id", *COUNTS, *EXTRA])

    schema = ", ".join(["doc_id long", *(f"{k} long" for k in COUNTS), *(f"{k} double" for k in EXTRA)])
    return map_batches(docs.select("doc_id", as_bytes().alias("text")), run, schema)


def ratio(name: str) -> Column:
    of = {"mean_word": "word_chars", "symbols_a_word": "n_symbols", "repeat_share": "n_repeat_words", "dup_lines_a_word": "n_dup_lines"}.get(name)
    return (F.col(of) / F.greatest(F.col("n_words"), F.lit(1))) if of else F.col(name).cast("double")


def _covered(conditions: list[tuple[str, str, float]], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, sign, cut in conditions:
        out &= x[name] > cut if sign == ">" else x[name] <= cut
    return out


def _cuts(values: np.ndarray, most: int = 60) -> np.ndarray:
    """At most `most` thresholds half-way between neighbouring values."""
    u = np.unique(values)
    u = u if len(u) <= most else np.unique(np.quantile(u, np.linspace(0, 1, most)))
    return (u[1:] + u[:-1]) / 2


def learn(x: dict[str, np.ndarray], y: np.ndarray, most: int = 12, longest: int = 3, least: int = 8, precision: float = 0.9) -> list[Rule]:
    """Sequential covering of the rejected rows (y = 0). Each round grows a conjunction of thresholds on two thirds of what is left by information gain, with at most one threshold on either side of a statistic, prunes
    conditions while the other third doesn't suffer, keeps the rule if its precision is at least `precision`, and sets aside what it covers. After a rule that isn't precise enough, rules that begin otherwise are tried.
    Of rules that do equally well the middle threshold of the first statistic counts. What no rule covers is kept (1). No rows or a single class give no rules."""
    rules: list[Rule] = []
    left = np.ones(len(y), bool)
    prune = np.arange(len(y)) % 3 == 2
    cuts = {k: _cuts(v) for k, v in x.items()}
    passed: set[tuple[str, str]] = set()  # the beginnings of rules that weren't precise enough
    while len(rules) < most and (left & (y == 0)).any():
        grow, check = left & ~prune, left & prune
        conditions: list[tuple[str, str, float]] = []
        inside = grow.copy()
        while len(conditions) < longest:
            bad, total = (inside & (y == 0)).sum(), inside.sum()
            if not bad or bad == total:
                break
            found, now = [], np.log2(bad / total)
            for name, values in x.items():
                for sign in (">", "<="):
                    if any(c[:2] == (name, sign) for c in conditions) or (not conditions and (name, sign) in passed):
                        continue
                    for cut in cuts[name]:
                        new = inside & (values > cut if sign == ">" else values <= cut)
                        b, t = (new & (y == 0)).sum(), new.sum()
                        if b >= least and t < total and (gain := b * (np.log2(b / t) - now)) > 1e-9:
                            found.append((float(gain), name, sign, float(cut)))
            if not found:
                break
            top = max(found)[0]
            best = [f for f in found if f[0] >= top * (1 - 1e-9)]
            best = [f for f in best if f[1:3] == best[0][1:3]]
            conditions.append(best[len(best) // 2][1:])  # of cuts that do equally well, the middle one
            inside = _covered(conditions, x, len(y)) & grow
        if not conditions:
            break

        def worth(c: list) -> float:
            hit = _covered(c, x, len(y)) & check
            return ((hit & (y == 0)).sum() - (hit & (y == 1)).sum()) / max(1, hit.sum())

        begins = conditions[0][:2]
        while len(conditions) > 1:
            shorter = max(([c for c in conditions if c is not gone] for gone in reversed(conditions)), key=worth)
            if worth(shorter) < worth(conditions):
                break
            conditions = shorter
        hit = _covered(conditions, x, len(y)) & left
        if not hit.any() or (hit & (y == 0)).sum() < precision * hit.sum():
            passed.add(begins)
            continue
        passed.clear()
        rules.append((conditions, 0))
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> list[Rule]:
    """A decision list from at most limit labelled rows."""
    sample = labelled_sample(labels, "quality", limit)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most limit rows of an id and a label
    rows = statistics(chosen).join(F.broadcast(sample), "doc_id").select("doc_id", "y", *(ratio(k).alias(f"r_{k}") for k in RATIOS)).toArrow().sort_by("doc_id")
    return learn({k: rows[f"r_{k}"].to_numpy() for k in RATIOS}, rows["y"].to_numpy())


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the first rule whose conditions all hold decides; otherwise the row is kept."""
    out = None
    for conditions, keep in rules:
        test = F.lit(True)
        for name, sign, cut in conditions:
            test = test & (ratio(name) > cut if sign == ">" else ratio(name) <= cut)
        out = F.when(test, F.lit(bool(keep))) if out is None else out.when(test, F.lit(bool(keep)))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def apply(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics with base_failed (fewer than 10 words, or over a fifth of the words in repeated windows) and kept. A null or empty text has no words and fails; very long texts are read whole; repeated rows each give the same
    row; further columns are ignored; an empty table gives no rows."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return statistics(docs).select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return apply(docs, fit(docs, read(spark, sf_dir, "labels")))
