"""Ranking quality of labelled postings under several mixes of the scores' parts, with and without the place, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring

#: The mixes that are compared; `current` is the score itself. Labels of good and partly good postings.
PARTS = ("ats", "experience", "semantic", "freshness")
MIXES: dict[str, dict[str, float] | None] = {
    "current": None,
    "spec 35/25/20/20": {"ats": 0.35, "experience": 0.25, "semantic": 0.20, "freshness": 0.20},
    "no freshness": {"ats": 0.40, "experience": 0.35, "semantic": 0.25, "freshness": 0.0},
    "experience-heavy": {"ats": 0.30, "experience": 0.40, "semantic": 0.20, "freshness": 0.10},
    "semantic-heavy": {"ats": 0.25, "experience": 0.30, "semantic": 0.35, "freshness": 0.10},
    "ats only": {"ats": 1.0},
    "semantic only": {"semantic": 1.0},
    "experience only": {"experience": 1.0},
}
GOOD, PARTIAL, DEPTH = 2, 1, 10


def _totals(mixes: dict[str, dict[str, float] | None]) -> Column:
    """Array of struct(mix, placed, total): a row's total under each mix, times the share that its place leaves, and without that."""
    parts = {p: F.coalesce(p, F.lit(0.0)) for p in PARTS}
    out = []
    for placed in (True, False):
        factor = scoring.location_factor(F.col("location_score")) if placed else F.lit(1.0)
        for name, weights in mixes.items():
            total = scoring.clamp(scoring.combine(*(parts[p] for p in ("ats", "semantic", "experience", "freshness"))) * factor) if weights is None else scoring.weighted_total(parts, weights, factor)
            out.append(F.struct(F.lit(name).alias("mix"), F.lit(placed).alias("placed"), total.alias("total")))
    return F.array(*out)


def grid(labelled: DataFrame, mixes: dict[str, dict[str, float] | None] = MIXES) -> DataFrame:
    """mix, placed and n, good, partial, p_at_5, p_at_5_good, p_at_10, ndcg_at_10 over labelled rows (id, label, the parts of a score, location_score), ranked by each mix's total, of equal totals by id.

    Null parts are 0; a null place leaves the whole score; an empty table gives no rows. Only the first DEPTH rows of a mix are ranked, and of each label no more than DEPTH are needed for the ideal order, so no task holds a
    mix's rows: all else are counts."""
    each = labelled.select("id", "label", F.explode(_totals(mixes)).alias("m")).select("id", "label", "m.*")
    counts = labelled.agg(F.count("*").alias("n"), F.count_if(F.col("label") == GOOD).alias("good"), F.count_if(F.col("label") == PARTIAL).alias("partial")).where("n > 0")
    place = F.row_number().over(Window.partitionBy("mix", "placed").orderBy(F.desc(F.round("total", 9)), "id"))
    first = each.withColumn("rank", place).where(F.col("rank") <= DEPTH)  # cut to DEPTH rows a mix before the shuffle, too
    gain = (F.pow(F.lit(2.0), F.col("label")) - 1) / F.log2(F.col("rank") + 1)
    share = lambda k, least: F.coalesce(F.avg(F.when(F.col("rank") <= k, (F.col("label") >= least).cast("double"))), F.lit(0.0))
    found = first.groupBy("mix", "placed").agg(share(5, PARTIAL).alias("p_at_5"), share(5, GOOD).alias("p_at_5_good"), share(10, PARTIAL).alias("p_at_10"), F.sum(gain).alias("got"))
    discount = lambda low, high: F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(DEPTH)), lambda k: (k > low) & (k <= high)), F.lit(0.0), lambda s, k: s + 1 / F.log2(k + 1))
    best = (2**GOOD - 1) * discount(F.lit(0), F.col("good")) + (2**PARTIAL - 1) * discount(F.col("good"), F.col("good") + F.col("partial"))
    whole = found.crossJoin(F.broadcast(counts)).withColumn("best", best)  # one row
    return whole.select("mix", "placed", "n", "good", "partial", "p_at_5", "p_at_5_good", "p_at_10", F.when(F.col("best") > 0, F.col("got") / F.col("best")).otherwise(0.0).alias("ndcg_at_10"))
