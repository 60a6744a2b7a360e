"""Relevance metrics over ranked lists, and what the gaps of a ranked list teach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision_at(k: int, least: int = 1) -> Column:
    """Over columns rank and label: share of the first k (or of all, if fewer) with that label at least."""
    return F.coalesce(F.avg(F.when(F.col("rank") <= k, (F.col("label") >= least).cast("double"))), F.lit(0.0))


def ndcg(ranked: DataFrame, group: str, k: int = 10) -> DataFrame:
    """group, ndcg: gains 2**label - 1 discounted by log2(rank + 1), over the gains of the ideal order."""
    ideal = ranked.withColumn("ideal", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("label"), "rank")))
    gain = F.pow(F.lit(2.0), F.col("label")) - 1
    dcg = lambda place: F.sum(F.when(F.col(place) <= k, gain / F.log2(F.col(place) + 1)).otherwise(0.0))
    out = ideal.groupBy(group).agg(dcg("rank").alias("got"), dcg("ideal").alias("best"))
    return out.select(group, F.when(F.col("best") > 0, F.col("got") / F.col("best")).otherwise(0.0).alias("ndcg"))


def skills_to_learn(gaps: DataFrame) -> DataFrame:
    """skill, jobs, closes: in how many postings a skill is missing, and in how many it is all that is missing."""
    each = gaps.select(F.explode("missing").alias("skill"), (F.size("missing") == 1).cast("int").alias("only"))
    return each.groupBy("skill").agg(F.count("*").alias("jobs"), F.sum("only").alias("closes"))


SORTS = {
    "best": (F.desc, "total"),
    "newest": (F.desc_nulls_last, "posted"),
    "experience": (F.asc_nulls_last, "years"),
}


def sorted_matches(matches: DataFrame, by: str) -> DataFrame:
    """The four orders of a match list; ties by score, then id. Postings that name fewer than three skills come last when sorted by gaps."""
    if by == "gaps":
        first = [F.when(F.col("n_required") < 3, 1).otherwise(0), F.col("n_missing")]
    else:
        how, column = SORTS[by]
        first = [how(column)]
    return matches.orderBy(*first, F.desc("total"), "id")


def match_filter(query: str = "", min_score: float = 0, max_years: int | None = None, keep_unknown_years: bool = True, source: str | None = None, status: str | None = None, takeable: bool = False) -> Column:
    """All conditions of a match list: every word of the query somewhere, score, years (15 is no limit), place, source and status (hidden ones only when asked for)."""
    hay = F.lower(F.concat_ws(" ", "title", "company", "location", F.array_join("required", " ")))
    out = F.coalesce("total", F.lit(0.0)) >= min_score
    for word in query.lower().split():
        out = out & hay.contains(word)
    if max_years is not None and max_years < 15:
        out = out & F.coalesce(F.col("years") <= max_years, F.lit(keep_unknown_years))
    if takeable:
        out = out & ~F.col("place").isin("restricted", "elsewhere")
    if source:
        out = out & (F.col("source") == source)
    return out & (F.col("status") == status if status else F.col("status") != "hidden")
