"""Order-dependent operators: first wins, interleaving, grouping, carrying forward, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key. Aggregated before the shuffle, so a key that very many rows have costs no more than others; ties in the order go to any one row."""
    columns = df.columns
    best = df.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("row"))
    return best.select("row.*").select(*columns)


#: Into how many ranges of its order a key's rows are cut, so that a key with very many rows is numbered by as many tasks.
RANGES = 64


def _ranged(df: DataFrame, key: str, by: str) -> DataFrame:
    """Adds range_: rows of one key in a lower range have a smaller `by` (a number). Edges are percentiles of each key's own rows; equal values stay together. Null keys are one key, null values come first."""
    shares = F.array(*(F.lit(k / RANGES) for k in range(1, RANGES)))
    edges = df.groupBy(F.col(key).alias("key_")).agg(F.percentile_approx(by, shares, 10_000).alias("edges_"))
    found = df.join(edges, F.col(key).eqNullSafe(F.col("key_")))
    return found.withColumn("range_", F.coalesce(F.size(F.filter("edges_", lambda e: e < F.col(by))), F.lit(0))).drop("key_", "edges_")


def _carried(per: DataFrame, key: str, **totals: Column) -> DataFrame:
    """Of a table with one row for each range of a key: key_, of_ (the range), and totals over the ranges before it."""
    before = Window.partitionBy(key).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    return per.select(F.col(key).alias("key_"), F.col("range_").alias("of_"), *(c.over(before).alias(name) for name, c in totals.items()))


def _with(df: DataFrame, carried: DataFrame, key: str) -> DataFrame:
    return df.join(carried, F.col(key).eqNullSafe(F.col("key_")) & (F.col("range_") == F.col("of_"))).drop("key_", "of_", "range_")


def interleaved(df: DataFrame, source: str, order: str) -> DataFrame:
    """Adds turn: the row's place within its source, by a number. Ordered by turn and source, sources take turns. Rows are numbered within ranges of their source, then moved on by the rows of the ranges before."""
    ranged = _ranged(df, source, order)
    own = ranged.withColumn("turn", F.row_number().over(Window.partitionBy(source, "range_").orderBy(order)))
    before = _carried(ranged.groupBy(source, "range_").agg(F.count("*").alias("n_")), source, n_=F.sum("n_"))
    return _with(own, before, source).withColumn("turn", F.col("turn") + F.coalesce("n_", F.lit(0)).cast("int")).drop("n_")


def grouped_matches(matches: DataFrame) -> DataFrame:
    """One row for each company, title and score, ignoring case and outer blanks: the first match leads; ids and distinct places in order."""
    keyed = matches.withColumns({"k_company": F.lower(F.trim("company")), "k_title": F.lower(F.trim("title"))})
    grouped = keyed.groupBy("k_company", "k_title", "total").agg(F.min("rank").alias("lead_rank"), F.array_sort(F.collect_list(F.struct("rank", "id", "location"))).alias("all"))
    return grouped.select("k_company", "k_title", "total", "lead_rank", F.col("all")[0]["id"].alias("lead_id"), F.transform("all", lambda x: x["id"]).alias("ids"), F.array_distinct(F.transform("all", lambda x: x["location"])).alias("places"))


def carried_forward(lines: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Each line gets the last value that isn't null at or before it (section headings, block states)."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(value, F.last(value, ignorenulls=True).over(w))


def next_lead(lines: DataFrame, group: str, order: str, is_entry: str) -> DataFrame:
    """Adds until: the order of the next entry line, where the bullets of this one end."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return lines.withColumn("until", F.min(F.when(F.col(is_entry), F.col(order))).over(w))


def limiter_slots(calls: DataFrame, host: str, micros: str, gap: int) -> DataFrame:
    """The time at which each call may go, `gap` microseconds after the one before it at least: slot(i) = max(t(i), slot(i-1) + gap), which a running maximum of t(i) - gap * i gives without a loop. Counts and maxima run
    within ranges of a host's calls; those of the ranges before are carried over."""
    c, step = F.col, F.lit(gap).cast("long")
    w = Window.partitionBy(host, "range_").orderBy(micros, "event_id")
    own = _ranged(calls, host, micros).withColumn("i", F.row_number().over(w)).withColumn("slack", c(micros) - c("i") * step)
    own = own.withColumn("running", F.max("slack").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = own.groupBy(host, "range_").agg(F.count("*").alias("n_"), F.max("slack").alias("top_"))
    whole = Window.partitionBy(host).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    per = per.withColumn("base_", F.coalesce(F.sum("n_").over(whole), F.lit(0)))
    before = _carried(per.withColumn("top_", c("top_") - c("base_") * step), host, top_=F.max("top_"), base_=F.sum("n_"))
    joined = _with(own, before, host).withColumn("base_", F.coalesce("base_", F.lit(0)))
    slot = F.greatest(c("running") - c("base_") * step, c("top_")) + (c("i") + c("base_")) * step
    return joined.withColumn("slot", slot).withColumn("wait", c("slot") - c(micros)).drop("i", "slack", "running", "base_", "top_")
