"""Phrases of a vocabulary table found in texts, at a cost that the vocabulary's size hardly changes: texts are cut into tokens once, and tokens and token sequences are looked up by keyed joins, as in a trie of two levels.

A phrase may not touch a letter, a digit or one of _ + # . - / before it, nor after it a letter, a digit, _ + #, or one of . - / with a letter or digit behind. So it starts where a run of such characters starts, and ends at
the end of one, or before one of . - / that no letter or digit follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import kept

#: What a run is made of, and where within one a phrase may end.
RUN, END = r"[A-Za-z0-9_+#.\-/]+", r"[.\-/](?![A-Za-z0-9])"
#: A vocabulary of at most so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 250_000


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def aliases(vocabulary: DataFrame) -> DataFrame:
    """first, key, runs, size, name, exact of a vocabulary (alias, name; with a column `exact` or any case), kept. Of rows of one alias the one of the greatest `no`, or else of the greatest name, holds. Aliases that are null, or that
    don't start and end in a run, can't be found and are refused."""
    exact = F.coalesce(F.col("exact"), F.lit(False)) if "exact" in vocabulary.columns else F.lit(False)
    no = F.col("no").cast("long") if "no" in vocabulary.columns else F.lit(0).cast("long")
    rows = vocabulary.where("name IS NOT NULL").select(F.regexp_replace(F.trim("alias"), r"\s+", " ").alias("alias"), "name", exact.alias("exact"), no.alias("no"))
    spelled = F.when(F.col("exact"), F.col("alias")).otherwise(F.lower("alias"))
    good = F.coalesce(F.col("alias").rlike(rf"^{RUN}(.*{RUN})?$") & F.col("alias").rlike(r"[A-Za-z0-9_+#]$"), F.lit(False))
    rows = rows.select(F.when(good, spelled).otherwise(F.raise_error(F.concat(F.lit("not a phrase: "), F.coalesce("alias", F.lit("null"))))).alias("key"), "exact", "no", "name")
    rows = rows.groupBy("key", "exact").agg(F.max_by("name", F.struct("no", "name")).alias("name"))
    runs = F.regexp_extract_all("key", F.lit(f"({RUN})"), F.lit(1))
    return kept(rows.select("key", "exact", "name", F.lower(runs[0]).alias("first"), F.size(runs).alias("runs"), F.length("key").alias("size")))


def _ends(run: Column) -> Column:
    """The beginnings of a run that a phrase may end with, the whole run among them."""
    cut = F.array_compact(F.transform(F.sequence(F.lit(1), F.length(run)), lambda n: F.when(F.substr(run, n + 1).rlike(f"^{END}"), F.substr(run, F.lit(1), n))))
    return F.when(run.rlike(END), F.array_distinct(F.concat(cut, F.array(run)))).otherwise(F.array(run))


def _candidates(texts: DataFrame, most: int) -> DataFrame:
    """row, start, t: for each place of a text the `most` runs from there on, each with what follows it (white space as one blank)."""
    runs = F.regexp_extract_all("text", F.lit(f"({RUN})"), F.lit(1))
    gaps = F.regexp_extract_all("text", F.lit(rf"{RUN}([^A-Za-z0-9_+#.\-/]*)"), F.lit(1))
    cut = texts.select("row", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ").alias("text")).select("row", runs.alias("r"), gaps.alias("g"))
    shifted = [F.slice(c, k + 1, F.greatest(F.size("r"), F.lit(1))).alias(f"{c}{k}") for k in range(most) for c in ("r", "g")]
    return cut.select("row", F.posexplode(F.arrays_zip(*shifted)).alias("start", "t"))


def _after(before: Column, ends: Column, runs: int) -> Column:
    return F.transform(ends, lambda e: F.struct(F.lit(runs).alias("runs"), F.concat(before, e).alias("key")))


def mentions(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """row, start (number of the run), name, exact of each mention in a table (row, text), where row numbers the texts. Phrases in any case and phrases in their own are looked for apart, each from left to right, at a place the
    longest first, and going on behind it, as a pattern of all of them would be. Null and empty texts mention nothing; neither does any text for an empty vocabulary."""
    known = aliases(vocabulary)
    most = known.agg(F.max("runs")).first()[0] or 1
    heads = _sized(known.groupBy("first").agg(F.max("runs").alias("most")))
    c = F.col
    tokens = _candidates(texts, most).select("row", "start", "t", F.explode(_ends(c("t.r0"))).alias("head"))
    tokens = tokens.join(heads, F.lower("head") == c("first"))  # all else is dropped here
    tried, before = [F.array(F.struct(F.lit(1).alias("runs"), c("head").alias("key")))], F.lit("")
    for k in range(1, most):
        before = F.concat(before, c(f"t.r{k - 1}"), c(f"t.g{k - 1}"))
        whole = (c("head") == c("t.r0")) & c(f"t.r{k}").isNotNull() & (c("most") > k)
        tried.append(F.when(whole, _after(before, _ends(c(f"t.r{k}")), k + 1)).otherwise(F.array().cast("array<struct<runs:int,key:string>>")))
    spelled = tokens.select("row", "start", F.explode(F.flatten(F.array(*tried))).alias("x")).select("row", "start", "x.runs", F.explode(F.array(F.struct(F.lit(True).alias("exact"), c("x.key").alias("key")), F.struct(F.lit(False).alias("exact"), F.lower("x.key").alias("key")))).alias("y"))
    found = spelled.select("row", "start", "runs", "y.exact", "y.key").join(_sized(known.drop("first")), ["runs", "exact", "key"])
    listed = found.groupBy("row", "exact").agg(F.array_sort(F.collect_list(F.struct("start", (-c("size")).alias("short"), "runs", "name"))).alias("all"))  # one text's
    state = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<start:int,name:string>>").alias("kept"))
    step = lambda s, x: F.when(x["start"] < s["next"], s).otherwise(F.struct((x["start"] + x["runs"]).alias("next"), F.concat(s["kept"], F.array(F.struct(x["start"].alias("start"), x["name"].alias("name")))).alias("kept")))
    return listed.select("row", "exact", F.explode(F.aggregate("all", state, step, lambda s: s["kept"])).alias("m")).select("row", "m.start", "m.name", "exact")


def names(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """row, names of each text that mentions any: each name once, in the order of first mention, of two at one place the one in any case first."""
    first = mentions(texts, vocabulary).groupBy("row", "name").agg(F.min(F.struct("start", "exact")).alias("at"))
    return first.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))
