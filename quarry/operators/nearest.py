"""The best documents for each of many profiles by cosine of weighed terms: a join over postings lists that is pruned by bounds on weights, exact for every profile and without a row for each pair.

Each profile's terms are put in order of how much they can add at most: the profile's weight times the greatest weight that any document gives the term. What a suffix of this order can add in all is known, so documents that
hold none of the terms before it reach no more than that. Once the best candidates of a profile beat this bound, the lists of the terms behind need not be read for new candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import dropped, kept, numbered
from . import vectors

#: Candidates of a profile that its first look takes, by the terms that add most; rounding that bounds are relaxed by.
FIRST_LOOK, SLACK = 50, 1e-9
#: Rows of a table up to which it is broadcast.
FEW = 250_000


def _parts(df: DataFrame, rows: int) -> int:
    """How many parts a shuffle of so many rows has."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // vectors.PAIRS))


def _scores(pairs: DataFrame, lists: DataFrame, own: DataFrame) -> DataFrame:
    """profile, row, id, score of the pairs (profile, row), over all terms that both hold."""
    total, few = pairs.count(), own.count() <= FEW
    parts, terms = _parts(pairs, max(total, lists.count())), own.select("profile", "term", "pw")
    met = lists.join(F.broadcast(pairs), "row") if total <= FEW else pairs.repartition(parts, "row").join(lists.repartition(parts, "row"), "row")
    on = ["profile", "term"]
    met = met.join(F.broadcast(terms), on) if few else met.join(terms, on).repartition(parts, "row")
    return met.groupBy("profile", "row", "id").agg(F.sum(F.col("w") * F.col("pw")).alias("score"))


def _met(lists: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of lists whose term is among the kept terms (profile, term, df), once for each profile, in parts by row. Few terms are broadcast, so that rows are dealt before there is one for each profile."""
    met, total = terms.agg(F.sum("df"), F.count("*")).first()
    parts, terms = _parts(lists, met or 0), terms.drop("df")
    return lists.repartition(parts, "row").join(F.broadcast(terms), "term") if total <= FEW else lists.join(terms, "term").repartition(parts, "row")


def _best(scores: DataFrame, most: int) -> DataFrame:
    """The top-k report: place by score, then by row."""
    place = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc(F.round("score", 9)), "row"))
    return scores.withColumn("place", place).where(F.col("place") <= most)


def top_documents(docs: DataFrame, id_: str, profiles: DataFrame, profile_id: str, terms_of, most: int = 20, counts: dict | None = None) -> DataFrame:
    """profile, place, id, cosine: for each row of profiles (profile_id, text) the `most` rows of docs (id_, text) of the greatest cosine above 0; of equal cosines, rounded to nine places, the least id first. Weights are those of
    one corpus of all documents; a profile's words that no document holds don't count, not even for its length.

    Null and empty texts are near to nothing; each row of docs is a document of its own and each row of profiles a profile of its own, under whatever id; empty tables give no rows. `counts`, if given, is filled with the numbers of
    pairs that were looked at."""
    c = F.col
    rows = docs.select(c(id_).cast("long").alias("id"), "text", F.monotonically_increasing_id().alias("row"))
    tf = vectors.counted(rows, ["row", "id"], terms_of(c("text")))
    n, df = docs.count(), vectors.frequencies(tf)
    raw = vectors.weight(c("tf"), c("df"), n)
    lengths = kept(vectors.with_frequencies(tf.where("term IS NOT NULL"), df).groupBy("row").agg(F.sqrt(F.sum(raw * raw)).alias("length")))
    people = numbered(profiles.select(c(profile_id).cast("long").alias("profile_id"), "text"), "profile")
    told = vectors.counted(people.select("profile", "text"), ["profile"], terms_of(c("text"))).where("term IS NOT NULL")
    # of the documents' terms only those that some profile holds go on
    asked = kept(told.select("term").distinct().join(df, "term"))
    size = asked.agg(F.sum("df")).first()[0] or 0
    asked_few, parts = asked.count() <= FEW, _parts(docs, size)
    lists = tf.join(F.broadcast(asked) if asked_few else asked, "term").select("row", "id", "term", raw.alias("raw"))
    lists = lists.join(F.broadcast(lengths), "row") if n <= FEW else lists.repartition(parts, "row").join(lengths.repartition(parts, "row"), "row")
    lists = kept(lists.select("row", "id", "term", (c("raw") / c("length")).alias("w")))
    dropped(tf)
    own = told.join(asked, "term").join(lists.groupBy("term").agg(F.max("w").alias("top")), "term").select("profile", "term", "df", "top", raw.alias("raw"))
    length = F.sqrt(F.sum(c("raw") * c("raw")).over(Window.partitionBy("profile")))
    # how much a term can add, and all from it on
    own = own.withColumn("pw", c("raw") / length).withColumn("most", c("pw") * c("top"))
    order = Window.partitionBy("profile").orderBy(F.desc("most"), "term")
    own = own.withColumn("k", F.row_number().over(order)).withColumn("rest", F.sum("most").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    own = kept(own)
    # a first look: the shortest prefix of terms whose lists hold enough documents gives a floor for the last place
    enough = Window.partitionBy("profile").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    looked = kept(own.withColumn("before", F.coalesce(F.sum("df").over(enough), F.lit(0))).where(c("before") < FIRST_LOOK * most).select("profile", "term", "pw", "df"))
    partly = _met(lists, looked).groupBy("profile", "row").agg(F.sum(c("w") * c("pw")).alias("score"))
    tried = kept(_best(partly, most).select("profile", "row"))
    floor = _best(_scores(tried, lists, own), most).groupBy("profile").agg(F.when(F.count("*") == most, F.min("score")).alias("floor"))
    floor = own.select("profile").distinct().join(floor, "profile", "left").select("profile", F.coalesce("floor", F.lit(0.0)).alias("floor"))
    # every document that can reach the floor holds a term that is needed for it, and over these terms no less than the floor without the terms after
    needs = c("rest") >= c("floor") - SLACK
    after = F.coalesce(F.max(F.when(~needs, c("rest"))).over(Window.partitionBy("profile")), F.lit(0.0))
    needed = kept(own.join(floor, "profile").withColumn("least", c("floor") - SLACK - after).where(needs).select("profile", "term", "pw", "df", "least"))
    found = _met(lists, needed).groupBy("profile", "row").agg(F.sum(c("w") * c("pw")).alias("part"), F.max("least").alias("least"))
    open_ = kept(found.where(c("part") >= c("least")).select("profile", "row"))
    if counts is not None:
        counts.update(joined=lists.join(needed, "term").count(), scored=open_.count(), pairs=n * people.count())
    scores = _scores(open_, lists, own)
    place = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc(F.round("score", 9)), "id", "row"))
    best = scores.withColumn("place", place).where(c("place") <= most)
    return best.join(people.select("profile", "profile_id"), "profile").select(c("profile_id").alias("profile"), "place", "id", c("score").alias("cosine"))
