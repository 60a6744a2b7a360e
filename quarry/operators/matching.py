"""Postings scored against one profile, from their texts to ranked totals."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import location, scoring, skills, years
from ..scratch import kept, numbered
from . import latent, ranking, vectors

#: The range of character-run cosines that counts as 0 to 100, and languages to suggest searches for, in this order.
SIMILAR = (0.05, 0.55)
#: The range of mean chunk cosines that counts as 0 to 100.
EMBEDDED = (0.20, 0.60)
LANGUAGES = ("Java", "Python", "JavaScript", "TypeScript", "Go", "Kotlin", "C#", "C++", "Ruby", "PHP", "Rust", "Scala", "Swift", "Dart")


class Profile(NamedTuple):
    """The one side of a scoring run: a text, skills that were typed in, years of experience, home country and preferred cities."""

    text: str
    extra_skills: tuple[str, ...] = ()
    years: float = 0.0
    home: str = ""
    cities: tuple[str, ...] = ()

    @property
    def whole(self) -> str:
        added = [s for s in self.extra_skills if s.strip()]
        return f"{self.text}\nAdditional skills: {', '.join(added)}" if added else self.text


def job_text(title: Column, company: Column, description: Column, tags: Column | None = None) -> Column:
    """The description or, where there is none, title, company and tags."""
    rest = F.trim(F.concat_ws(" ", title, company, *([] if tags is None else [tags])))
    return F.coalesce(F.when(F.trim(description) != "", description), rest)


def resume_text(raw: Column, extra_skills: Column, summary: Column, education: Column, names: Column) -> Column:
    """The raw text with the skills that were typed in or, where there is none, what was parsed from it."""
    extra = F.filter(F.coalesce(extra_skills, F.array().cast("array<string>")), lambda s: F.trim(s) != "")
    told = F.when(F.size(extra) > 0, F.concat(raw, F.lit("\nAdditional skills: "), F.array_join(extra, ", "))).otherwise(raw)
    parts = F.filter(F.array(summary, education, F.array_join(names, " ")), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.trim(raw) != "", told).otherwise(F.array_join(parts, "\n"))


def required_years(field: Column, title: Column, text: Column) -> Column:
    """Years that a posting asks for: its field between 0 and 50, else what the text states, else what its seniority implies."""
    given = F.when(field.cast("double").between(0, 50), F.round(field.cast("double")))
    return F.coalesce(given, years.required_years(text), years.seniority_years(title, text).cast("double"))


def has_text(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[A-Za-z0-9]"), F.lit(False))


def scores(ats: Column, ats_raw: Column, exp: Column, semantic: Column, fresh: Column, have_years: Column, asked_years: Column, covered: Column, place: Column, title_missing: Column) -> Column:
    """All figures of a match: the parts, the total before and after the place, its band, and what led to them. A skill of the title that is missing caps the keyword score."""
    capped = scoring.capped_by_title(ats, F.size(title_missing) > 0)
    base = scoring.combine(capped, semantic, exp, fresh)
    total = F.round(scoring.clamp(base * scoring.location_factor(place["score"])), 1)
    one = lambda c: F.round(c, 1)
    figures = {
        "total": total, "band": scoring.band(total), "missing_title_skills": title_missing, "base_total": one(base), "location_status": place["status"], "location_score": place["score"], "location_reason": place["reason"],
        "ats": one(capped), "experience": one(exp), "semantic": one(semantic), "freshness": one(fresh), "ats_raw": one(ats_raw), "skill_coverage": one(covered), "candidate_years": have_years, "required_years": asked_years,
    }
    return F.struct(*(c.alias(k) for k, c in figures.items()))


def _held(profile: DataFrame, vocabulary: Mapping[str, skills.Alias] | None) -> list[str]:
    """The skills that the one text of a profile names."""
    return profile.select(skills.named(F.col("text"), vocabulary)).first()[0]


def similarity(run_cosine: Column, latent_cosine: Column) -> Column:
    """Similarity without an embedding model, 0 to 100: character runs and, where there is a latent space, its share."""
    both = (1 - latent.SHARE) * run_cosine + latent.SHARE * latent_cosine
    return 100 * scoring.rescale(F.coalesce(both, run_cosine), *SIMILAR)


def score_postings(postings: DataFrame, profile: Profile, now: Column, vocabulary: Mapping[str, skills.Alias] | None = None, components: int = latent.COMPONENTS, chunks: DataFrame | None = None, own_chunks: DataFrame | None = None) -> DataFrame:
    """The rows of postings (id, title, company, location, description, source, posted, years) with text and scores. Keywords are weighed as words and pairs, similarity as character runs and, from latent.LEAST documents on,
    in a latent space of words, each in one corpus of the profile and all postings; a text without a letter or digit scores 0 in both. Nulls are empty, each row is scored for itself whatever its id, an empty table gives no
    rows. With embeddings of the chunks of postings (id, embedding) and of the profile (embedding), these give the similarity, and a posting without chunks has none."""
    spark = postings.sparkSession
    c = F.col
    # texts are written once; all parts start from there and meet again by the row's number
    rows = numbered(postings.withColumn("text", job_text(c("title"), c("company"), c("description"))), "_row")
    one = spark.createDataFrame([(profile.whole,)], "text string")
    texts = rows.select(c("_row").alias("row"), "text")
    words = vectors.cosines(texts, "row", one, lambda t: vectors.grams(vectors.tokens(t))).select(c("id").alias("_row"), c("cosine").alias("word_cosine"))
    if chunks is not None and own_chunks is not None:
        near = vectors.best_chunk_mean(chunks.select(c("id").alias("job"), "embedding"), own_chunks).select(c("job").alias("id"), "similarity")
        near = rows.select("_row", "id").join(near, "id", "left").select("_row", (100 * scoring.rescale(F.coalesce("similarity", F.lit(0.0)), *EMBEDDED)).alias("close"))
    else:
        runs = vectors.cosines(texts, "row", one, vectors.char_grams).select(c("id").alias("_row"), c("cosine").alias("run_cosine"))
        topics = latent.with_profile(texts, one, components=components).select(c("row").alias("_row"), "latent")
        near = runs.join(topics, "_row", "left").select("_row", similarity(c("run_cosine"), c("latent")).alias("close"))
    figures = kept(words.join(near, "_row"))
    held = F.array(*map(F.lit, dict.fromkeys([*_held(one, vocabulary), *profile.extra_skills]))).cast("array<string>")
    facts = rows.join(figures, "_row").withColumns({"held": held, "named": skills.named(c("text"), vocabulary), "in_title": skills.named(c("title"), vocabulary)})
    facts = facts.withColumns({"asked_years": required_years(c("years"), c("title"), c("text")), "place": location.fit(c("title"), c("location"), c("description"), c("source"), profile.home, profile.cities)})
    raw = F.when(has_text(c("text")) & F.lit(bool(re.search("[A-Za-z0-9]", profile.whole))), scoring.clamp(c("word_cosine"), 0.0, 1.0)).otherwise(0.0)
    close = F.when(has_text(c("text")), c("close")).otherwise(0.0)
    covered = scoring.coverage(c("held"), c("named"))
    lacking = F.filter("in_title", lambda s: ~F.array_contains(skills.lower_all(c("held")), F.lower(s)))
    have_years = F.lit(float(profile.years))
    whole = scores(scoring.blended(scoring.calibrate(raw), covered), 100 * raw, scoring.experience(have_years, c("asked_years")), close, scoring.freshness(c("posted"), now), have_years, c("asked_years"), covered, c("place"), lacking)
    return facts.withColumn("scores", whole).select(*postings.columns, "text", "scores")


#: Words that are frequent in postings and say nothing about fit.
FILLER = frozenset(
    "work team teams software product products build building development developer developers engineer engineers engineering apply senior customers customer applications application business including solutions ability"
    " roles role use using people strong features production employees make company best process global develop real looking working day modern like opportunity https http www com und der die mit für wir sie du ll ve re"
    " don experience years year skills job jobs hiring benefits applicants candidates new world join help across well time based".split()
)


def _cover(ranked: Column, matched: Column, missing: Column, most: int) -> Column:
    """struct(matched, missing): the lists filled up to `most` from ranked terms (term, held), in order, without those whose words are all in terms or skills of the same list."""
    skill_words = F.flatten(F.transform(F.concat(matched, missing), lambda s: F.split(F.lower(s), r"\s+")))
    start = F.struct(matched.alias("matched"), missing.alias("missing"), skill_words.alias("seen_matched"), skill_words.alias("seen_missing"))

    def step(state: Column, x: Column) -> Column:
        words, one = F.split(x["term"], " "), F.array(x["term"])
        seen = F.when(x["held"], state["seen_matched"]).otherwise(state["seen_missing"])
        full = F.size(state["matched"]) + F.size(state["missing"]) >= most
        added = F.when(
            x["held"],
            F.struct(F.concat(state["matched"], one).alias("matched"), state["missing"].alias("missing"), F.concat(state["seen_matched"], words).alias("seen_matched"), state["seen_missing"].alias("seen_missing")),
        ).otherwise(F.struct(state["matched"].alias("matched"), F.concat(state["missing"], one).alias("missing"), state["seen_matched"].alias("seen_matched"), F.concat(state["seen_missing"], words).alias("seen_missing")))
        return F.when(full | F.forall(words, lambda w: F.array_contains(seen, w)), state).otherwise(added)

    return F.aggregate(ranked, start, step, lambda state: F.struct(state["matched"].alias("matched"), state["missing"].alias("missing")))


def keyword_gap(scored: DataFrame, profile: Profile, vocabulary: Mapping[str, skills.Alias] | None = None, most: int = 15, filler: frozenset[str] = FILLER) -> DataFrame:
    """id, matched, missing of each row (id, text): at most `most` of what a posting asks for, held by the profile or not. Skills come first, in the text's order; then the text's heaviest words and pairs, weighed in a corpus
    of the profile and this posting, without filler, words of fewer than three characters, terms that name a skill, and terms all of whose words are listed already on the same side.

    A null text, or one without a letter or digit, asks for nothing; rows of equal ids each give a row; an empty table gives no rows."""
    c, spark = F.col, scored.sparkSession
    rows = numbered(scored.select("id", "text"), "row")
    one = spark.createDataFrame([(profile.whole,)], "text string")
    terms_of = lambda t: vectors.grams(vectors.tokens(t))
    tf = vectors.counted(rows, ["row"], terms_of(c("text"))).where("term IS NOT NULL")
    own = one.select(F.explode(terms_of(c("text"))).alias("term")).distinct().withColumn("held", F.lit(True))
    plain = F.forall(F.split("term", " "), lambda w: (F.length(w) >= 3) & ~w.isin(*filler))
    naming = tf.select("term").distinct().where(plain & (F.size(skills.named(c("term"), vocabulary)) > 0))  # each term is searched once
    weighed = tf.where(plain).join(naming, "term", "left_anti").join(own, "term", "left").select("row", "term", F.coalesce("held", F.lit(False)).alias("held"), vectors.weight(c("tf"), F.when(c("held"), 2).otherwise(1), 2).alias("w"))
    ranked = weighed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct((-F.round("w", 9)).alias("w"), "term", "held"))).alias("ranked"))  # one text's terms
    held = F.array(*map(F.lit, _held(one, vocabulary))).cast("array<string>")
    names = F.slice(skills.named(c("text"), vocabulary), 1, most)
    of = rows.join(ranked, "row", "left").select("id", "text", names.alias("names"), held.alias("held"), F.coalesce("ranked", F.array().cast("array<struct<w:double,term:string,held:boolean>>")).alias("ranked"))
    matched, missing = F.filter("names", lambda s: F.array_contains("held", s)), F.filter("names", lambda s: ~F.array_contains("held", s))
    of = of.select("id", "text", "ranked", matched.alias("matched"), missing.alias("missing")).withColumn("gap", _cover(c("ranked"), c("matched"), c("missing"), most))
    shown = lambda k: F.when(has_text(c("text")), c(f"gap.{k}")).otherwise(F.array().cast("array<string>")).alias(k)
    return of.select("id", shown("matched"), shown("missing"))


def labelled(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """rank, label and the columns of scored (url, total, id) for postings whose address is labelled (url, label), best first; addresses are compared without case, outer blanks and final slashes."""
    key = lambda c: F.regexp_replace(F.lower(F.trim(c)), "/+$", "")
    known = labels.select(key(F.col("url")).alias("_url"), "label").dropDuplicates(["_url"])
    joined = scored.join(known, key(F.col("url")) == F.col("_url")).drop("_url")
    return joined.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "id")))  # the labelled postings are few


def metrics(ranked: DataFrame) -> DataFrame:
    """One row over rank and label (2 good, 1 partial, 0 bad): n, good, partial, p_at_5, p_at_5_good, p_at_10, ndcg_at_10."""
    counts = ranked.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 2).alias("good"), F.count_if(F.col("label") == 1).alias("partial"), ranking.precision_at(5).alias("p_at_5"), ranking.precision_at(5, 2).alias("p_at_5_good"), ranking.precision_at(10).alias("p_at_10"))
    gain = ranking.ndcg(ranked.withColumn("_all", F.lit(1)), "_all").select(F.col("ndcg").alias("ndcg_at_10"))
    return counts.join(F.broadcast(gain), F.lit(True), "left").na.fill(0.0, ["ndcg_at_10"])  # one row of each


def suggested_search(raw: Column, names: Column) -> Column:
    """The language of the profile's skills that its text mentions most, of equals the first of LANGUAGES, as a developer's; without one, a software engineer's."""
    held = skills.lower_all(F.coalesce(names, F.array().cast("array<string>")))
    text = F.coalesce(raw, F.lit(""))
    told = F.array(*(F.when(F.array_contains(held, lang.lower()), F.struct((-F.regexp_count(text, F.lit(rf"(?i)(?<![\w+#]){re.escape(lang)}(?![\w+#])"))).alias("n"), F.lit(k).alias("k"), F.lit(lang).alias("name"))) for k, lang in enumerate(LANGUAGES)))
    best = F.array_min(F.array_compact(told))
    return F.coalesce(F.concat(best["name"], F.lit(" Developer")), F.lit("Software Engineer"))


def near_miss_order(matches: DataFrame, most: int = 20) -> DataFrame:
    """The top-k report of near misses (columns gap, total, id): fewest missing skills first, then the best total."""
    return matches.where(skills.near_miss(F.col("gap"))).orderBy(F.size("gap.missing"), F.desc("total"), "id").limit(most)


def page(matches: DataFrame, number: int, size: int = 50) -> DataFrame:
    """The page feature: rows of one page, counted from 1, in the order of total and id; the size is held between 1 and 1000."""
    size = min(1000, max(1, size))
    return matches.orderBy(F.desc_nulls_last("total"), "id").offset((max(1, number) - 1) * size).limit(size)


def strip(matches: DataFrame) -> DataFrame:
    """One row of a result list: sources present in alphabetical order, near misses, hidden rows."""
    return matches.agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count_if(skills.near_miss(F.col("gap"))).alias("near"), F.count_if(F.col("status") == "hidden").alias("hidden"))  # sources are few
