"""Checks of drafted text against a résumé, and requirements split into must and nice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import skills

# Fixed values, here and in the lists below, in their published order.
SENIOR = ("seasoned", "veteran", "senior", "expert", "extensive experience", "wealth of experience", "proven track record", "decade", "many years", "years of experience in the industry", "industry veteran")
SELF, ABOUT_OTHERS = r"(?i)\b(?:I|I'm|I've|I am|my|me)\b", r"\b(?:you|your|the role|requires?)\b"
CLAIM, PERCENT = r"(?i)\b(\d{1,2}(?:\.\d)?)\s*\+?\s*(?:years?|yrs?)\b", r"\b\d{1,3}(?:\.\d+)?\s?%"
DEGREES = {"master's degree": r"\bmaster'?s\b|\bm\.?\s?tech\b|\bm\.?\s?s\.?\b(?= in)|\bmsc\b", "MBA": r"\bmba\b", "PhD": r"\bph\.?\s?d\b|\bdoctorate\b"}
EMPLOYER = (
    r"\b(?i:worked|working|interned|interning|employed|served|my (?:time|role|work|internship))\s+(?:(?i:as an?) [\w -]{2,40}?\s+)?(?i:at|with|for)\s+"
    r"((?-i:[A-Z])[\w&.'-]*(?:\s+(?-i:[A-Z])[\w&.'-]*){0,3})"
)
#: What ends a name that a sentence goes on behind.
NOT_OF_A_NAME = ("I", "We", "My", "Our", "The", "And", "As", "In", "On")
USED = r"\b(?:experience|expertise|proficien|skilled|worked|built|used)\w*"
NICE = (
    r"nice[- ]to[- ]haves?", r"good[- ]to[- ]have", r"bonus(?: points)?", r"preferred(?: qualifications| skills)?", r"(?:is|are|would be|as) (?:a |an )?(?:big |strong |huge )?plus\b", r"\ba plus\b", r"desirable",
    r"not required", r"optional(?:ly)?", r"extra credit", r"ideally", r"it would be great", r"what would be great",
)
TRAILING = r"(?i)plus\b|desirable|not required|optional"
MUST = (
    r"requirements?", r"required", r"must[- ]haves?", r"what you(?:'ll| will)? (?:need|bring|do)", r"qualifications", r"minimum qualifications", r"responsibilities", r"what we(?:'re| are) looking for", r"about you", r"who you are",
    r"your profile", r"skills",
)
MOST_FLAGS, MOST_SKILLS, HEADING, MOST_NAMED = 8, 25, 60, 3


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda s: F.size(F.split(s, " ")) >= 3)


def plain(c: Column) -> Column:
    """Lower case, with letters a to z, digits, % . + and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9%.+ ]+", " "), " +", " "))


def _employer(raw: Column) -> Column:
    """A name as it is shown: without final signs and words that begin what follows."""
    words = F.split(F.regexp_replace(raw, "[.,;:']+$", ""), r"\s+")
    last = F.aggregate(F.sequence(F.size(words), F.lit(1)), F.size(words), lambda n, k: F.when((n == k) & (k > 1) & F.get(words, k - 1).isin(*NOT_OF_A_NAME), k - 1).otherwise(n))
    return F.array_join(F.slice(words, 1, last), " ")


def flagged(drafts: DataFrame, vocabulary: dict[str, skills.Alias] | None = None) -> DataFrame:
    """id, place, sentence, why of the first eight sentences of each draft that claim what the résumé doesn't hold; all reasons of a sentence are told. drafts: id, draft, resume, have (skills), years, and, where a draft may name
    the place applied to, target (its company, title and text). Nulls are empty; a sentence that comes again is told once."""
    target = plain(F.col("target")) if "target" in drafts.columns else F.lit("")
    have = F.coalesce("have", F.array().cast("array<string>"))
    facts = drafts.select("id", "draft", F.coalesce("years", F.lit(0.0)).alias("years"), target.alias("target"), plain(F.concat_ws(" ", "resume", F.array_join(have, " "))).alias("source"), skills.lower_all(F.concat(have, skills.named(F.col("resume"), vocabulary))).alias("held"))
    each = facts.select("id", "years", "source", "target", "held", F.posexplode(sentences(F.coalesce("draft", F.lit("")))).alias("place", "sentence"))
    first = Window.partitionBy("id", "sentence").orderBy("place")
    each = each.withColumn("again", F.row_number().over(first)).where("again = 1")
    s, low, years, source = F.col("sentence"), F.lower("sentence"), F.col("years"), F.col("source")
    own, shown = s.rlike(SELF), F.format_string("%.1f", years)
    only = lambda when, reasons: F.when(when, reasons).otherwise(F.array().cast("array<string>"))
    senior = F.regexp_extract(s, rf"(?i)\b(?:{'|'.join(SENIOR)})\b", 0)
    claims = F.filter(F.regexp_extract_all(s, F.lit(CLAIM), F.lit(0)), lambda x: F.regexp_extract(x, CLAIM, 1).cast("double") > years + 0.5)
    joined = F.replace(source, F.lit(" "), F.lit(""))
    figures = F.filter(F.regexp_extract_all(s, F.lit(PERCENT), F.lit(0)), lambda x: ~F.contains(joined, F.replace(plain(x), F.lit(" "), F.lit(""))))
    degrees = F.array_compact(F.array(*(F.when(own & low.rlike(p) & ~source.rlike(p), F.lit(f"Mentions a {name}, which your resume does not list.")) for name, p in DEGREES.items())))
    employers = F.filter(F.transform(F.regexp_extract_all(s, F.lit(EMPLOYER), F.lit(1)), _employer), lambda x: (plain(x) != "") & ~F.contains(source, plain(x)) & ~F.contains(F.col("target"), plain(x)))
    foreign = F.filter(skills.named(s, vocabulary), lambda x: ~F.array_contains("held", F.lower(x)))
    reasons = F.concat(
        only(own & (senior != "") & (years < 3), F.array(F.concat(F.lit('Says "'), senior, F.lit('", but your resume shows about '), shown, F.lit(" years of experience.")))),
        only(own & ~low.rlike(ABOUT_OTHERS), F.transform(claims, lambda x: F.concat(F.lit("Claims "), x, F.lit(", but your resume shows about "), shown, F.lit(" years.")))),
        F.transform(figures, lambda x: F.concat(F.lit("The figure "), x, F.lit(" is not on your resume."))),
        degrees,
        F.transform(employers, lambda x: F.concat(F.lit('Names "'), x, F.lit('" as an employer, but it is not on your resume.'))),
        only(own & low.rlike(USED) & (F.size(foreign) > 0), F.array(F.concat(F.lit("Claims experience with "), F.array_join(F.slice(foreign, 1, MOST_NAMED), ", "), F.lit(", which your resume does not mention.")))),
    )
    found = each.select("id", "place", "sentence", F.array_distinct(reasons).alias("reasons")).where(F.size("reasons") > 0)
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("place"))).where(F.col("n") <= MOST_FLAGS)
    return found.select("id", "place", "sentence", F.array_join("reasons", " ").alias("why"))


def requirements(postings: DataFrame, vocabulary: dict[str, skills.Alias] | None = None) -> DataFrame:
    """id, must, nice: skills of a posting. A short line without a full stop is a heading: one with a cue for optional things makes all below it nice, one that names requirements ends that. Elsewhere a cue makes
    its sentence's skills nice, those before it only if it is a trailing one. A skill's first mention decides; at most 25 of each."""
    nice_cue, must_cue = rf"(?i){'|'.join(NICE)}", rf"(?i)^\W*(?:{'|'.join(MUST)})\b.{{0,30}}$"
    lines = postings.select("id", F.posexplode(F.split(F.coalesce("description", F.lit("")), "\n")).alias("no", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).where("line <> ''")
    short = (F.length("line") <= HEADING) & ~F.col("line").endswith(".")
    block = F.when(short & F.col("line").rlike(nice_cue), F.lit(True)).when(short & F.col("line").rlike(must_cue), F.lit(False))
    w = Window.partitionBy("id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"starts": block, "optional": F.coalesce(F.last(block, ignorenulls=True).over(w), F.lit(False))}).where("NOT (starts IS NOT NULL AND starts)")
    parts = lines.select("id", "no", "optional", F.posexplode(F.split("line", r"(?<=[.;!?])\s+")).alias("part", "sentence"))
    cue = F.regexp_instr("sentence", F.lit(nice_cue))
    named = parts.withColumns({"cue": cue, "trailing": F.regexp_extract("sentence", nice_cue, 0).rlike(TRAILING)}).select("id", "no", "part", "optional", "cue", "trailing", "sentence", F.posexplode(skills.named(F.col("sentence"), vocabulary)).alias("k", "skill"))
    at = F.instr(F.lower("sentence"), F.lower("skill"))
    nice = F.col("optional") | ((F.col("cue") > 0) & (F.col("trailing") | (at == 0) | (at >= F.col("cue"))))
    first = named.withColumn("nice", nice).groupBy("id", "skill").agg(F.min(F.struct("no", "part", "k", "nice")).alias("f"))
    lists = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f.no", "f.part", "f.k", "f.nice", "skill"))).alias("all"))
    pick = lambda keep: F.slice(F.transform(F.filter("all", lambda x: x["nice"] == keep), lambda x: x["skill"]), 1, MOST_SKILLS)
    return postings.select("id").join(lists, "id", "left").select("id", F.coalesce(pick(False), F.array().cast("array<string>")).alias("must"), F.coalesce(pick(True), F.array().cast("array<string>")).alias("nice"))
