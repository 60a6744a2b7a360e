"""Résumé, match and document tables: upserts, edits, lists, overview and next step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import skills

# Fixed values.
TRACKED = ("saved", "applied", "rejected")
LONGEST_STATUS, LONGEST_SKILL, MOST_ROWS, DEFAULT_ROWS = 32, 40, 1000, 50
STRONG = 40.0


def clamp_limit(n: object, most: int = MOST_ROWS) -> int:
    """A row limit within 1 and `most`; 50 for what is no number."""
    try:
        return max(1, min(int(n), most))
    except (TypeError, ValueError):
        return DEFAULT_ROWS


def newest(df: DataFrame, by: str, limit: object = DEFAULT_ROWS) -> DataFrame:
    """A list's feature: the newest rows first, up to a limit."""
    return df.orderBy(F.desc_nulls_last(by), F.desc("id")).limit(clamp_limit(limit))


def latest(df: DataFrame, by: str = "created_at") -> DataFrame:
    """The newest row, without a sort."""
    return df.agg(F.max_by(F.struct(*df.columns), F.struct(by, "id")).alias("r")).where("r IS NOT NULL").select("r.*")


def upsert_resumes(stored: DataFrame, fresh: DataFrame, inherit_from: int | None = None) -> DataFrame:
    """Rows of the same raw text are one, which keeps its id and extra skills; all else comes anew. A blank text equals no other. New rows take the extra skills of the résumé `inherit_from`, where that is stored.
    Compared by hash, so long texts aren't shuffled twice."""
    keyed = lambda df, name: df.withColumns({"key": F.when(F.trim("raw_text") != "", F.sha2("raw_text", 256)), "there": F.lit(True)}).alias(name)
    if inherit_from is not None:
        old = stored.where(F.col("id") == inherit_from).agg(F.first("extra_skills").alias("inherited"))  # one row
        fresh = fresh.crossJoin(F.broadcast(old)).withColumn("extra_skills", F.coalesce("inherited", "extra_skills")).drop("inherited")
    both = keyed(stored, "o").join(keyed(fresh, "n"), F.col("o.key") == F.col("n.key"), "full_outer")
    was, came = F.col("o.there").isNotNull(), F.col("n.there").isNotNull()
    side = lambda c: F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in ("id", "extra_skills") else F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*(side(c).alias(c) for c in stored.columns))


def clean_skills(typed: Column, vocabulary: dict[str, skills.Alias] | None = None) -> Column:
    """Skills typed into a field, parted by commas, semicolons or lines: canonical where known, at most 40 characters, each once."""
    parts = F.filter(F.transform(F.split(F.coalesce(typed, F.lit("")), r"[,;\n]"), lambda x: F.trim(x)), lambda s: (s != "") & (F.length(s) <= LONGEST_SKILL))
    words = {a.lower(): v.name for a, v in (vocabulary or skills.parse_vocabulary()).items()}
    table = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    return F.array_distinct(F.transform(parts, lambda s: F.coalesce(F.try_element_at(table, F.lower(s)), s)))


def with_extra_skills(resumes: DataFrame, resume_id: int, extra: list[str]) -> DataFrame:
    new = F.array(*map(F.lit, extra)).cast("array<string>")
    return resumes.withColumn("extra_skills", F.when(F.col("id") == resume_id, new).otherwise(F.col("extra_skills")))


def with_status(matches: DataFrame, match_id: int, status: str) -> DataFrame:
    if not status or len(status) > LONGEST_STATUS:
        raise ValueError("a status has 1 to 32 characters")
    return matches.withColumn("status", F.when(F.col("match_id") == match_id, status).otherwise(F.col("status")))


def valid_documents(documents: DataFrame, matches: DataFrame) -> DataFrame:
    """Documents whose match exists."""
    return documents.join(matches.select("match_id"), "match_id", "left_semi")


def document_list(documents: DataFrame) -> DataFrame:
    """Documents with their numbers of words."""
    words = F.filter(F.split(F.trim(F.coalesce("content", F.lit(""))), r"\s+"), lambda w: w != "")
    return documents.withColumn("n_words", F.size(words))


def overview(matches: DataFrame) -> DataFrame:
    """One row: how many matches, strong ones that aren't hidden, and of each tracked status."""
    return matches.agg(F.count("*").alias("n"), F.count_if((F.col("total") >= STRONG) & (F.col("status") != "hidden")).alias("strong"), *(F.count_if(F.col("status") == s).alias(s) for s in TRACKED))


def next_step(n_resumes: Column, n_jobs: Column, n_matches: Column, strong: Column, saved: Column) -> Column:
    """What to do now, the first that applies."""
    return F.when(n_resumes == 0, "upload a résumé").when(n_jobs == 0, "search for postings").when(n_matches == 0, "score the postings").when((strong > 0) & (saved == 0), "save a strong match").when(saved > 0, "write for a saved match").otherwise("search more widely")


def grounded(items: Column, posting: Column, known: Column) -> Column:
    """Of proposed names those that the posting holds: at most 40 characters, at most two words unless known."""
    return F.array_distinct(F.filter(items, lambda s: (F.length(s) <= LONGEST_SKILL) & F.contains(F.lower(posting), F.lower(s)) & ((F.size(F.split(s, r"\s+")) <= 2) | F.array_contains(skills.lower_all(known), F.lower(s)))))


def letter_body(c: Column) -> Column:
    """A letter from its greeting on; all of it where there is none."""
    body = F.regexp_extract(c, r"(?is)(Dear\s+Hiring\s+Manager.*)", 1)
    return F.trim(F.when(body == "", c).otherwise(body))


def shown_file(path: Column) -> Column:
    """A stored file's name without folders and the eight characters put before it."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"^[0-9a-f]{8}[_-]", "")


def level_of(years: Column) -> Column:
    return F.when(years < 1, "entry level").when(years < 3, "early career").otherwise("experienced")
