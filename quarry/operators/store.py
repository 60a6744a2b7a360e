"""Upserts and housekeeping on posting and match tables, as joins that make the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import first_wins


def upsert_postings(stored: DataFrame, fresh: DataFrame, key: str, order: list[str], fixed: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows keep their values; only null or empty ones are filled from the first fresh row of their key; keys that aren't stored are added. Adds is_new. `fixed` columns of stored rows never change."""
    fresh = first_wins(fresh.where((F.col("url").isNotNull()) | (F.col("title").isNotNull())), key, order)
    columns = stored.columns
    kinds = dict(stored.dtypes)
    both = stored.alias("o").join(fresh.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    old = F.col(f"o.{key}").isNotNull()

    def merged(c: str) -> Column:
        before = F.nullif(F.col(f"o.{c}"), F.lit("")) if kinds[c] == "string" else F.col(f"o.{c}")
        filled = F.coalesce(before, F.col(f"n.{c}"), F.col(f"o.{c}"))
        return (F.when(old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in fixed else filled).alias(c)

    return both.select(*map(merged, columns), (~old).alias("is_new"))


def upsert_matches(stored: DataFrame, fresh: DataFrame, keys: tuple[str, str] = ("resume_id", "job_id"), scores: tuple[str, ...] = ("total", "ats", "semantic", "experience", "freshness")) -> DataFrame:
    """Scores are overwritten (null where absent), a status stays unless one comes, new rows start as new."""
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    both = stored.alias("o").join(fresh.alias("n"), on, "full_outer")
    came = F.col(f"n.{keys[0]}").isNotNull()
    return both.select(
        *(F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys),
        *(F.when(came, F.col(f"n.{s}")).otherwise(F.col(f"o.{s}")).alias(s) for s in scores),
        F.coalesce(F.col("n.status"), F.col("o.status"), F.lit("new")).alias("status"),
    )


def is_stale(posted: Column, scraped: Column, now: Column, days: int) -> Column:
    return F.coalesce(posted, scraped) < now - F.make_dt_interval(F.lit(max(1, days)))


def kept_ids(matches: DataFrame, documents: DataFrame) -> DataFrame:
    """Postings that are tracked or have a document."""
    tracked = matches.where(F.col("status").isin("saved", "applied", "rejected")).select("job_id")
    drafted = matches.join(documents.select("match_id"), "match_id", "left_semi").select("job_id")
    return tracked.unionByName(drafted).distinct()


def stale(postings: DataFrame, kept: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Old postings that nothing keeps: what housekeeping deletes."""
    old = postings.where(is_stale(F.col("posted"), F.col("scraped"), now, days))
    return old.join(kept.select(F.col("job_id").alias("id")), "id", "left_anti")


def delete_stale(postings: DataFrame, matches: DataFrame, gone: DataFrame, documents: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """The tables without them: matches go with their postings, and documents (match_id), where given, with their matches."""
    ids = gone.select("id")
    of = ids.withColumnRenamed("id", "job_id")
    left = postings.join(ids, "id", "left_anti"), matches.join(of, "job_id", "left_anti")
    return left if documents is None else (*left, documents.join(matches.join(of, "job_id", "left_semi").select("match_id"), "match_id", "left_anti"))
