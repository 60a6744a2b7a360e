"""Résumé, match and document tables."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import profiles


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def test_limits():
    assert [profiles.clamp_limit(x) for x in (0, 7, 5000, "x", None)] == [1, 7, 1000, 50, 50]


def test_resumes(spark):
    schema = "id long, raw_text string, skills array<string>, extra_skills array<string>, created_at timestamp"
    old = spark.createDataFrame([(1, "a", ["Java"], ["Go"], None)], schema)
    new = spark.createDataFrame([(9, "a", ["Kafka"], None, None), (2, "b", [], None, None)], schema)
    out = {r.id: r for r in profiles.upsert_resumes(old, new).collect()}
    assert set(out) == {1, 2} and out[1].skills == ["Kafka"] and out[1].extra_skills == ["Go"]
    assert profiles.with_extra_skills(old, 1, ["SQL"]).first().extra_skills == ["SQL"]
    assert profiles.latest(old.limit(0)).count() == 0 and profiles.latest(old).first().id == 1


def test_matches_and_documents(spark):
    matches = spark.createDataFrame([(1, 50.0, "new"), (2, 45.0, "hidden"), (3, None, "saved")], "match_id long, total double, status string")
    assert profiles.overview(matches).first().asDict() == {"n": 3, "strong": 1, "saved": 1, "applied": 0, "rejected": 0}
    assert {r.match_id: r.status for r in profiles.with_status(matches, 1, "applied").collect()}[1] == "applied"
    with pytest.raises(ValueError):
        profiles.with_status(matches, 1, "")
    docs = spark.createDataFrame([(1, "two words"), (8, "x"), (2, None)], "match_id long, content string")
    kept = profiles.document_list(profiles.valid_documents(docs, matches))
    assert {r.match_id: r.n_words for r in kept.collect()} == {1: 2, 2: 0}


def test_text(spark):
    assert one(spark, profiles.clean_skills(F.lit("js, golang; Cobol\n, js"))) == ["JavaScript", "Go", "Cobol"]
    assert one(spark, profiles.grounded(F.array(F.lit("Java"), F.lit("a b c"), F.lit("Rust")), F.lit("we use java, a b c"), F.array(F.lit("x")))) == ["Java"]
    assert one(spark, profiles.letter_body(F.lit("Sure!\nDear Hiring Manager, hi"))) == "Dear Hiring Manager, hi"
    assert one(spark, profiles.shown_file(F.lit("/a/b/0123abcd_cv.tex"))) == "cv.tex"
    assert one(spark, profiles.next_step(F.lit(1), F.lit(1), F.lit(1), F.lit(2), F.lit(0))) == "save a strong match"
