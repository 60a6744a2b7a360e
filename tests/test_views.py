"""Views, boards and what is written out."""

from datetime import date

import duckdb
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import profiles, views
from quarry.plans.queries import SQL
from quarry.plans.views import day_years
from quarry.sources import boards, postings


def test_wanted_places(spark):
    assert boards.wanted_places("Bangalore,  India; Remote") == ["bangalore", "bengaluru", "india", "remote"]
    assert boards.wanted_places(None) == boards.wanted_places(" ; ") == []
    rows = spark.createDataFrame([("Bengaluru, KA",), ("Indiana",), (None,), ("REMOTE  (India)",)], "location string")
    kept = lambda wanted: [r.location for r in rows.where(boards.place_wanted(F.col("location"), wanted)).collect()]
    assert kept(["india", "bengaluru"]) == ["Bengaluru, KA", "REMOTE  (India)"]
    assert len(kept([])) == 4


def test_listed_places_and_countries():
    assert boards.listed_places("India", ("Bengaluru, India", "Berlin")) == ["Bangalore, India"]
    assert boards.listed_places("Gurugram; Remote | Berlin, Germany") == ["Gurgaon, India", "Flexible / Remote", "Berlin, Germany"]
    assert len(boards.listed_places("india")) == 7 and boards.listed_places(None) == ["Flexible / Remote"]
    assert [boards.country_for(x) for x in ("Bangalore, India", "Remote", None, "Berlin / anywhere", "Nowhere")] == ["India", "", "", "Germany", ""]


def test_uploads(spark):
    files = [("cv.TXT", b"plain", None), ("cv.txt", b"a\0b", "text file holds binary data"), ("cv.md", b"\xff\xfe", "text file holds binary data"), ("cv.exe", b"x", "file type is not allowed"), ("cv.pdf", b"%PDF-1.4", None), ("cv.pdf", b"PK", "file is no PDF"), ("", b"x", "invalid file name"), (None, b"x", "invalid file name"), ("a.txt", b"", "file is empty"), ("a.txt", None, "file is empty"), ("a.txt", b"x" * 99, "file is too large"), (".txt", b"x", "file type is not allowed")]
    rows = spark.createDataFrame([(k, *f) for k, f in enumerate(files)], "k int, name string, data binary, expected string")
    got = rows.select("k", text.upload_problem(F.col("name"), F.col("data"), (".txt", ".md", ".pdf"), 50).alias("problem")).orderBy("k").collect()
    assert [r.problem for r in got] == [f[2] for f in files]


def test_csv(spark, tmp_path):
    from datetime import datetime

    views.export_csv(spark.createDataFrame([("=1+1", -5, datetime(2024, 1, 2, 3, 4, 5, 600)), (None, None, None)], "a string, b int, c timestamp").coalesce(1), str(tmp_path / "x"))
    assert next((tmp_path / "x").glob("*.csv")).read_text() == "a,b,c\n'=1+1,-5,2024-01-02 03:04:05\n,,\n"


def test_scraped_and_story(spark, tmp_path):
    now = F.lit("2024-01-02").cast("timestamp")
    rows = spark.createDataFrame([("Dev", "NaN", "Berlin", None, "https://www.linkedin.com/jobs/view/dev-at-x-123?refId=1", "2024-01-01"), (None, None, None, None, None, None)], "title string, company string, location string, description string, job_url string, date_posted string")
    got = postings.scraped(rows, "linkedin", now).collect()
    assert [(r.title, r.company, r.url) for r in got] == [("Dev", "Unknown company", "https://www.linkedin.com/jobs/view/123/")]
    (tmp_path / "s.json").write_text('{"hits": [{"objectID": "7", "title": "Ask HN: Who is hiring? (May)", "created_at_i": 5}, {"objectID": "9", "title": "Who wants to be hired?", "created_at_i": 9}, {"objectID": "8", "title": "Who  is hiring?", "created_at_i": 6}]}')
    assert [r.id for r in postings.latest_hiring_story(spark, str(tmp_path / "s.json")).collect()] == ["8"]


def test_inherited_skills(spark):
    schema = "id long, raw_text string, extra_skills array<string>, created_at int"
    old = spark.createDataFrame([(1, "a", ["Go"], 1), (2, "b", None, 1), (3, " ", None, 1)], schema)
    new = spark.createDataFrame([(9, "b", None, 2), (10, "c", None, 2), (11, " ", None, 2)], schema)
    assert sorted((r.id, r.extra_skills, r.created_at) for r in profiles.upsert_resumes(old, new, 1).collect()) == [(1, ["Go"], 1), (2, None, 2), (3, None, 1), (10, ["Go"], 2), (11, ["Go"], 2)]


def test_valid_slugs(spark):
    rows = spark.createDataFrame([([" stripe ", "a b", "stripe", "-x", None, "", "n26\n", "a" * 61],), (None,), ([],)], "names array<string>")
    assert [r.s for r in rows.select(boards.valid_slugs(F.col("names")).alias("s")).collect()] == [["stripe", "n26"], [], []]


def test_names(spark):
    rows = spark.createDataFrame([("hn", "new", "strong", "7.5"), (None, "onHold", None, "x"), ("own", None, "?", None)], "source string, status string, band string, n string")
    got = rows.select(views.source_name(F.col("source")), views.status_name(F.col("status")), views.band_name(F.col("band")), views.number_of(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("Hacker News Who's Hiring", "New", "Strong fit", 7.5), ("", "Onhold", "Not scored", 0.0), ("own", None, "Not scored", 0.0)]


def test_selectable(spark):
    keys = spark.createDataFrame([("hn",), ("linkedin",), ("naukri",), ("lever",)], "key string")
    got = {r.key: tuple(r)[2:] for r in views.selectable(keys, ("naukri",), ("lever",)).collect()}
    assert got == {"hn": (True, True, False), "naukri": (True, True, True), "lever": (False, True, False)}


def test_keywords(spark):
    text = "Go go Node.js C# the node.js kafka, KAFKA kafka of ai R&D"
    rows = views.keywords(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), "id", "text").orderBy("place").collect()
    assert [(r.term, r.n) for r in rows] == [("kafka", 3), ("node.js", 2), ("go", 2), ("c#", 1), ("ai", 1), ("r", 1)]
    found = {r.id: r for r in views.insights(spark.createDataFrame([(1, "5+ years of Java. Java and Kafka"), (2, None)], "id long, text string"), "id", "text").collect()}
    assert (found[1].skills, found[1].years, found[1].keywords[0]) == (["Java", "Kafka"], 5, "java")
    assert (found[2].skills, found[2].years, found[2].keywords) == ([], None, [])


def test_day_years(spark):
    day = date.fromisoformat
    rows = [(1, day("2020-01-01"), day("2021-01-01")), (1, day("2020-06-01"), day("2021-07-01")), (1, day("2023-01-01"), day("2023-01-01")), (2, day("2020-01-01"), None), (3, day("2021-01-01"), day("2020-01-01")), (4, day("2010-01-01"), day("2020-01-01")), (4, day("2012-01-01"), day("2013-01-01"))]
    got = {r.p: r.years for r in views.day_years(spark.createDataFrame(rows, "p long, a date, b date"), "p", "a", "b").collect()}
    assert got == {1: 1.5, 4: 10.0}


def test_skill_sets(spark):
    rows = spark.createDataFrame([("Java, kafka", [" python ", "Basket weaving", "java", ""]), (None, None)], "text string, extra array<string>")
    assert [r.h for r in rows.select(views.held_skills(F.col("text"), F.col("extra")).alias("h")).collect()] == [["Java", "Kafka", "Python", "Basket weaving"], []]
    g = spark.range(1).select(views.draft_gap(F.array(F.lit("Java"), F.lit("SQL"), F.lit("Go")), F.array(F.lit("java")), F.lit("wrote sql")).alias("g")).first().g
    assert (g.matched, g.missing) == (["Java", "SQL"], ["Go"])


def test_digest(spark):
    schema = f"summary string, names array<string>, roles {views.ROLES}, raw string"
    rows = spark.createDataFrame([("Builds things", ["Java", "Go"], [("Dev", "Acme", ""), ("", None, None)], "text"), (None, [], None, None)], schema)
    got = [r.d for r in rows.select(views.resume_digest(*map(F.col, rows.columns)).alias("d")).collect()]
    assert got == ["Summary: Builds things\nSkills: Java, Go\nRole: Dev - Acme\ntext", ""]


def test_rescored(spark):
    rows = spark.createDataFrame([(1, 5.0, 1), (2, 6.0, 2), (3, None, None)], "id long, total double, version int")
    assert sorted((r.id, r.total, r.version) for r in views.rescored(rows, 2, F.lit(9.0)).collect()) == [(1, 9.0, 2), (2, 6.0, 2), (3, 9.0, 2)]


def test_search_summary(spark):
    found = spark.createDataFrame([("hn", "a"), ("hn", "a"), ("hn", "b"), ("lever", "c"), ("hn", None)], "source string, url string")
    stored = spark.createDataFrame([("b",), ("c",), (None,)], "url string")
    assert {r.name: (r.found, r.new) for r in views.search_summary(found, stored, "url").collect()} == {"Hacker News Who's Hiring": (4, 1), "Lever company boards": (1, 0)}


def test_written(spark, tmp_path):
    p = spark.createDataFrame([(1, "http://a/x/", "t"), (2, "http://b", "u")], "id long, url string, title string")
    labels = spark.createDataFrame([("HTTP://A/x", 2), ("http://b", None)], "url string, label int")
    views.snapshot(p, labels, spark.createDataFrame([("me",)], "raw_text string"), str(tmp_path / "s"))
    assert [r.id for r in spark.read.json(str(tmp_path / "s/jobs")).collect()] == [1]
    paths = views.backup({"postings": p, "labels": labels}, str(tmp_path), "20240101_000000")
    assert [spark.read.parquet(x).count() for x in paths] == [2, 2]
    drafts = spark.createDataFrame([(1, "letter", "Dear"), (9, "letter", "Dear"), (1, "letter", " ")], "match_id long, kind string, content string")
    m = spark.createDataFrame([(1,)], "match_id long")
    for _ in range(2):
        views.save_documents(drafts, m, str(tmp_path / "d"), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    assert [r.file_name for r in spark.read.parquet(str(tmp_path / "d")).collect()] == ["match1_letter_20240102_030405.md"] * 2


def test_resume_list(spark):
    rows = spark.createDataFrame([(1, "a", date(2024, 1, 1), ["Java"], ["java", "Go"]), (2, None, date(2024, 2, 1), None, None)], "id long, file_path string, created_at date, skills array<string>, extra_skills array<string>")
    assert [(r.id, r.skill_count) for r in views.resume_list(rows).collect()] == [(2, 0), (1, 2)]


def test_learn_first_and_draftable(spark):
    gap = "struct<required:array<string>,matched:array<string>,missing:array<string>>"
    rows = spark.createDataFrame([((["a", "b", "c"], ["a", "b"], ["c"]),), ((["a", "d", "c", "e"], ["a", "e"], ["c", "d"]),), ((["x", "y"], ["x"], ["y"]),)], f"gap {gap}")
    assert [tuple(r) for r in views.learn_first(rows).collect()] == [("c", 2, 1), ("d", 1, 0)]
    m = spark.createDataFrame([(1, "new", 90.0), (2, "saved", 10.0), (3, "applied", 50.0), (4, "saved", None)], "match_id long, status string, total double")
    assert [r.match_id for r in views.draftable(m, 3).orderBy("place").collect()] == [2, 3, 1]


def test_equal_spans_after_a_gap_count_once_in_any_order(spark):
    day = date.fromisoformat
    rows = [(p, day(a), day(b)) for p in range(200) for a, b in (("2020-01-01", "2020-02-01"), ("2021-01-01", "2022-01-01"), ("2021-01-01", "2022-01-01"))]
    got = views.day_years(spark.createDataFrame(rows, "p long, a date, b date").repartition(7), "p", "a", "b").select("years").distinct().collect()
    assert [r.years for r in got] == [1.1]


def test_day_years_of_undated_orders_match_the_sql(spark, tmp_path):
    rows = "(1, 1, NULL), (2, 2, TIMESTAMP '2000-05-31 10:00:00'), (3, 2, NULL), (NULL, 3, TIMESTAMP '2000-05-31'), (4, NULL, TIMESTAMP '1999-02-03'), (5, 4, TIMESTAMP '1999-02-03'), (9, 5, TIMESTAMP '1999-02-03')"
    duck = duckdb.connect()
    duck.execute(f"CREATE TABLE orders AS SELECT k::BIGINT AS o_orderkey, c::BIGINT AS o_custkey, d AS o_orderdate FROM (VALUES {rows}) t(k, c, d)")
    duck.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    got = [tuple(r) for r in day_years(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(duck.execute(SQL["day_years"]).fetchall(), key=repr) and (1, None) in got
