"""Queries of views, summaries and orders, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, skills, text
from ..operators import matching, profiles, vectors, views
from ..session import spread, table
from ..sources import boards
from .postings import matches, postings, with_postings
from .queries import BAND, FETCHED, GAPS, TOKENS, _gaps, query

NAMES = "CASE WHEN description LIKE '%java and kafka%' THEN ['Java', 'Kafka'] WHEN description LIKE '%python and sql%' THEN ['Python', 'SQL'] WHEN description LIKE '%sql and excel%' THEN ['SQL'] ELSE ['Kubernetes', 'Docker', 'Java'] END"
PLACE = "CASE WHEN location LIKE '%Germany' THEN 'local' WHEN location = 'Remote, Europe' THEN 'remote_open' WHEN location = 'Remote' THEN 'remote' WHEN source = 'remoteok' AND location <> '' THEN 'restricted' WHEN source = 'remoteok' THEN 'remote' WHEN location = '' THEN 'unknown' ELSE 'elsewhere' END"
SOURCE = "CASE source WHEN 'remoteok' THEN 'RemoteOK' WHEN 'hn' THEN 'Hacker News Who''s Hiring' WHEN 'lever' THEN 'Lever company boards' ELSE source END"


@query(with_postings(f""", a AS (SELECT m.match_id, p.title, p.company, {SOURCE} AS source_name, {PLACE} AS place, {BAND} AS band, {NAMES} AS named,
  coalesce(years, CAST(regexp_extract(lower(description), '(\\d+)\\+? years', 1) AS INTEGER)) AS required_years FROM (SELECT *, coalesce(total, 0) AS t FROM matches) m JOIN postings p ON p.id = m.job_id)
  SELECT match_id, title, company, source_name, place, CASE band WHEN 'none' THEN 'weak' ELSE band END AS band, array_to_string(list_filter(named, lambda s: s IN ('Java', 'SQL')), ',') AS matched, array_to_string(list_filter(named, lambda s: s NOT IN ('Java', 'SQL')), ',') AS missing,
  len(named) >= 3 AND len(list_filter(named, lambda s: s NOT IN ('Java', 'SQL'))) BETWEEN 1 AND 3 AND len(list_filter(named, lambda s: s IN ('Java', 'SQL'))) >= len(list_filter(named, lambda s: s NOT IN ('Java', 'SQL'))) AS near, CAST(required_years AS DOUBLE) AS required_years FROM a"""))
def annotated_matches(spark: SparkSession, d: str) -> DataFrame:
    have = F.array(F.lit("java"), F.lit("SQL"))
    a = views.annotated(matches(spark, d), spread(postings(spark, d)), have, "Germany")
    return a.select("match_id", "title", "company", "source_name", "place", "band", F.array_join("gap.matched", ",").alias("matched"), F.array_join("gap.missing", ",").alias("missing"), "near", F.col("required_years").cast("double").alias("required_years"))


@query(with_postings("SELECT match_id, CAST(row_number() OVER (ORDER BY CASE status WHEN 'saved' THEN 0 WHEN 'applied' THEN 1 ELSE 2 END, total DESC, match_id) AS INTEGER) AS place FROM (SELECT * FROM matches ORDER BY total DESC NULLS LAST, match_id LIMIT 100) x"))
def draftable_matches(spark: SparkSession, d: str) -> DataFrame:
    return views.draftable(matches(spark, d)).select("match_id", "place")


NEAR = "SELECT * FROM gaps WHERE len(required) >= 3 AND len(missing) BETWEEN 1 AND 3 AND len(matched) >= len(missing)"


@query(GAPS + f"SELECT skill, count(*) AS jobs, count(*) FILTER (WHERE alone) AS closes FROM (SELECT unnest(missing) AS skill, len(missing) = 1 AS alone FROM ({NEAR}) x) y GROUP BY skill ORDER BY jobs DESC, closes DESC, lower(skill) LIMIT 8")
def learn_first(spark: SparkSession, d: str) -> DataFrame:
    return views.learn_first(_gaps(spark, d))


@query(GAPS + f"SELECT match_id, CAST(len(missing) AS INTEGER) AS n_missing FROM ({NEAR}) x ORDER BY len(missing), total DESC NULLS LAST, match_id LIMIT 12")
def near_miss_report(spark: SparkSession, d: str) -> DataFrame:
    g = _gaps(spark, d).withColumn("id", F.col("match_id"))
    return matching.near_miss_order(g, 12).select("match_id", F.size("gap.missing").alias("n_missing"))


@query(with_postings("SELECT match_id, total FROM matches ORDER BY total DESC NULLS LAST, match_id LIMIT 20 OFFSET 40"))
def third_page(spark: SparkSession, d: str) -> DataFrame:
    return matching.page(matches(spark, d).withColumn("id", F.col("match_id")), 3, 20).select("match_id", "total")


@query(GAPS + f", shown AS (SELECT m.match_id, m.status, p.source FROM matches m JOIN postings p ON p.id = m.job_id) SELECT (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT DISTINCT source FROM shown) s) AS sources, (SELECT count(*) FROM ({NEAR}) n WHERE match_id IN (SELECT match_id FROM shown)) AS near, (SELECT count(*) FROM shown WHERE status = 'hidden') AS hidden")
def result_strip(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d).select(F.col("id").alias("job_id"), "source")
    return matching.strip(_gaps(spark, d).join(p, "job_id")).withColumn("sources", F.array_join("sources", ","))


@query(with_postings(f"SELECT {SOURCE} AS name, count(*) AS found, count(DISTINCT url) FILTER (WHERE url NOT IN (SELECT url FROM postings WHERE {FETCHED})) AS new FROM postings WHERE NOT {FETCHED} GROUP BY source"))
def search_summary(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d)
    return views.search_summary(p.where(f"NOT {FETCHED}"), p.where(FETCHED), "url")


@query(with_postings("SELECT DISTINCT source AS key, CASE source WHEN 'remoteok' THEN 'RemoteOK' WHEN 'hn' THEN 'Hacker News Who''s Hiring' WHEN 'lever' THEN 'Lever company boards' ELSE source END AS name, source IN ('remoteok', 'hn') AS is_default, source <> 'lever' AS configured, false AS opt_in FROM postings"))
def selectable_sources(spark: SparkSession, d: str) -> DataFrame:
    return views.selectable(postings(spark, d).select(F.col("source").alias("key")).distinct())


@query(with_postings("SELECT match_id, CASE status WHEN 'new' THEN 'New' WHEN 'saved' THEN 'Saved' WHEN 'applied' THEN 'Applied' WHEN 'rejected' THEN 'Rejected' ELSE 'Hidden' END AS status_name, CASE WHEN total IS NULL THEN 'Not scored' WHEN total >= 40 THEN 'Strong fit' WHEN total >= 25 THEN 'Worth a look' ELSE 'Reach' END AS band_name FROM matches"))
def shown_names(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d).select("match_id", views.status_name(F.col("status")).alias("status_name"), views.band_name(scoring.band(F.col("total"))).alias("band_name"))


@query(with_postings("SELECT match_id, CASE WHEN status = 'new' THEN (ats + semantic) / 2 ELSE total END AS total, 2 AS version FROM matches"))
def rescored_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches that nobody has set a status on count as scored by the first version."""
    m = matches(spark, d).withColumn("version", F.when(F.col("status") != "new", 2))
    return views.rescored(m, 2, (F.col("ats") + F.col("semantic")) / 2).select("match_id", "total", "version")


@query("""WITH s AS (SELECT o_custkey AS person, CAST(date_trunc('month', o_orderdate) AS DATE) AS a, CAST(date_trunc('month', o_orderdate) + to_months(CAST(o_orderkey % 9 AS INTEGER)) AS DATE) AS b FROM orders),
  f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY person ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM s),
  i AS (SELECT *, sum(opens) OVER (PARTITION BY person ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM f), g AS (SELECT person, max(b) - min(a) AS days FROM i GROUP BY person, island)
  SELECT person, round(sum(days) / 365.25, 1) AS years FROM g GROUP BY person""")
def day_years(spark: SparkSession, d: str) -> DataFrame:
    first = F.trunc("o_orderdate", "month")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), first.alias("a"), F.add_months(first, (F.col("o_orderkey") % 9).cast("int")).alias("b"))
    years = views.day_years(o, "person", "a", "b").withColumnRenamed("person", "_person")
    # a person without a dated order has a row too, without years
    return o.select("person").distinct().join(years, F.col("person").eqNullSafe(F.col("_person")), "left").select("person", "years")


@query(with_postings("SELECT id FROM postings WHERE location LIKE '%Germany' OR location LIKE 'Remote%' OR location LIKE 'Bengaluru%'"))
def wanted_places(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d)
    return p.where(boards.place_wanted(F.col("location"), boards.wanted_places("Bangalore; Germany / remote"))).select("id")


@query(r"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS raw, generate_subscripts(string_split(text, ' '), 1) AS no FROM documents), s AS (SELECT doc_id, slug, min(no) AS first FROM (SELECT doc_id, no, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS slug FROM w) x WHERE regexp_matches(slug, '^[A-Za-z0-9][A-Za-z0-9_-]{0,59}$') GROUP BY 1, 2)
  SELECT doc_id, string_agg(slug, ',' ORDER BY first) AS slugs FROM s GROUP BY doc_id""")
def valid_slugs(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.array_join(boards.valid_slugs(F.split("text", " ")), ",").alias("slugs")).where("slugs <> ''")


@query(f"""WITH d AS (SELECT doc_id AS id, text FROM documents), t AS (SELECT id, unnest({TOKENS}) AS term FROM d), tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  w AS (SELECT id, tf.term, round((1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM d)) / (1.0 + df)) + 1), 9) AS raw FROM tf JOIN df ON df.term = tf.term)
  SELECT id, string_agg(term, ',' ORDER BY raw DESC, term) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY raw DESC, term) AS rk FROM w) x WHERE rk <= 10 GROUP BY id""")
def heaviest_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    top = vectors.heaviest(docs, "doc_id", vectors.tokens(F.col("text")), 10)
    return top.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), ",").alias("terms"))  # ten a document


KEYWORDS = f"""SELECT doc_id, CAST(rk AS INTEGER) AS place, term, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(term) <= 2, first) AS rk FROM (SELECT doc_id, lower(word) AS term, count(*) AS n, min(no) AS first FROM
  (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS no FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+#]*(?:\\.[A-Za-z0-9]+)*') AS words FROM documents) a) b
  WHERE lower(word) IN ('c', 'r', 'go', 'c#', 'ai', 'ml', 'ui', 'ux', 'qa') OR (length(word) > 2 AND lower(word) NOT IN ({", ".join(f"'{w}'" for w in sorted(vectors.STOP))})) GROUP BY doc_id, lower(word)) c) e WHERE rk <= 20"""


@query(KEYWORDS)
def document_keywords(spark: SparkSession, d: str) -> DataFrame:
    return views.keywords(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


@query(with_postings(f"SELECT id, array_to_string({NAMES}, ',') AS skills, CAST(regexp_extract(lower(description), '(\\d+)\\+? years', 1) AS INTEGER) AS years FROM postings"))
def posting_insights(spark: SparkSession, d: str) -> DataFrame:
    i = views.insights(spread(postings(spark, d)), "id", "description")
    return i.select("id", F.array_join("skills", ",").alias("skills"), "years")


@query(with_postings(f"""SELECT id, array_to_string(list_filter(n, lambda s: s IN ('SQL', 'Docker', 'Kafka')), ',') AS matched, array_to_string(list_filter(n, lambda s: s NOT IN ('SQL', 'Docker', 'Kafka')), ',') AS missing FROM
  (SELECT id, CASE WHEN title LIKE '%Java Dev%' AND NOT list_contains(named, 'Java') THEN list_append(named, 'Java') WHEN title LIKE '%Python Eng%' AND NOT list_contains(named, 'Python') THEN list_append(named, 'Python') ELSE named END AS n FROM (SELECT *, {NAMES} AS named FROM postings) x) y"""))
def draft_gaps(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    told = skills.named(F.concat_ws("\n", "description", "title"))
    g = postings(spark, d).select("id", told.alias("named")).select("id", views.draft_gap(c("named"), F.array(F.lit("sql")), F.lit("Ran kafka topics and docker images.")).alias("gap"))
    return g.select("id", F.array_join("gap.matched", ",").alias("matched"), F.array_join("gap.missing", ",").alias("missing"))


@query(with_postings(f"""SELECT id, array_to_string(list_sort(list_distinct(list_concat({NAMES}, list_transform(string_split(tags, ','), lambda s: CASE s WHEN 'java' THEN 'Java' WHEN 'python' THEN 'Python' WHEN 'sql' THEN 'SQL' ELSE s END)))), ',') AS held FROM postings"""))
def held_skills(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("id", F.array_join(F.array_sort(views.held_skills(F.col("description"), F.split("tags", ","))), ",").alias("held"))


@query(r"SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) AS INTEGER) AS n_words FROM conversations")
def document_list(spark: SparkSession, d: str) -> DataFrame:
    return profiles.document_list(table(spark, d, "conversations").withColumn("content", F.col("text"))).select("conv_id", "turn", "n_words")


@query(r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[A-Za-z0-9]') THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE '' END AS line FROM conversations")
def turns_in_one_line(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(matching.has_text(c), text.one_line(c, 1 << 30)).otherwise("").alias("line"))
