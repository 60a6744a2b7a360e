"""The library's queries by name, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys, location, scoring, skills, text, years
from ..operators import evaluation, matching, nearest, phrases, ranking, relevance, sequence, store, vectors
from ..scratch import kept, numbered
from ..session import spread, table
from .postings import NOW, matches, postings, with_postings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FRESH = "CASE WHEN posted IS NULL THEN 50.0 WHEN age <= 24 THEN 100.0 WHEN age <= 72 THEN 85.0 WHEN age <= 168 THEN 70.0 WHEN age <= 336 THEN 50.0 ELSE 30.0 END"
EXP = "CASE WHEN years IS NULL THEN 70.0 WHEN years <= 0 OR 5 >= years THEN 100.0 ELSE greatest(0.0, 100.0 - 20.0 * (years - 5)) END"
FIT = "(0.6 * ats + 0.4 * semantic) * (0.4 + 0.6 * (0.75 * exp + 0.25 * fresh) / 100)"
TOTAL = f"greatest(0.0, least(100.0, CASE WHEN ats < 20 THEN least({FIT}, 24.9) WHEN ats < 35 THEN least({FIT}, 39.9) ELSE {FIT} END))"
BAND = "CASE WHEN total IS NULL THEN 'none' WHEN total >= 40 THEN 'strong' WHEN total >= 25 THEN 'possible' ELSE 'weak' END"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def now() -> F.Column:
    return F.expr(NOW)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Matches with their postings' dates and years, and the whole formula over both."""
    m, p = matches(spark, d), postings(spark, d).withColumnRenamed("id", "job_id").drop("source")
    both = m.drop("experience", "freshness", "total").join(p, "job_id")
    both = both.withColumns({"fresh": scoring.freshness(F.col("posted"), now()), "exp": scoring.experience(F.lit(5), F.col("years"))})
    return both.withColumn("total", F.round(scoring.combine(F.col("ats"), F.col("semantic"), F.col("exp"), F.col("fresh")), 6))


SCORED = with_postings(
    f""", s1 AS (SELECT m.match_id, m.resume_id, m.job_id, m.ats, m.semantic, m.status, p.title, p.company, p.location, p.url, p.years, p.posted, p.scraped,
      epoch(CAST({NOW} AS TIMESTAMP)) / 3600.0 - epoch(p.posted) / 3600.0 AS age FROM matches m JOIN postings p ON p.id = m.job_id),
    s2 AS (SELECT *, {FRESH} AS fresh, {EXP} AS exp FROM s1), scored AS (SELECT *, round({TOTAL}, 6) AS total FROM s2) """
)


@query(SCORED + f"SELECT match_id, job_id, fresh, exp, total, {BAND} AS band FROM scored")
def match_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("match_id", "job_id", "fresh", "exp", "total", scoring.band(F.col("total")).alias("band"))


@query(SCORED + "SELECT resume_id, match_id, total, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY total DESC NULLS LAST, match_id) AS INTEGER) AS rank FROM scored")
def ranked_matches(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("resume_id").orderBy(F.desc_nulls_last("total"), "match_id")
    return scored(spark, d).select("resume_id", "match_id", "total", F.row_number().over(w).alias("rank"))


@query(SCORED + "SELECT match_id, total FROM scored ORDER BY total DESC NULLS LAST, match_id LIMIT 20")
def best_matches(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("match_id", "total").orderBy(F.desc_nulls_last("total"), "match_id").limit(20)


@query(SCORED + "SELECT match_id, round((0.5 * ats + 0.3 * semantic + 0.2 * fresh) * (0.4 + 0.6 * CASE WHEN location = '' THEN 50.0 ELSE 100.0 END / 100), 6) AS other_total FROM scored")
def weighted_totals(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    factor = scoring.location_factor(F.when(F.col("location") == "", 50.0).otherwise(100.0))
    return s.select("match_id", F.round(scoring.weighted_total({k: F.col(k) for k in ("ats", "semantic", "fresh")}, {"ats": 5, "semantic": 3, "fresh": 2}, factor), 6).alias("other_total"))


@query(with_postings("""SELECT id, CASE WHEN regexp_matches(lower(title), '\\b(principal|director)\\b') THEN 10 WHEN regexp_matches(lower(title), '\\b(lead|manager)\\b') THEN 7
  WHEN regexp_matches(lower(title), '\\bsenior\\b') THEN 5 WHEN regexp_matches(lower(title), '\\bjunior\\b') THEN 0 WHEN regexp_matches(lower(title), '\\bassociate\\b') THEN 1 END AS implied FROM postings"""))
def title_years(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("id", years.seniority_years(F.col("title"), F.col("description")).alias("implied"))


@query(with_postings("SELECT id, CAST(regexp_extract(lower(description), '(\\d+)\\+? years', 1) AS DOUBLE) AS required FROM postings"))
def required_years(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("id", years.required_years(F.col("description")).alias("required"))


@query(with_postings("SELECT id, CAST(regexp_extract(lower(description), '(\\d+)\\+? years', 1) AS INTEGER) AS stated FROM postings"))
def stated_years(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("id", years.stated_years(F.col("description")).alias("stated"))


VERDICT = """CASE WHEN location LIKE '%Germany' THEN 'local' WHEN location = 'Remote, Europe' THEN 'remote_open' WHEN location = 'Remote' THEN 'remote'
  WHEN source = 'remoteok' AND location <> '' THEN 'restricted' WHEN source = 'remoteok' THEN 'remote' WHEN location = '' THEN 'unknown' ELSE 'elsewhere' END"""


@query(with_postings(f"SELECT id, {VERDICT} AS place FROM postings"))
def location_verdicts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return spread(postings(spark, d)).select("id", location.fit(c("title"), c("location"), c("description"), c("source"), "Germany")["status"].alias("place"))


@query(with_postings("""SELECT id, CAST(CASE WHEN t > 0 OR b > 0 OR (g > 0 AND len < 400) THEN 3 * t + 2 * g + b + 100 * t ELSE 0 END AS INTEGER) AS relevance FROM (SELECT id, length(description) AS len,
  CAST(list_contains(regexp_split_to_array(lower(title), '[^a-z0-9+#]+'), 'java') AS INTEGER) AS t, CAST(list_contains(regexp_split_to_array(tags, '[^a-z0-9+#]+'), 'java') AS INTEGER) AS g,
  CAST(len(list_filter(regexp_split_to_array(lower(description), '[^a-z0-9+#]+'), lambda w: w = 'java')) >= CASE WHEN length(description) < 400 THEN 1 ELSE 2 END AS INTEGER) AS b FROM postings) x"""))
def keyword_relevance(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("id", relevance.relevance("java", F.col("title"), F.col("tags"), F.col("description")).alias("relevance"))


@query(with_postings("""SELECT id FROM postings WHERE regexp_matches(lower(title), 'python engineer') OR (regexp_matches(lower(title), 'engineer|developer') AND regexp_matches(lower(description), '(^|[^a-z0-9+#])python($|[^a-z0-9+#])'))
  ORDER BY CASE WHEN regexp_matches(lower(title), 'python engineer') THEN 0 ELSE 1 END, CASE WHEN tags LIKE '%python%' THEN 0 ELSE 1 END, CASE WHEN regexp_matches(lower(description), '(^|[^a-z0-9+#])python($|[^a-z0-9+#])') THEN 0 ELSE 1 END, id LIMIT 20"""))
def most_relevant(spark: SparkSession, d: str) -> DataFrame:
    return relevance.select_relevant(postings(spark, d), "python engineer").select("id")


KEY = "sha256(CASE WHEN trim(url) <> '' THEN concat('url:', trim(url)) ELSE concat('tcl:', lower(concat_ws('|', trim(title), trim(company), trim(location)))) END)"


def _keyed(p: DataFrame) -> DataFrame:
    c = F.col
    return p.withColumn("key", keys.storage_key(c("url"), c("title"), c("company"), c("location")))


@query(with_postings(f"SELECT id, {KEY} AS storage_key, rtrim(lower(trim(url)), '/') AS session_key, rtrim(lower(trim(url)), '/') AS evaluation_key FROM postings"))
def posting_keys(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    args = (c("url"), c("title"), c("company"), c("location"))
    return postings(spark, d).select("id", keys.storage_key(*args).alias("storage_key"), keys.session_key(*args).alias("session_key"), keys.evaluation_key(c("url")).alias("evaluation_key"))


@query(with_postings("SELECT rtrim(lower(trim(url)), '/') AS key, min(id) AS id FROM postings GROUP BY 1"))
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d).select(keys.evaluation_key(F.col("url")).alias("key"), "id")
    return sequence.first_wins(p, "key", ["id"])


@query(with_postings("SELECT id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY id) AS INTEGER) AS turn FROM postings"))
def interleaved_sources(spark: SparkSession, d: str) -> DataFrame:
    return sequence.interleaved(postings(spark, d).select("id", "source"), "source", "id")


@query(SCORED + """, r AS (SELECT match_id, lower(trim(company)) AS k_company, lower(trim(title)) AS k_title, total, location, row_number() OVER (PARTITION BY resume_id ORDER BY match_id) AS rk, resume_id FROM scored)
  SELECT resume_id, k_company, k_title, total, min(rk) AS lead_rank, min_by(match_id, rk) AS lead_id, count(*) AS members FROM r GROUP BY resume_id, k_company, k_title, total""")
def grouped_matches(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("resume_id").orderBy("match_id")).cast("long"))
    keyed = s.select("resume_id", F.concat_ws("\x1f", F.col("resume_id").cast("string"), "company").alias("company"), "title", "total", "rank", F.col("match_id").alias("id"), "location")
    g = sequence.grouped_matches(keyed)
    part = F.split("k_company", "\x1f")
    return g.select(part[0].cast("long").alias("resume_id"), part[1].alias("k_company"), "k_title", "total", "lead_rank", "lead_id", F.size("ids").cast("long").alias("members"))


@query(with_postings("SELECT status, count(*) AS n, count(*) FILTER (WHERE total >= 40 AND status <> 'hidden') AS strong FROM matches GROUP BY status"))
def status_overview(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.count_if((F.col("total") >= 40) & (F.col("status") != "hidden")).alias("strong"))


@query(with_postings("SELECT source, count(*) AS n, round(100.0 * count(*) / max(count(*)) OVER (), 6) AS bar FROM postings GROUP BY source"))
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    g = postings(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.max("n").alias("most")))).select("source", "n", F.round(100.0 * F.col("n") / F.greatest("most", F.lit(1)), 6).alias("bar"))


@query(with_postings(f"SELECT {BAND} AS band, count(*) AS n, avg(total) AS mean FROM matches GROUP BY 1"))
def band_histogram(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d).groupBy(scoring.band(F.col("total")).alias("band")).agg(F.count("*").alias("n"), F.avg("total").alias("mean"))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'part', count(*) FROM part")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("orders", "documents", "pages", "part"):
        one = table(spark, d, name).agg(F.lit(name).alias("name"), F.count("*").alias("n")).select("name", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(with_postings("SELECT m.match_id, p.title, p.company, m.total FROM matches m JOIN postings p ON p.id = m.job_id"))
def matches_with_postings(spark: SparkSession, d: str) -> DataFrame:
    m, p = matches(spark, d), postings(spark, d)
    return m.join(p, m.job_id == p.id).select("match_id", "title", "company", "total")


CELL = "CASE WHEN substr({0}, 1, 1) IN ('=', '+', '-', '@') THEN concat('''', {0}) ELSE {0} END"


@query(with_postings(f"SELECT m.match_id, c.c_name AS resume, {CELL.format('p.title')} AS title, {CELL.format('p.company')} AS company, CASE WHEN m.total IS NULL THEN '' ELSE CAST(CAST(m.total AS INTEGER) AS VARCHAR) END AS total FROM matches m JOIN postings p ON p.id = m.job_id JOIN customer c ON c.c_custkey = m.resume_id"))
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    m, p, c = matches(spark, d), postings(spark, d), table(spark, d, "customer")
    both = m.join(p, m.job_id == p.id).join(c, m.resume_id == c.c_custkey)
    return both.select("match_id", F.col("c_name").alias("resume"), text.neutral_cell(F.col("title")).alias("title"), text.neutral_cell(F.col("company")).alias("company"), text.neutral_cell(F.col("total").cast("int")).alias("total"))


KEPT = "SELECT job_id FROM matches WHERE status IN ('saved', 'applied', 'rejected') UNION SELECT job_id FROM matches WHERE match_id % 10 = 4"
OLD = f"coalesce(posted, scraped) < CAST({NOW} AS TIMESTAMP) - INTERVAL 30 DAY"


def _kept(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d)
    return store.kept_ids(m, m.where("match_id % 10 = 4").select("match_id"))


@query(with_postings(f"SELECT p.id, p.title FROM postings p WHERE {OLD} AND p.id NOT IN ({KEPT})"))
def stale_postings(spark: SparkSession, d: str) -> DataFrame:
    return store.stale(postings(spark, d), _kept(spark, d), now()).select("id", "title")


@query(with_postings(f"SELECT count(*) FILTER (WHERE {OLD} AND k.job_id IS NULL) AS stale, count(*) FILTER (WHERE {OLD} AND k.job_id IS NOT NULL) AS kept FROM postings p LEFT JOIN ({KEPT}) k ON k.job_id = p.id"))
def stale_summary(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d).join(_kept(spark, d).select(F.col("job_id").alias("id"), F.lit(True).alias("kept")), "id", "left")
    old = store.is_stale(F.col("posted"), F.col("scraped"), now(), 30)
    return p.agg(F.count_if(old & F.col("kept").isNull()).alias("stale"), F.count_if(old & F.col("kept").isNotNull()).alias("kept"))


@query(with_postings(f"SELECT m.match_id FROM matches m WHERE m.job_id NOT IN (SELECT p.id FROM postings p WHERE {OLD} AND p.id NOT IN ({KEPT}))"))
def matches_after_cleaning(spark: SparkSession, d: str) -> DataFrame:
    p, m = postings(spark, d), matches(spark, d)
    return store.delete_stale(p, m, store.stale(p, _kept(spark, d), now()))[1].select("match_id")


#: Documents of the matches of a tenth, some of which belong to postings that only these documents would keep.
DRAFTS = "SELECT match_id, match_id * 10 + k AS document_id FROM matches, (SELECT unnest([0, 1]) AS k) n WHERE match_id % 10 = 3"
GONE = f"SELECT p.id FROM postings p WHERE {OLD} AND p.id NOT IN ({KEPT})"


def _cleaned(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """postings, matches and documents after housekeeping has deleted what was stale when the documents weren't there yet."""
    p, m = postings(spark, d), matches(spark, d)
    documents = m.where("match_id % 10 = 3").select("match_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select("match_id", (F.col("match_id") * 10 + F.col("k")).alias("document_id"))
    return store.delete_stale(p, m, store.stale(p, _kept(spark, d), now()), documents)


@query(with_postings(f"SELECT id FROM postings WHERE id NOT IN ({GONE})"))
def postings_after_cleaning(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d)[0].select("id")


@query(with_postings(f"SELECT match_id, document_id FROM ({DRAFTS}) x WHERE match_id NOT IN (SELECT match_id FROM matches WHERE job_id IN ({GONE}))"))
def documents_after_cleaning(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d)[2].select("match_id", "document_id")


#: What counts as stored: postings fetched before a day, matches that someone has set a status on. All others are fresh.
FETCHED = "coalesce(scraped < TIMESTAMP '1995-06-17 00:00:00', false)"
FIRST = "SELECT url, title, location, years, id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM postings WHERE {0}) x WHERE rn = 1"


@query(with_postings(f"""SELECT coalesce(o.url, n.url) AS url, coalesce(o.title, n.title) AS title, coalesce(nullif(o.location, ''), n.location, o.location) AS location, coalesce(o.years, n.years) AS years, coalesce(o.id, n.id) AS id, o.url IS NULL AS is_new
  FROM ({FIRST.format(FETCHED)}) o FULL JOIN ({FIRST.format("NOT " + FETCHED)}) n ON o.url = n.url"""))
def upserted_postings(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d)
    side = lambda test: p.where(test).select("url", "title", "location", "years", "id")
    return store.upsert_postings(sequence.first_wins(side(FETCHED), "url", ["id"]), side(f"NOT {FETCHED}"), "url", ["id"], fixed=("id",))


@query(with_postings("""SELECT coalesce(o.resume_id, n.resume_id) AS resume_id, coalesce(o.job_id, n.job_id) AS job_id, CASE WHEN n.job_id IS NOT NULL THEN n.total ELSE o.total END AS total, coalesce(n.status, o.status, 'new') AS status
  FROM (SELECT resume_id, job_id, min(total) AS total, min(status) AS status FROM matches WHERE status <> 'new' GROUP BY resume_id, job_id) o
  FULL JOIN (SELECT resume_id, job_id, max(total) AS total, CAST(NULL AS VARCHAR) AS status FROM matches WHERE status = 'new' GROUP BY resume_id, job_id) n ON o.resume_id = n.resume_id AND o.job_id = n.job_id"""))
def upserted_matches(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d)
    old = m.where("status <> 'new'").groupBy("resume_id", "job_id").agg(F.min("total").alias("total"), F.min("status").alias("status"))
    new = m.where("status = 'new'").groupBy("resume_id", "job_id").agg(F.max("total").alias("total"), F.lit(None).cast("string").alias("status"))
    return store.upsert_matches(old, new, scores=("total",))


NAMES = "CASE job_id % 4 WHEN 0 THEN ['Java', 'Kafka', 'Spring Boot'] WHEN 1 THEN ['Python', 'SQL', 'Airflow'] WHEN 2 THEN ['SQL', 'Excel', 'Python', 'Kafka'] ELSE ['Kubernetes', 'Docker', 'Java'] END"
HAVE = "['java', 'sql', 'docker', 'python']"
GAPS = with_postings(f""", g AS (SELECT match_id, total, list_filter({NAMES}, lambda s: lower(s) NOT IN ('ai', 'saas', 'c', 'r', 'excel')) AS required FROM matches),
  gaps AS (SELECT match_id, total, required, list_filter(required, lambda s: list_contains({HAVE}, lower(s))) AS matched, list_filter(required, lambda s: NOT list_contains({HAVE}, lower(s))) AS missing FROM g) """)


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    names = (["Java", "Kafka", "Spring Boot"], ["Python", "SQL", "Airflow"], ["SQL", "Excel", "Python", "Kafka"], ["Kubernetes", "Docker", "Java"])
    pick = F.element_at(F.array(*(F.array(*map(F.lit, n)) for n in names)), (F.col("job_id") % 4 + 1).cast("int"))
    have = F.array(*map(F.lit, ("java", "SQL", "Docker", "python")))
    return matches(spark, d).withColumn("gap", skills.gap(pick, have))


@query(GAPS + "SELECT match_id, array_to_string(matched, ',') AS matched, array_to_string(missing, ',') AS missing FROM gaps")
def skill_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d).select("match_id", F.array_join("gap.matched", ",").alias("matched"), F.array_join("gap.missing", ",").alias("missing"))


@query(GAPS + "SELECT match_id, CAST(len(missing) AS INTEGER) AS n_missing FROM gaps WHERE len(required) >= 3 AND len(missing) BETWEEN 1 AND 3 AND len(matched) >= len(missing)")
def near_misses(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d).where(skills.near_miss(F.col("gap"))).select("match_id", F.size("gap.missing").alias("n_missing"))


@query(GAPS + "SELECT skill, count(*) AS jobs, CAST(sum(alone) AS BIGINT) AS closes FROM (SELECT unnest(missing) AS skill, CASE WHEN len(missing) = 1 THEN 1 ELSE 0 END AS alone FROM gaps) x GROUP BY skill")
def skills_to_learn(spark: SparkSession, d: str) -> DataFrame:
    return ranking.skills_to_learn(_gaps(spark, d).select("gap.missing"))


@query(GAPS + "SELECT concat(s.skill, CASE WHEN m.skill IS NULL THEN ' (missing)' ELSE '' END) AS skill, s.n FROM (SELECT skill, count(*) AS n FROM (SELECT unnest(required) AS skill FROM gaps) x GROUP BY skill) s LEFT JOIN (SELECT DISTINCT unnest(matched) AS skill FROM gaps) m ON m.skill = s.skill ORDER BY s.n DESC, s.skill LIMIT 8")
def top_skills(spark: SparkSession, d: str) -> DataFrame:
    g = _gaps(spark, d)
    n = g.select(F.explode("gap.required").alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))
    held = g.select(F.explode("gap.matched").alias("skill")).distinct().withColumn("held", F.lit(True))
    return n.join(held, "skill", "left").orderBy(F.desc("n"), "skill").limit(8).select(F.concat("skill", F.when(F.col("held").isNull(), " (missing)").otherwise("")).alias("skill"), "n")


@query(SCORED + "SELECT match_id FROM scored WHERE coalesce(total, 0) >= 25 AND contains(lower(concat_ws(' ', title, company, location)), 'developer') AND (years IS NULL OR years <= 8) AND status <> 'hidden'")
def filtered_matches(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumns({"required": F.array().cast("array<string>"), "place": F.lit("local")})
    return s.where(ranking.match_filter("developer", min_score=25, max_years=8)).select("match_id")


SAID = "CASE WHEN description LIKE '%java and kafka%' THEN ['Java', 'Kafka'] WHEN description LIKE '%python and sql%' THEN ['Python', 'SQL'] WHEN description LIKE '%sql and excel%' THEN ['SQL'] ELSE ['Kubernetes', 'Docker', 'Java'] END"
HAY = "lower(concat_ws(' ', title, company, location, array_to_string(names, ' ')))"


@query(SCORED + f", v AS (SELECT id, {SAID} AS names, {VERDICT} AS place FROM postings) SELECT match_id FROM scored JOIN v ON v.id = job_id WHERE coalesce(total, 0) >= 10 AND contains({HAY}, 'docker') AND contains({HAY}, 'developer') AND place NOT IN ('restricted', 'elsewhere') AND status <> 'hidden'")
def takeable_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches whose posting names a skill in its text and a word in its title, in a place that one may work from."""
    c = F.col
    place = location.fit(c("title"), c("location"), c("description"), c("source"), "Germany")["status"]
    # each posting is judged once, before matches repeat it, and by all tasks: a small file of parts is one or two
    judged = kept(spread(postings(spark, d)).select(c("id").alias("job_id"), skills.named(c("description")).alias("required"), place.alias("place")))
    return scored(spark, d).join(judged, "job_id").where(ranking.match_filter("docker developer", min_score=10, takeable=True)).select("match_id")


@query(with_postings(f""", n AS (SELECT id, {SAID} AS names FROM postings), g AS (SELECT list_filter(names, lambda s: NOT list_contains({HAVE}, lower(s))) AS missing FROM matches JOIN n ON n.id = job_id)
  SELECT skill, count(*) AS jobs, CAST(sum(alone) AS BIGINT) AS closes FROM (SELECT unnest(missing) AS skill, CASE WHEN len(missing) = 1 THEN 1 ELSE 0 END AS alone FROM g) x GROUP BY skill"""))
def text_skills_to_learn(spark: SparkSession, d: str) -> DataFrame:
    """Skills that the texts of matched postings name and the profile lacks."""
    named = postings(spark, d).select(F.col("id").alias("job_id"), skills.named(F.col("description")).alias("names"))
    have = F.array(*map(F.lit, ("java", "SQL", "Docker", "python")))
    return ranking.skills_to_learn(matches(spark, d).join(named, "job_id").select(skills.gap(F.col("names"), have).alias("gap")).select("gap.missing"))


@query(SCORED + "SELECT match_id, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY CASE status WHEN 'saved' THEN 0 WHEN 'applied' THEN 1 ELSE 2 END, total DESC, match_id) AS INTEGER) AS place FROM scored WHERE status IN ('saved', 'applied', 'rejected')")
def tracker_order(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("status") == "saved", 0).when(F.col("status") == "applied", 1).otherwise(2)
    s = scored(spark, d).where(F.col("status").isin("saved", "applied", "rejected"))
    return s.select("match_id", F.row_number().over(Window.partitionBy("resume_id").orderBy(rank, F.desc("total"), "match_id")).alias("place"))


RANKED = with_postings(""", ranked AS (SELECT resume_id AS grp, match_id % 3 AS label, row_number() OVER (PARTITION BY resume_id ORDER BY total DESC NULLS LAST, match_id) AS rank FROM matches) """)


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("resume_id").orderBy(F.desc_nulls_last("total"), "match_id")
    return matches(spark, d).select(F.col("resume_id").alias("grp"), (F.col("match_id") % 3).alias("label"), F.row_number().over(w).alias("rank"))


@query(RANKED + """, i AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY label DESC, rank) AS ideal FROM ranked),
  n AS (SELECT grp, sum(CASE WHEN rank <= 10 THEN (pow(2, label) - 1) / log2(rank + 1) ELSE 0 END) AS got, sum(CASE WHEN ideal <= 10 THEN (pow(2, label) - 1) / log2(ideal + 1) ELSE 0 END) AS best FROM i GROUP BY grp)
  SELECT r.grp, count(*) AS n, round(coalesce(avg(CASE WHEN rank <= 5 THEN CASE WHEN label >= 1 THEN 1.0 ELSE 0.0 END END), 0), 6) AS p5, round(max(CASE WHEN best > 0 THEN got / best ELSE 0 END), 6) AS ndcg10 FROM ranked r JOIN n ON n.grp = r.grp GROUP BY r.grp""")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(spark, d)
    n = ranking.ndcg(r, "grp")
    return r.groupBy("grp").agg(F.count("*").alias("n"), F.round(ranking.precision_at(5), 6).alias("p5")).join(n, "grp").select("grp", "n", "p5", F.round("ndcg", 6).alias("ndcg10"))


def _mixed(name: str, weights: dict | None) -> str:
    if weights is None:
        return f"({TOTAL.replace('exp', 'experience').replace('fresh)', 'freshness)')})"
    return "(" + " + ".join(f"{p} * {w / sum(weights.values())!r}" for p, w in weights.items()) + ")"


PLACED = "CASE match_id % 7 WHEN 0 THEN 100.0 WHEN 1 THEN 0.0 WHEN 2 THEN NULL ELSE 70.0 END"
MIXED = " UNION ALL ".join(
    f"SELECT '{name}' AS mix, {placed} AS placed, match_id, label, {'greatest(0.0, least(100.0, ' if weights is None else '('}{_mixed(name, weights)} * {f'coalesce(0.4 + 0.6 * ({PLACED}) / 100, 1.0)' if placed == 'true' else '1.0'}{'))' if weights is None else ')'} AS total FROM known"
    for placed in ("true", "false")
    for name, weights in evaluation.MIXES.items()
)


@query(with_postings(f""", known AS (SELECT m.*, CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 OR toxic = 0 THEN 1 ELSE 0 END AS label FROM matches m JOIN labels ON doc_id = match_id), each AS ({MIXED}),
  r AS (SELECT *, row_number() OVER (PARTITION BY mix, placed ORDER BY round(total, 9) DESC, match_id) AS rank, row_number() OVER (PARTITION BY mix, placed ORDER BY label DESC) AS ideal FROM each),
  d AS (SELECT mix, placed, count(*) AS n, count(*) FILTER (WHERE label = 2) AS good, count(*) FILTER (WHERE label = 1) AS partial, avg(CASE WHEN label >= 1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE rank <= 5) AS p_at_5,
    avg(CASE WHEN label >= 2 THEN 1.0 ELSE 0.0 END) FILTER (WHERE rank <= 5) AS p_at_5_good, avg(CASE WHEN label >= 1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE rank <= 10) AS p_at_10,
    sum((pow(2, label) - 1) / log2(rank + 1)) FILTER (WHERE rank <= 10) AS got, sum((pow(2, label) - 1) / log2(ideal + 1)) FILTER (WHERE ideal <= 10) AS best FROM r GROUP BY mix, placed)
  SELECT mix, placed, n, good, partial, p_at_5, p_at_5_good, p_at_10, round(CASE WHEN best > 0 THEN got / best ELSE 0 END, 6) AS ndcg_at_10 FROM d"""))
def evaluation_grid(spark: SparkSession, d: str) -> DataFrame:
    """All mixes with and without the place, over matches whose number a label has."""
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).when((F.col("quality") == 1) | (F.col("toxic") == 0), 1).otherwise(0)
    known = matches(spark, d).join(table(spark, d, "labels").select(F.col("doc_id").alias("match_id"), label.alias("label")), "match_id")
    n = F.col("match_id") % 7
    known = known.withColumn("location_score", F.when(n == 0, 100.0).when(n == 1, 0.0).when(n == 2, None).otherwise(70.0)).withColumnRenamed("match_id", "id")
    return evaluation.grid(known).withColumn("ndcg_at_10", F.round("ndcg_at_10", 6))


@query("""WITH i AS (SELECT o_custkey AS person, year(o_orderdate) * 12 + month(o_orderdate) AS s, year(o_orderdate) * 12 + month(o_orderdate) + o_orderkey % 9 AS e FROM orders),
  m AS (SELECT *, max(e) OVER (PARTITION BY person ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i)
  SELECT person, round(least(sum(CASE WHEN before IS NULL OR s > before THEN e - s + 1 ELSE greatest(e - before, 0) END) / 12.0, 50.0), 1) AS held FROM m GROUP BY person""")
def held_years(spark: SparkSession, d: str) -> DataFrame:
    start = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    i = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), F.struct(start.alias("start"), (start + F.col("o_orderkey") % 9).alias("end")).alias("i"))
    g = i.groupBy("person").agg(F.collect_list("i").alias("all"))  # a person's entries
    return g.select("person", years.held_years(F.col("all"), F.array().cast("array<double>")).alias("held"))


@query("""WITH c AS (SELECT event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)
  SELECT event_id, CAST(max(t - 1500000 * i) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) + 1500000 * i - t AS BIGINT) AS wait FROM c""")
def limiter_waits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return sequence.limiter_slots(e, "event_type", "t", 1_500_000).select("event_id", "wait")


@query("SELECT label AS job, round(avg(best), 6) AS similarity FROM (SELECT a.label, a.vec_id, max(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))) AS best FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) b GROUP BY a.label, a.vec_id) x GROUP BY label")
def chunk_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.best_chunk_mean(e.select(F.col("label").alias("job"), "embedding"), e.where("vec_id % 100 = 0").select("embedding")).select("job", F.round("similarity", 6).alias("similarity"))


TOKENS = "list_filter(regexp_extract_all(lower(text), '[a-z](?:[a-z0-9+#./-]*[a-z0-9+#])?'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in sorted(vectors.STOP)) + "))"


@query(f"""WITH d AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1, text FROM benchmark WHERE item_id = 0), t AS (SELECT id, unnest({TOKENS}) AS term FROM d), tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY id, term),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), w AS (SELECT id, tf.term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM d)) / (1.0 + df)) + 1) AS raw FROM tf JOIN df ON df.term = tf.term),
  l AS (SELECT id, sqrt(sum(raw * raw)) AS len FROM w GROUP BY id), p AS (SELECT term, raw / len AS pw FROM w JOIN l ON l.id = w.id WHERE w.id = -1),
  c AS (SELECT w.id, sum(raw / len * pw) AS cosine FROM w JOIN l ON l.id = w.id JOIN p ON p.term = w.term WHERE w.id <> -1 GROUP BY w.id)
  SELECT doc_id AS id, round(coalesce(cosine, 0.0), 6) AS cosine, round(100 * (1 - exp(-6 * coalesce(cosine, 0.0))), 4) AS keywords FROM documents LEFT JOIN c ON c.id = doc_id""")
def keyword_cosines(spark: SparkSession, d: str) -> DataFrame:
    profile = table(spark, d, "benchmark").where("item_id = 0").select("text")
    c = vectors.cosines(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", profile, vectors.tokens)
    return c.select("id", F.round("cosine", 6).alias("cosine"), F.round(scoring.calibrate(F.col("cosine")), 4).alias("keywords"))


@query()
def keyword_pair_cosines(spark: SparkSession, d: str) -> DataFrame:
    """keyword_cosines over words and neighbouring pairs, as the reference weighs them. It has no SQL; a test holds it against brute force."""
    profile = table(spark, d, "benchmark").where("item_id = 0").select("text")
    c = vectors.cosines(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", profile, lambda t: vectors.grams(vectors.tokens(t)))
    return c.select("id", F.round("cosine", 6).alias("cosine"), F.round(scoring.calibrate(F.col("cosine")), 4).alias("keywords"))


@query(f"""WITH t AS (SELECT doc_id AS id, unnest({TOKENS}) AS term FROM documents), tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  n AS (SELECT count(*) AS n FROM documents), w AS (SELECT id, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1.0 + df)) + 1) AS raw FROM tf JOIN df ON df.term = tf.term, n), l AS (SELECT id, sqrt(sum(raw * raw)) AS len FROM w GROUP BY id),
  pt AS (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark), pf AS (SELECT item_id, term, count(*) AS tf FROM pt GROUP BY item_id, term), pw AS (SELECT item_id, pf.term, (1 + ln(tf)) * (ln((1 + n) / (1.0 + df)) + 1) AS raw FROM pf JOIN df ON df.term = pf.term, n),
  pl AS (SELECT item_id, sqrt(sum(raw * raw)) AS len FROM pw GROUP BY item_id), c AS (SELECT pw.item_id AS profile, w.id, sum(w.raw / l.len * pw.raw / pl.len) AS cosine FROM pw JOIN pl ON pl.item_id = pw.item_id JOIN w ON w.term = pw.term JOIN l ON l.id = w.id GROUP BY pw.item_id, w.id),
  r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY round(cosine, 9) DESC, id) AS place FROM c) SELECT profile, CAST(place AS INTEGER) AS place, id, round(cosine, 6) AS cosine FROM r WHERE place <= 20""")
def nearest_documents(spark: SparkSession, d: str) -> DataFrame:
    """The top-20 report of documents for each item of benchmark as a profile."""
    docs, profiles = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text")
    return nearest.top_documents(spread(docs), "doc_id", profiles, "item_id", vectors.tokens, 20).select("profile", "place", "id", F.round("cosine", 6).alias("cosine"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) x GROUP BY term")
def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    t = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(vectors.tokens(F.col("text"))).alias("term"))
    return t.groupBy("term", "doc_id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


@query(f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term, generate_subscripts({TOKENS}, 1) AS pos FROM documents), g AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM t GROUP BY doc_id, term)
  SELECT doc_id, string_agg(term, ',' ORDER BY n DESC, first) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rk FROM g) x WHERE rk <= 20 GROUP BY doc_id""")
def top_keywords(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    words = F.transform(vectors.tokens(F.col("text")), lambda w, i: F.struct(w.alias("term"), i.alias("pos")))
    best = vectors.most_frequent(F.col("terms"), 20)  # the report has 20 a document
    line = vectors.bound(best, lambda b: F.when(F.size(b) > 0, F.array(F.array_join(F.transform(b, lambda x: x["term"]), ","))))
    return vectors.of_one_id(docs, "doc_id", words).select("doc_id", F.explode(line).alias("keywords"))


@query("SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(ceil((n - 256) / 224.0), 0) + 1 END AS INTEGER) AS windows FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS n FROM documents) x")
def word_windows(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.size(text.word_windows(F.col("text"))).alias("windows"))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)>', '<>', 'g'), '(?i)<br\s*/?>', concat('<>', chr(10), '<>'), 'g'), '(?s)(?:<[^>]*>)+', chr(10), 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\x{00A0}]+', ' ', 'g'), '\n\s*\n+', concat(chr(10), chr(10)), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM pages""")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages").select("page_id", "html")).select("page_id", F.md5(text.strip_html(F.col("html")).cast("binary")).alias("text_md5"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, 'AIza[0-9A-Za-z_\-]{20,}', '[REDACTED]', 'g'), '(?i)(bearer\s+)[A-Za-z0-9._\-]+', '\1[REDACTED]', 'g'), '(?i)\b((?:api[_-]?key|key|token|secret|password|authorization)\s*[=:]\s*)[^\s&,;"'']+', '\1[REDACTED]', 'g') AS text FROM conversations""")
def redacted_turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.redacted(F.col("text")).alias("text"))


@query(rf"SELECT conv_id, turn, concat('{text.NOTICE}', chr(10), '<<<BEGIN UNTRUSTED ', upper(role), '>>>', chr(10), regexp_replace(regexp_replace(left(text, 20000), '(?i)<{{3,}}|>{{3,}}|\b(?:BEGIN|END)[\s_-]*UNTRUSTED\b', '[removed]', 'g'), '(?i)<\|[^|<>\n]{{0,40}}\|>|\[/?(?:INST|SYSTEM_PROMPT|AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS)\]|<</?SYS>>|</?s>|</?(?:start|end)_of_turn>', '[removed]', 'g'), chr(10), '<<<END UNTRUSTED ', upper(role), '>>>') AS text FROM conversations")
def fenced_turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.fenced(F.col("role"), F.col("text")).alias("text"))


@query(r"SELECT doc_id, CASE WHEN length(f) <= 240 THEN f ELSE concat(regexp_replace(left(f, 240), '\s\S*$', ''), '...') END AS snippet FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[*_#`]+', '', 'g'), '\s+', ' ', 'g')) AS f FROM documents) x")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query(r"SELECT page_id, regexp_matches(url, '^https?://([a-z0-9-]+\.)*example\.(com|org)(/|$|\?|#)') AS allowed FROM pages")
def allowed_urls(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.urls import allowed

    return table(spark, d, "pages").select("page_id", allowed(F.col("url"), ("example.com", "example.org")).alias("allowed"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents), h AS (SELECT doc_id, no, CASE WHEN length(line) BETWEEN 1 AND 30 THEN line END AS heading FROM l) SELECT doc_id, CAST(no - 1 AS INTEGER) AS no, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS heading FROM h")
def section_headings(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    lines = lines.select("doc_id", "no", F.when(F.length("line").between(1, 30), F.col("line")).alias("heading"))
    return sequence.carried_forward(lines, "doc_id", "no", "heading")


@query(with_postings("SELECT id, CASE WHEN description LIKE '%java and kafka%' THEN 'Java,Kafka' WHEN description LIKE '%python and sql%' THEN 'Python,SQL' WHEN description LIKE '%sql and excel%' THEN 'SQL' ELSE 'Kubernetes,Docker,Java' END AS named FROM postings"))
def named_skills(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("id", F.array_join(skills.named(F.col("description")), ",").alias("named"))


@query(with_postings("SELECT id, CASE WHEN EXISTS (SELECT 1 FROM part q WHERE q.p_size % 2 = 0 AND q.p_name = p.p_name AND q.p_type = p.p_type) THEN concat(p.p_name, ' ', p.p_type) ELSE p.p_name END AS phrase, p.p_type AS kind FROM postings JOIN part p ON p.p_partkey = id"))
def phrase_mentions(spark: SparkSession, d: str) -> DataFrame:
    """What a posting mentions of the parts' names, in any case, and types, in their own; names with their types, which some parts give as phrases too, are longer and go before names."""
    part = table(spark, d, "part")
    whole = F.when(F.col("p_size") % 2 == 0, F.struct(F.concat_ws(" ", "p_name", "p_type").alias("alias"), F.lit(False).alias("exact")))
    said = part.select(F.explode(F.array_compact(F.array(F.struct(F.col("p_type").alias("alias"), F.lit(True).alias("exact")), F.struct(F.col("p_name").alias("alias"), F.lit(False).alias("exact")), whole))).alias("x")).select("x.alias", "x.exact").distinct()
    rows = numbered(postings(spark, d).select("id", F.upper("description").alias("text")))
    last = lambda exact: F.max_by(F.when(F.col("exact") == exact, F.col("name")), F.when(F.col("exact") == exact, F.col("start")))
    found = phrases.mentions(rows, said.withColumn("name", F.col("alias"))).groupBy("row").agg(last(False).alias("phrase"), last(True).alias("kind"))
    return rows.join(found, "row", "left").select("id", "phrase", "kind")


def _profile(spark: SparkSession, d: str) -> matching.Profile:
    """The profile of the scoring queries: the text of the posting of the least id, as if someone had copied it."""
    first = postings(spark, d).orderBy("id").select("title", "description").first()
    return matching.Profile("" if first is None else f"{first['title']}. {first['description']}", ("Docker",), 5.0, "Germany", ("Berlin",))


@query()
def scored_postings(spark: SparkSession, d: str) -> DataFrame:
    """Every posting scored from its text: skills, keywords, similarity, years, date and place. It has no SQL; a test holds it against plain Python on a small table."""
    s = matching.score_postings(spread(postings(spark, d)), _profile(spark, d), now())
    return s.select("id", "scores.total", "scores.band", "scores.ats", "scores.semantic", "scores.experience", "scores.freshness", "scores.location_status", "scores.required_years", F.array_join("scores.missing_title_skills", ",").alias("missing_title_skills"))


FILLER = ", ".join(f"'{w}'" for w in sorted(matching.FILLER))


@query(with_postings(f""", base AS (SELECT id, description AS text, {SAID} AS names FROM postings),
  me AS (SELECT concat(title, '. ', description, chr(10), 'Additional skills: Docker') AS text, list_concat({SAID}, ['Docker'], CASE WHEN title LIKE '%Java%' THEN ['Java'] WHEN title LIKE '%Python%' THEN ['Python'] ELSE [] END) AS have FROM postings ORDER BY id LIMIT 1),
  w AS (SELECT id, {TOKENS} AS w FROM base), mw AS (SELECT {TOKENS} AS w FROM me),
  g AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: concat(w[k], ' ', w[k + 1])))) AS term FROM w), own AS (SELECT DISTINCT unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: concat(w[k], ' ', w[k + 1])))) AS term FROM mw),
  tf AS (SELECT id, term, count(*) AS n, string_split(term, ' ') AS words FROM g GROUP BY id, term),
  r AS (SELECT tf.id, tf.term, tf.words, own.term IS NOT NULL AS held, row_number() OVER (PARTITION BY tf.id ORDER BY round((1 + ln(n)) * (ln(3.0 / (CASE WHEN own.term IS NULL THEN 2 ELSE 3 END)) + 1), 9) DESC, tf.term) AS k
    FROM tf LEFT JOIN own ON own.term = tf.term WHERE len(list_filter(words, lambda x: length(x) < 3 OR x IN ({FILLER}) OR x IN ('java', 'kafka', 'python', 'sql', 'kubernetes', 'docker'))) = 0),
  s AS (SELECT id, list_filter(names, lambda x: list_contains(have, x)) AS matched, list_filter(names, lambda x: NOT list_contains(have, x)) AS missing, list_transform(names, lambda x: lower(x)) AS seen FROM base, me),
  f AS (SELECT id, 0 AS k, matched, missing, seen AS seen_matched, seen AS seen_missing FROM s
    UNION ALL SELECT f.id, f.k + 1, CASE WHEN takes AND held THEN list_append(matched, term) ELSE matched END, CASE WHEN takes AND NOT held THEN list_append(missing, term) ELSE missing END,
      CASE WHEN takes AND held THEN list_concat(seen_matched, words) ELSE seen_matched END, CASE WHEN takes AND NOT held THEN list_concat(seen_missing, words) ELSE seen_missing END
    FROM (SELECT f.*, r.term, r.held, r.words, len(f.matched) + len(f.missing) < 15 AND len(list_filter(r.words, lambda x: NOT list_contains(CASE WHEN r.held THEN f.seen_matched ELSE f.seen_missing END, x))) > 0 AS takes FROM f JOIN r ON r.id = f.id AND r.k = f.k + 1) f)
  SELECT id, array_to_string(arg_max(matched, k), ',') AS matched, array_to_string(arg_max(missing, k), ',') AS missing FROM f GROUP BY id""").replace("WITH", "WITH RECURSIVE", 1))
def keyword_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What each posting asks for, skills first and then its heaviest words and pairs, held by the profile or not."""
    p = postings(spark, d).withColumn("text", F.col("description"))
    g = matching.keyword_gap(p, _profile(spark, d))
    return g.select("id", F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"))
