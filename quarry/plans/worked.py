"""Queries of rules over worded cases dealt to the rows of the tables. Their SQL lists what each case must give and knows nothing of the patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, location, skills, text, years
from ..operators import drafts
from ..session import spread, table
from ..sources.urls import allowed
from .postings import postings, with_postings
from .queries import query


def dealt(values: list, id_: str) -> Column:
    """The case of a row, by its id."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(id_) % len(values) + 1).cast("int"))


def sql_dealt(values: list, id_: str, kind: str) -> str:
    """The same in SQL."""
    shown = ("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values)
    return f"list_extract(CAST([{', '.join(shown)}] AS {kind}[]), CAST({id_} % {len(values)} + 1 AS INTEGER))"


ASKED = [("Requires 3+ years of experience in Scala", 3), ("2-4 years experience", 2), ("at least 5 years in data work", 5), ("minimum of 7 yrs", 7), ("5 yrs exp with clouds", 5), ("Founded 10 years ago. 4+ years experience needed", 4), ("No experience needed", None)]
STATED = [("3+ years of Scala", 3), ("2-4 yrs experience", 2), ("five years of experience in Go", 5), ("company founded 30 years ago", None), ("Need 2+ years of Java and 6+ years overall experience", 6), ("The firm: 18+ yrs strong and owned by its staff. You: 5+ yr senior dev.", 5), ("Nothing to tell", None)]
IMPLIED = [("Senior Software Engineer", 5), ("Sr. Backend Developer", 5), ("Lead Web Engineer", 7), ("Staff Engineer", 7), ("Principal Engineer", 10), ("Senior Principal Data Engineer", 10), ("Junior Web Engineer", 0), ("Software Engineering Intern", 0), ("Associate Engineer", 1), ("Werkstudent Backend", 0), ("Leadership Coach", None), ("Engineer", None), ("Freshers hiring", 0)]
BEGINNERS = [("Open to recent undergraduates", 0), ("No prior experience needed", 0), ("New grads welcome", 0), ("We hire students still in college", 0), ("Seniority level: mid size firm", None), ("About us\nLevel: Mid Level, Senior Level", 3), ("Level: management", 8), ("The entry level of a tower", None), ("Nothing told", None)]
NEEDED = [
    ("Requirements\nJava and Kafka. Docker is a plus.", "Java,Kafka", "Docker"), ("What you'll bring\nPython\nNice-to-have:\nDocker\nSkills\nSQL", "Python,SQL", "Docker"), ("Java is needed; ideally Kafka too.", "Java", "Kafka"),
    ("Kafka would be a huge plus", "", ""), ("Kafka would be a huge plus.", "", "Kafka"), ("Docker desirable. Java required.", "Java", "Docker"), ("Python. Good to have\nPython, Kafka", "", "Python,Kafka"), ("We surplus SQL", "SQL", ""), ("Kafka is not required but Java is.", "", "Kafka,Java"),
]
CLAIMED = [
    ("I bring 4 years of Java to you both.", ""), ("I bring 4 years of Java.", "Claims 4 years, but your resume shows about 1.0 years."), ("We cut costs by 45% last year.", "The figure 45% is not on your resume."), ("We grew by 30 % again.", ""),
    ("I worked at Infosys on payments.", 'Names "Infosys" as an employer, but it is not on your resume.'), ("I interned with Acme Cars I think.", ""), ("I hold an MBA from there.", "Mentions a MBA, which your resume does not list."),
    ("My decade of work shows.", 'Says "decade", but your resume shows about 1.0 years of experience.'), ("I used Kafka and Java.", "Claims experience with Kafka, which your resume does not mention."), ("They used Kafka and Java.", ""),
]
PLACES = [
    ("Bengaluru", "", "hn", "local"), ("Remote(Everywhere)", "", "hn", "remote_open"), ("REMOTE", "Firm | Head | REMOTE | We hire anywhere in the world.", "hn", "remote_open"), ("Northern America, LATAM, Europe, APAC", "A remote job.", "hn", "remote_open"),
    ("", "We build tools.", "remoteok", "remote"), ("REMOTE (US)", "", "hn", "restricted"), ("REMOTE (US time zones)", "", "hn", "restricted"), ("REMOTE", "Firm | REMOTE | Must reside in the US.", "hn", "restricted"), ("Fully REMOTE (Poland or Romanian residents only)", "", "hn", "restricted"),
    ("REMOTE (AMER or EMEA time zones)", "", "hn", "restricted"), ("Ireland", "Build the web app.", "remoteok", "restricted"), ("New York, NY", "", "hn", "elsewhere"), ("HYBRID", "Firm | Engineer | Toronto, Canada | HYBRID", "hn", "elsewhere"),
    ("Berlin", "Requirements: good German and English.", "hn", "restricted"), ("REMOTE", "Firm | REMOTE | Join us and help us grow.", "hn", "remote"), ("", "We build tools.", "hn", "unknown"), ("Remote (EU)", "Must be based in the EU.", "hn", "restricted"),
]
NAMED = [("Expert in C++ and C# and Node.js", "C++,C#,Node.js"), ("We go to the office in spring", ""), ("kafka, then Java, then Kafka", "Kafka,Java"), ("spring\n boot and Go, .NET", "Spring Boot,Go,.NET"), ("", "")]
SECRETS = [("token=abc123 bearer xyz.1", "token=[REDACTED] bearer [REDACTED]"), ("key=abc, authorization: xyz", "key=[REDACTED], authorization: [REDACTED]"), ("monkey=1 api-key = q", "monkey=1 api-key = [REDACTED]"), ("PASSWORD: hunter2; then", "PASSWORD: [REDACTED]; then"), ("no keys here", "no keys here")]
HOSTS = [("https://jobs.example.com:8443/", True), ("https://example.com./", True), ("https://EXAMPLE.org/", True), ("https://notexample.com/", False), ("https://example.com.evil.net/", False), ("ftp://example.com/", False), ("https://example.com:99999/", False)]


def of(cases: list, k: int = 0) -> list:
    return [c[k] for c in cases]


@query(with_postings(f"SELECT id, CAST({sql_dealt(of(ASKED, 1), 'id', 'INTEGER')} AS DOUBLE) AS asked, {sql_dealt(of(STATED, 1), 'id', 'INTEGER')} AS stated, {sql_dealt(of(IMPLIED, 1), 'id', 'INTEGER')} AS implied, {sql_dealt(of(BEGINNERS, 1), 'id', 'INTEGER')} AS begun FROM postings"))
def worded_years(spark: SparkSession, d: str) -> DataFrame:
    worded = lambda cases: F.concat_ws("\n", dealt(of(cases), "id"), "tags")
    title = F.concat_ws(", ", dealt(of(IMPLIED), "id"), "company")
    return postings(spark, d).select("id", years.required_years(worded(ASKED)).cast("double").alias("asked"), years.stated_years(worded(STATED)).alias("stated"), years.seniority_years(title, F.col("tags")).alias("implied"), years.seniority_years(F.lit("Coder"), worded(BEGINNERS)).alias("begun"))


@query(with_postings(f"SELECT id, {sql_dealt(of(PLACES, 3), 'id', 'VARCHAR')} AS place FROM postings"))
def worded_places(spark: SparkSession, d: str) -> DataFrame:
    p = spread(postings(spark, d)).select("id", F.concat_ws(" ", dealt(of(PLACES, 1), "id"), "tags").alias("body"), *(dealt(of(PLACES, k), "id").alias(n) for k, n in ((0, "at"), (2, "from"))))
    return p.select("id", location.fit(F.lit("Engineer"), F.col("at"), F.col("body"), F.col("from"), "India")["status"].alias("place"))


@query(with_postings(f"SELECT id, {sql_dealt(of(NAMED, 1), 'id', 'VARCHAR')} AS named FROM postings"))
def worded_skills(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("id", F.array_join(skills.named(F.concat_ws("\n", dealt(of(NAMED), "id"), "location")), ",").alias("named"))


@query(with_postings(f"SELECT id, {sql_dealt(of(NEEDED, 1), 'id', 'VARCHAR')} AS must, {sql_dealt(of(NEEDED, 2), 'id', 'VARCHAR')} AS nice FROM postings"))
def worded_requirements(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d).select("id", F.concat_ws("\n", dealt(of(NEEDED), "id"), F.concat("location", F.lit("."))).alias("description"))
    return drafts.requirements(p).select("id", F.array_join("must", ",").alias("must"), F.array_join("nice", ",").alias("nice"))


@query(with_postings(f"SELECT id, {sql_dealt(of(CLAIMED, 1), 'id', 'VARCHAR')} AS why FROM postings"))
def worded_claims(spark: SparkSession, d: str) -> DataFrame:
    """Drafts of one sentence and a company's name, against one résumé."""
    p = postings(spark, d).select("id", F.concat_ws("\n", dealt(of(CLAIMED), "id"), "company").alias("draft"), F.lit("Java at Acme Cars; cut errors by 30%").alias("resume"), F.array(F.lit("SQL")).alias("have"), F.lit(1.0).alias("years"))
    return p.select("id").join(drafts.flagged(p), "id", "left").select("id", F.coalesce("why", F.lit("")).alias("why"))


@query(f"SELECT conv_id, turn, concat('turn ', CAST(turn AS VARCHAR), ' of ', role, ': ', {sql_dealt(of(SECRETS, 1), 'conv_id', 'VARCHAR')}) AS text FROM conversations")
def worded_secrets(spark: SparkSession, d: str) -> DataFrame:
    told = F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(" of "), "role", F.lit(": "), dealt(of(SECRETS), "conv_id"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.redacted(told).alias("text"))


@query(f"SELECT page_id, {sql_dealt(of(HOSTS, 1), 'page_id', 'BOOLEAN')} AS allowed FROM pages")
def worded_urls(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(dealt(of(HOSTS), "page_id"), F.lit("p/"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", allowed(url, ("example.com", "example.org")).alias("allowed"))


@query(with_postings("""SELECT id, sha256(CASE WHEN id % 3 = 0 THEN concat('url:', trim(url)) ELSE concat('tcl:', lower(trim(title)), '|', lower(trim(company)), '|', lower(trim(location))) END) AS storage_key FROM postings"""))
def keys_without_urls(spark: SparkSession, d: str) -> DataFrame:
    """Two of three postings have no URL: one blank, one null."""
    p = postings(spark, d).withColumn("url", F.when(F.col("id") % 3 == 0, F.col("url")).when(F.col("id") % 3 == 1, F.lit("  ")))
    return p.select("id", keys.storage_key(F.col("url"), F.col("title"), F.col("company"), F.col("location")).alias("storage_key"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS words FROM documents), n AS (SELECT *, unnest(range(0, CAST(greatest(ceil((len(words) - 256) / 224.0), 0) + 1 AS INTEGER))) AS no FROM w WHERE len(words) > 0)
  SELECT doc_id, CAST(no AS INTEGER) AS no, md5(array_to_string(list_slice(words, 224 * no + 1, 224 * no + 256), ' ')) AS window_md5 FROM n""")
def window_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(text.word_windows(F.col("text"))).alias("no", "w")).select("doc_id", "no", F.md5(F.col("w").cast("binary")).alias("window_md5"))
