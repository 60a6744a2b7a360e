"""Readers of job-board payloads, each from JSON files that an ingestion agent has landed to one posting schema.

A reader keeps no row limit of its own; choosing and capping are separate operators. Files that can't be read give no rows, and rows without URL and title are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, years
from ..operators.sequence import interleaved
from .urls import canonical_job_view

POSTING = "title string, company string, location string, description string, source string, url string, posted timestamp, experience_years int"
# Fixed values.
UNTITLED, UNKNOWN_COMPANY, LONGEST_URL, SHOWN_PLACES = "Untitled role", "Unknown company", 2000, 4
MILLIS = 1e12


def first_of(*columns: Column) -> Column:
    return F.coalesce(*(text.blank_to_null(c.cast("string")) for c in columns))


def posted_date(c: Column, now: Column) -> Column:
    """ISO dates and times, seconds or milliseconds since 1970, `yesterday`, `3 days ago` and the like; null for anything else."""
    low = F.lower(F.trim(c.cast("string")))
    number = low.try_cast("double")
    epoch = F.when(number.isNotNull() & (number > 0), F.timestamp_micros((F.when(number > MILLIS, number / 1000).otherwise(number) * 1e6).cast("long")))
    n = F.coalesce(F.nullif(F.regexp_extract(low, r"(\d+)\+?\s*(?:minute|hour|day|week|month)", 1), F.lit("")).try_cast("int"), F.lit(1))
    hours = F.when(low.rlike(r"minute"), 0).when(low.rlike(r"hour"), n).when(low.rlike(r"\bday"), n * 24).when(low.rlike(r"week"), n * 168).when(low.rlike(r"month"), n * 720)
    ago = F.when(low.rlike(r"\bago\b|\d\+"), now - F.make_dt_interval(F.lit(0), hours.cast("int")))
    today = F.when(low.isin("today", "just now", "just posted"), now).when(low == "yesterday", now - F.make_dt_interval(F.lit(1)))
    shapes = [F.try_to_timestamp(low, F.lit(f)) for f in ("MMM d, yyyy", "d MMM yyyy", "MM/dd/yyyy", "dd.MM.yyyy")]
    return F.coalesce(F.upper(low).try_cast("timestamp"), epoch, today, ago, *shapes)


def normalized(raw: DataFrame, source: str, now: Column) -> DataFrame:
    """Columns title, company, location, description, url, posted and years (all strings) to the posting schema."""
    title, body = text.one_line(F.col("title")), F.left(text.strip_html(F.coalesce("description", F.lit(""))), F.lit(text.MOST_TEXT))
    url = F.trim(F.coalesce("url", F.lit("")))
    out = raw.select(
        F.coalesce(F.nullif(title, F.lit("")), F.lit(UNTITLED)).alias("title"),
        F.coalesce(F.nullif(text.one_line(F.col("company")), F.lit("")), F.lit(UNKNOWN_COMPANY)).alias("company"),
        text.one_line(F.col("location")).alias("location"),
        body.alias("description"),
        F.lit(source[:64]).alias("source"),
        F.when(url.rlike(r"^https?://") & (F.length(url) <= LONGEST_URL), url).otherwise("").alias("url"),
        posted_date(F.col("posted"), now).alias("posted"),
        F.coalesce(F.col("years").try_cast("int"), years.stated_years(F.concat_ws("\n", title, body))).alias("experience_years"),
        title.alias("_title"),
    )
    return out.where("url <> '' OR _title <> ''").drop("_title")


def _fields(df: DataFrame, **columns: Column) -> DataFrame:
    names = ("title", "company", "location", "description", "url", "posted", "years")
    return df.select(*(columns.get(n, F.lit(None)).cast("string").alias(n) for n in names))


def with_lines(body: Column, **extra: Column) -> Column:
    """A description with further `Name: value` lines for values that aren't empty."""
    return F.concat_ws("\n", body, *(F.when(F.length(v) > 0, F.concat(F.lit(f"{k}: "), v)) for k, v in extra.items()))


def shown(places: Column) -> Column:
    """At most four places, and dots for more."""
    return F.concat(F.array_join(F.slice(places, 1, SHOWN_PLACES), ", "), F.when(F.size(places) > SHOWN_PLACES, ", ...").otherwise(""))


def _landed(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """The records of JSON files. Files that can't be read or parsed give none; `broken` lists them."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).json(path)


def remoteok(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """A JSON array whose first element is a legal notice."""
    schema = "legal string, position string, company string, location string, description string, tags array<string>, url string, apply_url string, epoch string, date string, salary_min long, salary_max long"
    rows = _landed(spark, schema, path).where("legal IS NULL")
    salary = F.when(F.col("salary_min") > 0, F.concat(F.lit("$"), F.format_number("salary_min", 0), F.lit(" - $"), F.format_number("salary_max", 0)))
    body = with_lines(F.col("description"), Tags=F.array_join("tags", ", "), Salary=salary)
    place = F.coalesce(text.blank_to_null(F.col("location")), F.lit("Remote"))
    return normalized(_fields(rows, title=F.col("position"), company=F.col("company"), location=place, description=body, url=first_of(F.col("url"), F.col("apply_url")), posted=first_of(F.col("epoch"), F.col("date"))), "remoteok", now)


def muse(spark: SparkSession, path: str, now: Column, wanted: tuple[str, ...] = ()) -> DataFrame:
    """Postings of the payload; with `wanted` only those that list one of these places by its exact name."""
    name = "array<struct<name:string>>"
    schema = f"results array<struct<name:string,contents:string,publication_date:string,locations:{name},levels:{name},refs:struct<landing_page:string>,company:struct<name:string>>>"
    r = _landed(spark, schema, path).select(F.inline("results"))
    if wanted:
        r = r.where(F.arrays_overlap("locations.name", F.array(*map(F.lit, wanted))))
    places = F.array_join(F.slice("locations.name", 1, SHOWN_PLACES), "; ")
    body = with_lines(F.col("contents"), Level=F.array_join("levels.name", ", "))
    return normalized(_fields(r, title=F.col("name"), company=F.col("company.name"), location=places, description=body, url=F.col("refs.landing_page"), posted=F.col("publication_date")), "muse", now)


def arbeitnow(spark: SparkSession, path: str, now: Column) -> DataFrame:
    schema = "data array<struct<title:string,company_name:string,description:string,remote:boolean,url:string,tags array<string>,location:string,created_at:long>>".replace("tags array", "tags:array")
    r = _landed(spark, schema, path).select(F.inline("data"))
    place = F.concat("location", F.when(F.col("remote"), " (Remote)").otherwise(""))
    url = F.regexp_replace("url", r"^https?://(?:www\.)?arbeitnow\.[a-z]+/", "https://www.arbeitnow.com/")
    return normalized(_fields(r, title=F.col("title"), company=F.col("company_name"), location=place, description=with_lines(F.col("description"), Tags=F.array_join("tags", ", ")), url=url, posted=F.col("created_at")), "arbeitnow", now)


def company_of(slug: Column) -> Column:
    return F.initcap(F.regexp_replace(slug, r"[-_]+", " "))


def greenhouse(spark: SparkSession, path: str, now: Column, board: str) -> DataFrame:
    schema = "jobs array<struct<title:string,company_name:string,absolute_url:string,location:struct<name:string>,first_published:string,updated_at:string,content:string>>"
    r = _landed(spark, schema, path).select(F.inline("jobs"))
    return normalized(_fields(r, title=F.col("title"), company=F.coalesce(text.blank_to_null(F.col("company_name")), company_of(F.lit(board))), location=F.col("location.name"), description=text.unescape(F.col("content")), url=F.col("absolute_url"), posted=first_of(F.col("first_published"), F.col("updated_at"))), "greenhouse", now)


def lever(spark: SparkSession, path: str, now: Column, board: str) -> DataFrame:
    schema = "text string, hostedUrl string, applyUrl string, createdAt long, workplaceType string, descriptionPlain string, additionalPlain string, categories struct<location:string,allLocations:array<string>>, lists array<struct<text:string,content:string>>"
    r = _landed(spark, schema, path)
    lists = F.array_join(F.transform("lists", lambda x: F.concat_ws("\n", x["text"], x["content"])), "\n")
    places = F.coalesce(F.nullif(F.array_join(F.slice("categories.allLocations", 1, SHOWN_PLACES), "; "), F.lit("")), F.col("categories.location"))
    place = F.concat(F.coalesce(places, F.lit("")), F.when(F.lower("workplaceType") == "remote", " (Remote)").otherwise(""))
    return normalized(_fields(r, title=F.col("text"), company=company_of(F.lit(board)), location=place, description=F.concat_ws("\n", "descriptionPlain", lists, "additionalPlain"), url=first_of(F.col("hostedUrl"), F.col("applyUrl")), posted=F.col("createdAt")), "lever", now)


def himalayas(spark: SparkSession, path: str, now: Column) -> DataFrame:
    schema = "jobs array<struct<title:string,companyName:string,locationRestrictions:array<string>,seniority:array<string>,description:string,pubDate:string,applicationLink:string,guid:string>>"
    r = _landed(spark, schema, path).select(F.inline("jobs"))
    places = F.col("locationRestrictions")
    place = F.concat(F.lit("Remote ("), F.when(F.coalesce(F.size(places), F.lit(0)) < 1, "worldwide").otherwise(shown(places)), F.lit(")"))
    body = with_lines(F.col("description"), Seniority=F.array_join("seniority", ", "))
    return normalized(_fields(r, title=F.col("title"), company=F.col("companyName"), location=place, description=body, url=first_of(F.col("applicationLink"), F.col("guid")), posted=F.col("pubDate")), "himalayas", now)


ROLE, SEEKER = r"(?i)\b(engineer|developer|scientist|designer|manager|analyst|architect|devops|sre|programmer|lead|researcher)\b", r"(?i)\b(seeking work|looking for (?:work|a job)|willing to relocate:|résumé/cv:|resume/cv:)"
PLACE, MONEY = r"(?i)\b(remote|onsite|on-site|hybrid|usa?|uk|eu|europe|germany|berlin|london|new york|nyc|san francisco|sf|bay area)\b", r"[$€£]\s?\d|\b\d+k\b"


def latest_hiring_story(spark: SparkSession, path: str) -> DataFrame:
    """id, title, created_at_i of the newest story whose title asks who is hiring; no row if there is none."""
    schema = "hits array<struct<objectID:string,story_id:long,title:string,created_at_i:long>>"
    r = _landed(spark, schema, path).select(F.inline("hits")).where(F.col("title").rlike(r"(?i)who\s+is\s+hiring"))
    r = r.select(F.coalesce("objectID", F.col("story_id").cast("string")).alias("id"), "title", "created_at_i")
    return r.agg(F.max_by(F.struct("*"), F.struct("created_at_i", "id")).alias("r")).where("r IS NOT NULL").select("r.*")


def hiring_comments(spark: SparkSession, path: str, now: Column, story: str | None = None) -> DataFrame:
    """Top-level comments of a hiring thread, whose first paragraph is `Company | Role | Location`. Job seekers and replies are left out."""
    schema = "hits array<struct<objectID:string,parent_id:long,story_id:long,comment_text:string,created_at_i:long>>"
    r = _landed(spark, schema, path).select(F.inline("hits")).where("comment_text IS NOT NULL")
    r = r.where(F.col("parent_id").cast("string") == story) if story else r.where("parent_id = story_id OR story_id IS NULL")
    clean = text.strip_html(text.unescape(F.col("comment_text")))
    header = text.one_line(text.strip_html(text.unescape(F.split("comment_text", "<p>")[0])), 400)
    r = r.withColumns({"body": clean, "header": header}).where(~F.left("body", F.lit(600)).rlike(SEEKER))
    parts = F.when(F.col("header").contains(" | "), F.split("header", r"\s*\|\s*")).otherwise(F.split("header", r"\s+[-–—]\s+"))
    rest = F.slice(parts, 2, 100)
    pick = lambda test: F.try_element_at(F.filter(rest, test), F.lit(1))
    link = lambda p: p.rlike(r"https?://|www\.")
    title = F.coalesce(pick(lambda p: p.rlike(ROLE) & ~link(p)), pick(lambda p: ~p.rlike(PLACE) & ~link(p) & ~p.rlike(MONEY) & (F.length(p) > 0)), F.lit("Software role"))
    place = F.coalesce(pick(lambda p: p.rlike(PLACE)), pick(lambda p: p.rlike(r"^[A-Z][A-Za-z .,]+$") & ~p.rlike(ROLE)), F.lit(""))
    url = F.coalesce(F.nullif(F.regexp_extract("body", r"(https?://[^\s<>\"')]+)", 1), F.lit("")), F.concat(F.lit("https://news.ycombinator.com/item?id="), "objectID"))
    return normalized(_fields(r, title=title, company=F.regexp_replace(parts[0], r"\s*\([^)]*\)$", ""), location=place, description=F.col("body"), url=url, posted=F.col("created_at_i")), "hn", now)


def pasted(frame: DataFrame, now: Column) -> DataFrame:
    """Postings that were pasted as text: typed fields (title, company, location, url) win over guesses from the first lines (`Company · Place · age`) of text."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n"), lambda x: F.trim(x)), lambda x: x != "")
    middle = F.try_element_at(F.filter(lines, lambda x: x.contains(" · ")), F.lit(1))
    dots = F.split(middle, r"\s+·\s+")
    body = F.coalesce(F.nullif(F.trim(F.regexp_extract("text", r"(?s)About the job\s*\n(.*)", 1)), F.lit("")), F.col("text"))
    guess = {"title": F.try_element_at(lines, F.lit(1)), "company": F.try_element_at(dots, F.lit(1)), "location": F.try_element_at(dots, F.lit(2))}
    fields = {k: F.coalesce(text.blank_to_null(F.col(k)), v) for k, v in guess.items()}
    return normalized(_fields(frame, **fields, description=body, url=F.col("url"), posted=F.try_element_at(dots, F.lit(3))), "manual", now)


def scraped(frame: DataFrame, site: str, now: Column) -> DataFrame:
    """Postings of a scraper's table (title, company, location, description, job_url, job_url_direct, date_posted), in which empty cells may be written as words."""
    value = lambda name: F.when(~F.col(name).cast("string").isin("NaN", "nan", "NaT", "None"), F.col(name).cast("string")) if name in frame.columns else F.lit(None)
    url = first_of(value("job_url"), value("job_url_direct"))
    url = canonical_job_view(url) if site == "linkedin" else url
    return normalized(_fields(frame, **{k: value(k) for k in ("title", "company", "location", "description")}, url=url, posted=value("date_posted")), site, now)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """url, label of a graded list."""
    return spark.read.schema("jobs array<struct<url:string,title:string,company:string,label:int,why:string>>").option("multiLine", True).json(path).select(F.inline("jobs")).select("url", "label")


READERS: dict[str, Callable] = {"remoteok": remoteok, "hn": hiring_comments, "muse": muse, "arbeitnow": arbeitnow, "greenhouse": greenhouse, "lever": lever, "himalayas": himalayas}


def broken(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """source, file, reason of each landed file that a source's reader gets nothing from, as its bytes aren't JSON. A source without files has one row without a file; a file without bytes holds nothing
    and isn't listed."""
    out = spark.createDataFrame([], "source string, file string, reason string")
    for source, path in paths.items():
        try:
            files = spark.read.format("binaryFile").load(path)
        except AnalysisException:  # no such path
            out = out.unionByName(spark.createDataFrame([(source, None, "no file")], out.schema))
            continue
        text = F.col("content").cast("string")
        reason = F.when(~F.coalesce(F.is_valid_utf8(text), F.lit(False)), "not text").when(F.try_parse_json(text).isNull(), "not JSON")
        out = out.unionByName(files.select(F.lit(source).alias("source"), F.element_at(F.split("path", "/"), -1).alias("file"), reason.alias("reason")).where("reason IS NOT NULL"))
    return out


def fan_out(spark: SparkSession, paths: dict[str, str], now: Column, cap: int | None = None, boards: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The postings of all sources (name of a reader -> path, which may be a pattern), in turns by source, and what failed (source, file, reason). A file or source that fails leaves all others whole.

    With a cap, the feature of a search session, each source gives at most so many postings, its newest, before turns are taken. `boards` names the company of sources that are one company's board."""
    failed, frames = broken(spark, paths), {}
    missing = {r["source"] for r in failed.where("file IS NULL").collect()}  # a row for each source at most
    for source, path in paths.items():
        if source not in missing:
            frames[source] = READERS[source](spark, path, now, *([boards[source]] if source in (boards or {}) else []))
    if not frames:
        return spark.createDataFrame([], "source string, turn int"), failed
    every = union_of(frames)
    newest = F.row_number().over(Window.partitionBy("source").orderBy(F.desc_nulls_last("posted"), "url", "title"))
    ranked = every.withColumn("place_", newest).where(F.col("place_") <= cap) if cap is not None else every.withColumn("place_", -F.coalesce(F.unix_micros("posted"), F.lit(0)))
    return interleaved(ranked, "source", "place_").drop("place_"), failed


def union_of(frames: dict[str, DataFrame]) -> DataFrame:
    """All sources in one table; what a source lacks is null."""
    out = None
    for frame in frames.values():
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out
