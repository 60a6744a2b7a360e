"""What screens read: names for keys, annotated matches, orders, summaries, what a posting asks for; and what is written out for keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import location, scoring, skills, text, years
from . import matching, vectors

# Names shown for keys, sources by kind, short words that count as keywords.
SOURCE_NAMES = {
    "remoteok": "RemoteOK", "hn": "Hacker News Who's Hiring", "themuse": "The Muse", "arbeitnow": "Arbeitnow", "himalayas": "Himalayas", "greenhouse": "Greenhouse company boards", "lever": "Lever company boards",
    "linkedin": "LinkedIn", "naukri": "Naukri", "manual": "Added by you",
}
STATUS_NAMES = {"new": "New", "saved": "Saved", "applied": "Applied", "rejected": "Rejected", "hidden": "Hidden"}
BAND_NAMES = {"strong": "Strong fit", "possible": "Worth a look", "weak": "Reach", "none": "Not scored"}
DEFAULT_SOURCES = ("remoteok", "hn", "themuse", "arbeitnow", "himalayas")
OPT_IN_SOURCES = ("linkedin", "naukri")
BOARD_SOURCES = ("greenhouse", "lever")
SHORT_KEYWORDS = ("c", "r", "go", "c#", "ai", "ml", "ui", "ux", "qa")
#: Fixed pattern: a letter, then letters, digits, + and #; parts after full stops belong to it.
KEYWORD = r"[A-Za-z][A-Za-z0-9+#]*(?:\.[A-Za-z0-9]+)*"


def _named(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.coalesce(key, F.lit("")))


def source_name(key: Column) -> Column:
    return F.coalesce(_named(SOURCE_NAMES, key), key, F.lit(""))


def status_name(status: Column) -> Column:
    """An unknown status begins with a capital."""
    return F.coalesce(_named(STATUS_NAMES, status), F.concat(F.upper(F.substring(status, 1, 1)), F.lower(F.substr(status, F.lit(2)))))


def band_name(band: Column) -> Column:
    return F.coalesce(_named(BAND_NAMES, band), F.lit(BAND_NAMES["none"]))


def number_of(c: Column) -> Column:
    """A number, or 0 for what is none."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def selectable(sources: DataFrame, opted: tuple[str, ...] = (), boards: tuple[str, ...] = ()) -> DataFrame:
    """key, name, is_default, configured, opt_in of each source that may be picked: those to opt into only once opted into, boards configured only where one is named."""
    key = F.col("key")
    opt_in = key.isin(*OPT_IN_SOURCES)
    return sources.where(~opt_in | key.isin(*opted)).select(key, source_name(key).alias("name"), key.isin(*DEFAULT_SOURCES, *opted).alias("is_default"), (~key.isin(*BOARD_SOURCES) | key.isin(*boards)).alias("configured"), opt_in.alias("opt_in"))


def held_skills(text: Column, extra: Column) -> Column:
    """Skills that a text names, then those typed in, under their known names where they have one."""
    typed = F.filter(F.transform(F.coalesce(extra, F.array().cast("array<string>")), F.trim), lambda s: s != "")
    return F.array_union(skills.named(text), F.transform(typed, lambda s: F.coalesce(skills.canonical(s), s)))


def draft_gap(named: Column, have: Column, raw: Column) -> Column:
    """struct(matched, missing) of the skills that a posting names: matched if held or anywhere in the résumé's text, case ignored."""
    held = lambda s: F.array_contains(skills.lower_all(have), F.lower(s)) | F.contains(F.lower(F.coalesce(raw, F.lit(""))), F.lower(s))
    return F.struct(F.filter(named, held).alias("matched"), F.filter(named, lambda s: ~held(s)).alias("missing"))


def keywords(docs: DataFrame, id_: str, text: str, stop: frozenset[str] = vectors.STOP, most: int = 20) -> DataFrame:
    """id_, place, term, n: the top-k report of each text's most frequent words of over two characters, none of them in `stop`, and of SHORT_KEYWORDS. Of equal counts long words come first, then the earlier one.
    Texts without any have no row; rows with one id are one text."""
    short = lambda x: x["term"].isin(*SHORT_KEYWORDS)
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(KEYWORD), F.lit(0)), lambda w, i: F.struct(F.lower(w).alias("term"), i.alias("pos")))
    told = F.filter(words, lambda x: short(x) | ((F.length(x["term"]) > 2) & ~x["term"].isin(*stop)))
    best = vectors.most_frequent(F.col("terms"), most, short)
    return vectors.of_one_id(docs, id_, told).select(id_, F.posexplode(best).alias("place", "x")).select(id_, (F.col("place") + 1).alias("place"), "x.term", "x.n")


def insights(postings: DataFrame, id_: str, text: str) -> DataFrame:
    """id_, skills, years, keywords of each posting: names in order of mention, years stated (null if none), keywords by frequency."""
    facts = postings.select(id_, skills.named(F.col(text)).alias("skills"), years.stated_years(F.col(text)).alias("years"))
    words = keywords(postings, id_, text).groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("all"))  # at most 20 a text
    told = F.coalesce(F.transform("all", lambda x: x["term"]), F.array().cast("array<string>"))
    return facts.join(words, id_, "left").select(id_, "skills", "years", told.alias("keywords"))


def annotated(matches: DataFrame, postings: DataFrame, have: Column, home: str, cities: tuple[str, ...] = ()) -> DataFrame:
    """The columns of matches (job_id, total) with title, company, source_name, band, gap, near, place and required_years. What depends on the posting alone is worked out once a posting, before the join."""
    c = F.col
    body = matching.job_text(c("title"), c("company"), c("description"))
    facts = postings.select(
        c("id").alias("job_id"), F.coalesce("title", F.lit("Untitled role")).alias("title"), F.coalesce("company", F.lit("Unknown company")).alias("company"), source_name(c("source")).alias("source_name"), skills.gap(skills.named(body), have).alias("gap"),
        location.fit(c("title"), c("location"), c("description"), c("source"), home, cities)["status"].alias("place"), matching.required_years(c("years"), c("title"), body).alias("required_years"),
    )
    return matches.join(facts.withColumn("near", skills.near_miss(c("gap"))), "job_id").withColumn("band", scoring.band(number_of(c("total"))))


def draftable(matches: DataFrame, most: int = 100) -> DataFrame:
    """The top-k report of matches to write for: the best by total, of these saved ones first, then applied ones, then all others. Adds place."""
    best = matches.orderBy(F.desc_nulls_last("total"), "match_id").limit(most)
    rank = F.when(F.col("status") == "saved", 0).when(F.col("status") == "applied", 1).otherwise(2)
    return best.withColumn("place", F.row_number().over(Window.orderBy(rank, F.desc(number_of(F.col("total"))), "match_id")))  # at most `most` rows


def learn_first(gaps: DataFrame, most: int = 8) -> DataFrame:
    """The top-k report of skills missing from near misses (column gap): by postings that want one, then by postings that lack only it, then by name."""
    near = gaps.where(skills.near_miss(F.col("gap"))).select(F.explode("gap.missing").alias("skill"), (F.size("gap.missing") == 1).cast("int").alias("only"))
    return near.groupBy("skill").agg(F.count("*").alias("jobs"), F.sum("only").alias("closes")).orderBy(F.desc("jobs"), F.desc("closes"), F.lower("skill")).limit(most)


def search_summary(found: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """name, found, new of each source of a search: how many postings came, and how many keys among them aren't stored. A null key is stored nowhere and counts as none."""
    known = stored.select(key).distinct().withColumn("_known", F.lit(True))
    counted = found.groupBy("source", key).agg(F.count("*").alias("n")).join(known, key, "left")
    first = counted.groupBy("source").agg(F.sum("n").alias("found"), F.count_if(F.col("_known").isNull() & F.col(key).isNotNull()).alias("new"))
    return first.select(source_name(F.col("source")).alias("name"), "found", "new")


def rescored(matches: DataFrame, version: int, total: Column) -> DataFrame:
    """Rows of another scoring version (or none) get the total anew and the version; all others stay."""
    old = ~F.col("version").eqNullSafe(F.lit(version))
    return matches.withColumns({"total": F.when(old, total).otherwise(F.col("total")), "version": F.lit(version)})


def day_years(spans: DataFrame, person: str, start: str, end: str) -> DataFrame:
    """person, years: days covered by the spans of each person over 365.25, to one decimal; days covered twice count once. Spans without an end or start, or that end before they start, count nothing."""
    good = spans.where(F.col(start) <= F.col(end))
    before = F.max(end).over(Window.partitionBy(person).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.date_diff(F.col(end), F.greatest(F.col(start), F.coalesce("_before", F.col(start)))), F.lit(0))
    return good.withColumn("_before", before).groupBy(person).agg(F.round(F.sum(added) / 365.25, 1).alias("years"))


def resume_digest(summary: Column, names: Column, roles: Column, raw: Column, most: int = 2500) -> Column:
    """What a prompt is told of a résumé: summary, at most 30 skills, at most four roles (title, company, dates), and the text's beginning; longer by 1500 characters than the text at most."""
    told = lambda c: c.isNotNull() & (c != "")
    role = lambda r: F.concat_ws(" - ", *(F.nullif(r[k], F.lit("")) for k in ("title", "company", "dates")))
    lines = F.transform(F.filter(F.transform(F.slice(F.coalesce(roles, F.expr("array()").cast(ROLES)), 1, 4), role), told), lambda r: F.concat(F.lit("Role: "), r))
    parts = F.concat(F.array(F.when(told(summary), F.concat(F.lit("Summary: "), summary)), F.when(F.size(names) > 0, F.concat(F.lit("Skills: "), F.array_join(F.slice(names, 1, 30), ", ")))), lines, F.array(F.left(F.coalesce(raw, F.lit("")), F.lit(most))))
    return F.left(F.array_join(F.array_compact(parts), "\n"), F.lit(most + 1500))


ROLES = "array<struct<title:string,company:string,dates:string>>"


def backup(tables: dict[str, DataFrame], folder: str, stamp: str) -> list[str]:
    """Writes each table under folder/stamp/name as Parquet, and returns the paths. A stamp that is there already is an error."""
    paths = []
    for name, frame in tables.items():
        paths.append(f"{folder}/{stamp}/{name}")
        frame.write.parquet(paths[-1])
    return paths


def export_csv(frame: DataFrame, path: str) -> None:
    """Writes a table as CSV with a header: texts that a spreadsheet would run are quoted, times go to the second, nulls are empty."""
    cells = {"string": lambda c: text.neutral_cell(c), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "timestamp_ntz": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")}
    frame.select(*(cells.get(kind, lambda c: c)(F.col(name)).alias(name) for name, kind in frame.dtypes)).write.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def snapshot(postings: DataFrame, labels: DataFrame, resume: DataFrame, folder: str) -> None:
    """Writes what an evaluation needs as JSON lines: the labelled postings (url, label) under jobs, the résumé under resume."""
    key = lambda c: F.regexp_replace(F.lower(F.trim(c)), "/+$", "")
    wanted = labels.where("label is not null").select(key(F.col("url")).alias("_url"))
    postings.withColumn("_url", key(F.col("url"))).join(wanted, "_url", "left_semi").drop("_url").write.json(f"{folder}/jobs")
    resume.write.json(f"{folder}/resume")


def save_documents(fresh: DataFrame, matches: DataFrame, path: str, now: Column) -> DataFrame:
    """Appends written documents (match_id, kind, content) to the table at path, with a name match<id>_<kind>_<time>.md; those without a match or text are left out. Returns the rows that were added."""
    good = fresh.where(F.trim(F.coalesce("content", F.lit(""))) != "").join(matches.select("match_id"), "match_id", "left_semi")
    name = F.concat(F.lit("match"), F.col("match_id").cast("string"), F.lit("_"), F.col("kind"), F.lit("_"), F.date_format(now, "yyyyMMdd_HHmmss"), F.lit(".md"))
    rows = good.select("match_id", "kind", "content", name.alias("file_name"), now.alias("created_at"))
    rows.write.mode("append").parquet(path)
    return rows


def resume_list(resumes: DataFrame, most: int = 50) -> DataFrame:
    """The top-k report of stored résumés, newest first: id, file_path, created_at, skill_count."""
    count = F.size(skills.merged(F.coalesce("skills", F.array().cast("array<string>")), F.coalesce("extra_skills", F.array().cast("array<string>"))))
    return resumes.select("id", "file_path", "created_at", count.alias("skill_count")).orderBy(F.desc("created_at"), F.desc("id")).limit(most)
