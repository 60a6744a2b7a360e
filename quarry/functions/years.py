"""Years of experience: stated in text, implied by a title, held by a candidate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MOST_STATED, MOST_LOW, MOST_HELD = 20, 30, 50
TITLE_YEARS = (
    (r"\b(principal|distinguished|director|vp|vice president|head of|cto|chief)\b", 10),
    (r"\b(staff|lead|architect|manager|founding)\b", 7),
    (r"\b(senior|sr)\b", 5),
    (r"\b(intern|internship|trainee|fresher|freshers|graduate|new grad|entry[- ]level|junior|jr|working student|werkstudent)\b", 0),
    (r"\bassociate\b", 1),
)
#: Words of a posting for beginners, and the years of each level that a `Level:` line names.
FRESHERS = (r"recent (under)?graduates?", r"new grad(uate)?s?\b", r"\bfreshers?\b", r"no (prior )?experience (required|needed)", r"still in college", r"current (students|undergraduates)")
LEVELS = (("internship", 0), ("entry level", 0), ("mid level", 3), ("senior level", 5), ("management", 8))


def required_years(text: Column) -> Column:
    """`At least` or `minimum` decides; otherwise the first number of years up to 20 that isn't an age, those next to the word experience before others."""
    low = F.lower(F.coalesce(text, F.lit("")))
    floor = F.regexp_extract(low, r"(?:at least|minimum(?: of)?|min\.?)\s+(\d+(?:\.\d+)?)\+?\s*(?:years?|yrs?)", 1)
    shape = r"(\d+(?:\.\d+)?)\s*(?:\+|plus)?\s*(?:(?:-|–|to)\s*\d+(?:\.\d+)?\s*\+?\s*)?(?:years?|yrs?)\b"
    ok = lambda a: F.filter(F.transform(a, lambda x: F.try_to_number(x, F.lit("9999.99")).cast("double")), lambda x: (x > 0) & (x <= MOST_STATED))
    told = ok(F.regexp_extract_all(low, F.lit(r"(?:experience.{0,40}?)" + shape + r"(?!.{0,6}\b(?:old|ago)\b)"), F.lit(1)))
    tied = ok(F.regexp_extract_all(low, F.lit(shape + r"(?!.{0,6}\b(?:old|ago)\b)(?=.{0,40}?\bexp)"), F.lit(1)))
    plain = ok(F.regexp_extract_all(low, F.lit(shape + r"(?!.{0,6}\b(?:old|ago)\b)"), F.lit(1)))
    first = lambda a: F.try_element_at(a, F.lit(1))
    return F.coalesce(F.nullif(floor, F.lit("")).try_cast("double"), first(tied), first(told), first(plain))


# Numbers in words; what makes a mention of years a demand; what follows years that nobody asks for.
WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fifteen": 15}
DEMAND = (r"experience", r"exp\b", r"professional", r"industry", r"working", r"hands[- ]on", r"in\s+(?:a|an|the)?\s*\w+", r"of\s+\w+", r"with\s+\w+", r"building", r"developing")
NO_DEMAND = (r"old", r"ago", r"warranty", r"guarantee", r"history", r"in\s+business", r"stable", r"running", r"strong", r"of\s+(?:growth|success|history|operation)", r"track\s+record")


def stated_years(text: Column) -> Column:
    """The most years that a text asks for, of a range the lower end, up to 30, in digits or words. A mention counts with `at least` and the like before it, a plus or a range, or with a word of work within 60 characters
    of its sentence; ages and histories of companies don't count."""
    number = r"(?:\d{1,2}|" + "|".join(WORDS) + ")"
    before, unit = r"((?:at\s+least|minimum(?:\s+of)?|min\.?|over|more\s+than)?)\s*", r"(?:years?|yrs?)\b(?=([^.;\n]{0,60}))"
    mention = rf"{before}({number})\s*((?:\+|plus)?)\s*((?:(?:-|–|—|to)\s*{number}\s*\+?)?)\s*{unit}"
    low = F.lower(F.coalesce(text, F.lit("")))
    part = lambda k: F.regexp_extract_all(low, F.lit(mention), F.lit(k))
    value = F.create_map(*(F.lit(x) for pair in WORDS.items() for x in pair))
    mentions = F.arrays_zip(*(part(k).alias(name) for k, name in enumerate(("pre", "low", "plus", "high", "after"), 1)))
    judged = F.transform(mentions, lambda m: F.when(((m["pre"] != "") | (m["plus"] != "") | (m["high"] != "") | m["after"].rlike(rf"\b(?:{'|'.join(DEMAND)})")) & ~m["after"].rlike(rf"^\s*(?:{'|'.join(NO_DEMAND)})"), F.coalesce(m["low"].try_cast("int"), F.try_element_at(value, m["low"]))))
    return F.when(low.rlike(r"years?\b|yrs?\b"), F.array_max(F.filter(judged, lambda x: x <= MOST_LOW)))


def seniority_years(title: Column, text: Column) -> Column:
    """What a title implies, then words for beginners, then the least level of the first line that begins with `Level:`."""
    low, body = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    out = F.when(F.lit(False), F.lit(0))
    for pattern, years in TITLE_YEARS:
        out = out.when(low.rlike(pattern), years)
    line = F.regexp_extract(body, r"(?m)^level:\s*(.+)$", 1)
    least = F.array_min(F.array_compact(F.array(*(F.when(line.contains(word), years) for word, years in LEVELS))))
    return out.when(body.rlike("|".join(FRESHERS)), 0).otherwise(least)


def held_years(intervals: Column, explicit: Column) -> Column:
    """Years held: months of merged intervals, both ends counted, plus years stated outright and one for each entry that tells neither; at most 50, to one decimal.

    intervals: array of struct(start, end) in months, null where unknown; explicit: array of years, null where not stated."""
    known = F.array_sort(F.filter(intervals, lambda i: i["start"].isNotNull() & i["end"].isNotNull() & (i["end"] >= i["start"])))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("end"))
    merged = F.aggregate(
        known,
        start,
        lambda acc, i: F.struct(
            (acc["total"] + F.when(acc["end"].isNull() | (i["start"] > acc["end"]), i["end"] - i["start"] + 1).otherwise(F.greatest(i["end"] - acc["end"], F.lit(0)))).cast("long").alias("total"),
            F.greatest(acc["end"], i["end"]).cast("long").alias("end"),
        ),
    )
    stated = F.aggregate(explicit, F.lit(0.0), lambda acc, y: acc + F.coalesce(y.cast("double"), F.lit(0.0)))
    vague = F.size(intervals) - F.size(known)
    return F.round(F.least(merged["total"] / 12 + stated + vague, F.lit(float(MOST_HELD))), 1)
