"""Which company boards are read, and which of their postings are wanted by place."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import location as gazetteer

# What a board's short name may look like, and cities that boards spell in two ways.
SLUG = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,59}\z"
SPELLINGS = {"bangalore": "bengaluru", "gurgaon": "gurugram", "bombay": "mumbai", "delhi": "new delhi"}

#: A country searched as a whole at one source, by the cities that it knows there; other spellings of these; words for any place, and that source's own.
COUNTRY_CITIES = {"india": ("Bangalore", "Hyderabad", "Chennai", "Pune", "Gurgaon", "Mumbai", "Noida")}
OTHER_CITIES = {"bengaluru": "Bangalore", "gurugram": "Gurgaon", "bombay": "Mumbai"}
ANYWHERE, REMOTE = ("", "remote", "anywhere", "worldwide", "flexible", "flexible / remote"), "Flexible / Remote"


def valid_slugs(names: Column) -> Column:
    """The short names of an array that may be a board's, outer blanks off, each once, in order; none for null."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s.rlike(SLUG)))


def wanted_places(location: str | None) -> list[str]:
    """The places of a search, parted by ; , | or /, in lower case, each followed by its other spelling. None means any place."""
    other = SPELLINGS | {v: k for k, v in SPELLINGS.items()}
    parts = [" ".join(p.split()).lower() for p in re.split(r"[;,|/]", location or "")]
    return list(dict.fromkeys(x for p in parts if p for x in (p, other.get(p)) if x))


def place_wanted(location: Column, wanted: list[str]) -> Column:
    """Whether a posting's place names one of the wanted ones as whole words."""
    if not wanted:
        return F.lit(True)
    shown = F.trim(F.regexp_replace(F.lower(F.coalesce(location, F.lit(""))), r"\s+", " "))
    return shown.rlike(r"(?U)\b(?:" + "|".join(map(re.escape, wanted)) + r")\b")


def listed_places(location: str | None, cities: tuple[str, ...] = ()) -> list[str]:
    """The place names to ask a source for that lists cities as `City, Country`: a country stands for the preferred cities in it, else for all that are known; no place is a remote one."""
    listed = {c.lower(): f"{c}, {country.title()}" for country, own in COUNTRY_CITIES.items() for c in own}
    listed |= {k: listed[v.lower()] for k, v in OTHER_CITIES.items()}
    city = lambda place: listed.get(place.split(",")[0].strip().lower())

    def names(part: str) -> list[str]:
        if part.lower() in ANYWHERE:
            return [REMOTE]
        if part.lower() in COUNTRY_CITIES:
            own = [listed[c.lower()] for c in COUNTRY_CITIES[part.lower()]]
            return [c for c in map(city, cities) if c in own] or own
        return [city(part) or part]

    parts = [p.strip() for p in re.split("[;|]", location or "")]
    return list(dict.fromkeys(n for p in parts for n in names(p)))


def country_for(location: str | None) -> str:
    """The country of a search, by its last part that names one; empty for remote or unknown places."""
    named = (gazetteer.normalize_country(p.strip()) for p in reversed(re.split(r"[;,|/]", location or "")) if p.strip().lower() not in ANYWHERE)
    return next((c for c in named if c in gazetteer.PLACES), "")
