"""The three keys of a posting: storage, session and evaluation. They differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def storage_key(url: Column, title: Column, company: Column, location: Column) -> Column:
    """SHA-256 of the trimmed URL, or of title, company and location in lower case."""
    other = F.lower(F.concat_ws("|", _text(title), _text(company), _text(location)))
    return F.sha2(F.when(_text(url) != "", F.concat(F.lit("url:"), _text(url))).otherwise(F.concat(F.lit("tcl:"), other)), 256)


def session_key(url: Column, title: Column, company: Column, location: Column) -> Column:
    """The URL in lower case without end slashes, or a hash of the other fields with white space collapsed."""
    flat = lambda c: F.regexp_replace(F.lower(_text(c)), r"\s+", " ")
    return F.when(_text(url) != "", F.rtrim(F.lower(_text(url)), F.lit("/"))).otherwise(F.concat(F.lit("h:"), F.sha2(F.concat_ws("|", flat(title), flat(company), flat(location)), 256)))


def evaluation_key(url: Column) -> Column:
    return F.rtrim(F.lower(_text(url)), F.lit("/"))
