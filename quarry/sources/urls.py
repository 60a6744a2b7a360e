"""Predicates and canonical forms of URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def allowed(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a URL is http(s), without credentials or white space, on one of the hosts or below it, with a legal port or none. A host may end in a dot. Addresses in numbers never are allowed."""
    names = "|".join(re.escape(h.lower()) for h in hosts)
    found = F.regexp_extract(F.lower(url), rf"^https?://(?:[a-z0-9_-]+\.)*(?:{names})\.*(?::([0-9]*))?(?:[/?#]|$)", 1)
    on_host = F.lower(url).rlike(rf"^https?://(?:[a-z0-9_-]+\.)*(?:{names})\.*(?::[0-9]*)?(?:[/?#]|$)") & ~url.rlike(r"[\x00\r\n\t ]")
    return F.coalesce(on_host & ((found == "") | (F.try_to_number(found, F.lit("9999999999")) <= 65535)), F.lit(False))


def canonical_job_view(url: Column) -> Column:
    """The plain address of a posting on a network site: its number from the path or the currentJobId parameter, else the URL without its query."""
    number = F.coalesce(F.nullif(F.regexp_extract(url, r"/jobs/view/(?:[^/?#]*-)?(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"[?&]currentJobId=(\d+)", 1), F.lit("")))
    site = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    return F.coalesce(F.concat(site, F.lit("/jobs/view/"), number, F.lit("/")), F.regexp_replace(url, r"[?#].*$", ""))
