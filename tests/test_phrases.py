"""Phrases of a vocabulary table against one pattern of all of them."""

import random
import re

import pytest

from quarry.functions import skills
from quarry.operators import phrases

LEFT, RIGHT = skills.NOT_BEFORE, skills.NOT_AFTER
WORDS = ["C", "C++", "Java", "java", "JAVA", "Node.js", "node", ".NET", "CI/CD", "ruby on rails", "Ruby", "rails", "Embedded  C", "embedded c", "spark sql", "Spark", "SQL", "A/B", "x", "é", "R"]
ALIASES = [("C", "C", True), ("C++", "C++", False), ("java", "Java", False), ("Node.js", "Node.js", False), ("node", "Node.js", True), (".NET", ".NET", False), ("CI/CD", "CI/CD", False), ("ruby on rails", "Rails", False)]
ALIASES += [("Ruby", "Ruby", False), ("Embedded C", "Embedded", False), ("Spark SQL", "Spark", False), ("Spark", "Spark", True), ("SQL", "SQL", False), ("R", "R", True), ("on  rails", "On", False)]


def by_patterns(text, aliases=ALIASES):
    """One pattern for phrases in any case and one for those in their own; names in the order of first mention."""
    first = {}
    for exact in (False, True):
        known = {re.sub(r"\s+", " ", a) if exact else re.sub(r"\s+", " ", a).lower(): n for a, n, e in aliases if e == exact}
        body = "|".join(r"\s+".join(map(re.escape, a.split())) for a in sorted(known, key=len, reverse=True))
        for m in re.finditer(f"{LEFT}(?:{body}){RIGHT}", text or "", 0 if exact else re.IGNORECASE):
            said = re.sub(r"\s+", " ", m.group())
            name = known[said if exact else said.lower()]
            first.setdefault(name, m.start())
            first[name] = min(first[name], m.start())
    return {(n, at) for n, at in first.items()}


@pytest.mark.parametrize("limit", [phrases.BROADCAST_ROWS, 0])
def test_mentions_are_those_of_the_patterns(spark, monkeypatch, limit):
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", limit)
    rng = random.Random(5)
    texts = ["".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "\n", ", ", ".", ". ", "-", "/", "/ ", "(", "...", "-.x "]) for _ in range(rng.randrange(12))) for _ in range(300)] + [None, "", " ", "Java", "Java" * 3, "java " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    vocabulary = spark.createDataFrame([(*a, k) for k, a in enumerate(ALIASES)] + [("JAVA", "older", False, -1)], "alias string, name string, exact boolean, no int")
    got = {r.row: r.names for r in phrases.names(rows, vocabulary).collect()}
    for k, text in enumerate(texts):
        found = by_patterns(text)
        order = [n for n, _ in sorted(found, key=lambda x: x[1])]
        places = [at for _, at in found]
        if len(places) == len(set(places)):
            assert got.get(k, []) == order, text
        else:
            assert sorted(got.get(k, [])) == sorted(order), text


def test_odd_vocabularies(spark):
    rows = spark.createDataFrame([(1, "java and a, b")], "row long, text string")
    assert phrases.names(rows, spark.createDataFrame([], "alias string, name string")).collect() == []
    assert phrases.names(rows.limit(0), spark.createDataFrame([("java", "Java")], "alias string, name string")).collect() == []
    assert phrases.names(rows, spark.createDataFrame([("a, b", "pair"), ("b", None)], "alias string, name string")).first().names == ["pair"]
    with pytest.raises(Exception, match="not a phrase"):
        phrases.names(rows, spark.createDataFrame([("(a)", "x")], "alias string, name string")).collect()
