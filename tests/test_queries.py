"""Every query that has SQL gives DuckDB's rows."""

import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quarry.operators import vectors
from quarry.plans import queries, views, worked  # noqa: F401 (they register their queries)
from quarry.session import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if type(value).__name__ == "Decimal":
        value = float(value)
    return None if isinstance(value, float) and math.isnan(value) else round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect())
    result = duck.sql(queries.SQL[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    theirs = sorted(repr(tuple(plain(r[k]) for k in places)) for r in result.fetchall())
    assert ours == theirs


def test_keyword_pair_cosines(spark, duck):
    texts = dict(duck.sql("SELECT doc_id, text FROM documents UNION ALL SELECT -1, text FROM benchmark WHERE item_id = 0").fetchall())
    words = {i: [w for w in re.findall(vectors.TOKEN, (t or "").lower()) if w not in vectors.STOP] for i, t in texts.items()}
    counts = {i: Counter([*w, *map(" ".join, zip(w, w[1:]))]) for i, w in words.items()}
    df = Counter(term for c in counts.values() for term in c)
    weights = {i: {t: (1 + math.log(n)) * (math.log((1 + len(counts)) / (1 + df[t])) + 1) for t, n in c.items()} for i, c in counts.items()}
    length = {i: math.sqrt(sum(x * x for x in w.values())) for i, w in weights.items()}
    own = weights[-1]
    cosine = {i: sum(x * own[t] for t, x in w.items() if t in own) / (length[i] * length[-1] or 1) for i, w in weights.items() if i != -1}
    got = {r.id: r for r in queries.QUERIES["keyword_pair_cosines"](spark, FOLDER).collect()}
    assert {i: r.cosine for i, r in got.items()} == pytest.approx(cosine, abs=2e-6)
    assert {i: r.keywords for i, r in got.items()} == pytest.approx({i: 100 * (1 - math.exp(-6 * c)) for i, c in cosine.items()}, abs=1e-3)
    assert {i: r.cosine for i, r in got.items()} != {r.id: r.cosine for r in queries.QUERIES["keyword_cosines"](spark, FOLDER).collect()}
