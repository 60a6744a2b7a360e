"""The pruned top-k join against all pairs."""

import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.operators import nearest, vectors

FOLDER = "/root/testdata/sf0.001"


def brute(rows, profiles, most):
    docs = [Counter(w for w in (t or "").split() if w not in vectors.STOP) for _, t in rows]
    df = Counter(w for d in docs for w in d)
    weigh = lambda c: {w: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, n in c.items() if w in df}
    size = lambda w: math.sqrt(sum(x * x for x in w.values()))
    weighed = [weigh(d) for d in docs]
    out = defaultdict(list)
    for k, (name, text) in enumerate(profiles):
        own = weigh(Counter(w for w in (text or "").split() if w not in vectors.STOP))
        found = [(sum(x * w[t] for t, x in own.items() if t in w) / (size(own) * size(w)), i) for (i, _), w in zip(rows, weighed, strict=True) if own.keys() & w.keys()]
        found.sort(key=lambda x: (-round(x[0], 9), math.inf if x[1] is None else x[1]))
        out[k] = [(name, place, i, round(c, 6)) for place, (c, i) in enumerate(found[:most], 1)]
    return sorted(repr(x) for rows in out.values() for x in rows)


@pytest.mark.parametrize("most, look", [(1, 1), (5, 1), (5, 50), (400, 50)])
def test_top_documents_are_exact(spark, monkeypatch, most, look):
    monkeypatch.setattr(nearest, "FIRST_LOOK", look)
    rng = random.Random(9)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 300}"
    word2 = lambda: word().replace("0", "o").replace("1", "l")
    rows = [(k, " ".join(word2() for _ in range(rng.randrange(30)))) for k in range(300)] + [(300, None), (301, ""), (7, "walpha beta"), (302, "walpha beta")]
    rows += [(400 + k, rows[5][1]) for k in range(8)]
    profiles = [(k, " ".join(word2() for _ in range(rng.randrange(1, 12)))) for k in range(25)] + [(25, None), (26, "nowhere"), (27, rows[5][1]), (27, "walpha")]
    got = nearest.top_documents(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", spark.createDataFrame(profiles, "item long, text string"), "item", vectors.tokens, most).collect()
    assert sorted(repr((r.profile, r.place, r.id, round(r.cosine, 6))) for r in got) == brute(rows, profiles, most)


def test_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a word")], "id long, text string"), spark.createDataFrame([], "id long, text string")
    assert nearest.top_documents(none, "id", some, "id", vectors.tokens).collect() == [] and nearest.top_documents(some, "id", none, "id", vectors.tokens).collect() == []


@pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")
def test_pruning(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    counts = {}
    nearest.top_documents(docs, "doc_id", items, "item_id", vectors.tokens, 3, counts).collect()
    terms = docs.select(F.explode(vectors.tokens(F.col("text"))).alias("t"), "doc_id").distinct().count()
    assert counts["scored"] < counts["pairs"] / 2 and counts["joined"] < items.count() * terms / 50, (counts, terms)


@pytest.mark.parametrize("few", [0, 60, 250_000])  # nothing is broadcast; some is; all is
def test_tasks_hold_few_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(nearest, "FEW", few, raising=False)
    monkeypatch.setattr(vectors, "PAIRS", 100, raising=False)
    written, whole = [], nearest.kept
    monkeypatch.setattr(nearest, "kept", lambda frame: written.append(frame) or whole(frame))
    rng = random.Random(12)
    text = lambda most: " ".join(f"w{'abcdefgh'[int(rng.paretovariate(0.5)) % 8]}{'xyz'[rng.randrange(3)]}" for _ in range(rng.randrange(1, most)))
    rows, profiles = [(k, text(25)) for k in range(200)], [(k, text(6)) for k in range(20)]
    got = nearest.top_documents(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", spark.createDataFrame(profiles, "item long, text string"), "item", vectors.tokens, 4).collect()
    assert sorted(repr((r.profile, r.place, r.id, round(r.cosine, 6))) for r in got) == brute(rows, profiles, 4)
    pairs = next(f for f in reversed(written) if f.columns == ["profile", "row"])  # of all profiles with documents that can reach the floor
    sizes = [n for _, n in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and max(sizes) < sum(sizes) / 3, sizes
