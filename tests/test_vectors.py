import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import vectors
from quarry.scratch import numbered


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    frames = []
    whole = vectors.kept
    monkeypatch.setattr(vectors, "kept", lambda frame: frames.append(frame) or whole(frame))
    return frames


def test_terms_are_counted_within_their_row(spark, written):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(["java", "kafka", "sql", "c++", "ab", "ä"]) for _ in range(rng.randrange(40))) for i in range(50)} | {50: None, 51: ""}
    tf = vectors.counted(spark.createDataFrame(list(texts.items()), "id long, text string"), ["id"], F.split(F.nullif("text", F.lit("")), " "))
    got = {(r.id, r.term): r.tf for r in tf.collect()}
    assert got == {(i, w): n for i, t in texts.items() for w, n in (Counter(t.split()) if t else {None: None}).items()}
    assert "Aggregate" not in plan(written[0])


def test_rows_of_one_id_are_weighed_as_one(spark):
    rows = [(1, "java kafka java"), (1, "kafka sql"), (2, "sql"), (None, "java"), (None, "java sql")]
    got = {(r.id, r.term): r.w for r in vectors.weights(spark.createDataFrame(rows, "id long, text string"), "id", vectors.tokens(F.col("text")), unit=False).collect()}
    assert set(got) == {(1, "java"), (1, "kafka"), (1, "sql"), (2, "sql"), (None, "java"), (None, "sql")}
    assert got[1, "java"] == pytest.approx(got[None, "java"]) and got[1, "java"] > got[1, "sql"] == got[2, "sql"]


def test_pairs_of_any_number_of_words(spark):
    rows = spark.createDataFrame([(None,), ("",), ("java",), ("java sql go",)], "text string").select(vectors.grams(vectors.tokens(F.col("text"))).alias("g"))
    assert [r.g for r in rows.collect()] == [[], [], ["java"], ["java", "sql", "go", "java sql", "sql go"]]


@pytest.mark.parametrize("name", ["top_keywords", "document_keywords"])
def test_keywords_leave_no_word_to_a_shuffle(spark, name):
    from quarry.plans import queries, views  # noqa: F401 (they register their queries)

    frame = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert frame.count() > 0 and "Aggregate" not in plan(frame) and "Window" not in plan(frame)
    before = "\n".join(plan(frame).split("Repartition")[1:])
    assert "regexp_extract_all" not in before  # no text is cut before it is dealt


def test_keywords_of_rows_under_one_id(spark):
    from quarry.operators import views

    rows = spark.createDataFrame([(1, "kafka java java"), (1, "kafka kafka"), (2, "sql"), (None, "sql go"), (None, "go")], "id long, text string")
    got = sorted((r.id or 0, r.place, r.term, r.n) for r in views.keywords(rows, "id", "text").collect())
    assert got == [(0, 1, "go", 2), (0, 2, "sql", 1), (1, 1, "kafka", 3), (1, 2, "java", 2), (2, 1, "sql", 1)]


def test_cosines_over_many_chunks_and_parts(spark, written, monkeypatch):
    rng = random.Random(5)
    words = ["java", "kafka", "sql", "golang", "rust", "scala"]
    rows = [(rng.choice([1, 2, None, -1]), f"{' '.join(rng.choices(words, k=rng.randrange(9)))} word{i}" if i % 7 else None) for i in range(60)]
    corpus = [t or "" for _, t in rows] + ["java and kafka java"]
    counts = [Counter(w for w in t.split() if w not in vectors.STOP) for t in corpus]
    df = Counter(w for c in counts for w in c)
    weights = [{w: (1 + math.log(n)) * (math.log((1 + len(counts)) / (1 + df[w])) + 1) for w, n in c.items()} for c in counts]
    length = [math.sqrt(sum(x * x for x in w.values())) for w in weights]
    want = sorted((i or 0, round(sum(x * weights[-1].get(t, 0) for t, x in w.items()) / (n * length[-1] or 1), 9)) for (i, _), w, n in zip(rows, weights, length))
    monkeypatch.setattr(vectors, "CHUNK", 2)
    monkeypatch.setattr(vectors, "PART", 40)
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = vectors.cosines(docs, "id", spark.createDataFrame([(corpus[-1],)], "text string"), vectors.tokens)
    assert sorted((r.id or 0, round(r.cosine, 9)) for r in got.collect()) == want
    assert written and not any("explode" in plan(f) for f in written)  # no row for each term, written or shuffled


def test_a_term_of_all_rows_travels_once_for_a_piece(spark, written, monkeypatch):
    """A task that weighs holds distinct hashes, not the entries of its rows: these it reads one piece after the other."""
    monkeypatch.setattr(vectors, "CHUNK", 6)
    rows = numbered(spark.createDataFrame([(k % 5, f"java kafka java sql {'rare' * (k == 7)}") for k in range(1000)], "id long, text string").repartition(2))
    dealt = vectors._dealt(rows, lambda t: vectors.tokens(t), 3).collect()
    pieces = {r["first"] for r in dealt}
    assert sum(len(r["hashes"] or []) for r in dealt) == 3 * len(pieces) + 1 and len(pieces) < 40
    assert sum(len(r["at"] or []) for r in dealt) == 3001 == sum(sum(r["n"] or []) for r in dealt)
    written.clear()
    got = vectors.cosines(rows.select("id", "text"), "id", spark.createDataFrame([("java java kafka sql",)], "text string"), vectors.tokens)
    assert sorted(round(r.cosine, 6) for r in got.collect())[1:] == [1.0] * 999
    sums = next(plan(f) for f in written if "FlatMapGroupsInArrow" in plan(f))
    assert "FlatMapGroupsInArrow [part" not in sums and "Sort [part" in sums  # no task gathers a part's rows


def test_long_texts_travel_in_more_pieces(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HASHES", 30, raising=False)
    rows = numbered(spark.createDataFrame([(k, " ".join(f"w{k * j % 17}" for j in range(k % 12))) for k in range(50)] + [(50, None), (51, " ".join(f"v{j}" for j in range(90)))], "id long, text string").coalesce(1))
    dealt = vectors._dealt(rows, vectors.tokens, 2).collect()
    held = Counter()
    for r in dealt:
        held[r["first"]] += sum(r["n"] or [])
    assert len(held) > 5 and max(held.values()) <= 30 + 90
    texts = [r.text or "" for r in rows.orderBy("id").collect()]
    counts = [Counter(t.split()) for t in [*texts, "w1 w2 w2 v3"]]
    df = Counter(w for c in counts for w in c)
    weights = [{w: (1 + math.log(n)) * (math.log((1 + len(counts)) / (1 + df[w])) + 1) for w, n in c.items()} for c in counts]
    length = [math.sqrt(sum(x * x for x in w.values())) for w in weights]
    got = vectors.cosines(rows.select("id", "text"), "id", spark.createDataFrame([("w1 w2 w2 v3",)], "text string"), vectors.tokens).orderBy("id").collect()
    assert [r.cosine for r in got] == pytest.approx([sum(x * weights[-1].get(t, 0) for t, x in w.items()) / (n * length[-1] or 1) for w, n in zip(weights[:-1], length)])


def test_takeable_matches_judge_each_posting_once(spark):
    from quarry.plans import queries

    told = plan(queries.QUERIES["takeable_matches"](spark, "/root/testdata/sf0.001"))
    assert "RLIKE" not in told and "regexp_extract_all" not in told  # places and skills are read, not worked out by match


def many_terms(rng, rows=60):
    return [(k // 2 if k % 7 else None, " ".join(f"w{'abcdefghij'[int(rng.paretovariate(0.5)) % 10]}{int(rng.paretovariate(0.4)) % 3000}" for _ in range(rng.randrange(80))) or None) for k in range(rows)]


@pytest.mark.parametrize("parts", [100_000, 50])  # all terms frequent; most of them rare
def test_heaviest_terms_after_bounds(spark, monkeypatch, parts):
    monkeypatch.setattr(vectors, "PARTS", parts)
    monkeypatch.setattr(vectors, "PAIRS", 100, raising=False)
    rows = many_terms(random.Random(8))
    counts = {}
    for i, t in rows:
        counts.setdefault(i, Counter()).update((t or "").split())
    df = Counter(w for c in counts.values() for w in c)
    heavy = {i: sorted((-round((1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[w])) + 1), 9), w) for w, n in c.items())[:5] for i, c in counts.items()}
    got = vectors.heaviest(spark.createDataFrame(rows, "id long, text string").repartition(3), "id", vectors.tokens(F.col("text")), 5)
    assert sorted((r.id or -1, r.place, r.term) for r in got.collect()) == sorted((-1 if i is None else i or -1, k, w) for i, ws in heavy.items() for k, (_, w) in enumerate(ws, 1))


def test_tasks_sort_few_pairs(spark, monkeypatch, written):
    monkeypatch.setattr(vectors, "PAIRS", 100, raising=False)
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(many_terms(random.Random(4)))], "id long, text string")
    sizes = lambda frame: [n for _, n in frame.groupBy(F.spark_partition_id()).count().collect()]
    w = vectors.weights(docs, "id", vectors.tokens(F.col("text")))
    pairs = written[0].count()
    assert w.count() == written[0].where("term IS NOT NULL").count() and len(sizes(w)) > pairs / 100 / 2 and max(sizes(w)) < pairs / 4
    told = plan(vectors.heaviest(docs, "id", vectors.tokens(F.col("text")), 3))
    assert "Window" in told and "Window" not in told[told.index("RepartitionByExpression [id") :]  # nothing is sorted before its shuffle
