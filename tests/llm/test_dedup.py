"""Operators 1, 2, 5 and 7 and the pipeline against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from quarry.llm import decontamination, graph, html_extraction, minhash_dedup, sentencepieces, suffix_dedup
from quarry.llm.common import shingle_set

ODD = [(1, None), (2, ""), (3, "only three words"), (3, "only three words"), (4, "Only THREE words"), (None, "only three words"), (5, "x " * 20_000)]


def texts(n=120, seed=5):
    """Bases, exact and near copies of them, a common passage, and words of their own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(rng.randrange(30, 120))] for _ in range(8)]
    out = []
    for k in range(n):
        words = list(rng.choice(bases)) if rng.random() < 0.7 else [word() for _ in range(rng.randrange(80))]
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if words:
                words[rng.randrange(len(words))] = word()
        out.append((k, " ".join(words + (passage if rng.random() < 0.3 else []))))
    return out


def brute_components(rows):
    sets = {i: set(shingle_set((t or "").encode()).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(table):
    rows = texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.classes(table(rows)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("crowd, block", [(minhash_dedup.CROWD, minhash_dedup.BLOCK_NODES), (1, 50), (1 << 20, 50)])
def test_template_and_hub(table, monkeypatch, crowd, block):
    """Documents below the similarity to each other that one nearly bare copy of their template links."""
    monkeypatch.setattr(minhash_dedup, "CROWD", crowd)
    monkeypatch.setattr(minhash_dedup, "BLOCK_NODES", block)
    template = " ".join(f"t{k}" for k in range(94))
    rows = [(k, template + "".join(f" d{k}w{j}" for j in range(4 if k == 77 else 20))) for k in range(300)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.classes(table(rows)).collect()}
    assert got == brute_components(rows)
    assert len({c for _, c in got.values()}) == 1


def test_near_duplicate_edges(table):
    got = minhash_dedup.classes(table(ODD)).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got) == sorted(
        [("1", 0, 1, True), ("2", 0, 2, True), ("3", 1, 3, True), ("3", 1, 3, True), ("4", 1, 3, False), ("None", 1, 3, False), ("5", 1, 5, True)]
    )
    assert minhash_dedup.classes(table([])).count() == 0
    assert sorted(r.doc_id for r in minhash_dedup.keep_one(table(ODD[:5])).collect()) == [1, 2, 3, 3]


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (102, 101), (7, 7), (0, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("large, sent", [(suffix_dedup.LARGE, suffix_dedup.SENT), (500, 0), (1, suffix_dedup.SENT)])
def test_repeats(table, monkeypatch, large, sent):
    monkeypatch.setattr(suffix_dedup, "SENT", sent)
    rows = texts(60) + [(900, None), (901, ""), (902, "ab" * 400), (903, "é" * 150), (904, "é" * 150 + "x")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(table(rows), large=large).collect()}
    assert got == brute_removed(rows)


def test_repeats_around_one_passage(table):
    """A passage between many unlike neighbours: its minimizer is too large at the first gram size, its windows repeat at shifted places."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, wide = noise(60), noise(120)
    rows = [(k, noise(rng.randrange(90)) + (wide if k % 3 == 0 else passage) + noise(rng.randrange(60))) for k in range(150)]
    rows += [(500 + k, rows[k * 7][1][rng.randrange(20) :]) for k in range(15)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(table(rows), large=2000).collect()}
    assert got == brute_removed(rows)


def test_repeat_edges(table):
    long = "some words that are long enough to be a repeat of one hundred bytes, since they go on for quite a while. "
    got = sorted((repr(r.doc_id), r.n_removed) for r in suffix_dedup.deduplicated(table([(1, long), (1, long), (2, long), (None, long)])).collect())
    assert got == [("1", 0), ("1", 0), ("2", len(long)), ("None", len(long))]
    assert suffix_dedup.deduplicated(table([])).count() == 0


def test_long_matches():
    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(1, 4, 300), [0], rng.integers(1, 4, 50), [0]]).astype(np.uint16)
    text[310:340] = text[20:50]
    order, apart = suffix_dedup.long_matches(text, 12)
    around = np.concatenate([text, text])
    assert [list(around[a : a + 12]) != list(around[b : b + 12]) for a, b in zip(order[:-1], order[1:])] == apart.tolist()


def test_decontamination(spark, table):
    rng = random.Random(4)
    items = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))) for k, n in enumerate([40, 25, 15, 3, 0])] + [(9, None)]
    words = items[0][1].split()
    edited = words[:20] + ["changed"] + words[21:]
    docs = [(1, "before " + items[0][1].upper() + " after"), (2, " ".join(edited)), (3, "nothing of it"), (4, items[3][1]), (5, None), (6, ""), (None, items[0][1]), (7, " ".join(words[:15])), (8, "a b " + items[2][1]), (8, "a b " + items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(table(docs), bench).collect()}
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    expected = {(1, 0): 1.0, (4, 3): 1.0, (8, 2): 1.0}
    if (s := decontamination.similarity(bag(edited), bag(words))) >= 0.75:
        expected[2, 0] = s
    assert got == pytest.approx(expected)
    assert decontamination.contaminated(table([]), bench).count() == 0
    assert decontamination.contaminated(table(docs), bench.limit(0)).count() == 0
    assert {r.doc_id for r in decontamination.drop_contaminated(table(docs), bench).collect()} == {3, 5, 6, 7} | ({2} - {d for d, _ in got})


def test_decontamination_matches_brute_force(spark, table):
    """All windows of all texts: what is found is right, and SimHash loses few pairs at 0.75 or more."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(rng.randrange(6, 60)))) for k in range(30)]
    docs = []
    for k in range(200):
        part = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            part[rng.randrange(len(part))] = word()
        docs.append((k, " ".join([word() for _ in range(rng.randrange(30))] + part + [word() for _ in range(rng.randrange(30))])))
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    truth = {}
    for i, item in items:
        own = item.split()
        of_item, n = bag(own), len(own)
        for d, text in docs:
            w = text.split()
            for k in range(len(w) - n + 1):
                there = bag(w[k : k + n])
                both = sum((there & of_item).values())
                if (share := both / (2 * (n - 4) - both)) >= 0.75:
                    truth[d, i] = max(share, truth.get((d, i), 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(table(docs), bench).collect()}
    assert len(truth) > 80 and set(got) <= set(truth) and all(got[k] <= truth[k] + 1e-9 for k in got)
    assert sum(got[k] == pytest.approx(truth[k]) for k in got) / len(truth) >= 0.95


def test_extraction(spark):
    page = '<body><nav><a>Menu</a></nav><div class="ad">Buy</div><article><h1>T &amp; x</h1><p><b>one  two<br><p>three<div class="comments">c</div><p class="notice">n<p>four<form>f</form></article><footer>z</footer>'
    rows = [(1, "http://h/1", page), (2, None, None), (3, "http://h/2", ""), (4, "http://h/3", "<script>x<p>no</p></script>a&nbsp;b"), (1, "http://h/1", page)]
    got = html_extraction.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "T & x\none two\nthree\nfour", 24), (1, "T & x\none two\nthree\nfour", 24), (2, "", 0), (3, "", 0), (4, "a b", 3)]
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_page_differences(spark):
    rows = [(k, f"http://h.com/a/{k:02d}", f"<body><div>Home</div><p>text {k} one</p><p>text {k} two</p><div>Copyright</div></body>") for k in range(40)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == {k: f"text {k} one\ntext {k} two" for k in range(40)}


def test_page_differences_beside_articles(spark):
    rows = [(k, f"http://h.com/a/{k:02d}", f"<body><div>Home</div><article><p>Teaser</p></article><div>body {k}</div><div>Copyright</div></body>") for k in range(10)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == {k: f"Teaser\nbody {k}" for k in range(10)}


def test_page_differences_long_templates_and_copies(spark):
    menu = "".join(f"<div>menu {j}</div>" for j in range(15))
    rows = [(k, f"http://h.com/a/{k:02d}", f"<body>{menu}" + "".join(f"<p>text {k // 3} {j}</p>" for j in range(3)) + "</body>") for k in range(12)]
    rows += [(k, f"http://c.com/{k}", "<p>one</p><p>two</p>") for k in (50, 51)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == {**{k: "\n".join(f"text {k // 3} {j}" for j in range(3)) for k in range(12)}, 50: "one\ntwo", 51: "one\ntwo"}


def test_shared_lines():
    assert html_extraction.shared_lines([1, 2, 3, 4, 5], [1, 9, 3, 8, 5]) == [0, 2, 4]
    assert html_extraction.shared_lines([1, 2], []) == []


@pytest.mark.parametrize("cells", [html_extraction.CELLS, 4])
def test_shared_lines_match_brute_force(monkeypatch, cells):
    monkeypatch.setattr(html_extraction, "CELLS", cells)

    def longest(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        found = html_extraction.shared_lines(a, b)
        rest = iter(b)
        assert found == sorted(set(found)) and len(found) == longest(a, b) and all(a[k] in rest for k in found)


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    clean = [" ".join(word() for _ in range(60)) + "." for _ in range(40)]
    junk = [" ".join([f"{word()}###"] * 30) for _ in range(40)]
    item = " ".join(word() for _ in range(30))
    own = " ".join(word() for _ in range(60)) + "."
    docs = [(k, t) for k, t in enumerate([*clean, *junk])] + [(100, clean[0]), (101, clean[1] + " " + item), (102, " ".join(word() for _ in range(60)) + " mail me@site.com.")]
    docs += [(5, clean[5]), (None, clean[6]), (None, item + " " + own), (None, own), (103, None), (104, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 40), 0) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = {r.doc_id: r for r in found}
    empty = {r.doc_id for r in found if not r.text}
    assert empty in (set(), {103, 104})  # the classifier decides whether a text without words is good
    assert sorted((r.doc_id for r in found if r.text and r.doc_id is not None)) == sorted([*range(40), 5, 102])  # a repeated row stays with its like
    assert [r.text for r in found if r.doc_id is None] == [own]
    assert "[email]" in rows[102].text and rows[102].token_ids
    original = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL_PATH)
    assert all(r.token_ids == original.encode(r.text) and original.decode(r.token_ids) == r.text and r.parity and r.round_trip for r in found if r.text)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_stages_take_columns_of_any_names(spark, labels):
    """Columns that are called as the operators' own are, through every filtering stage."""
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(k, words if k < 3 else f"{words} {k}" * 2, 1, "t", 2, "g", 3.0, 4, 5) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone long, _text string, gone long, of_text string, score double, node long, row long")
    assert sorted(r.doc_id for r in minhash_dedup.keep_one(docs).collect()) == [0, 3, 4, 5]
    assert minhash_dedup.keep_one(docs).columns == docs.columns and minhash_dedup.keep_one(docs.limit(0)).collect() == []
    item = spark.createDataFrame([(1, "no such item as this one here")], "item_id long, text string")
    assert decontamination.drop_contaminated(docs, item).columns == docs.columns
