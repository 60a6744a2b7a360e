"""Operators 11, 12 and 13 against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import exact_dedup, periodic_runs, piece_model, tokenizer_alignment
from quarry.llm.sentencepieces import MODEL_PATH

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")
models = pytest.mark.skipif(not Path(MODEL_PATH).exists() or not Path(tokenizer_alignment.BYTE_PATH).exists(), reason="no tokenizer files")
ODD = [(1, None), (2, ""), (3, "A b"), (3, "A b"), (4, "a B"), (None, "a b"), (None, "É"), (5, "x " * 20_000), (6, " \n"), (7, "▁x"), (8, "a\tb  c d <|endoftext|> </s>"), (9, "é"), (10, "a b")]
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def split(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", text or "")


def all_runs(words):
    """Every maximal run, by trying every period at every place."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and j > i and not any(q % p == 0 and all(words[k] == words[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected_runs(doc_id, text):
    words = split(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    stay = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *told, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(stay)))


def repeating(rng):
    """Words with planted runs of all sizes, some broken or next to each other."""
    words = []
    for _ in range(rng.randrange(1, 6)):
        letters = rng.choice([1, 2, 3, 40])
        unit = [str(rng.randrange(letters)) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 24, 31, 32, 33, 64, 65]))]
        part = unit * rng.choice([1, 2, 3, 4, 7]) + unit[: rng.randrange(len(unit) + 1)]
        if rng.random() < 0.3:
            part[rng.randrange(len(part))] = "x"
        words += part
    return words


def test_runs_are_all_maximal_runs():
    rng = random.Random(11)
    documents = [repeating(rng) for _ in range(150)] + [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 5000, ["a", "b"] * 700 + ["a"]]
    got = periodic_runs.runs_of([[w.encode() for w in words] for words in documents])
    assert sum(map(len, got)) > 200
    assert got == [all_runs(words) for words in documents]


def test_differences_are_sums_of_squares():
    rng = np.random.default_rng(1)
    blocks, windows = rng.integers(0, 2**27, (5, 16), np.uint64), rng.integers(0, 2**27, (5, 32), np.uint64)
    exact = [[sum((int(blocks[r, i]) - int(windows[r, i + d])) ** 2 for i in range(16)) % periodic_runs.PRIME for d in range(17)] for r in range(5)]
    assert periodic_runs.differences(blocks, windows).tolist() == exact


def test_runs_of_documents(table):
    rng = random.Random(3)
    rows = [(k, " ".join(repeating(rng))) for k in range(120)] + ODD
    got = [tuple(r) for r in periodic_runs.digests(table(rows)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(expected_runs(*r)) for r in rows)
    assert periodic_runs.digests(table([])).collect() == []


@tables
def test_runs_of_the_test_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows = [r for r in rows if len(split(r[1])) < 1500]
    got = {r.doc_id: tuple(r) for r in periodic_runs.digests(docs).collect()}
    assert len(rows) > 150 and {i: got[i] for i, _ in rows} == {i: expected_runs(i, t) for i, t in rows}


class Whole:
    """The alignment of a whole text by both libraries, with all pairs of tokens compared."""

    def __init__(self):
        self.a = Tokenizer.from_file(tokenizer_alignment.BYTE_PATH)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - visible))}
        self.byte = {k: bytes(byte_of.get(c, 63) for c in t) for t, k in self.a.get_vocab().items()}

    def piece(self, k):
        p = self.b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()

    def __call__(self, text):
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        of_a, of_b = [self.byte[k] for k in a], [self.piece(k) for k in b]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            return None
        spans = lambda tokens: [(sum(map(len, tokens[:k])), sum(map(len, tokens[: k + 1]))) for k in range(len(tokens))]
        at_a, at_b = spans(of_a), spans(of_b)
        common = sorted({e for _, e in at_a} & {e for _, e in at_b})
        within = lambda at, ids, low, high: ",".join(str(k) for k, (s, e) in zip(ids, at, strict=True) if low <= s and e <= high)
        groups = [f"{within(at_a, a, low, high)}|{within(at_b, b, low, high)}" for low, high in zip([0, *common], common)]  # noqa: B905
        links = Counter((x, y) for x, (s, e) in zip(a, at_a, strict=True) for y, (t, f) in zip(b, at_b, strict=True) if s < f and t < e)
        return len(a), len(b), groups, links


def expected_links(rows):
    whole = Whole()
    found = [whole(t) for _, t in rows]
    counts = Counter(pair for f in found if f for pair in f[3])
    tops = {}
    for (a, _), n in counts.items():
        tops[a] = max(tops.get(a, 0), n)
    out = []
    for (i, _), f in zip(rows, found, strict=True):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        out.append((i, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == tops[p[0]]), sum(n * counts[p] for p, n in links.items()), sha(";".join(groups))))
    return out


def odd_texts(n):
    rng = random.Random(4)
    parts = ["ab", " e", "1", "🙂", "é", "中文", "\n", ".", "▁", "  ", " the ", "'s", " 's", "<|endoftext|>", " <s>", "\t ", "　", "_", "\x1c ", "\x85", " unbelievable", " naïveté", " of"]
    return ["".join(rng.choices(parts, [4] * 8 + [1] + [4] * (len(parts) - 9), k=rng.randrange(40))) for _ in range(n)]


@models
@pytest.mark.parametrize("rare", [False, True])
def test_links(table, monkeypatch, rare):
    """With few parts no pair is frequent enough for a broadcast, and all are joined by a shuffle."""
    monkeypatch.setattr(tokenizer_alignment, "PARTS", 3 if rare else 100_000)
    rows = list(enumerate(odd_texts(250))) + [(i, t) for i, t in ODD if i != 5] + [(400, "the of the " * 9), (401, "the of the " * 9)]
    tokenizer, data = piece_model.load(tokenizer_alignment.BYTE_PATH).decode(), piece_model.load(MODEL_PATH)
    got = [tuple(r) for r in tokenizer_alignment.links(table(rows), tokenizer, data).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected_links(rows)))
    assert sum(r[1] > 0 for r in got) > 100


@models
def test_long_and_empty_tables_of_links(table):
    tokenizer, data = piece_model.load(tokenizer_alignment.BYTE_PATH).decode(), piece_model.load(MODEL_PATH)
    assert tokenizer_alignment.links(table([]), tokenizer, data).collect() == []
    (row,) = tokenizer_alignment.links(table([(5, "x " * 20_000)]), tokenizer, data).collect()
    assert row.n_links > 20_000 and row.n_best == row.n_links


def test_alignment_of_any_cuttings():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randrange(1, 30)
        ends = [sorted({*rng.sample(range(1, n + 1), rng.randrange(n)), n}) for _ in range(2)]
        a, b = ([y - x for x, y in zip([0, *e], e)] for e in ends)  # noqa: B905
        groups, links = tokenizer_alignment.align(a, b)
        assert [sum(a[: up]) for _, up, _, _ in groups.tolist()] == sorted({*ends[0]} & {*ends[1]})
        spans = [[(x, y) for x, y in zip([0, *e], e)] for e in ends]  # noqa: B905
        assert links.tolist() == [[i, j] for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]


def expected_copies(rows):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(i, keep[lower(t)], len(groups[lower(t)]), i == keep[lower(t)], sha(lower(t))) for i, t in rows]


@pytest.mark.parametrize("capacity, page", [(exact_dedup.CAPACITY, exact_dedup.PAGE), (3, 5), (1, 1)])
def test_copies(table, capacity, page):
    rng = random.Random(6)
    rows = [(k, rng.choice(["Copy of MANY", "copy of many", f"text {rng.randrange(60)}", f"TEXT {rng.randrange(60)}", f"own {k}"])) for k in range(400)] + ODD
    got = [tuple(r) for r in exact_dedup.copies(table(rows), capacity, page).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected_copies(rows)))
    assert exact_dedup.copies(table([]), capacity, page).collect() == []


def test_texts_of_one_key_are_told_apart(table, monkeypatch):
    """With every text under one key, only the comparison of bytes separates them."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.length(c).cast("long") * 0)
    rows = [(k, f"text {k % 7}") for k in range(60)]
    got = [tuple(r) for r in exact_dedup.copies(table(rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected_copies(rows)))


def test_directory_splits_full_buckets(spark):
    keys = spark.range(3000).selectExpr("xxhash64(id) AS key").unionByName(spark.range(500).selectExpr("id AS key"))
    entries = exact_dedup.directory(keys, 100)
    bits = len(entries).bit_length() - 1
    counts = Counter(entries[(r.key % 2**64) >> (64 - bits)] for r in keys.collect())
    assert entries == sorted(entries) and set(entries) == set(range(entries[-1] + 1))
    crowded = [b for b, n in counts.items() if n > 100]
    assert len(crowded) == 1 and counts[crowded[0]] >= 500  # these keys have their first bits in common
    assert exact_dedup.directory(keys.limit(0), 100) == [0]


@tables
def test_copies_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got = exact_dedup.copies(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    theirs = con.sql(f"SELECT {', '.join(got.columns)} FROM ({exact_dedup.SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(theirs)


def test_copies_stay_in_the_jvm(table):
    """No Python runs in the plan, and equal texts meet without a shuffle of their own."""
    rows = table([(1, "a"), (2, "a")])
    plan = exact_dedup.copies(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
