"""Operators 8 and 10 against the original library and brute force."""

import random
import struct
from pathlib import Path

import pytest
import sentencepiece

from quarry.llm import piece_model, sentencepieces, token_counts

pytestmark = pytest.mark.skipif(not Path(sentencepieces.MODEL_PATH).exists(), reason="no model file")
TEXTS = ["a  b", "  a", "a\n\nb", "a\tb", "é￿🙂  x ", "", "<s>a</s>", "<0x0A>", "x\0y", "▁x ▁ y", "▁", " ", "   ", " a", "the quick brown fox"]


@pytest.fixture(scope="module")
def data():
    return piece_model.load(sentencepieces.MODEL_PATH)


def some(n=800):
    rng = random.Random(2)
    return TEXTS + ["".join(rng.choice("ab e1 🙂é中\n.▁ the ") for _ in range(rng.randrange(60))) for _ in range(n)]


def test_parity_and_round_trip(data):
    original = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = some()
    theirs = [original.encode(t) for t in texts]
    assert sentencepieces.encode(texts, data) == theirs
    assert all(same for _, same, _ in sentencepieces.encoded(texts, data, verify=True))
    assert sentencepieces.decode(theirs, data) == [original.decode(t) for t in theirs]


def test_model_file(data):
    model, original = piece_model.parse(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert len(model.pieces) == original.get_piece_size()
    assert all(model.pieces[k][0] == original.id_to_piece(k) and model.pieces[k][1] == pytest.approx(original.get_score(k)) for k in range(0, len(model.pieces), 97))


def test_counts_match_single_words(data):
    pieces = token_counts.pieces_of(data)
    words = sorted({w for t in some() for w in token_counts.SEGMENT.findall(("▁" + t).replace(" ", "▁"))} | {"▁" + "ab" * 100, "x" * 65})
    assert token_counts.count_words(words, pieces) == [token_counts.count_one(w, pieces) for w in words]


def test_counts_match_the_original(data):
    original = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = [t for t in some(2000) if "\x00" not in t] + ["tokenisation of unbelievably long-winded, interwoven words " * 20, "x" * 500 + "中" * 70]
    assert [n for _, n in token_counts.count_texts(texts, data)] == [len(original.encode(t)) for t in texts]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").is_dir(), reason="no test tables")
def test_counts_of_documents_match_the_original(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = {r.doc_id: r.n_tokens for r in token_counts.counts(docs, data).collect()}
    assert counts == {r.doc_id: r.n_tokens for r in sentencepieces.digests(docs, data).collect()}


def test_counts_match_all_segmentations(data):
    pieces = token_counts.Pieces(data, unigram=True)

    def best(word):
        if not word:
            return 0.0, 0
        options = []
        for k in range(1, len(word) + 1):
            s = pieces.score.get(word[:k], pieces.unknown if k == 1 else None)
            if s is not None:
                rest = best(word[k:])
                options.append((s + rest[0], (1 if word[:k] in pieces.score else len(word[:k].encode())) + rest[1]))
        return max(options, key=lambda o: o[0])

    for word in ("▁there", "▁of中x", "▁aé🙂", "abcabc"):
        score, count = best(word)
        assert token_counts.count_one(word, pieces) == count


@pytest.mark.parametrize("rows", [[(1, None), (2, ""), (3, "ab " * 5000), (4, "x"), (4, "x"), (None, "y")], []])
def test_edge_cases(table, data, rows):
    docs = table(rows)
    for out in (sentencepieces.digests(docs, data), token_counts.counts(docs, data), sentencepieces.tokenised(docs, data)):
        got = out.collect()
        assert sorted(repr(r.doc_id) for r in got) == sorted(repr(i) for i, _ in rows)
    if rows:
        assert {(r.doc_id, r.n_tokens) for r in token_counts.counts(docs, data).collect() if r.doc_id in (1, 2)} == {(1, 0), (2, 0)}
        assert {r.doc_id: r.token_ids for r in sentencepieces.tokenised(docs, data).collect()}[1] is None


def unigram_model(byte_fallback, pieces):
    """A model file of the unigram kind, written out field by field: no tokenizer is trained."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    number, block = (lambda k, v: varint(k << 3) + varint(v)), (lambda k, v: varint(k << 3 | 2) + varint(len(v)) + v)
    piece = lambda text, score, kind: block(1, block(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + number(3, kind))
    out = piece("<unk>", 0.0, 2) + piece("<s>", 0.0, 3) + piece("</s>", 0.0, 3)
    out += b"".join(piece(f"<0x{k:02X}>", 0.0, 6) for k in range(256)) if byte_fallback else b""
    out += b"".join(piece(text, score, 1) for text, score in pieces.items())
    return out + block(2, number(3, 1) + (number(35, 1) if byte_fallback else b"")) + block(3, block(1, b"identity") + number(3, 1) + number(4, 0) + number(5, 1))


TIES = ["$$$", "$$$$$", "a $$$ b", "###", "x ### $$$ the of the", "ab" * 40, "thethe there", "éé 中 🙂 zz", "", " ", "a  b", "the $$$ the $$$ of"]


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_unigram_models(byte_fallback):
    """Ids, decoding, parity and counts under a unigram model, against the original over whole texts, with many cuttings of equal score."""
    scores = {"▁": -3.0, "▁the": -2.5, "the": -3.7, "re": -4.1, "▁of": -2.9, "$": -5.0, "$$": -6.3, "▁$": -5.5, "▁$$": -6.8, "#": -4.0, "##": -4.0, "ab": -3.3, "abab": -6.6, "aba": -5.1, "▁a": -3.1}
    scores |= {c: -7.0 - k / 8 for k, c in enumerate("abcdefghijklmnopqrstuvwxyé")}
    data = unigram_model(byte_fallback, scores)
    original = sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(6)
    texts = TIES + ["".join(rng.choice(["$", "$$", "#", "ab", "a", "b", " ", " the", "re", " of", "é", "中", "x"]) for _ in range(rng.randrange(30))) for _ in range(600)]
    theirs = [original.encode(t) for t in texts]
    ours = sentencepieces.encode(texts, data)
    assert [same for _, same, _ in sentencepieces.encoded(texts, data, verify=True)] == [a == b for a, b in zip(ours, theirs, strict=True)]
    assert sum(a == b for a, b in zip(ours, theirs, strict=True)) > 0.9 * len(texts)
    assert sentencepieces.decode(theirs, data) == [original.decode(t) for t in theirs]
    pieces = token_counts.pieces_of(data)
    assert pieces.core is None  # scores are added up, not merges followed
    words = sorted({w for t in texts for w in token_counts.SEGMENT.findall(("▁" + t).replace(" ", "▁"))})
    assert token_counts.count_words(words, pieces) == [token_counts.count_one(w, pieces) for w in words]
    counts = [n for _, n in token_counts.count_texts(texts, data)]
    assert sum(n == len(t) for n, t in zip(counts, theirs, strict=True)) >= 0.98 * len(texts)
