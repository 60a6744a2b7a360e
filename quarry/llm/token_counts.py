"""Operator 10: token counts. Distinct pre-tokens go into a trie; the forward pass is made once for each shared prefix, and each word's end holds its count.

For a unigram model the pass keeps the best score of each prefix. A model of merges (BPE) has no such scores: its numbers are the order of merges, and added up they give counts of no tokenizer. There the pass keeps
the last piece of each prefix instead: a prefix ends in the piece that encodes as itself and forms a lasting pair with the last piece of what is before it, where a pair lasts if its text encodes as these two. A
sequence of pieces is an encoding if all its neighbours last together, so one such piece fits, and counts are those of the tokenizer itself.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import piece_model
from .common import STEP, arrow_ready, as_bytes, map_batches, mix, read
from .piece_model import MARK
from .sentencepieces import MODEL_PATH, SEGMENT, build, words_of

#: Longer words, rare, are scored one by one: a level of the trie with a single node gains nothing from arrays.
LONGEST = 64
#: Words whose counts a task remembers (beyond it starts anew) and cells of a trie's arrays at once.
REMEMBERED, CELLS = 250_000, 2 << 20
FILTER_BITS = 22


class Pieces:
    """The pieces of a model by the hash of their characters. Byte pieces stand for characters that no piece covers, at the library's fixed penalty of 10 below the worst score."""

    def __init__(self, data: bytes, unigram: bool = False):
        """With unigram, the scores of a model of merges are taken for those of a unigram model."""
        self.model = piece_model.parse(data)
        plain = self.model.plain()
        self.texts, self.ids = list(plain), list(plain.values())
        self.core = words_of(data).bare if self.model.kind == piece_model.BPE and not unigram else None
        self.lasting: dict[int, bool] = {}
        if self.core:
            self.whole = np.array([len(e.ids) == 1 for e in self.core.encode_batch_fast(self.texts, add_special_tokens=False)], bool)
        self.score = {p: self.model.pieces[k][1] for p, k in plain.items()}
        self.longest = max(map(len, plain), default=1)
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        by_hash = sorted((int(self.hashes(p)[-1]), k) for k, p in enumerate(self.texts))
        self.keys, self.places = np.array([h for h, _ in by_hash], np.uint64), np.array([k for _, k in by_hash], np.int64)
        self.values = np.array([self.score[p] for p in self.texts])
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(LONGEST, STEP, np.uint64)]))
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[self.slot(self.keys)] = True

    @staticmethod
    def hashes(text: str) -> np.ndarray:
        h, out = np.uint64(0), []
        with np.errstate(over="ignore"):
            for c in text:
                h = h * STEP + mix(np.array([ord(c) + 1], np.uint64))[0]
                out.append(h)
        return np.array(out, np.uint64)

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return mix(h) >> np.uint64(64 - FILTER_BITS)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of the piece of each hash, -1 where there is none. A small bitmap spares most searches."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.seen[self.slot(h)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        out[maybe[hit]] = self.places[at[hit]]
        return out

    def last_together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces lasts; nothing joins with what no piece covers (left -1). Each pair is encoded once."""
        n = len(self.texts)
        keys, back = np.unique(np.where(left < 0, -1, left * n + right), return_inverse=True)
        new = [k for k in keys.tolist() if k >= 0 and k not in self.lasting]
        if new:
            if len(self.lasting) > REMEMBERED * 4:
                self.lasting.clear()
                new = [k for k in keys.tolist() if k >= 0]
            found = self.core.encode_batch_fast([self.texts[k // n] + self.texts[k % n] for k in new], add_special_tokens=False)
            plain = self.ids
            self.lasting.update((k, e.ids == [plain[k // n], plain[k % n]]) for k, e in zip(new, found, strict=True))
        return np.array([k < 0 or self.lasting[k] for k in keys.tolist()], bool)[back]


@lru_cache(maxsize=4)
def pieces_of(data: bytes) -> Pieces:
    return Pieces(data)


def count_one(word: str, pieces: Pieces) -> int:
    """Tokens of a word on its own: by merges, or the best path of pieces, of equal ones that with the longest last piece."""
    if pieces.core:
        return len(pieces.core.encode(word, add_special_tokens=False).ids)
    best, count, lost = [0.0], [0], [False]
    for end in range(1, len(word) + 1):
        top = (-np.inf, 0, False)
        for start in range(max(0, end - pieces.longest), end):
            s = pieces.score.get(word[start:end])
            if s is not None and best[start] + s > top[0]:
                top = (best[start] + s, count[start] + 1, False)
        if word[end - 1] not in pieces.score and best[end - 1] + pieces.unknown > top[0]:
            own = len(word[end - 1].encode("utf-8", "replace")) if pieces.model.byte_fallback else 1 - lost[end - 1]
            top = (best[end - 1] + pieces.unknown, count[end - 1] + own, True)
        best.append(top[0]), count.append(top[1]), lost.append(top[2])
    return count[-1]


def _trie_counts(words: list[str], pieces: Pieces) -> np.ndarray:
    """Counts of sorted distinct words of at most LONGEST characters. Node (i, d) is the first d characters of word i, where i is the first word with them; level by level, all nodes of a level at once."""
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    width = int(sizes.max())
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.zeros((n, width), np.uint32)
    inside = np.arange(width) < sizes[:, None]
    chars[inside] = flat
    differs = np.ones((n, width), bool)
    differs[1:] = np.logical_or.accumulate((chars[1:] != chars[:-1]) | ~inside[:-1], axis=1)
    score = np.zeros((width + 1, n))
    count = np.zeros((width + 1, n), np.int32)
    lost = np.zeros((width + 1, n), bool)
    prefix = np.zeros((width + 1, n), np.uint64)
    first = np.zeros((width + 1, n), np.int32)  # the word that holds the node of each word's prefix
    last = np.full((width + 1, n), -1, np.int32)  # of a model of merges: the last piece of each node
    out = np.zeros(n, np.int64)
    for d in range(1, width + 1):
        node = np.flatnonzero(inside[:, d - 1] & differs[:, d - 1])
        mark = np.zeros(n, np.int32)
        mark[node] = node
        first[d] = np.maximum.accumulate(mark)
        c = chars[node, d - 1]
        up = first[d - 1][node] if d > 1 else np.zeros(len(node), np.int32)
        own = prefix[d - 1][up] * STEP + mix(c.astype(np.uint64) + np.uint64(1))
        prefix[d][node] = own
        best, tokens = np.full(len(node), -np.inf), np.zeros(len(node), np.int32)
        if pieces.core:
            open_ = np.arange(len(node))
            single = pieces.find(own - prefix[d - 1][up] * pieces.powers[1]) >= 0
            for k in range(min(d, pieces.longest), 0, -1):
                at = first[d - k][node[open_]] if d > k else np.zeros(len(open_), np.int32)
                piece = pieces.find(own[open_] - prefix[d - k][at] * pieces.powers[k])
                hit = np.flatnonzero((piece >= 0) & pieces.whole[piece])
                if d > k and len(hit):
                    hit = hit[pieces.last_together(last[d - k][at[hit]].astype(np.int64), piece[hit])]
                tokens[open_[hit]] = count[d - k][at[hit]] + 1
                last[d][node[open_[hit]]] = piece[hit]
                open_ = np.delete(open_, hit)
                if not len(open_):
                    break
            best[:] = 0.0
            best[open_] = -np.inf  # characters that no piece covers
        for k in () if pieces.core else range(min(d, pieces.longest), 0, -1):
            at = first[d - k][node] if d > k else np.zeros(len(node), np.int32)
            piece = pieces.find(own - prefix[d - k][at] * pieces.powers[k])
            if k == 1:
                single = piece >= 0
            s = np.where(piece >= 0, pieces.values[piece] + score[d - k][at], -np.inf)
            better = s > best
            best[better] = s[better]
            tokens[better] = count[d - k][at[better]] + 1
        s = np.where(single, -np.inf, score[d - 1][up] + pieces.unknown)
        better = np.isinf(best) if pieces.core else s > best
        if better.any():
            x = c[better]
            extra = 1 + (x >= 0x80).astype(np.int32) + (x >= 0x800) + (x >= 0x10000) if pieces.model.byte_fallback else 1 - lost[d - 1][up[better]].astype(np.int32)
            best[better] = 0.0 if pieces.core else s[better]
            tokens[better] = count[d - 1][up[better]] + extra
        score[d][node], count[d][node], lost[d][node] = best, tokens, better
        done = np.flatnonzero(sizes == d)
        out[done] = count[d][first[d][done]]
    return out


def count_words(words: list[str], pieces: Pieces) -> list[int]:
    """Tokens of each of the distinct words, in their order."""
    order = sorted(range(len(words)), key=words.__getitem__)
    out = [0] * len(words)
    short = [k for k in order if 0 < len(words[k]) <= LONGEST]
    for k in order:
        if len(words[k]) > LONGEST:
            out[k] = count_one(words[k], pieces)
    for limit in (16, LONGEST):
        own = [k for k in short if len(words[k]) <= limit and (limit == 16 or len(words[k]) > 16)]
        for a in range(0, len(own), CELLS // limit):
            part = own[a : a + CELLS // limit]
            for k, c in zip(part, _trie_counts([words[k] for k in part], pieces).tolist(), strict=True):
                out[k] = c
    return out


@lru_cache(maxsize=4)
def _known(data: bytes) -> dict[str, int]:
    return {}


def count_texts(texts: list[str], data: bytes) -> list[tuple[int, int]]:
    """Pre-tokens and tokens of each text."""
    pieces, known, model = pieces_of(data), _known(data), piece_model.parse(data)
    if model.charsmap or model.squeeze:
        normal = [build(data).normalizer.normalize_str(t) for t in texts]
    else:
        normal = [((MARK if model.dummy_prefix else "") + t if t else "").replace(" ", MARK) for t in texts]
    cut = [SEGMENT.findall(t) if model.splits_before_mark else [t] * bool(t) for t in normal]
    if len(known) > REMEMBERED:
        known.clear()
    new = list({w for words in cut for w in words}.difference(known))
    known.update(zip(new, count_words(new, pieces), strict=True))
    return [(len(words), sum(map(known.__getitem__, words))) for words in cut]


def counts(docs: DataFrame, data: bytes) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of each row under the model. Very long texts are counted whole; a null or empty text has none; bytes that aren't UTF-8 count as the replacement character; repeated rows each give a row;
    a null id stays null; further columns are ignored."""
    arrow_ready(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = count_texts([t.decode("utf-8", "replace") for t in batch["text"].to_pylist()], data)
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array([a for a, _ in both], pa.int64()), pa.array([b for _, b in both], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return map_batches(docs.select("doc_id", as_bytes().alias("text")), run, "doc_id long, n_pretokens long, n_tokens long")


def query(spark: SparkSession, sf_dir: str, path: str = MODEL_PATH) -> DataFrame:
    return counts(read(spark, sf_dir, "documents"), piece_model.load(path))
