"""Operator 12: runs of repeated word sequences. At dyadic scales each block of words is convolved with the words after it; places where the squared differences sum to nothing give distances, from which runs are extended.

A run of period d in [B, 2B) and length 3d holds a whole aligned block of B words and its next occurrence, d words on: one of the scales B = 8, 16, 32, ... sees every run (the first one also takes the periods below 8,
whose runs have 24 words). Sums are exact modulo a prime by a number-theoretic transform; a zero modulo the prime that isn't one is found out when the seed is extended, and a real occurrence is always a zero.
Blocks are left out of the convolution only where they can't have an occurrence in their window, or none but those of a run that is known.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_ready, as_bytes, chunks, map_batches, read

#: A prime with roots of unity of order 2 ** 23, and a generator of its units.
PRIME, GENERATOR = 998244353, 3
_P = np.uint64(PRIME)
#: The smallest block, the words and the repetitions that make a run, and the numbers that a transform works on at once.
FIRST, LEAST, TIMES, AT_ONCE = 8, 24, 3, 1 << 17
#: The longest block that one transform can take with its window; longer ones are compared in parts of this size.
LARGEST = 1 << 21

Run = tuple[int, int, int]  # start, length, period


@lru_cache(maxsize=64)
def _roots(half: int, inverse: bool) -> np.ndarray:
    """The powers 0 to half - 1 of a root of unity of order 2 * half."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    out = np.ones(half, np.uint64)
    size = 1
    while size < half:  # doubled from the front
        out[size : 2 * size] = out[:size] * np.uint64(pow(root, size, PRIME)) % _P
        size *= 2
    return out


def _transform(x: np.ndarray) -> np.ndarray:
    """The transform of each row, in bit-reversed order."""
    rows, n = x.shape
    half = n // 2
    while half:
        x = x.reshape(rows, -1, 2, half)
        a, b = x[:, :, 0], x[:, :, 1]
        total, rest = a + b, a + (_P - b)
        x = np.stack((np.minimum(total, total - _P), rest * _roots(half, False) % _P), axis=2)
        half //= 2
    return x.reshape(rows, n)


def _back(x: np.ndarray) -> np.ndarray:
    """The inverse transform of each row, from bit-reversed order."""
    rows, n = x.shape
    half = 1
    while half < n:
        x = x.reshape(rows, -1, 2, half)
        a, b = x[:, :, 0], x[:, :, 1] * _roots(half, True) % _P
        total, rest = a + b, a + (_P - b)
        x = np.stack((np.minimum(total, total - _P), np.minimum(rest, rest - _P)), axis=2)
        half *= 2
    return x.reshape(rows, n) * np.uint64(pow(n, PRIME - 2, PRIME)) % _P


def differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each row, the sum of squared differences modulo the prime between the block and the window's words from place d on, d = 0, 1, ... as far as the block fits. A window's width is a power of two."""
    size, width = blocks.shape[1], windows.shape[1]
    turned = np.zeros(windows.shape, np.uint64)
    turned[:, :size] = blocks[:, ::-1]
    products = _back(_transform(turned) * _transform(windows) % _P)[:, size - 1 :]  # of a cyclic product, these places hold no others
    squares = np.zeros((len(windows), width + 1), np.uint64)
    np.cumsum(windows * windows % _P, axis=1, out=squares[:, 1:])
    own = (blocks * blocks % _P).sum(1, dtype=np.uint64)[:, None]
    return (own + squares[:, size:] - squares[:, : width - size + 1] + np.uint64(2) * (_P - products)) % _P


def _stretch(x: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The ends of the longest stretch about place `at` in which words d apart are identical."""
    high, step = at, 64
    while high + d < len(x):
        part = min(step, len(x) - d - high)
        differ = x[high : high + part] != x[high + d : high + d + part]
        k = int(differ.argmax())
        if differ[k]:
            high += k
            break
        high, step = high + part, 2 * step
    low, step = at, 64
    while low > 0:
        part = min(step, low)
        differ = x[low - part : low][::-1] != x[low - part + d : low + d][::-1]
        k = int(differ.argmax())
        if differ[k]:
            low -= k
            break
        low, step = low - part, 2 * step
    return low, high + d


def _primitive(x: np.ndarray, start: int, d: int) -> bool:
    """Whether d words from start on, which repeat after that, are no repetition of fewer words."""
    rest, f = d, 2
    while rest > 1:
        f = f if f * f <= rest else rest
        if rest % f:
            f += 1
            continue
        q = d // f
        if np.array_equal(x[start : start + d], x[start + q : start + q + d]):
            return False
        while rest % f == 0:
            rest //= f
    return True


class _Search:
    """The runs among the words of some documents, one after the other; x numbers the words, equal only within one document."""

    def __init__(self, x: np.ndarray, order: np.ndarray, ends: np.ndarray, lengths: np.ndarray):
        """order: places by word, then place; ends, lengths: of each place's document."""
        self.x, self.ends, self.lengths, self.n = x, ends, lengths, len(x)
        self.values = x.astype(np.uint64) % _P
        self.often = np.bincount(x, minlength=1)[x]
        self.places = x[order] * self.n + order
        self.runs: dict[Run, None] = {}

    def all(self) -> list[Run]:
        size, longest = FIRST, int(self.lengths.max(initial=0))
        while longest >= max(LEAST, TIMES * size):
            self._scale(size)
            size *= 2
        return list(self.runs)

    def _live(self, size: int, low: int) -> np.ndarray:
        """The starts of blocks that may occur again at a distance in [low, 2 * size) as part of an unknown run."""
        often = self.often[: self.n // size * size].reshape(-1, size)
        starts = np.arange(len(often)) * size
        live = (often.min(1) > 1) & (self.ends[starts] >= starts + size + low) & (self.lengths[starts] >= max(LEAST, TIMES * low))
        for start, length, _ in self.runs:
            end = start + length
            last = end - 1 if end == self.ends[start] else end - 3 * size
            live[-(-start // size) : max(0, last // size + 1)] = False  # their occurrences are that run's own
        starts = starts[live]
        at = starts + often[live].argmin(1)  # the block's rarest word must occur there
        base = self.x[at] * self.n + at
        following = np.append(self.places, np.iinfo(np.int64).max)[np.searchsorted(self.places, base + low)]
        return starts[following < base + 2 * size]

    def _scale(self, size: int) -> None:
        low = 1 if size == FIRST else size
        starts = self._live(size, low)
        part = min(size, LARGEST)
        width = 4 * FIRST if size == FIRST else 2 * part
        padded = np.concatenate([self.values, np.zeros(3 * size + width, np.uint64)])
        found = []
        each = max(1, AT_ONCE // width)
        for k in range(0, len(starts), each):
            own = starts[k : k + each, None]
            blocks = padded[own + np.arange(part)]
            for step in range(low, 2 * size, width - part):
                zero = differences(blocks, padded[own + step + np.arange(width)]) == 0
                row, d = np.nonzero(zero)
                found.append(np.stack([own[row, 0], d + step]))
        if found:
            b, d = np.concatenate(found, axis=1)
            fits = (d < 2 * size) & (b + d + size <= self.ends[b])
            self._extend(b[fits], d[fits], size)

    def _extend(self, b: np.ndarray, d: np.ndarray, size: int) -> None:
        """Extends each seed (block start, distance), by block and distance, unless it lies in a stretch that is known to have a period of which its distance is a multiple."""
        order = np.lexsort((d, b))
        b, d = b[order], d[order]
        alive = np.ones(len(b), bool)

        def settle(start: int, end: int, period: int) -> None:
            i, j = np.searchsorted(b, (start, end))
            alive[i:j] &= (d[i:j] % period != 0) | (b[i:j] + d[i:j] + size > end)

        for start, length, period in self.runs:
            settle(start, start + length, period)
        for k in range(len(b)):
            if not alive[k]:
                continue
            at, period = int(b[k]), int(d[k])
            if not np.array_equal(self.x[at : at + size], self.x[at + period : at + period + size]):
                continue
            start, end = _stretch(self.x, at, period)
            settle(start, end, period)
            if end - start >= max(LEAST, TIMES * period) and _primitive(self.x, start, period):
                self.runs[start, end - start, period] = None


def _codes(words: list[bytes]) -> np.ndarray:
    """Equal numbers for identical words."""
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)


def runs_of(documents: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each document's words, by start, then period."""
    sizes = np.array([len(w) for w in documents], np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[Run]] = [[] for _ in documents]
    if not edges[-1]:
        return out
    codes = _codes([w for words in documents for w in words])
    key = np.repeat(np.arange(len(documents)), sizes) * (codes.max() + 1) + codes
    order = np.argsort(key, kind="stable")
    x = np.empty_like(key)
    x[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
    for start, length, period in sorted(_Search(x, order, np.repeat(edges[1:], sizes), np.repeat(sizes, sizes)).all(), key=lambda r: (r[0], r[2])):
        k = int(np.searchsorted(edges, start, "right")) - 1
        out[k].append((start - int(edges[k]), length, period))
    return out


def folded(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document as the query has them: those of a tenth of the ids go round in a circle from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that repeat a run's first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [words[k] for k in np.flatnonzero(~gone).tolist()]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(docs: DataFrame, words_of=folded) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the run of the greatest exponent (ties: the first start, then the least period), sha256 of the list of runs and of the words that stay, for each row.
    words_of(words, doc_id) gives the words that are searched.

    A null or empty text, or one of white space, has no words and no runs; very long texts are searched whole; a row without id is searched as it is; repeated rows each give a row; further columns are ignored; an empty
    table gives no rows."""
    arrow_ready(docs.sparkSession)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batch: pa.RecordBatch):
        ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
        for low, high in chunks(texts):
            documents = [words_of(texts[k].split(), ids[k]) for k in range(low, high)]
            rows = []
            for k, words, runs in zip(range(low, high), documents, runs_of(documents), strict=True):
                best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                rows.append((ids[k], len(runs), *told, sha(listed.encode()), sha(b" ".join(collapsed(words, runs)))))
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(c, pa.string() if i > 5 else pa.int64()) for i, c in enumerate(columns)], [x.split()[0] for x in SCHEMA.split(", ")])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text")), run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
