"""Statistics of one text that the quality operators (4 and 6) score and test."""

from __future__ import annotations

from collections import Counter

import numpy as np

from .common import shingle_hashes, word_hashes


def _bytes_of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


SPACE, SYMBOL, UPPER, DIGIT = (_bytes_of(x) for x in (b" \t\n\v\f\r", b"#*$%&|<>", bytes(range(65, 91)), b"0123456789"))
MARK, LETTER, CONTINUED = _bytes_of(b"!?"), _bytes_of(bytes([*range(65, 91), *range(97, 123)])), _bytes_of(bytes(range(0x80, 0xC0)))
STOP, BARE = _bytes_of(b".,;:"), _bytes_of(bytes(range(0xC0, 0x100)))

#: The counts that the contract of the quality rules names, then what the models take in.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "words_log", "mean_word", "symbol_share", "upper_share", "digit_share", "mark_share", "stop_share", "beyond_ascii", "dup_line_share", "repeat_share",
    "distinct_share", "same_as_last", "top_word_share", "mean_line", "pipe_words", "symbol_words", "mark_words", "short_words", "long_words", "capital_words",
    "bytes_log", "trigram_repeat", "odd_end", "word_entropy",
)


def stats(text: bytes, size: int = 5) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of a text, words being runs without ASCII white space, in their own case. An empty text has zeros throughout."""
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n, length = len(words), max(1, len(text))
    inside = len(text) - int(seen @ SPACE) - int(seen @ CONTINUED)
    symbols = int(seen @ SYMBOL)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    if not n:
        return [0, 0, symbols, 0, 0], [0.0] * len(FEATURES)
    hashes = word_hashes(words)
    repeated = 0
    if n >= size:
        _, at, times = np.unique(shingle_hashes(hashes, size), return_inverse=True, return_counts=True)
        twice = times[at] > 1
        if twice.any():
            edge = np.zeros(n + 1, np.int64)
            edge[: len(twice)] += twice
            edge[size : size + len(twice)] -= twice
            repeated = int((np.cumsum(edge[:n]) > 0).sum())
    times = np.unique(hashes, return_counts=True)[1]
    share = times / n
    pairs = np.unique(shingle_hashes(hashes, 3))
    sizes = np.fromiter(map(len, words), np.int64, n)
    last = Counter(w[-1] for w in words)
    letters = max(1, int(seen @ LETTER))
    features = [
        np.log1p(n), inside / n, symbols / length, int(seen @ UPPER) / letters, int(seen @ DIGIT) / length, int(seen @ MARK) / length, int(seen @ STOP) / length,
        int(seen @ BARE) / length, dup / max(1, len(lines)), repeated / n, len(times) / n, float((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0.0,
        float(share.max()), n / max(1, len(lines)), last[124] / n, sum(last[c] for c in b"*#$%&<>") / n, sum(last[c] for c in b"!?") / n,
        float((sizes <= 2).mean()), float((sizes >= 14).mean()), float(sum(w[:1].isupper() for w in words)) / n,
        np.log1p(len(text)), 1 - len(pairs) / max(1, n - 2), float(words[-1][-1] not in b".!?\"')"), float(-(share * np.log2(share)).sum()),
    ]
    return [n, inside, symbols, dup, repeated], features
