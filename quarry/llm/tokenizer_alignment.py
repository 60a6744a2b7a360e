"""Operator 11: tokens of two tokenizers, aligned. Of each text the cumulative ends of either tokenizer's tokens are kept in a dictionary from end to index; the ends that both dictionaries hold, in order, slice both lists
of ids into groups, and within each slice the tokens whose bytes overlap are linked. Pairs of linked ids are counted over the corpus by Spark.

Neither tokenizer joins anything over a single space after a character that isn't white space, so a text is cut there into stretches, of which each distinct one is encoded and aligned once in a task: the ends of stretches are
ends of tokens of both. Where the piece model may join over such a space, a text is one stretch.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from functools import lru_cache
from itertools import accumulate, chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import piece_model
from .common import Scratch, arrow_ready, as_bytes, chunks, map_batches, read, result
from .piece_model import MARK
from .sentencepieces import MODEL_PATH, original

#: Where the byte-level tokenizer's file is, unless a caller or the environment names another.
BYTE_PATH = os.environ.get("BYTE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: Before a space that follows a letter, a digit or a visible ASCII sign, and has a word behind it.
CUT = re.compile(r"(?<=[!-~\w])(?= +[!-~\w])")
#: Stretches that a task remembers; beyond it starts anew, so its memory stays bounded.
REMEMBERED = 1_200_000
#: Pairs of at least this part of all linked pairs of documents, so at most so many, are broadcast with their counts; all others are joined by a shuffle, in which none is frequent.
PARTS = 100_000


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """Fixed rule of byte-level vocabularies: visible bytes stand for themselves, all others for the characters from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def align(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of two cuttings of the same bytes, given by the lengths of their tokens: the groups between common ends, as rows of index ranges (from, to, from, to), and the index pairs of tokens whose bytes overlap."""
    ends_a, ends_b = (dict(zip(accumulate(lengths), count(1))) for lengths in (a, b))  # noqa: B905 (one is endless)
    common = sorted(ends_a.keys() & ends_b.keys())
    up, to = (np.fromiter(map(ends.__getitem__, common), np.int64, len(common)) for ends in (ends_a, ends_b))
    i, j = (np.concatenate([[0], x[:-1]])[: len(x)] for x in (up, to))
    single = (up - i == 1) & (to - j == 1)
    links = [np.stack([i[single], j[single]], axis=1)]
    for of in zip(*(x[~single].tolist() for x in (i, up, j, to)), strict=True):
        links.append(np.array(_overlapping(a, b, of[:2], of[2:]), np.int64))
    found = np.concatenate(links)
    return np.stack([i, up, j, to], axis=1), found[np.lexsort((found[:, 1], found[:, 0]))]


def _overlapping(a: list[int], b: list[int], of_a: tuple[int, int], of_b: tuple[int, int]) -> list[tuple[int, int]]:
    """The overlapping pairs of a slice; both sides are walked once."""
    found, (x, last_x), (y, last_y) = [], of_a, of_b
    end_x, end_y = a[x], b[y]
    while True:
        found.append((x, y))
        x_done, y_done = end_x <= end_y, end_y <= end_x
        x, y = x + x_done, y + y_done
        if x == last_x or y == last_y:
            return found
        end_x += a[x] if x_done else 0
        end_y += b[y] if y_done else 0


class Stretches:
    """What a task knows of the stretches it has met: numbers of tokens and groups, the groups as text, and the linked id pairs, one after the other; none where the tokens' bytes aren't the stretch's own."""

    def __init__(self, tokenizer: str, data: bytes):
        self.a, self.b = Tokenizer.from_str(tokenizer), original(data)
        self.a.encode_special_tokens = True
        byte_of, vocabulary = _byte_of(), self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = {k: bytes(map(byte_of.__getitem__, t)) for t, k in vocabulary.items() if all(c in byte_of for c in t)}
        model = piece_model.parse(data)
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if kind == piece_model.BYTE else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]
        self.base = len(model.pieces)
        self.written = [*map(str, range(max(self.base, 1 + max(self.bytes_a, default=0))))]
        self.cuts = model.splits_before_mark and model.dummy_prefix and not model.charsmap and not model.squeeze
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.told: list[str | None] = []
        self.n_a: list[int] = []
        self.n_b: list[int] = []
        self.n_groups: list[int] = []
        self.pairs: list[bytes] = []
        gc.freeze()  # these only grow: going through them for garbage would cost a tenth of the time

    def cut(self, text: str) -> list[str]:
        """The stretches of a text with a space in front."""
        if not self.cuts:
            return [" " + text]
        if " ".join(text.split()) == text.replace("\n", " "):  # white space is single blanks and line ends: every blank is a cut
            return text.split(" ")
        return [s[1:] for s in CUT.split(" " + text)]

    def learn(self, cut: list[list[str]]) -> None:
        """Encodes the stretches that are new by both tokenizers and aligns them all at once, one after the other."""
        if len(self.place) > REMEMBERED:
            self._forget()
        new = list(set().union(*cut).difference(self.place))
        whole = [" " + s if self.cuts else s for s in new]
        a = self._ids_a(whole)
        b = self.b.encode(new if self.cuts else [s[1:] for s in new], num_threads=1)
        bytes_of = [s.encode() for s in whole]
        right = [True] * len(new) if self._same(a, b, bytes_of) else [self._same([x], [y], [s]) for x, y, s in zip(a, b, bytes_of, strict=True)]
        flat_a, flat_b = ([*chain.from_iterable(compress(ids, right))] for ids in (a, b))
        groups, links = align([len(self.bytes_a[k]) for k in flat_a], [len(self.bytes_b[k]) for k in flat_b])
        at_a, at_b = ([*map(self.written.__getitem__, ids)] for ids in (flat_a, flat_b))
        told = [",".join(at_a[i:up]) + "|" + ",".join(at_b[j:to]) if up - i + to - j > 2 else at_a[i] + "|" + at_b[j] for i, up, j, to in zip(*groups.T.tolist(), strict=True)]
        pairs = (np.array(flat_a, np.int64)[links[:, 0]] * self.base + np.array(flat_b, np.int64)[links[:, 1]]).tobytes()
        n_a, n_b = ([len(x) if good else 0 for x, good in zip(ids, right, strict=True)] for ids in (a, b))
        ends = np.cumsum(n_a)  # a stretch's end is a common end, so its groups and links are the next ones up to it
        g, k = (np.searchsorted(x, ends).tolist() for x in (groups[:, 0], links[:, 0]))
        self.place.update(zip(new, count(len(self.told))))  # noqa: B905 (one is endless)
        self.told += [";".join(told[x:y]) if good else None for x, y, good in zip([0, *g], g, right)]  # noqa: B905 (one is longer)
        self.pairs += [pairs[8 * x : 8 * y] for x, y in zip([0, *k], k)]  # noqa: B905 (one is longer)
        self.n_groups += [y - x for x, y in zip([0, *g], g)]  # noqa: B905 (one is longer)
        self.n_a += n_a
        self.n_b += n_b

    def _ids_a(self, whole: list[str]) -> list[list[int]]:
        """The byte-level tokenizer's ids of each stretch. As nothing is joined over a cut, the stretches are encoded as one text and told apart by their ends; where one ends in white space, one by one."""
        if self.cuts and not any(s[-1].isspace() for s in whole):
            ids = self.a.encode_batch_fast(["".join(whole)], add_special_tokens=False)[0].ids
            place = dict(zip(accumulate(len(self.bytes_a.get(k, b"")) for k in ids), count(1)))  # noqa: B905 (one is endless)
            ends = [0, *(place.get(end, -1) for end in accumulate(len(s.encode()) for s in whole))]
            if -1 not in ends:
                return [ids[i:j] for i, j in zip(ends, ends[1:])]  # noqa: B905 (one is longer)
        return [e.ids for e in self.a.encode_batch_fast(whole, add_special_tokens=False)]

    def _same(self, a: list[list[int]], b: list[list[int]], whole: list[bytes]) -> bool:
        """Whether the bytes of each stretch's tokens are its own, on both sides, and no token is without bytes."""
        joined, sizes = b"".join(whole), [*map(len, whole)]
        for ids, bytes_of in ((a, self.bytes_a.get), (b, self.bytes_b.__getitem__)):
            tokens = [*map(bytes_of, chain.from_iterable(ids))]
            if not all(tokens) or b"".join(tokens) != joined:
                return False
            ends = [0, *accumulate(map(len, tokens))]
            at = [ends[k] for k in accumulate(map(len, ids))]
            if at != [*accumulate(sizes)]:
                return False
        return True

    def aligned(self, cut: list[str]) -> tuple | None:
        """n_a, n_b, n_groups, n_links, the groups as text, the distinct linked pairs and how often each is linked; none where a token's bytes aren't the text's."""
        at = [*map(self.place.__getitem__, cut)]
        told = [*map(self.told.__getitem__, at)]
        if None in told:
            return None
        links = np.frombuffer(b"".join(map(self.pairs.__getitem__, at)), np.int64)
        pairs, times = np.unique(links, return_counts=True)
        return *(sum(map(n.__getitem__, at)) for n in (self.n_a, self.n_b, self.n_groups)), len(links), ";".join(told), pairs, times


@lru_cache(maxsize=2)
def _stretches(tokenizer: str, data: bytes) -> Stretches:
    return Stretches(tokenizer, data)


SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: long, times: int>>"


def aligned(docs: DataFrame, tokenizer: str, data: bytes) -> DataFrame:
    """row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and links (the distinct linked pairs of ids, as a * pieces + b, and their times) of each row; see links for what odd rows give."""

    def run(batch: pa.RecordBatch):
        known, rows, ids, texts = _stretches(tokenizer, data), batch["row"], batch["doc_id"], batch["text"].to_pylist()
        for low, high in chunks(texts, 1 << 20):
            whole = [t.decode("utf-8", "replace") for t in texts[low:high]]
            cut = [known.cut(t) if t and t.encode() == raw else [] for t, raw in zip(whole, texts[low:high], strict=True)]
            known.learn(cut)
            found = [known.aligned(c) if c else None for c in cut]
            numbers = [pa.array([f[k] if f else 0 for f in found], pa.int64()) for k in range(4)]
            told = pa.array([hashlib.sha256(f[4].encode()).hexdigest() if f else "" for f in found], pa.string())
            offsets = np.concatenate([[0], np.cumsum([len(f[5]) if f else 0 for f in found])])
            pairs, times = (np.concatenate([np.zeros(0, t), *(f[k] for f in found if f)]).astype(t) for k, t in ((5, np.int64), (6, np.int32)))
            links = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "times"]))
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
            yield pa.RecordBatch.from_arrays([rows[low:high], ids[low:high], *numbers, told, links], names)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"))
    return map_batches(numbered, run, SCHEMA)


def links(docs: DataFrame, tokenizer: str, data: bytes) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row, for a byte-level tokenizer's file (a) and a piece model's bytes (b). A pair's count is the number of rows in which it is linked.

    A null or empty text, one that isn't UTF-8 and one whose tokens' bytes aren't a space and the text (such as one with the white space mark in it) have no tokens: zeros, and '' for the groups. Very long texts are aligned
    whole; of pairs with equal counts all are best; repeated rows each count and give a row; further columns are ignored; an empty table gives no rows."""
    arrow_ready(docs.sparkSession, 128)
    base = len(piece_model.parse(data).pieces)
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(aligned(docs, tokenizer, data))
        linked = rows.select("row", F.inline("links"))
        counts = scratch.keep(linked.groupBy("pair").agg(F.count("*").alias("n")))
        of_a = F.floor(F.col("pair") / base)
        tops = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("top"))  # a row for each id of a vocabulary
        scored = scratch.keep(counts.join(F.broadcast(tops), of_a == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).cast("int").alias("best")))
        total = scored.agg(F.sum("n")).first()[0] or 0
        frequent = scored.where(F.col("n") * PARTS > total)  # fewer than PARTS rows: their counts add up to no more than the total
        met = linked.join(F.broadcast(frequent), "pair", "left")
        rare = F.when(F.col("n").isNull(), F.col("pair")).alias("rare")
        # one row for each document's frequent pairs, and one for each of its rare ones
        sums = met.groupBy("row", rare).agg(F.sum("times").alias("times"), F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        sums = scratch.keep(sums)
        others = sums.where("rare IS NOT NULL").join(scored, F.col("rare") == F.col("pair")).select("row", (F.col("times") * F.col("best")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
        both = sums.where("rare IS NULL").select("row", "n_best", "count_sum").unionByName(others)
        both = both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        whole = rows.drop("links").join(both, "row", "left")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        return result(whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"))


def query(spark: SparkSession, sf_dir: str, byte_path: str = BYTE_PATH, piece_path: str = MODEL_PATH) -> DataFrame:
    return links(read(spark, sf_dir, "documents"), piece_model.load(byte_path).decode(), piece_model.load(piece_path))
