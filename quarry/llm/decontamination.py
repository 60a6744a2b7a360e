"""Operator 1: benchmark decontamination. Windows of item size are fingerprinted with SimHash, found among the items' fingerprints by multi-index Hamming blocks, and confirmed by exact weighted-shingle similarity.

SimHash features are single words, which an edited word changes in one place only; the confirming similarity is on shingles of five words, each weighing as often as it occurs. One changed word in forty turns
five shingles of 36 on either side, near 0.75, and about 5 of 64 bits. Only windows in which enough shingles are some item's at all are fingerprinted: with fewer, 0.75 is out of reach for every item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_ready, as_bytes, map_batches, mix, read, shingle_hashes, windows, word_hashes

SIZE, LEAST = 5, 0.75
#: Radius of the search in bits of 64, and blocks: of two fingerprints within the radius, one of the blocks of 8 bits differs in RADIUS // BLOCKS bits at most.
RADIUS, BLOCKS = 23, 8
#: Items are searched for in blocks of at most so many words, each with an index of bounded size that is sent to the tasks.
INDEX_WORDS = 1_000_000
#: Bits of a shingle's hash that look it up in a bitmap before the exact search.
FILTER_BITS = 22


def item_words(text: bytes) -> np.ndarray:
    """Hashes of the words in lower case; case is folded beyond A-Z too, as texts in capitals hold benchmark passages."""
    return word_hashes((text if text.isascii() else text.decode("utf-8", "replace").lower().encode()).lower().split())


def fingerprint_bits(words: np.ndarray) -> np.ndarray:
    """+1 or -1 for each word and bit."""
    return np.unpackbits(mix(words + np.uint64(1)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity: what two bags of shingles share over what they hold together."""
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


@dataclass
class Index:
    """Of a block of items: ids, word counts, shingle bags, fingerprints, all shingles, and a bitmap of them, and for each size, block of bits and value the items near it."""

    ids: np.ndarray
    sizes: np.ndarray
    bags: list[Counter]
    prints: np.ndarray
    shingles: np.ndarray
    seen: np.ndarray
    near: dict[int, list[tuple[np.ndarray, np.ndarray]]]


def index(items: list[tuple[int, np.ndarray]]) -> Index:
    prints = np.array([packed(fingerprint_bits(w).sum(0, keepdims=True))[0] for _, w in items], np.uint64)
    bags = [Counter(shingle_hashes(w, SIZE).tolist()) for _, w in items]
    sizes = np.array([len(w) for _, w in items], np.int64)
    values = np.arange(256, dtype=np.uint8)
    near: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        near[size] = []
        for b in range(BLOCKS):
            block = ((prints[own] >> np.uint64(8 * b)) & np.uint64(255)).astype(np.uint8)
            value, item = np.nonzero(np.bitwise_count(values[:, None] ^ block[None, :]) <= RADIUS // BLOCKS)
            near[size].append((np.searchsorted(value, np.arange(257)), own[item]))
    shingles = np.unique(np.concatenate([np.fromiter(x, np.uint64, len(x)) for x in bags]))
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[shingles >> np.uint64(64 - FILTER_BITS)] = True
    return Index(np.array([i for i, _ in items], np.int64), sizes, bags, prints, shingles, seen, near)


def candidates(prints: np.ndarray, size: int, ix: Index) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a window and an item of its size whose fingerprints are within the radius: all of them, as each agrees nearly in one of the blocks."""
    windows, items = [], []
    for b, (edges, own) in enumerate(ix.near[size]):
        value = ((prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)
        n = edges[value + 1] - edges[value]
        windows.append(np.repeat(np.arange(len(prints)), n))
        items.append(own[np.repeat(edges[value] - np.cumsum(n) + n, n) + np.arange(n.sum())])
    pairs = np.unique((np.concatenate(windows) << 32) | np.concatenate(items))
    window, item = pairs >> 32, pairs & 0xFFFFFFFF
    close = np.bitwise_count(prints[window] ^ ix.prints[item]) <= RADIUS
    return window[close], item[close]


def leaks(words: np.ndarray, ix: Index) -> dict[int, float]:
    """The items (by place) that some window of the words, of that item's number of words, reaches LEAST with, and the best similarity of each."""
    best: dict[int, float] = {}
    n = len(words)
    if not n:
        return best
    grams = shingle_hashes(words, SIZE)
    hit = ix.seen[grams >> np.uint64(64 - FILTER_BITS)]
    maybe = np.flatnonzero(hit)
    hit[maybe] = ix.shingles[np.minimum(np.searchsorted(ix.shingles, grams[maybe]), len(ix.shingles) - 1)] == grams[maybe]
    short = np.unique(ix.sizes[(ix.sizes < SIZE) & (ix.sizes <= n)])
    if not hit.any() and not len(short):
        return best
    sums = None
    for size in np.unique(ix.sizes[ix.sizes <= n]):
        own = grams
        if size < SIZE:  # an item of fewer words is one shingle: the whole sequence
            own = windows(words, int(size))
            starts = np.flatnonzero(np.isin(own, ix.shingles))
            width = 1
        else:
            width = int(size) - SIZE + 1
            total = np.concatenate([[0], np.cumsum(hit)])
            starts = np.flatnonzero(total[width:] - total[:-width] >= LEAST * width)
        if not len(starts):
            continue
        if sums is None:
            sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(fingerprint_bits(words), axis=0, dtype=np.int32)])
        for a in range(0, len(starts), 4096):
            part = starts[a : a + 4096]
            prints = packed(sums[part + size] - sums[part])
            bags: dict[int, Counter] = {}
            for w, k in zip(*(x.tolist() for x in candidates(prints, int(size), ix)), strict=True):
                if best.get(k, 0) == 1:
                    continue
                if w not in bags:
                    bags[w] = Counter(own[part[w] : part[w] + width].tolist())
                s = similarity(bags[w], ix.bags[k])
                if s >= LEAST and s > best.get(k, 0):
                    best[k] = s
    return best


def item_blocks(benchmark: DataFrame, words: int = INDEX_WORDS) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items with an id and at least one word, in blocks of at most `words` words in all (a longer item is one of its own)."""
    block: list[tuple[int, np.ndarray]] = []
    size = 0
    for row in benchmark.select("item_id", as_bytes().alias("text")).where("item_id is not null").dropDuplicates().orderBy("item_id").toLocalIterator():
        w = item_words(bytes(row["text"]))
        if len(w):
            if block and size + len(w) > words:
                yield block
                block, size = [], 0
            block.append((int(row["item_id"]), w))
            size += len(w)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity: for each document and benchmark item, the best similarity of a window of the document with as many words as the item has, where that is at least 0.75.

    Words are runs without ASCII white space, in lower case. An item of fewer than five words is one shingle. Null and empty texts and items hold nothing; rows without id are left out, as they can't be
    named; repeated rows give one result; further columns are ignored; an empty table gives no rows. Every item is searched for in every whole text, with the items in blocks of bounded size."""
    arrow_ready(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text")).where("doc_id is not null")
    out = None
    for block in item_blocks(benchmark):
        ix = docs.sparkSession.sparkContext.broadcast(index(block))  # at most INDEX_WORDS words

        def run(batch: pa.RecordBatch, ix=ix) -> pa.RecordBatch:
            found = [(d, int(ix.value.ids[k]), s) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True) for k, s in leaks(item_words(t.as_py()), ix.value).items()]
            return pa.record_batch([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "similarity"])

        part = map_batches(texts, run, "doc_id long, item_id long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double")
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no benchmark item, with all their columns, with or without an id and of whatever names. Null and empty texts hold none; very long ones are
    searched whole; repeated rows share one fate; an empty table gives no rows."""
    arrow_ready(docs.sparkSession)
    for block in item_blocks(benchmark):
        ix = docs.sparkSession.sparkContext.broadcast(index(block))  # at most INDEX_WORDS words

        def clean(batch: pa.RecordBatch, ix=ix) -> pa.RecordBatch:
            return batch.filter(pa.array([not leaks(item_words(t.as_py() or b""), ix.value) for t in batch["text"].cast(pa.binary())], pa.bool_()))

        docs = map_batches(docs, clean, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
