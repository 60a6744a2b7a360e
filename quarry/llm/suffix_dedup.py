"""Operator 7: removal of repeated byte strings of a minimum length, by threshold-bounded interval expansion on Burrows-Wheeler transforms.

Equal strings must meet in one block of text. Each window of LENGTH bytes is filed under its minimizer, the least hash of its grams of some length: equal windows have equal minimizers. A context is a run of
neighbouring windows of a document with one minimizer. Only minimizers that occur twice matter; equal contexts are merged and their first place kept before any shuffle; contexts of a minimizer go to one task.
There the transform of a block of contexts is built. Breadth-first backward extension assigns common prefixes by increasing value, 0, 1, 2, ..., and stops at LENGTH: between neighbours that are left without a
value the common prefix is at least LENGTH, so they start equal windows, of which all but the first in the corpus go. Distinct contexts of a minimizer with more text than a block holds are filed anew by
minimizers of longer grams, in the end by whole windows, so every block is settled by its transform.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_ready, as_bytes, map_batches, mix, read, result, sized

#: Gram sizes of minimizers, the next for what is too large with the one before it. Grams of LENGTH bytes are whole windows: each distinct one is a context of its own.
LENGTH, GRAMS = 100, (32, 64, 100)
#: Windows of a text that are hashed at once; bytes of a minimizer's contexts from which it counts as large. A block stays under 2**20 bytes, as three numbers share 64 bits.
SLAB, LARGE = 1 << 16, 1 << 19
_PLACE = np.uint64((1 << 17) - 1)
#: So many shared minimizers are sent to all tasks (8 bytes each); more are joined by a shuffle.
SENT = 4_000_000
LAST = 2**63 - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UP = np.cumprod(np.concatenate([[np.uint64(1)], np.full(SLAB + LENGTH, _BASE)]))
_DOWN = np.cumprod(np.concatenate([[np.uint64(1)], np.full(SLAB + LENGTH, np.uint64(pow(int(_BASE), -1, 2**64)))]))


def contexts(text: bytes, gram: int = GRAMS[0]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Minimizer, first window and number of windows of each context of a text, slab by slab. Of equal grams the leftmost counts, and another place begins another context, so no two windows of one are equal."""
    width = LENGTH - gram + 1
    for at in range(0, len(text) - LENGTH + 1, SLAB):
        a = np.frombuffer(text[at : at + SLAB + LENGTH - 1], np.uint8).astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(a * _UP[: len(a)])])
        grams = mix((sums[gram:] - sums[:-gram]) * _DOWN[: len(a) - gram + 1])
        m = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        n, step = len(a) - LENGTH + 1, 1
        while step * 2 <= width:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        m = np.minimum(m[:n], m[width - step : width - step + n])
        first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        yield grams[(m[first] & _PLACE).astype(np.int64)], at + first, np.diff(np.append(first, n))


def _order(text: np.ndarray) -> np.ndarray:
    """Places of a circular text in the order of the 128 symbols from there on, by doubling; each round sorts two ranks and the place packed in one number."""
    n = len(text)
    at = np.arange(n, dtype=np.uint64)
    rank = np.zeros(n, np.uint64)
    for k in range(4):
        rank = (rank << np.uint64(9)) | np.roll(text, -k).astype(np.uint64)
    keys = np.sort((rank << np.uint64(20)) | at)
    step = 4
    while True:
        order = (keys & np.uint64(0xFFFFF)).astype(np.int64)
        high = keys >> np.uint64(20)
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], high[1:] != high[:-1]])).astype(np.uint64)
        if step >= 128 or int(rank[order[-1]]) == n - 1:
            return order
        keys = np.sort((rank << np.uint64(40)) | (np.roll(rank, -step) << np.uint64(20)) | at)
        step *= 2


def long_matches(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The order of a circular text's places, and for each but the first whether it shares fewer than `length` symbols with the one before it.

    An interval holds the places from which one string starts. Extending the string at its front by each symbol before those places gives the intervals of strings one longer; where such an interval ends for
    the first time, neighbours share exactly the shorter string's length."""
    n = len(text)
    order = _order(text)
    before = text[order - 1]
    by_symbol = np.argsort(before, kind="stable")
    moved = np.empty(n, np.int64)
    moved[by_symbol] = np.arange(n)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    last, next_ = np.full(n, -1), np.full(n, n)
    last[by_symbol[1:][same]] = by_symbol[:-1][same]
    next_[by_symbol[:-1][same]] = by_symbol[1:][same]
    ends = np.zeros(n + 1, bool)
    ends[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        sizes = high - low
        total = int(sizes.sum())
        if not total:
            break
        at = np.arange(total) + np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        firsts = np.sort(moved[at[last[at] < np.repeat(low, sizes)]])
        lasts = np.sort(moved[at[next_[at] >= np.repeat(high, sizes)]]) + 1
        new = ~ends[lasts]
        ends[lasts[new]] = True
        low, high = firsts[new], lasts[new]
    return order, ends[1:n]


def repeats(texts: list[bytes], d: np.ndarray, t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of contexts, given with the document, tie-break and place of each one's first occurrence: the context and the byte spans (in the document) of the windows that are equal to one which comes
    earlier, by document, tie-break and place."""
    flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    flat[starts + sizes] = 0
    order, apart = long_matches(flat)
    by_place = np.lexsort((t, d))
    rank = np.empty(len(d), np.int64)
    rank[by_place] = np.cumsum(np.concatenate([[0], (np.diff(d[by_place]) != 0) | (np.diff(t[by_place]) != 0)]))
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    place = np.arange(len(flat)) - starts[owner]
    key = np.where(place + LENGTH <= sizes[owner], (rank[owner] << 40) + first[owner] + place, np.iinfo(np.int64).max)
    sorted_keys = key[order]
    group = np.flatnonzero(np.concatenate([[True], apart]))
    least = np.repeat(np.minimum.reduceat(sorted_keys, group), np.diff(np.append(group, len(order))))
    dup = np.zeros(len(flat) + 1, np.int8)
    dup[order] = (sorted_keys > least) & (sorted_keys < np.iinfo(np.int64).max)
    edge = np.flatnonzero(np.diff(dup, prepend=np.int8(0)))  # a context's last places start no window, so no run reaches over its end
    low, high = edge[::2], edge[1::2]
    of = owner[low]
    return of, first[of] + low - starts[of], first[of] + high - starts[of] - 1 + LENGTH


PARTS = "d long, t long, first int, own boolean, a int, b int"


def _parts(d: np.ndarray, t: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(d)
    return pa.record_batch([pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(first.astype(np.int32)), pa.array(np.ones(n, bool)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["d", "t", "first", "own", "a", "b"])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams contexts sorted by minimizer; whole minimizers are put into blocks. For each context's first place: a mark (a = b = 0), and the spans that are repeats."""
    texts: list[bytes] = []
    rows: list[np.ndarray] = []
    size = 0

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal texts, rows, size
        if texts:
            d, t, first = np.concatenate(rows, axis=1)
            of, a, b = repeats(texts, d, t, first)
            yield _parts(d[of], t[of], first[of], a, b)
        texts, rows, size = [], [], 0

    group: list[pa.RecordBatch] = []

    def close() -> Iterator[pa.RecordBatch]:
        """Ends the current minimizer, and the block if it is full. A context on its own, or its first place, repeats nothing."""
        nonlocal group, size
        if sum(map(len, group)) > 1:
            for part in group:
                own = part["text"].to_pylist()
                texts.extend(own)
                rows.append(np.stack([part[k].to_numpy().astype(np.int64) for k in ("d", "t", "start")]))
                size += sum(map(len, own)) + len(own)
        group = []
        if size >= LARGE:
            yield from done()

    of = None
    for batch in batches:
        if not len(batch):
            continue
        zero = np.zeros(len(batch), np.int32)
        yield _parts(batch["d"].to_numpy(), batch["t"].to_numpy(), batch["start"].to_numpy(), zero, zero)
        h = batch["h"].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])).tolist() + [len(h)]
        for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if (k or h[0] != of) and group:
                yield from close()
            if y - x > 1 or x == 0 or y == len(h):  # a minimizer within a batch that has one context is settled
                group.append(batch.slice(x, y - x))
        of = h[-1]
    yield from close()
    yield from done()


def _joined(parts: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Small batches put together to ones of about limit bytes, as each one that is sent costs time of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in parts:
        held.append(part)
        size += part.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _finer(texts: DataFrame, gram: int) -> DataFrame:
    """h, d, t, start, n, text: the contexts by minimizers of a longer gram within contexts (d, t, start, text)."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = zip(batch["text"], batch["d"].to_pylist(), batch["t"].to_pylist(), batch["start"].to_pylist(), strict=True)
        yield from _joined(_cut(value.as_py(), d, t, h.view(np.int64), first, n, at) for value, d, t, at in rows for h, first, n in contexts(value.as_py(), gram))

    return map_batches(texts.select("d", "t", "start", "text"), cut, CONTEXTS)


def _distinct(found: DataFrame) -> DataFrame:
    """Equal contexts as one, with their first place."""
    return found.groupBy("h", "text").agg(F.min(F.struct("d", "t", "start")).alias("r")).select("h", "text", "r.*")


def _places(found: DataFrame, level: int) -> DataFrame:
    """Each context's whole span, which goes unless the place is the first of its text."""
    return found.select("d", "t", F.col("start").alias("first"), F.lit(False).alias("own"), F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + LENGTH).alias("b"), F.lit(level).alias("level"))


def _spans(found: DataFrame, large: int, scratch: Scratch) -> DataFrame:
    """The rows of PARTS, with a level, for contexts found by the first gram size. A context and one made of it may begin at one place; the level tells their marks apart."""
    parts = None
    for level, gram in enumerate(GRAMS):
        merged = scratch.keep(_distinct(found))
        rows, rest, big = [_places(found, level)], merged, None
        if level + 1 < len(GRAMS):
            sizes = scratch.keep(merged.groupBy("h").agg(F.sum(F.length("text") + 1).alias("size")).where(F.col("size") >= large).select("h"))
            if not sizes.isEmpty():
                crowded = sized(sizes)
                big, rest = merged.join(crowded, "h", "left_semi"), merged.join(crowded, "h", "left_anti")
                rows.append(big.select("d", "t", F.col("start").alias("first"), F.lit(True).alias("own"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(level).alias("level")))
        rows.append(rest.repartition("h").sortWithinPartitions("h").mapInArrow(_settled, PARTS).withColumn("level", F.lit(level)))
        for row in rows:
            parts = row if parts is None else parts.unionByName(row)
        if big is None:
            return parts
        found = scratch.keep(_finer(big, GRAMS[level + 1]))
    return parts


def _merged(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The removed spans of each document, as one sorted list of starts and ends. Places that aren't a context's first are repeats as a whole."""
    lists = batch["all"]
    offsets = lists.offsets.to_numpy()
    rows = lists.flatten()
    first, own, a, b, level = (rows.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("first", "own", "a", "b", "level"))
    of = np.repeat(np.arange(len(batch)), np.diff(offsets))
    keys = (((of << 2) + level) << 32) + first
    use = (b > 0) & ((own == 1) | ~np.isin(keys, keys[own == 1]))
    low, high = ((of[use] << 32) + x[use] for x in (a, b))
    order = np.argsort(low)
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > reach[:-1]])[: len(low)]
    ends = reach[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)] if len(low) else reach
    spans = np.stack([low[new], ends], 1)
    count = np.bincount(spans[:, 0] >> 32, minlength=len(batch))
    flat = pa.array((spans & 0xFFFFFFFF).ravel().astype(np.int32))
    return pa.record_batch([batch["d"], batch["t"], pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * count)]).astype(np.int32)), flat)], ["d", "t", "spans"])


def _place() -> list[Column]:
    """d, t: the order of documents. Rows without id come last; of rows with one id, the text's hash decides."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(as_bytes()).alias("t"), as_bytes().alias("text")]


CONTEXTS = "h long, d long, t long, start int, n int, text binary"


def _cut(text: bytes, d: int, t: int, h: np.ndarray, first: np.ndarray, n: np.ndarray, at: int = 0) -> pa.RecordBatch:
    """Contexts of a text that itself begins at a place of its document."""
    parts = [text[a : a + k + LENGTH - 1] for a, k in zip(first.tolist(), n.tolist(), strict=True)]
    return pa.record_batch([pa.array(h), pa.array([d] * len(h), pa.int64()), pa.array([t] * len(h), pa.int64()), pa.array(first + at, pa.int32()), pa.array(n, pa.int32()), pa.array(parts, pa.binary())], ["h", "d", "t", "start", "n", "text"])


def shared_contexts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """h, d, t, start, n, text of each context whose minimizer occurs more than once."""
    rows = docs.select(*_place())

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield from _joined(pa.record_batch([pa.array(h.view(np.int64))], ["h"]) for value in batch["text"] for h, *_ in contexts(value.as_py()))

    def starts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield from _joined(all_starts(batch))

    def all_starts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for value, d, t in zip(batch["text"], batch["d"].to_pylist(), batch["t"].to_pylist(), strict=True):
            for h, first, n in contexts(value.as_py()):
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array([d] * len(h), pa.int64()), pa.array([t] * len(h), pa.int64()), pa.array(first, pa.int32()), pa.array(n, pa.int32())], ["h", "d", "t", "start", "n"])

    shared = scratch.keep(map_batches(rows.select("text"), count, "h long").groupBy("h").count().where("count > 1").select("h"))
    if shared.count() <= SENT:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(shared.toArrow()["h"].to_numpy()))  # at most SENT numbers

        def pick(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield from _joined(known_ones(batch))

        def known_ones(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            all_ = known.value
            if not len(all_):
                return
            for value, d, t in zip(batch["text"], batch["d"].to_pylist(), batch["t"].to_pylist(), strict=True):
                text = value.as_py()
                for h, first, n in contexts(text):
                    h = h.view(np.int64)
                    hit = all_[np.minimum(np.searchsorted(all_, h), len(all_) - 1)] == h
                    if hit.any():
                        yield _cut(text, d, t, h[hit], first[hit], n[hit])

        return map_batches(rows, pick, CONTEXTS)
    found = map_batches(rows, starts, "h long, d long, t long, start int, n int").join(shared, "h").groupBy("d", "t").agg(F.collect_set(F.struct("start", "h", "n")).alias("own"))

    def take(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = zip(batch["text"], batch["d"].to_pylist(), batch["t"].to_pylist(), batch["own"].to_pylist(), strict=True)
        yield from _joined(_cut(value.as_py(), d, t, *(np.array([x[k] for x in own], np.int64) for k in ("h", "start", "n"))) for value, d, t, own in rows)

    return map_batches(rows.join(found, ["d", "t"]), take, CONTEXTS)


def deduplicated(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) of each row: every byte goes that is covered by a LENGTH-byte string which also starts earlier, in a document of a smaller id
    or earlier in the same one, in the texts as they came.

    A null text is empty. Rows without id come last; rows with one id and one text are one document and get one result; of rows with one id and several texts the order of a text hash decides. Very long texts
    are taken whole; further columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    arrow_ready(spark, 256)
    with Scratch(spark) as scratch:
        found = scratch.keep(shared_contexts(docs, scratch))
        each = _spans(found, large, scratch).groupBy("d", "t").agg(F.collect_list(F.struct("first", "own", "a", "b", "level")).alias("all"))  # of one document
        gone = result(map_batches(each, _merged, "d long, t long, spans array<int>").where(F.size("spans") > 0))

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, removed, spans = [], [], []
        for value, own in zip(batch["text"], batch["spans"].to_pylist(), strict=True):
            text, own = value.as_py(), own or []
            edges = [0, *own, len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            removed.append(len(text) - len(kept[-1]))
            spans.append(len(own) // 2)
        sums = [hashlib.sha256(k).hexdigest() for k in kept]
        columns = [batch["doc_id"].cast(pa.int64()), pa.array([len(t.as_py()) for t in batch["text"]], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums, pa.string()), pa.array(kept, pa.binary())]
        return pa.record_batch(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    whole = docs.select("doc_id", *_place()).join(gone, ["d", "t"], "left").select("doc_id", "text", "spans")
    return map_batches(whole, remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents")).drop("kept")
