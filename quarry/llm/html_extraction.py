"""Operator 5: main text of web pages by nearest-URL page differencing.

Pages of a host are put in the order of their URL paths, each is paired with the neighbour whose path is more like its own, the text lines of the two are aligned by longest common subsequence, and lines that
they share are deleted. Differencing alone can't tell right: menus and adverts may differ from page to page, and articles may quote the same passage. So marks veto and protect: furniture (menus, headers,
footers, sidebars, notices, adverts, forms, comments, scripts, styles) is never text, what is inside a marked article always is, and differencing decides all other lines of all pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_ready, map_batches, read, result, sized

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>", re.S | re.I)
HINTS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements and class, id or role words of furniture, elements that mark the article, elements that start a new block, elements without an end.
FURNITURE = frozenset("nav footer aside form menu dialog button select".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners cookie cookies consent notice notices alert comment comments commentlist disqus sidebar widget widgets menu navbar nav navigation breadcrumb"
    " breadcrumbs footer masthead popup modal newsletter subscribe subscription share sharing social related recommended recommendations promo promotion sponsor sponsored skip toolbar pagination pager search login"
    " signup complementary contentinfo".split()
)
ARTICLE = frozenset(("article", "main"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary"
    " table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = frozenset("p li dt dd td th tr".split())
HASH = "page_id long, of long, host string, path string, lines array<long>"


def _is_furniture(name: str, attributes: str, inside: bool) -> bool:
    if name in FURNITURE or name == "header" and not inside:
        return True
    for found in HINTS.finditer(attributes):
        for word in re.split(r"[^a-z0-9]+", (found[1] or found[2] or found[3] or "").lower()):
            if word in WORDS:
                return name not in ("html", "body")
    return False


def blocks(page: str) -> tuple[list[str], list[bool]]:
    """The text blocks of a page outside furniture, in page order, and whether each is in a marked article. References are decoded and white space in a block is one space."""
    texts: list[str] = []
    inside: list[bool] = []
    parts: list[str] = []
    article = skip = last = 0
    skipped = ""

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                texts.append(text)
                inside.append(article > 0)

    for m in TOKEN.finditer(page):
        if not skip and m.start() > last:
            parts.append(page[last : m.start()])
        last = m.end()
        name = (m[3] or "").lower()
        if m[1]:
            parts.append(" " if not skip else "")
            continue
        if not name:
            continue
        end = bool(m[2])
        if skip:
            if skipped in SELF_CLOSING and name in BLOCKS and (name != skipped or not end):
                skip = 0  # the next block ends it, though it has no end tag
            elif name == skipped:
                skip += -1 if end else 1
            if skip or end and name == skipped:
                continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if not end and name not in VOID and not m[4].rstrip().endswith("/") and _is_furniture(name, m[4], article > 0):
            flush()
            skip, skipped = 1, name
        elif name in ARTICLE:
            article = max(0, article + (-1 if end else 1))
    if not skip and last < len(page):
        parts.append(page[last:])
    flush()
    return texts, inside


def _hashes(texts: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, len(texts)).view(np.int64)


#: Cells of an alignment table that are held at once; longer middles are halved first, in two rows of memory.
CELLS = 1 << 22


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The length of a longest common subsequence of x with each beginning of y."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        row[1:] = np.maximum.accumulate(np.where(y == v, row[:-1] + 1, row[1:]))
    return row


def _aligned(x: np.ndarray, y: np.ndarray, at: int) -> list[int]:
    """Places of x, counted from `at`, of a longest common subsequence with y."""
    if not len(x) or not len(y):
        return []
    if len(x) == 1:
        return [at] if (y == x[0]).any() else []
    if len(x) * len(y) > CELLS:  # halved where the two halves have most in common with the two parts of y
        half = len(x) // 2
        cut = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
        return _aligned(x[:half], y[:cut], at) + _aligned(x[half:], y[cut:], at + half)
    size = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        match = np.where(y == x[i], size[i + 1, 1:] + 1, size[i + 1, :-1])
        size[i, :-1] = np.maximum.accumulate(match[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append(at + i)
            i, j = i + 1, j + 1
        elif size[i + 1, j] >= size[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence with b. Equal ends are matched first, and lines of only one of them left out."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = np.array(a[start : len(a) - end], np.int64), np.array(b[start : len(b) - end], np.int64)
    common = np.intersect1d(x, y)
    xs, ys = np.flatnonzero(np.isin(x, common)), np.flatnonzero(np.isin(y, common))
    middle = [start + int(xs[k]) for k in _aligned(x[xs], y[ys], 0)]
    return [*range(start), *middle, *range(len(a) - end, len(a))]


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


PAIRED = HASH + ", open boolean, shared array<int>, edge boolean"
_SCHEMA = pa.schema([("page_id", pa.int64()), ("of", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64())), ("open", pa.bool_()), ("shared", pa.list_(pa.int32())), ("edge", pa.bool_())])


def _shared(left: dict | None, row: dict, right: dict | None) -> list[int]:
    """What is to be deleted from a page, given the pages before and after it in URL order. A neighbour that leaves it no line of its own has a copy of it: then the other one is asked."""
    near = [x for x in (left, right) if x and x["host"] and x["host"] == row["host"] and x["page_id"] != row["page_id"]]
    for x in sorted(near, key=lambda x: -_alike(x["path"], row["path"])):
        if len(found := shared_lines(row["lines"], x["lines"])) < len(row["lines"]):
            return found
    return []


def _paired(last_pass: bool):
    """A pass over partitions in URL order. The first decides all pages but the first and last of a partition, whose neighbours are elsewhere: these are `open` and come again as `edge` rows, along with the pages
    next to them. The last pass, over the edge rows of all partitions, decides the open ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: dict | None = None
        row: dict | None = None
        n = 0
        edges: list[dict] = []
        out: list[dict] = []

        def decide(after: dict | None) -> None:
            if row is None or (last_pass and not row["open"]) or (not last_pass and (before is None or after is None)):
                return
            if found := _shared(before, row, after):
                out.append(row | {"shared": found, "edge": False})

        def batch() -> pa.RecordBatch:
            found = pa.RecordBatch.from_pylist([{k: r.get(k) for k in _SCHEMA.names} for r in out], _SCHEMA)
            out.clear()
            return found

        for part in batches:
            for after in part.to_pylist():
                decide(after)
                before, row, n = row, after, n + 1
                if n <= 2:
                    edges.append(row)
            yield batch()
        decide(None)
        if not last_pass and row is not None:
            ends = {id(r): r for r in [*edges, *([before] if before else []), row]}
            out += [r | {"open": r is edges[0] or r is row, "edge": True} for r in ends.values()]
        yield batch()

    return run


def differences(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, of (hash of url and html), shared: line numbers to delete. Pages of a host with equal lines are copies: the first in URL order is paired for all of them, with pages that aren't."""
    arrow_ready(pages.sparkSession, 256)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = [_hashes(blocks(value.as_py().decode("utf-8", "replace"))[0]) for value in batch["html"]]
        return pa.record_batch([batch["page_id"], batch["of"], batch["host"], batch["path"], pa.array(lines, pa.list_(pa.int64()))], ["page_id", "of", "host", "path", "lines"])

    url = F.coalesce("url", F.lit(""))
    keyed = pages.withColumns({"host": F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), "path": F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)})
    rows = map_batches(keyed.select("page_id", "of", "host", "path", "html"), run, HASH)
    order = ["host", "path", "page_id", "of"]
    kept = scratch.keep(rows.where("host <> '' and size(lines) > 0").withColumn("copy", F.xxhash64("lines")))
    one = kept.groupBy("host", "copy").agg(F.min_by(F.struct("page_id", "of", "path", "lines"), F.struct("path", "page_id", "of")).alias("r")).select("r.page_id", "r.of", "host", "r.path", "r.lines")
    ranged = one.withColumn("open", F.lit(False)).repartitionByRange(*order).sortWithinPartitions(*order)
    first = scratch.keep(ranged.mapInArrow(_paired(False), PAIRED))
    ends = first.where("edge").drop("shared", "edge").coalesce(1).sortWithinPartitions(*order)  # at most four pages of each partition
    second = ends.mapInArrow(_paired(True), PAIRED)
    found = first.where("not edge").unionByName(second).select("host", F.xxhash64("lines").alias("copy"), "shared")
    return kept.select("page_id", "of", "host", "copy").distinct().join(found, ["host", "copy"]).select("page_id", "of", "shared")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page. Null or empty html gives an empty text; very long pages are taken whole; of neighbours whose paths are equally like a page's own the one before it is asked first; a page without a URL has no neighbours; repeated rows each give a row and aren't neighbours of each other; pages that share all their lines lose none; further
    columns are ignored. Blocks are joined in page order by a line feed."""
    arrow_ready(pages.sparkSession, 256)
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html")).withColumn("of", F.xxhash64("url", "html"))
    with Scratch(pages.sparkSession) as scratch:
        gone = result(differences(body, scratch))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for value, shared in zip(batch["html"], batch["shared"].to_pylist(), strict=True):
            texts, inside = blocks(value.as_py().decode("utf-8", "replace"))
            drop = set(shared or ())
            keep = [marked or k not in drop for k, marked in enumerate(inside)]
            out.append("\n".join(t for t, k in zip(texts, keep, strict=True) if k))
        return pa.record_batch([batch["page_id"], batch["url"], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = body.join(sized(gone), ["page_id", "of"], "left").select("page_id", "url", "html", "shared")
    return map_batches(joined, run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
