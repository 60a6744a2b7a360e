"""Latent semantic similarity: a truncated singular value decomposition of a sparse table of weighed terms, by subspace iteration over blocks of the table.

The table is cut into blocks of rows and blocks of terms, each a row of Spark with its entries as arrays. A round multiplies every block by its terms' part of a basis, adds up the products by block of rows, multiplies back and
adds up by block of terms: two keyed aggregates. Only the Gram matrix of the basis, of at most (2 * components) ** 2 numbers, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import dropped, kept
from . import vectors

#: Words of two or more letters, digits or underscores; as many components at most; the share of the latent similarity, and the least documents that it is taken from.
WORD, COMPONENTS, SHARE, LEAST = r"[\p{L}\p{N}_]{2,}", 100, 0.3, 20
#: Rows and terms of a block, entries that are multiplied at once, and the relative change of the singular values that ends the rounds.
BLOCK_ROWS, BLOCK_TERMS, AT_ONCE, TOLERANCE = 4_096, 20_000, 4_096, 1e-9


def words(text: Column, stop: frozenset[str] = vectors.STOP) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(*stop)) if stop else found


def blocks(weights: DataFrame, terms: int) -> tuple[DataFrame, DataFrame]:
    """rb, tb, r, t, w: the entries of each block of a table (row, term, w) as arrays; and tb, n: the number of terms of each block of terms. Both kept."""
    of = F.pmod(F.xxhash64("term"), F.lit(max(1, -(-terms // BLOCK_TERMS)))).cast("int")
    known = weights.select("term").distinct().withColumn("tb", of)
    known = kept(known.withColumn("t", (F.row_number().over(Window.partitionBy("tb").orderBy("term")) - 1).cast("int")))
    entries = weights.join(known, "term").withColumn("rb", F.floor(F.col("row") / BLOCK_ROWS)).withColumn("r", (F.col("row") % BLOCK_ROWS).cast("int"))

    def gathered(block: pa.Table) -> pa.Table:
        order = np.lexsort([block[c].to_numpy() for c in ("t", "r")])
        lists = {c: pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), pa.array(block[c].to_numpy()[order])) for c in ("r", "t", "w")}
        return pa.table({"rb": block["rb"][:1], "tb": block["tb"][:1], **lists})

    # a task holds one block, at most BLOCK_ROWS rows' terms of one block of terms: lists that grow for many blocks at once are not counted as Spark's memory
    made = entries.select("rb", "tb", "r", "t", "w").groupBy("rb", "tb").applyInArrow(gathered, "rb long, tb int, r array<int>, t array<int>, w array<double>")
    return kept(made, wide=True), kept(known.groupBy("tb").agg(F.count("*").alias("n")))


def _matrix(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, width)


def _times(to: np.ndarray, of: np.ndarray, w: np.ndarray, right: np.ndarray, height: int) -> np.ndarray:
    """The product of a sparse matrix, given by its entries (to, of, w), with a dense one."""
    out = np.zeros((height, right.shape[1]))
    order = np.argsort(to, kind="stable")
    for k in range(0, len(order), AT_ONCE):
        part = order[k : k + AT_ONCE]
        rows = to[part]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[starts]] += np.add.reduceat(w[part, None] * right[of[part]], starts)
    return out


def _product(table: DataFrame, basis: DataFrame, width: int, forth: bool) -> DataFrame:
    """key, m: of the block table times a basis by tb (forth), or its transpose times one by rb, with the products of a block of rows or of terms added up. Kept."""
    here, key = ("tb", "rb") if forth else ("rb", "tb")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r, t, w = (batch[c][k].values.to_numpy(zero_copy_only=False) for c in ("r", "t", "w"))
                right = _matrix(batch["m"][k].as_py(), width)
                made = _times(r, t, w, right, int(r.max()) + 1) if forth else _times(t, r, w, right, batch["n"][k].as_py())
                yield pa.record_batch([pa.array([batch["key"][k].as_py()], pa.int64()), pa.array([made.tobytes()], pa.binary())], ["key", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros((0, width))
        for batch in batches:  # a block's products come a batch at a time
            key = batch["key"][:1].cast(pa.int64())
            for raw in batch["m"]:
                m = _matrix(raw.as_py(), width)
                if len(m) > len(total):
                    total = np.concatenate([total, np.zeros((len(m) - len(total), width))])
                total[: len(m)] += m
        if key is not None:
            yield pa.record_batch([key, pa.array([total.tobytes()], pa.binary())], ["key", "m"])

    joined = table.join(basis.withColumnRenamed("key", here), here).select(F.col(key).cast("long").alias("key"), "r", "t", "w", "m", F.col("n") if not forth else F.lit(0).alias("n"))
    return kept(joined.mapInArrow(multiply, "key long, m binary").groupBy("key").applyInArrow(add, "key long, m binary"), wide=True)


def _gram(basis: DataFrame, width: int) -> np.ndarray:
    """The sum over the blocks of each block's own products: width * width numbers."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for m in batch["m"]:
                part = _matrix(m.as_py(), width)
                total += part.T @ part
        yield pa.record_batch([pa.array([total.ravel()], pa.list_(pa.float64()))], ["g"])

    sums = basis.select("m").mapInArrow(own, "g array<double>").select(F.posexplode("g").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
    out = np.zeros(width * width)
    for r in sums.collect():
        out[r["k"]] = r["x"]
    return out.reshape(width, width)


def _turned(basis: DataFrame, width: int, by: np.ndarray) -> DataFrame:
    """Each block of a basis times a small matrix."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch["key"], pa.array([(_matrix(m.as_py(), width) @ by).tobytes() for m in batch["m"]], pa.binary())], ["key", "m"])

    return basis.mapInArrow(turn, "key long, m binary")


def _square_root(gram: np.ndarray) -> np.ndarray:
    """The matrix that makes a basis of this Gram matrix orthonormal, without the directions that it lacks."""
    values, directions = np.linalg.eigh(gram)
    good = values > max(values[-1], 0.0) * 1e-12
    return directions[:, good] / np.sqrt(values[good])


def latent(weights: DataFrame, components: int, rounds: int = 50) -> tuple[DataFrame, int, np.ndarray]:
    """Of a table (row, term, w): key and m, for each block of BLOCK_ROWS row numbers their coordinates in the space of the largest singular values; its width; and the singular values.

    The basis has twice the components, so that the wanted ones come out soon, and starts from numbers drawn by block of terms. Rounds end when the wanted values change by less than TOLERANCE of themselves; `rounds` bounds
    them where values lie too close together to be told apart."""
    spark = weights.sparkSession
    terms = weights.agg(F.count_distinct("term")).first()[0]
    table, sizes = blocks(weights, terms)
    width = max(1, min(2 * components, terms))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tb, n in zip(batch["tb"].to_pylist(), batch["n"].to_pylist(), strict=True):
                yield pa.record_batch([pa.array([tb], pa.int64()), pa.array([np.random.default_rng(tb).standard_normal((n, width)).tobytes()], pa.binary())], ["key", "m"])

    table = kept(table.join(F.broadcast(sizes), "tb"), wide=True)  # a row for each block of terms
    basis = kept(sizes.mapInArrow(drawn, "key long, m binary"), wide=True)
    before = np.zeros(0)
    for _ in range(rounds):
        ready = _square_root(_gram(basis, width))
        basis, old, width = kept(_turned(basis, width, ready), wide=True), basis, ready.shape[1]
        dropped(old)
        forth = _product(table, basis, width, True)
        values, directions = np.linalg.eigh(_gram(forth, width))
        order = np.argsort(values)[::-1]
        values, directions = np.sqrt(np.maximum(values[order], 0.0))[:components], directions[:, order][:, :components]
        if len(values) == len(before) and np.all(np.abs(values - before) <= TOLERANCE * values[0]):
            break
        before, old = values, basis
        basis = _product(table, forth, width, False)
        dropped(old), dropped(forth)
    return _turned(forth, width, directions), len(values), values


def similarities(weights: DataFrame, profile_row: int, components: int) -> DataFrame:
    """row, latent: the cosine, between 0 and 1, of each row with the profile's row in the latent space."""
    coordinates, width, _ = latent(weights, components)
    coordinates = kept(coordinates, wide=True)
    at = coordinates.where(F.col("key") == profile_row // BLOCK_ROWS).first()
    own = _matrix(at["m"], width)[profile_row % BLOCK_ROWS] if at and len(at["m"]) // (8 * width) > profile_row % BLOCK_ROWS else np.zeros(width)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch["key"].to_pylist(), batch["m"], strict=True):
                m = _matrix(raw.as_py(), width)
                size = np.linalg.norm(m, axis=1) * np.linalg.norm(own)
                found = np.clip(np.divide(m @ own, size, out=np.zeros(len(m)), where=size > 0), 0.0, 1.0)
                yield pa.record_batch([pa.array(key * BLOCK_ROWS + np.arange(len(m))), pa.array(found)], ["row", "latent"])

    return coordinates.mapInArrow(compare, "row long, latent double")


def with_profile(docs: DataFrame, profile: DataFrame, stop: frozenset[str] = vectors.STOP, components: int = COMPONENTS) -> DataFrame:
    """row, latent of each row of docs (row, text; row numbers its rows) with the one text of profile (text), all in one corpus. Without LEAST documents, the profile among them, or three terms there is no latent space: no rows.
    A text without words gets 0; so do all if the profile has none."""
    spark, n = docs.sparkSession, docs.count() + 1
    none = spark.createDataFrame([], "row long, latent double")
    if n < LEAST:
        return none
    most = docs.agg(F.max("row")).first()[0] + 1
    both = docs.select("row", "text").unionByName(profile.limit(1).select(F.lit(most).alias("row"), "text"))
    weighed = kept(vectors.weights(both, "row", words(F.col("text"), stop)).select(F.col("id").alias("row"), "term", "w"))
    terms = weighed.agg(F.count_distinct("term")).first()[0]
    components = min(components, n // 2, terms - 1)
    if components < 2:
        return none
    return similarities(weighed, most, components).where(F.col("row") != most)
