"""Operator 2: near-duplicate documents by MinHash with tensored banding.

Two collections of M band values are made, A and B, each value from R minhashes. A table's key joins one value of A with one of B, so 2 * M * R minhashes serve M * M tables of 2 * R minhashes each.
Only values that documents share are paired, so most documents make no key at all. In the M tables (A[i], B[i]) documents are first linked to a leader, which brings near copies together at little cost. Then every
pair that shares a key of any table and isn't in one component yet is compared: pairs of keys that few documents have as rows, crowds of documents that have keys in common in blocks of bounded size.
Every link is confirmed on the full shingle sets.

At similarity 0.75, M = 25 and R = 4, a pair shares no table with probability 2 * (1 - 0.75**4)**25 = 1.5e-4, and fewer than one in 1e7 at 0.9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_ready, as_bytes, map_batches, mix, read, result, shingle_set, sized
from .graph import components

M, R = 25, 4
HASHES = 2 * M * R
#: Two bits of each minhash, in numbers of 32 pairs. Of 200 pairs, sets of similarity 0.75 differ in 38 on average, with a deviation of 5.5.
SKETCH, MOST_DIFFERENT = -(-HASHES // 32), 62
_PAIRS = 0x5555555555555555
_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
BLOCK = 1 << 15
#: Nodes with a table key that more than CROWD nodes have are compared in blocks, of at most so many nodes and shingles a side.
CROWD, BLOCK_NODES, BLOCK_SHINGLES = 32, 1024, 500_000


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of HASHES minima for each non-empty set, by blocks that stay in the processor's cache."""
    out = np.full((len(sets), HASHES), np.iinfo(np.uint64).max, np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= BLOCK):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        y = np.empty_like(x)
        for k in range(HASHES):
            np.multiply(x, FACTORS[k], out=y)
            np.add(y, OFFSETS[k], out=y)
            out[at:end, k] = np.minimum.reduceat(y, starts)
        at = end
    return out


def bands(minima: np.ndarray) -> np.ndarray:
    """The 2 * M band values of each row: first A's, then B's. Values of different bands are different."""
    out = np.tile(np.arange(2 * M, dtype=np.uint64) << np.uint64(32), (len(minima), 1))
    for k in range(R):
        out = mix(out + minima[:, k::R] + np.uint64(k))
    return out


def sketches(minima: np.ndarray) -> np.ndarray:
    two = np.zeros((len(minima), SKETCH * 32), np.uint64)
    two[:, :HASHES] = mix(minima) & np.uint64(3)
    return (two.reshape(len(minima), SKETCH, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(2, dtype=np.uint64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, holder (hash of the text), n_shingles, node (identity of the shingle set; null if empty), bands, sketch of each row. A node is 64 bits of a strong hash: among n sets, n * n / 2**65 chance meetings are expected."""
    arrow_ready(docs.sparkSession, 256)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t.as_py()) for t in batch["text"]]
        full = [k for k, s in enumerate(sets) if len(s)]
        b: list = [None] * len(sets)
        s: list = [None] * len(sets)
        nodes: list = [None] * len(sets)
        if full:
            minima = minhashes([sets[k] for k in full])
            for k, x, y in zip(full, bands(minima).view(np.int64), sketches(minima).view(np.int64), strict=True):
                b[k], s[k], nodes[k] = x, y, np.uint64(xxhash.xxh3_128_intdigest(sets[k].tobytes()) & (2**64 - 1)).astype(np.int64)
        longs = pa.list_(pa.int64())
        columns = [batch["doc_id"].cast(pa.int64()), batch["holder"], pa.array(map(len, sets), pa.int64()), pa.array(nodes, pa.int64()), pa.array(b, longs), pa.array(s, longs)]
        return pa.record_batch(columns, ["doc_id", "holder", "n_shingles", "node", "bands", "sketch"])

    texts = docs.select("doc_id", as_bytes().alias("text")).withColumn("holder", F.xxhash64("text"))
    return map_batches(texts, run, "doc_id long, holder long, n_shingles long, node long, bands array<long>, sketch array<long>")


def _differing(a: str, b: str) -> Column:
    """In how many of the pairs of bits of their sketches two nodes differ."""
    total = F.lit(0)
    for k in range(SKETCH):
        d = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        total = total + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(_PAIRS)))
    return total


def _shared(values: DataFrame) -> DataFrame:
    """node, own: of the values (node, root, value) those that nodes of more than one component have, as a set for each node. Counted before the shuffle and joined back, so a value of very many nodes is split like any skewed join."""
    common = values.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("value")
    return values.select("node", "value").join(common, "value").groupBy("node").agg(F.collect_set("value").alias("own"))  # at most M values


def _open(nodes: DataFrame, roots: DataFrame | None, scratch: Scratch) -> DataFrame:
    """The nodes (node, root, bands) that share both a value of A and a value of B with a node of another component, and these values as the sets a and b. Only nodes with such a value of A are asked for theirs of B."""
    own = nodes.withColumn("root", F.col("node")) if roots is None else nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = own.select("node", "root", "bands")
    of_a = scratch.keep(_shared(own.select("node", "root", F.explode(F.slice("bands", 1, M)).alias("value"))).withColumnRenamed("own", "a"))
    left = scratch.keep(own.join(of_a, "node"))
    of_b = _shared(left.select("node", "root", F.explode(F.slice("bands", M + 1, M)).alias("value"))).withColumnRenamed("own", "b")
    return scratch.keep(left.join(of_b, "node"))


def _stars(open_: DataFrame) -> DataFrame:
    """Pairs (a, b) of a node and the leader of a key of the tables (A[i], B[i]) that it has. The leader is the node of the least hash, so the keys of a group of near copies agree on few leaders."""
    at = lambda i: F.get("bands", i)
    shared = lambda i: F.when(F.array_contains("a", at(i)) & F.array_contains("b", at(i + M)), F.xxhash64(at(i), at(i + M)))
    keys = open_.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(M - 1)), shared)).alias("key")).where("key is not null")
    best = keys.groupBy("key").agg(F.min(F.struct(F.xxhash64("node"), "node")).alias("top"), F.count("*").alias("n")).where("n > 1").select("key", F.col("top.node").alias("leader"))
    return keys.join(best, "key").where("node <> leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()


def _sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """node, set of the wanted nodes, made anew from their texts."""
    wanted = scratch.keep(wanted.distinct().join(nodes.select("node", "doc_id", "holder"), "node").select("doc_id", "holder", "node"))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch["node"], pa.array([shingle_set(t.as_py()).view(np.int64) for t in batch["text"]], pa.list_(pa.int64()))], ["node", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"))
    # the text of a node: the row that has both its id and its text hash, so repeated ids with other texts don't interfere
    texts = texts.withColumn("holder", F.xxhash64("text"))
    chosen = texts.join(sized(wanted.where("doc_id is not null")), ["doc_id", "holder"]).select("node", "text")
    lost = texts.where("doc_id is null").join(sized(wanted.where("doc_id is null").drop("doc_id")), "holder").select("node", "text")
    return scratch.keep(map_batches(chosen.unionByName(lost), sets, "node long, set array<long>").dropDuplicates(["node"]))


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that aren't far below the similarity by their sizes and sketches."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
    close = (100 * F.least("na", "nb") >= 75 * F.greatest("na", "nb")) & (_differing("sa", "sb") <= MOST_DIFFERENT)
    of_a = pairs.join(side("a"), "a").join(side("b").withColumnRenamed("b", "own_b"), (F.col("b") == F.col("own_b")) & close)
    return of_a.select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def _confirmed(near: DataFrame, made: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the similarity."""

    def similar(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch["x"], batch["y"], strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 75 * (len(x) + len(y) - both))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = near.join(made.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(made.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return map_batches(both, similar, "a long, b long")


class _Roots:
    """Which components of a block are one by now."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def of(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.of(x), self.of(y)
        self.up[x] = y
        return x != y


def _compared(table: pa.Table) -> pa.Table:
    """Links (a, b) between the left and the right nodes of a block that make its components one wherever a pair of its nodes reaches the similarity. Sketches set pairs aside, full sets decide."""
    sides = []
    for side in (True, False):
        part = table.filter(pc.equal(table["left"], side)).combine_chunks()
        sets = [x.values.to_numpy().view(np.uint64) for x in part["set"]]
        sketch = np.array([x.values.to_numpy() for x in part["sketch"]], np.int64).view(np.uint64).reshape(-1, SKETCH)
        sides.append((part["node"].to_numpy(), part["root"].to_numpy(), np.array([*map(len, sets)], np.int64), np.concatenate([*sets, np.empty(0, np.uint64)]), sketch))
    (a, ra, na, xs, sa), (b, rb, nb, ys, sb) = sides
    words = np.unique(ys)
    where = np.searchsorted(words, ys)
    begins = np.concatenate([[0], np.cumsum(nb)])
    own = np.searchsorted(words, xs)
    own[words[np.minimum(own, len(words) - 1)] != xs] = len(words)  # a word that no right node has
    edges = np.concatenate([[0], np.cumsum(na)])
    roots, found = _Roots(), []
    flag = np.zeros(len(words) + 1, np.int64)
    for i in range(len(a)):
        d = sb ^ sa[i]
        far = np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(_PAIRS)).sum(1, dtype=np.int64)
        maybe = np.flatnonzero((far <= MOST_DIFFERENT) & (rb != ra[i]) & (100 * np.minimum(nb, na[i]) >= 75 * np.maximum(nb, na[i])))
        maybe = maybe[np.argsort(far[maybe], kind="stable")]  # the likeliest first: after a link, the rest of that component is settled
        flag[own[edges[i] : edges[i + 1]]] = 1
        flag[-1] = 0
        for low in range(0, len(maybe), 64):
            part = np.array([j for j in maybe[low : low + 64].tolist() if roots.of(int(rb[j])) != roots.of(int(ra[i]))], np.int64)
            if not len(part):
                continue
            at = np.concatenate([where[begins[j] : begins[j + 1]] for j in part.tolist()])
            both = np.add.reduceat(flag[at], np.cumsum(nb[part]) - nb[part])
            for j in part[100 * both >= 75 * (na[i] + nb[part] - both)].tolist():
                if roots.join(int(ra[i]), int(rb[j])):
                    found.append((min(a[i], b[j]), max(a[i], b[j])))
        flag[own[edges[i] : edges[i + 1]]] = 0
    out = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": out[:, 0], "b": out[:, 1]})


def _blocks(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of families (node, root, family), dealt to blocks: each node outside its family's largest component meets all nodes of the family. family, i, j, left, node, root, sketch of each."""
    members = members.join(nodes.select("node", "n_shingles", "sketch"), "node")
    per = members.groupBy("family", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    per = per.groupBy("family").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "root")).alias("top"))
    count = lambda n, w: F.greatest(F.lit(1), F.ceil(n / BLOCK_NODES), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    per = per.select("family", F.col("top.root").alias("most"), count(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("rows"), count(F.col("n"), F.col("w")).alias("columns"))
    dealt = members.join(per, "family")
    at = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lefts = dealt.where("root <> most").select("family", at("rows", 1).alias("i"), every("columns").alias("j"), F.lit(True).alias("left"), "node", "root", "sketch")
    return lefts.unionByName(dealt.select("family", every("rows").alias("i"), at("columns", 2).alias("j"), F.lit(False).alias("left"), "node", "root", "sketch"))


def _rest(open_: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The links of all pairs of nodes that share a table key and are in different components, as far as they join components. Components that have crowded keys in common make up families, whose nodes are all compared, once each and
    in blocks; all other pairs of a key are rows, at most CROWD * CROWD / 2 of a key."""
    keys = open_.select("node", "root", "b", F.explode("a").alias("of_a")).select("node", "root", "of_a", F.explode("b").alias("of_b")).select("node", "root", F.xxhash64("of_a", "of_b").alias("key"))
    keys = scratch.keep(keys)
    per = scratch.keep(keys.groupBy("key", "root").agg(F.count("*").alias("n")))
    sizes = per.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("roots"), F.min(F.struct(F.xxhash64("root"), "root")).alias("top")).where("roots > 1")
    sizes = scratch.keep(sizes.select("key", "n", F.col("top.root").alias("leader")))
    crowded = per.join(sizes.where(F.col("n") > CROWD).select("key", "leader"), "key").select(F.col("leader").alias("a"), F.col("root").alias("b")).distinct()
    families = scratch.keep(components(crowded, scratch).select(F.col("node").alias("root"), F.col("root").alias("family")))
    members = scratch.keep(open_.select("node", "root").join(families, "root"))
    few = keys.join(sizes.where(F.col("n") <= CROWD).select("key"), "key").join(families, "root", "left")
    few = scratch.keep(few)
    other = few.select("key", F.col("node").alias("b"), F.col("root").alias("of_b"), F.col("family").alias("family_b"))
    apart = (F.col("node") < F.col("b")) & (F.col("root") != F.col("of_b")) & ~F.coalesce(F.col("family") == F.col("family_b"), F.lit(False))
    pairs = few.join(other.withColumnRenamed("key", "other_key"), (F.col("key") == F.col("other_key")) & apart).select(F.col("node").alias("a"), "b").distinct()
    near = scratch.keep(_near(pairs, nodes))
    made = _sets(_ends(near).unionByName(members.select("node")), nodes, docs, scratch)
    dealt = _blocks(members, nodes).join(made, "node")
    found = dealt.groupBy("family", "i", "j").applyInArrow(lambda t: _compared(t), "a long, b long")
    return scratch.keep(_confirmed(near, made).unionByName(found))


def _labelled(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, holder (hash of the text), n_shingles, component_id, first (least hash of a text of the component) of each row."""
    signed = scratch.keep(signatures(docs))
    nodes = scratch.keep(signed.where("node is not null").groupBy("node").agg(F.min_by(F.struct("doc_id", "holder", "n_shingles", "bands", "sketch"), F.struct(F.col("doc_id").isNull(), "doc_id", "holder")).alias("r")).select("node", "r.*"))
    open_ = _open(nodes, None, scratch)
    near = scratch.keep(_near(_stars(open_), nodes))
    links = scratch.keep(_confirmed(near, _sets(_ends(near), nodes, docs, scratch)))
    roots = components(links, scratch)
    still = _open(open_.select("node", "bands"), roots, scratch)
    roots = components(links.unionByName(_rest(still, nodes, docs, scratch)), scratch)
    named = nodes.select("node", "doc_id", "holder").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min("holder").alias("first"))
    of = scratch.keep(named.join(least, "root").select("node", "component_id", "first"))
    alone = F.col("node").isNull()
    of_row = lambda c, own: F.when(alone, F.col(own)).otherwise(F.col(c)).alias(c)
    return signed.select("doc_id", "holder", "n_shingles", "node").join(of, "node", "left").select("doc_id", "holder", "n_shingles", of_row("component_id", "doc_id"), of_row("first", "holder"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row. Rows with the same shingle set are one node from the start; the nodes of the M tables (A[i], B[i]) are linked to leaders; then all pairs that share a key of
    any of the M * M tables across components are compared.

    A null or empty text has no shingles and is alone; very long texts are taken whole. A row without id takes the least id of its component and is kept only if there is none. Of rows with equal sets the least id is kept;
    repeated rows each give the same row. Further columns are ignored; an empty table gives no rows."""
    with Scratch(docs.sparkSession) as scratch:
        return result(_labelled(docs, scratch).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component, with all their columns: those of its least id or, where no row of it has an id, those of the text of the least hash. Exact copies under one id stay together.

    Null and empty texts are alone and stay; very long texts are taken whole; docs may have columns of any names; an empty table gives no rows."""
    with Scratch(docs.sparkSession) as scratch:
        rows = _labelled(docs, scratch)
        stands = F.when(F.col("component_id").isNull(), F.col("holder") == F.col("first")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
        gone = result(rows.where(~stands).select(F.col("doc_id").alias("gone"), F.col("holder").alias("of_text")).distinct())
    whole = docs.select(F.struct(*docs.columns).alias("row"))  # one column, whatever those of docs are called
    same = (F.xxhash64(as_bytes("row.text")) == F.col("of_text")) & F.col("row.doc_id").cast("long").eqNullSafe(F.col("gone"))
    return whole.join(sized(gone), same, "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))
