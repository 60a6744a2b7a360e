"""TF-IDF with smooth inverse document frequencies, sublinear counts and unit length; cosines of arrays; chunk similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import dropped, kept, numbered

#: Fixed pattern: a token starts with a letter, may hold digits and + # . / - inside, and ends with a letter, digit, + or #.
TOKEN = r"[a-z](?:[a-z0-9+#./-]*[a-z0-9+#])?"
#: Common English words that carry no weight.
STOP = frozenset(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her"
    " here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them then there"
    " these they this those through to too under until up very was we were what when where which while who whom why will with you your yours".split()
)


def tokens(text: Column, stop: frozenset[str] = STOP) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it, also within functions of elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(words: Column) -> Column:
    """Words, then neighbouring pairs."""
    pairs = lambda w: F.slice(F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat_ws(" ", a, b)), F.lit(1), F.size(w) - 1)
    return bound(words, lambda w: F.when(F.size(w) > 1, F.concat(w, pairs(w))).otherwise(w))


def runs(values: Column, one: Callable[[Column, Column], Column], key: Callable[[Column], Column] = lambda x: x) -> Column:
    """one(first, n) for each run of values of equal keys, once the values are in order: terms of a text counted within its row, whatever the number of rows in a task."""

    def told(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda k: (k == 1) | (key(F.element_at(s, k)) != key(F.get(s, k - 2))))
        each = lambda at: F.transform(at, lambda k, i: one(F.element_at(s, k), (F.coalesce(F.get(at, i + 1), F.size(s) + 1) - k).cast("long")))
        return F.when(F.size(s) > 0, bound(starts, each))

    return bound(F.sort_array(values), told)


def of_one_id(docs: DataFrame, id_: str, terms: Column) -> DataFrame:
    """id_, terms: one row for each id, with the terms of all rows under it. Only rows whose id comes again are brought together."""
    rows = docs.select(id_, terms.alias("terms"))
    again = docs.groupBy(F.col(id_).alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    if again.isEmpty():
        return rows
    same = F.col(id_).eqNullSafe(F.col("_id"))
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").groupBy(id_).agg(F.flatten(F.collect_list("terms")).alias("terms")))


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character runs within words padded by a blank on either side."""
    words = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    runs = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda k: F.substring(w, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.flatten(F.transform(words, lambda w: F.array(*(runs(w, n) for n in range(low, high + 1))))))


#: Terms of more than this part of all documents' terms, so fewer than so many, are broadcast with their frequencies; all others, of which none is frequent, are joined by a shuffle.
PARTS = 100_000
#: Pairs of a row and a term that a task sorts at a time, of about 100 bytes each: shuffles of pairs have as many parts as that takes, whatever the session's number of parts or the size that it joins them to.
PAIRS = 1_000_000


def most_frequent(found: Column, most: int, last: Callable[[Column], Column] = lambda x: F.lit(False)) -> Column:
    """The top-k report of found (struct of term and pos): struct(term, n, first) by count; of equal counts those that are `last` come last, then the earlier one first."""
    each = runs(found, lambda x, n: F.struct((-n).alias("less"), last(x).alias("last"), x["pos"].alias("first"), x["term"].alias("term")), lambda x: x["term"])
    return F.transform(F.slice(F.sort_array(each), 1, most), lambda x: F.struct(x["term"].alias("term"), (-x["less"]).alias("n"), x["first"].alias("first")))


def counted(docs: DataFrame, keys: list[str], terms: Column) -> DataFrame:
    """keys, term, tf of each row of docs, kept. A row without terms has one null term. Terms are counted within their row, so a task holds the terms of one row at a time and nothing is shuffled."""
    each = runs(terms, lambda term, n: F.struct(term.alias("term"), n.alias("tf")))
    return kept(docs.select(*keys, F.explode_outer(each).alias("_t")).select(*keys, "_t.term", "_t.tf"))


def frequencies(tf: DataFrame) -> DataFrame:
    """term, df of a counted table, kept."""
    return kept(tf.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df")))


def _shares(pairs: DataFrame) -> int:
    """How many parts a shuffle of a kept table of pairs has."""
    return max(pairs.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // PAIRS))


def split_frequencies(df: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """The frequent terms, to be broadcast (fewer than PARTS rows: their df add up to no more than all terms of documents); the rare ones in parts for a join by term; how many documents a rare one is in at most; and how many
    parts there are."""
    total = df.agg(F.sum("df")).first()[0] or 0
    often, parts = F.col("df") * PARTS > total, max(df.sparkSession.sparkContext.defaultParallelism, -(-total // PAIRS))
    return F.broadcast(df.where(often)), df.where(~often).repartition(parts, "term"), total // PARTS, parts


def with_frequencies(tf: DataFrame, df: DataFrame) -> DataFrame:
    """The counted terms with their df."""
    frequent, rare, _, parts = split_frequencies(df)
    return tf.join(frequent, "term").unionByName(tf.join(frequent, "term", "left_anti").repartition(parts, "term").join(rare, "term"))


def weight(tf: Column, df: Column, n: int) -> Column:
    return (1 + F.log(tf)) * (F.log((1 + F.lit(n)) / (1 + df)) + 1)


def weights(docs: DataFrame, id_: str, terms: Column, unit: bool = True) -> DataFrame:
    """id, term, w: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), with unit divided by the document's length. Rows under one id are one document, and in one part of the result."""
    tf = counted(of_one_id(docs, id_, terms).withColumnRenamed(id_, "id"), ["id"], F.col("terms"))
    weighed = with_frequencies(tf, frequencies(tf)).select("id", "term", weight(F.col("tf"), F.col("df"), docs.count()).alias("w"))
    weighed = weighed.repartition(_shares(tf), "id")
    if not unit:
        return weighed
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return weighed.select("id", "term", (F.col("w") / length).alias("w"))


def _hopeful(known: DataFrame, n: int, rare: int, most: int) -> DataFrame:
    """The rows of known (id, term, tf, df), df null for terms of at most `rare` documents, that may be among the `most` heaviest of their id: those as heavy at best as so many rows of the id, next to them in a batch, are at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tf, df = batch["tf"].to_numpy(), batch["df"].to_numpy(zero_copy_only=False)
            least, best = ((1 + np.log(tf)) * (np.log((1 + n) / (1 + np.where(np.isnan(df), unknown, df))) + 1) for unknown in (max(rare, 1), 1))
            ids = batch["id"]
            of = np.cumsum(pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False))
            of = np.append(np.zeros(min(len(ids), 1), of.dtype), of)
            order = np.lexsort((-least, of))
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            last = starts + most - 1
            full = last < np.append(starts[1:], len(of))
            floor = np.full(len(starts), -np.inf)
            floor[full] = least[order][last[full]]
            yield batch.filter(pa.array(best >= floor[of] - 1e-6))

    return known.select("id", "term", "tf", F.col("df").cast("double")).mapInArrow(run, f"id {known.schema['id'].dataType.simpleString()}, term string, tf long, df double")


def heaviest(docs: DataFrame, id_: str, terms: Column, most: int) -> DataFrame:
    """id, place, term: the top-k report of each document's terms by weight, of equal weights in alphabetical order. Terms that bounds on weights rule out within a task go no further."""
    tf = counted(of_one_id(docs, id_, terms).withColumnRenamed(id_, "id"), ["id"], F.col("terms"))
    df, n = frequencies(tf), docs.count()
    frequent, rare, at_most, parts = split_frequencies(df)
    hopeful = kept(_hopeful(tf.where("term IS NOT NULL").join(frequent, "term", "left"), n, at_most, most))
    dropped(tf)
    found = hopeful.where("df IS NULL").drop("df").repartition(parts, "term").join(rare, "term").unionByName(hopeful.where("df IS NOT NULL"))
    w = found.select("id", "term", weight(F.col("tf"), F.col("df"), n).alias("w")).repartition(_shares(hopeful), "id")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("w", 9)), "term"))
    return w.withColumn("place", place).where(F.col("place") <= most).select("id", "place", "term")


#: Rows of a table (two to the power of that, 14 at most) whose hashed terms travel together, about how many of these at most, and bytes of text whose terms are weighed in one part.
CHUNK, HASHES, PART = 12, 1_000_000, 36_000_000


def _dealt(rows: DataFrame, terms_of, parts: int) -> DataFrame:
    """part, entries, first, hashes, n, at, tf: the terms of a piece of rows (row, text), some next to each other in one chunk, dealt over parts by their 64-bit hashes. A piece goes by its first row and has two rows in a
    part: its distinct hashes, in order, with the number of its rows that each is in; and the entries, in the hashes' order: the row's place in the chunk, and how often the term is there."""

    def lists(ends: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [pa.nulls(parts, pa.list_(t)) for t in (pa.int64(), pa.int16(), pa.int16(), pa.int32())]
        for batch in batches:
            numbers = batch["row"].to_numpy()
            if np.any(numbers[1:] < numbers[:-1]):  # never, as long as a table is read as it was written
                batch = batch.take(pa.array(np.argsort(numbers, kind="stable")))
            chunks, until = batch["row"].to_numpy() >> CHUNK, np.cumsum(pc.list_value_length(batch["hashes"]).to_numpy()) // HASHES
            cuts = np.flatnonzero(np.append(True, (chunks[1:] != chunks[:-1]) | (until[1:] != until[:-1])))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(chunks)), strict=True):
                row, found = batch["row"][lo:hi].to_numpy(), batch["hashes"][lo:hi]
                h = found.flatten().to_numpy()
                if not len(h):
                    continue
                at = np.repeat((row & ((1 << CHUNK) - 1)).astype(np.int16), pc.list_value_length(found).to_numpy())
                starts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (at[1:] != at[:-1]))).astype(np.int32)  # hashes are in order within a row
                tf, h, at = np.diff(starts, append=np.int32(len(h))), h[starts], at[starts]
                order = np.argsort(h, kind="stable")
                h, at, tf = h[order], at[order], tf[order]
                del order
                starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                known, ends = h[starts], np.append(starts, len(h))
                cuts = np.searchsorted((((known >> 33) + (1 << 30)) * parts) >> 31, np.arange(parts + 1))
                some, part, first = pa.array(np.diff(cuts) > 0), pa.array(np.arange(parts, dtype=np.int32)), pa.array(np.full(parts, row[0]))
                for entries, values in ((False, lists(cuts, known, np.diff(ends).astype(np.int16)) + none[2:]), (True, none[:2] + lists(ends[cuts], at, tf))):
                    yield pa.record_batch([part, pa.array(np.full(parts, entries)), first, *values], ["part", "entries", "first", "hashes", "n", "at", "tf"]).filter(some)

    hashed = F.sort_array(F.transform(terms_of(F.col("text")), lambda t: F.xxhash64(t)))
    return rows.select("row", F.coalesce(hashed, F.array().cast("array<bigint>")).alias("hashes")).mapInArrow(run, "part int, entries boolean, first long, hashes array<long>, n array<short>, at array<short>, tf array<int>")


def _known(hashes: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which of all distinct hashes each hash of the pieces is, and how many rows each distinct one is in."""
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    h = h[order]
    which = np.empty(len(h), np.int32)
    which[order] = np.cumsum(np.append(False, h[1:] != h[:-1]), dtype=np.int32)
    return which, np.bincount(which, np.concatenate(sizes))


def _sums(dealt: DataFrame, n: int, profile: int, parts: int) -> DataFrame:
    """row, squares, dot of each row with a term: the sum of its weights' squares, and of their products with those of the row that is the profile (0 without a common term). The profile's number is less than all others.

    A task reads a part's distinct hashes first and its entries after them, a piece at a time: it holds no more than the hashes, of which a frequent term has one for each piece."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, hashes, sizes, idf = None, [], [], None
        for batch in batches:
            for k in range(batch.num_rows):
                if batch["part"][k].as_py() != part:
                    part, hashes, sizes, idf = batch["part"][k].as_py(), [], [], None
                if not batch["entries"][k].as_py():
                    hashes.append(batch["hashes"][k].values.to_numpy().copy())
                    sizes.append(batch["n"][k].values.to_numpy().copy())
                    continue
                if idf is None:
                    which, df = _known(hashes, sizes)
                    idf, theirs, piece, at = np.log((1 + n) / (1 + df)) + 1, np.zeros(len(df)), 0, 0
                    hashes = []
                of, to = which[at : at + len(sizes[piece])], batch["at"][k].values.to_numpy()
                raw = (1 + np.log(batch["tf"][k].values.to_numpy())) * np.repeat(idf[of], sizes[piece])
                first = batch["first"][k].as_py()
                if first == profile:
                    theirs[of] = raw
                sums = [pa.array([np.bincount(to, x)], pa.list_(pa.float64())) for x in (raw * raw, raw * np.repeat(theirs[of], sizes[piece]))]
                yield pa.record_batch([pa.array([first >> CHUNK]), *sums], ["chunk", "squares", "dot"])
                piece, at = piece + 1, at + len(of)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = np.zeros((2, 1 << CHUNK)), 0
        for batch in batches:  # a chunk's sums come a batch at a time
            for k in range(batch.num_rows):
                chunk = batch["chunk"][k].as_py()
                for into, name in zip(total, ("squares", "dot"), strict=True):
                    x = batch[name][k].values.to_numpy()
                    into[: len(x)] += x
        some = np.flatnonzero(total[0])
        yield pa.record_batch([pa.array((chunk << CHUNK) + some), pa.array(total[0][some]), pa.array(total[1][some])], ["row", "squares", "dot"])

    in_order = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "entries", "first")
    weighed = in_order.mapInArrow(weigh, "chunk long, squares array<double>, dot array<double>")
    return weighed.groupBy("chunk").applyInArrow(add, "row long, squares double, dot double")


def cosines(docs: DataFrame, id_: str, profile: DataFrame, terms_of) -> DataFrame:
    """id, cosine of each row with the one text of profile (text), all weighed in one corpus of the rows and the profile. Each row is a document of its own: ids may repeat, be null or any number, and each row gets its own
    result. A row without a term of the profile's, null texts among them, gets 0; so do all for a profile without terms or of no row. An empty table gives no rows.

    Terms travel once, in arrays of a part for a chunk of rows: a hash of 64 bits for all of the chunk, and its rows; sums come back in arrays too. Two terms of one hash would count as one: among a billion different terms 0.03 such pairs are expected."""
    rows = numbered(docs.select(F.col(id_).cast("long").alias("id"), "text"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    own = -1 << CHUNK  # the profile is a row of a chunk of its own, before all others
    both = rows.select("row", "text").unionByName(profile.limit(1).select(F.lit(own).alias("row"), "text"))
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // PART))
    sums = kept(_sums(_dealt(both, terms_of, parts), n + 1, own, parts))
    mine = sums.where(F.col("row") == own).select("squares").first()
    found = F.coalesce(F.col("dot") / F.sqrt(F.col("squares") * F.lit(float(mine[0]))), F.lit(0.0)) if mine else F.lit(0.0)
    return rows.select("row", "id").join(sums, "row", "left").select("id", found.alias("cosine"))


#: Chunks of profiles, and of documents, in a block: a product of two blocks is one task's smallest piece of work.
BLOCK, ROWS = 256, 2_048


def _products(pairs: DataFrame, schema: str) -> DataFrame:
    """profile, of, job, best: for each chunk of a block of documents the best cosine with any chunk of each profile in a block of profiles, as products of matrices. Vectors without length are near to nothing."""

    def unit(vectors: pa.Array) -> np.ndarray:
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, chunks in zip(batch["rows"], batch["chunks"], strict=True):
                left, right = rows.values, chunks.values
                profiles = right.field("profile").dictionary_encode()
                codes = profiles.indices.to_numpy()
                order = np.argsort(codes, kind="stable")
                starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
                best = np.maximum.reduceat((unit(left.field("embedding")) @ unit(right.field("embedding")).T)[:, order], starts, axis=1)
                each = pa.array(np.repeat(np.arange(len(left)), len(starts)))
                yield pa.record_batch([profiles.dictionary.take(pa.array(np.tile(np.arange(len(starts)), len(left)))), left.field("of").take(each), left.field("job").take(each), pa.array(best.ravel())], ["profile", "of", "job", "best"])

    return pairs.select("rows", "chunks").mapInArrow(run, schema)


def best_chunk_means(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """profile, job, similarity of tables (job, embedding) and (profile, embedding), with embeddings of one length: of each chunk of a job, the best cosine with any chunk of the profile, averaged over the job. Chunks of both sides
    are put into blocks, and each block of jobs meets each block of profiles once.

    Rows with a null embedding are left out; repeated chunks count as often as they come; a table without chunks gives no rows."""
    jobs, profiles = jobs.where("embedding IS NOT NULL").select("job", "embedding"), profiles.where("embedding IS NOT NULL").select("profile", "embedding")
    wide, high = (max(1, -(-t.count() // n)) for t, n in ((profiles, BLOCK), (jobs, ROWS)))
    dealt = lambda n: F.pmod(F.xxhash64("embedding", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    right = profiles.withColumn("j", dealt(wide)).groupBy("j").agg(F.collect_list(F.struct("profile", "embedding")).alias("chunks"))  # about BLOCK of them
    left = jobs.withColumn("of", F.monotonically_increasing_id()).withColumn("i", dealt(high)).groupBy("i").agg(F.collect_list(F.struct("of", "job", "embedding")).alias("rows"))  # about ROWS
    pairs = left.select("rows", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("j")).join(right, "j")
    kinds = {c: t.schema[c].dataType.simpleString() for t, c in ((profiles, "profile"), (jobs, "job"))}
    met = _products(pairs, f"profile {kinds['profile']}, of long, job {kinds['job']}, best double")
    return met.groupBy("profile", "of", "job").agg(F.max("best").alias("best")).groupBy("profile", "job").agg(F.avg("best").alias("similarity"))


def best_chunk_mean(jobs: DataFrame, profile: DataFrame) -> DataFrame:
    """job, similarity: best_chunk_means for the one profile whose chunks are given (embedding)."""
    return best_chunk_means(jobs, profile.select(F.lit(0).alias("profile"), "embedding")).drop("profile")
