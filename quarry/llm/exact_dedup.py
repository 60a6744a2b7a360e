"""Operator 13: documents of equal text, by an extendible-hash index that is written to the shared folder. DataFrame functions only.

A key is 64 bits of hash. The directory names a bucket for each prefix of the key: where a bucket holds more keys than its capacity, it is split by one more bit, and the directory doubled when it has no such bit. Each bucket,
a range of keys, has an owner task. There the texts of a key are compared byte by byte, and each different text is an entry of its own in the key's chain. More bits can't split one key: the rows of a hot key are dealt over
pages with other owners, of which each finds the copies on its page; what is left of the pages is then compared in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, result

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that fill a bucket, and the most bits of a directory: it has at most 65,536 entries, beyond which buckets overfill.
CAPACITY, MOST_BITS = 4_000, 16
#: A hot key has more rows than a page and more than this part of all rows, so fewer than so many keys are hot.
PAGE, PARTS = 250, 4_096


def normalised(column: str = "text") -> Column:
    """A text with A to Z in lower case and nothing else changed; null is empty."""
    return F.translate(F.coalesce(F.col(column).cast("string"), F.lit("")), UPPER, LOWER)


def prefix(key: Column, bits: int) -> Column:
    """The first bits of a key, as a number."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def directory(keys: DataFrame, capacity: int = CAPACITY, most: int = MOST_BITS) -> list[int]:
    """The bucket of each entry of the directory for a table of distinct keys; entries are in the order of their prefixes, and so are the buckets' numbers. Counts of at most 2 ** most prefixes come to the driver."""
    sums = [0] * ((1 << most) + 1)
    for r in keys.groupBy(prefix(F.col("key"), most).alias("at")).agg(F.count("*").alias("n")).collect():
        sums[r["at"] + 1] = r["n"]
    for k in range(1 << most):
        sums[k + 1] += sums[k]
    bits, buckets = 0, [(0, 0)]  # prefix, and of how many bits
    while True:
        full = {(p, b) for p, b in buckets if b < most and sums[(p + 1) << (most - b)] - sums[p << (most - b)] > capacity}
        if not full:
            return [k for k, (_, b) in enumerate(buckets) for _ in range(1 << (bits - b))]
        bits = max(bits, 1 + max(b for _, b in full))
        buckets = [part for p, b in buckets for part in ([(2 * p, b + 1), (2 * p + 1, b + 1)] if (p, b) in full else [(p, b)])]


def _chains(docs: DataFrame, keys: DataFrame, hot: DataFrame, scratch: Scratch, capacity: int) -> DataFrame:
    """The index: key, sha, n and keep_id of each distinct text, in files of one owner's keys each."""
    spark, entries = docs.sparkSession, directory(keys, capacity)
    bits, owners = len(entries).bit_length() - 1, entries[-1] + 1
    buckets = spark.createDataFrame(list(enumerate(entries)), "at int, bucket int")  # at most 2 ** MOST_BITS rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("body")).withColumn("key", F.xxhash64("body"))
    rows = rows.join(F.broadcast(hot), "key", "left").join(F.broadcast(buckets), prefix(F.col("key"), bits) == F.col("at"))
    page = F.when(F.col("pages").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("pages")).cast("int"))
    rows = rows.select("doc_id", "body", "key", F.pmod(F.col("bucket") + F.coalesce(page, F.lit(0)), F.lit(owners)).alias("owner"), page.isNotNull().alias("paged"))
    # an owner's rows are in one partition, so equal texts are found there without a further shuffle
    found = rows.repartitionById(owners, F.col("owner")).groupBy("owner", "key", "paged", "body").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
    entry = lambda n, keep: (F.sha2("body", 256).alias("sha"), n, keep)
    found = scratch.keep(found.select("key", F.when(F.col("paged"), F.col("body")).alias("body"), "paged", *entry(F.col("n"), F.col("keep_id"))))
    pages = found.where("paged").groupBy("key", "body").agg(F.sum("n").alias("n"), F.max("keep_id").alias("keep_id"))
    return scratch.keep(found.where("NOT paged").select("key", "sha", "n", "keep_id").unionByName(pages.select("key", *entry(F.col("n"), F.col("keep_id")))))


def copies(docs: DataFrame, capacity: int = CAPACITY, page: int = PAGE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row. Of rows with equal texts, A to Z in either case, that of the largest id is kept.

    A null text is empty, and empty texts equal each other; very long texts are compared whole. A row without id comes after all others: it is kept only where no row of its text has an id. Repeated rows of the largest id are
    ties and all kept. Further columns are ignored; an empty table gives no rows."""
    with Scratch(docs.sparkSession) as scratch:
        body = normalised()
        rows = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("key"), F.sha2(body, 256).alias("sha")))
        keys = scratch.keep(rows.groupBy("key").agg(F.count("*").alias("n")))
        total = keys.agg(F.sum("n")).first()[0] or 0
        hot = scratch.keep(keys.where((F.col("n") > page) & (F.col("n") * PARTS > total)).select("key", F.ceil(F.col("n") / page).cast("int").alias("pages")))
        index = _chains(docs, keys, hot, scratch, capacity)
        # a hot key's rows meet its chain where they are; no other key has many rows
        hot = F.broadcast(hot.select("key"))
        usual = rows.join(hot, "key", "left_anti").join(index, ["key", "sha"])
        crowded = rows.join(F.broadcast(index.join(hot, "key", "left_semi")), ["key", "sha"])
        found = usual.unionByName(crowded)
        return result(found.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")))


#: DuckDB SQL for copies().
SQL = """WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
  SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256 FROM t WINDOW g AS (PARTITION BY text_sha256)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(read(spark, sf_dir, "documents"))
