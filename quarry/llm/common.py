"""What the operators of this subpackage share: byte-level text handling, Arrow batches, scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIX1, MIX2, STEP = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
#: Bytes of text that a task turns into arrays at once.
CHUNK_BYTES = 4 << 20


def arrow_ready(spark: SparkSession, rows: int = 512) -> None:
    """Small Arrow batches: a batch of the default 10,000 rows of long texts would not fit a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))


def as_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes; null is empty. Bytes reach Python whole even where they aren't valid UTF-8."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """One call of fn for each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most limit bytes in all; a longer text is a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each window of exactly size words: a polynomial of the words' hashes, mixed."""
    out = np.full(max(0, len(hashes) - size + 1), size, np.uint64)
    for k in range(size):
        out *= STEP
        out += hashes[k : k + len(out)]
    return mix(out)


def shingle_hashes(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """The hash of each window of size words, in text order; fewer words make one window; no words, none."""
    return windows(hashes, min(size, len(hashes))) if len(hashes) else hashes


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z in lower case, words split at ASCII white space."""
    return np.unique(shingle_hashes(word_hashes(text.lower().split()), size))


def digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def training_row(column: str = "doc_id") -> Column:
    """Whether a row's labels may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 != 1


def held_out(column: str = "doc_id") -> Column:
    """The rows whose labels are never learnt from; false for a null id, which has no label."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def result(df: DataFrame) -> DataFrame:
    """A table that is written to the shared folder and read again, for a caller who may read it more than once. The folder goes when the driver ends."""
    at = f"{shared_dir(df.sparkSession)}/result-{uuid.uuid4().hex}"
    df.write.parquet(at)
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class Scratch:
    """Tables written to the shared folder for as long as an operator works, so that a lost executor costs no more than the task at hand."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame, drop_last: bool = False) -> DataFrame:
        """The table as written and read again. With drop_last, the table that was kept before it is deleted then."""
        self.n += 1
        at = f"{self.path}/{self.n}"
        df.write.parquet(at)
        if drop_last:
            self._delete(f"{self.path}/{self.n - 1}")
        return self.spark.read.schema(df.schema).parquet(at)

    def _delete(self, at: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def __exit__(self, *_) -> None:
        self._delete(self.path)


#: A side of at most so many rows of two numbers is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 250_000


def sized(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A kept table of narrow rows, marked for broadcast if its counted rows are few enough."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small
