"""Keyed tables that change together: rows in buckets by the hash of a key, of which a change writes only those that it touches, and one small file that names the buckets of every table, whose renaming is the commit.

folder/data/<table>/<commit>/bucket=<k> holds rows, folder/commits/<number>.json names for each table its key, number of buckets, schema and the folder of each bucket. Readers take the highest number. What a writer leaves
behind when it dies is named by no commit; it goes with the next one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import store

#: Buckets of a new table, and commits that readers may still be reading.
BUCKETS, KEPT_COMMITS = 64, 2


def bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _files(spark: SparkSession, folder: str):
    jvm = spark._jvm
    path = lambda at: jvm.org.apache.hadoop.fs.Path(f"{folder}/{at}")
    return path, path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str, at: str) -> list[str]:
    path, fs = _files(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path(at))) if fs.exists(path(at)) else []


def commits(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, folder, "commits") if n.endswith(".json") and n[:-5].isdigit())


def state(spark: SparkSession, folder: str, number: int | None = None) -> dict:
    """What a commit (the last one) names, by table; empty before the first."""
    found = commits(spark, folder)
    if not found:
        return {}
    return json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/commits/{number or found[-1]}.json").collect()))["tables"]


def _read(spark: SparkSession, folder: str, table: dict, only: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(table["schema"])
    at = [f"{folder}/{p}" for k, p in table["buckets"].items() if only is None or int(k) in only]
    return spark.read.schema(schema).parquet(*at) if at else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str, name: str, number: int | None = None) -> DataFrame | None:
    """The rows of a table at a commit (the last one), or None where there is no such table."""
    table = state(spark, folder, number).get(name)
    return None if table is None else _read(spark, folder, table)


def _written(rows: DataFrame, folder: str, name: str, key: str, n: int) -> dict[str, str]:
    """Writes rows by bucket; the folder of each bucket that has any."""
    at = f"data/{name}/{uuid.uuid4().hex}"
    rows.withColumn("bucket", bucket(F.col(key), n)).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{at}")
    return {x[7:]: f"{at}/{x}" for x in _names(rows.sparkSession, folder, at) if x.startswith("bucket=")}


def change(spark: SparkSession, folder: str, changes: dict[str, tuple[str, DataFrame, Callable[[DataFrame], DataFrame]]], tag: str | None = None, buckets: int = BUCKETS) -> int | None:
    """Changes tables in one commit: name -> (key, keys, to), where `keys` has a column of the key's name with the keys that change, and to(stored) makes the new rows from all stored rows of their buckets. Only these buckets
    are read and written. A tag that the last commit carries already is not applied again (None). Returns the commit's number.

    The commit is one renaming to a name that must be free: of two writers at once one fails, and nothing of it is seen."""
    found = commits(spark, folder)
    last = json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/commits/{found[-1]}.json").collect())) if found else {"tables": {}, "tag": None}
    if tag is not None and last["tag"] == tag:
        return None
    tables = dict(last["tables"])
    for name, (key, keys, to) in changes.items():
        old = tables.get(name)
        n = old["n"] if old else buckets
        touched = {r[0] for r in keys.select(bucket(F.col(key), n)).distinct().collect()}  # at most n numbers
        rows = to(_read(spark, folder, old, touched) if old else spark.createDataFrame([], keys.schema))
        made = _written(rows.where(bucket(F.col(key), n).isin(*touched)) if touched else rows.limit(0), folder, name, key, n)
        kept = {k: p for k, p in (old["buckets"] if old else {}).items() if int(k) not in touched}
        tables[name] = {"key": key, "n": n, "schema": json.loads(rows.schema.json()), "buckets": {**kept, **made}}
    number = (found[-1] if found else 0) + 1
    _commit(spark, folder, number, {"tables": tables, "tag": tag})
    _clean(spark, folder)
    return number


def _commit(spark: SparkSession, folder: str, number: int, what: dict) -> None:
    path, fs = _files(spark, folder)
    draft, final = path(f"commits/draft-{uuid.uuid4().hex}"), path(f"commits/{number}.json")
    fs.mkdirs(path("commits"))
    out = fs.create(draft)
    out.write(bytearray(json.dumps(what).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"another writer made commit {number}")


def _clean(spark: SparkSession, folder: str) -> None:
    """Deletes commits but the last ones, and data that none of those names."""
    path, fs = _files(spark, folder)
    found = commits(spark, folder)
    for number in found[:-KEPT_COMMITS]:
        fs.delete(path(f"commits/{number}.json"), False)
    named = {p.rsplit("/", 1)[0] for number in found[-KEPT_COMMITS:] for t in state(spark, folder, number).values() for p in t["buckets"].values()}
    for name in _names(spark, folder, "data"):
        for made in _names(spark, folder, f"data/{name}"):
            if f"data/{name}/{made}" not in named:
                fs.delete(path(f"data/{name}/{made}"), True)


def upsert_postings(folder: str, fresh: DataFrame, key: str, order: list[str], fixed: tuple[str, ...] = (), tag: str | None = None, name: str = "postings") -> int | None:
    """A batch of postings into a table by key. Rows without a key are left out; an empty batch makes a commit that names what the last one did."""
    fresh = fresh.where(F.col(key).isNotNull())
    to = lambda stored: store.upsert_postings(stored, fresh, key, order, fixed).drop("is_new")
    return change(fresh.sparkSession, folder, {name: (key, fresh, to)}, tag)


def clean(spark: SparkSession, folder: str, now: Column, days: int = 30) -> int | None:
    """Deletes stale postings that nothing keeps, their matches, and those matches' documents: three tables, by posting, posting and match, in one commit."""
    postings, matches, documents = (read(spark, folder, name) for name in ("postings", "matches", "documents"))
    gone = store.stale(postings, store.kept_ids(matches, documents), now, days).select("id")
    of = gone.withColumnRenamed("id", "job_id")
    unmatched = matches.join(of, "job_id", "left_semi").select("match_id")
    without = lambda keys, key: lambda stored: stored.join(keys, key, "left_anti")
    return change(spark, folder, {"postings": ("id", gone, without(gone, "id")), "matches": ("job_id", of, without(of, "job_id")), "documents": ("match_id", unmatched, without(unmatched, "match_id"))})
