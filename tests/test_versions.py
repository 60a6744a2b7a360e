"""Tables in buckets that change together."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.operators import store, versions
from quarry.streaming import ingest

NOW = dt.datetime(2024, 6, 30, tzinfo=dt.timezone.utc)
SCHEMA = "key string, title string, url string, scraped timestamp"


def files(folder):
    return {str(p.relative_to(folder)) for p in Path(folder).rglob("*.parquet")}


def rows_of(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


def test_upserts_write_only_the_buckets_they_touch(spark, tmp_path):
    folder = str(tmp_path)
    first = spark.createDataFrame([(f"k{k}", None, "u", NOW) for k in range(500)], SCHEMA)
    assert versions.upsert_postings(folder, first, "key", ["title"]) == 1
    before, old = files(folder), versions.state(spark, folder)["postings"]["buckets"]
    assert len(old) == versions.BUCKETS
    small = spark.createDataFrame([("k7", "T", "u", NOW), ("new", "N", "v", NOW), (None, "x", "y", NOW)], SCHEMA)
    versions.upsert_postings(folder, small, "key", ["title"])
    new = versions.state(spark, folder)["postings"]["buckets"]
    touched = {k for k in new if new[k] != old.get(k)}
    assert 1 <= len(touched) <= 2 and len(files(folder) - before) <= 2
    expected = store.upsert_postings(first, small.where("key IS NOT NULL"), "key", ["title"]).drop("is_new")
    assert rows_of(versions.read(spark, folder, "postings")) == rows_of(expected)
    versions.upsert_postings(folder, small.limit(0), "key", ["title"])
    assert rows_of(versions.read(spark, folder, "postings")) == rows_of(expected)
    versions.upsert_postings(folder, small, "key", ["title"])
    assert versions.commits(spark, folder) == [3, 4]
    named = {p for t in (3, 4) for p in versions.state(spark, folder, t)["postings"]["buckets"].values()}
    assert {f"data/postings/{p.split('/')[2]}" for p in files(folder)} == {p.rsplit("/", 1)[0] for p in named}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    batch = spark.createDataFrame([("a", "A", "u", NOW)], SCHEMA)
    assert versions.upsert_postings(str(tmp_path), batch, "key", ["title"], tag="s#0") == 1
    assert versions.upsert_postings(str(tmp_path), batch, "key", ["title"], tag="s#0") is None
    assert versions.commits(spark, str(tmp_path)) == [1]


def tables(spark, folder):
    old = NOW - dt.timedelta(days=90)
    postings = spark.createDataFrame([(1, "old", old, old), (2, "tracked", old, old), (3, "new", NOW, NOW), (4, "drafted", old, old), (5, "dateless", None, old)], "id long, title string, posted timestamp, scraped timestamp")
    matches = spark.createDataFrame([(10, 1, "new"), (20, 2, "saved"), (30, 3, "new"), (40, 4, "hidden"), (50, 5, "new"), (51, 5, "hidden")], "match_id long, job_id long, status string")
    documents = spark.createDataFrame([(40, "letter"), (99, "orphan")], "match_id long, body string")
    same = lambda frame: lambda stored: frame
    versions.change(spark, folder, {"postings": ("id", postings, same(postings)), "matches": ("job_id", matches, same(matches)), "documents": ("match_id", documents, same(documents))})


def ids(spark, folder):
    return [sorted(r[0] for r in versions.read(spark, folder, name).select(key).collect()) for name, key in (("postings", "id"), ("matches", "match_id"), ("documents", "match_id"))]


def test_cleaning_cascades_in_one_commit(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    assert versions.clean(spark, folder, F.lit(NOW)) == 2
    assert ids(spark, folder) == [[2, 3, 4], [20, 30, 40], [40, 99]]
    gone = spark.createDataFrame([(4,)], "id long")
    left = store.delete_stale(*(versions.read(spark, folder, n) for n in ("postings", "matches")), gone, versions.read(spark, folder, "documents"))
    assert [sorted(r[0] for r in t.select(c).collect()) for t, c in zip(left, ("id", "match_id", "match_id"), strict=True)] == [[2, 3], [20, 30], [99]]


@pytest.mark.parametrize("writes", [1, 2, 3])
def test_a_failure_between_writes_leaves_the_old_tables(spark, tmp_path, monkeypatch, writes):
    folder = str(tmp_path)
    tables(spark, folder)
    before, real, done = ids(spark, folder), versions._written, []

    def fails(*args):
        done.append(1)
        if len(done) == writes:
            raise OSError("lost")
        return real(*args)

    with monkeypatch.context() as m:
        m.setattr(versions, "_written", fails)
        with pytest.raises(OSError):
            versions.clean(spark, folder, F.lit(NOW))
    assert ids(spark, folder) == before
    assert versions.clean(spark, folder, F.lit(NOW)) == 2 and ids(spark, folder) == [[2, 3, 4], [20, 30, 40], [40, 99]]


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    tables(spark, folder)
    versions._commit(spark, folder, 2, {"tables": versions.state(spark, folder), "tag": "other"})
    with pytest.raises(RuntimeError, match="another writer"):
        versions._commit(spark, folder, 2, {"tables": {}, "tag": None})
    assert ids(spark, folder)[0] == [1, 2, 3, 4, 5]


def test_stream_restarts(spark, tmp_path):
    source, folder, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in ([("a", None, "u", NOW)], [("a", "T", "u", NOW), ("b", "B", "v", NOW)], []):
        if rows:
            spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(source)
        ingest.upsert_stream(spark.readStream.schema(SCHEMA).parquet(source), folder, check).awaitTermination()
    assert {(r.key, r.title) for r in ingest.latest(spark, folder).collect()} == {("a", "T"), ("b", "B")}
    last = versions.commits(spark, folder)[-1]
    newest = max((Path(check) / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.with_name(f".{newest.name}.crc").unlink(missing_ok=True)
    newest.unlink()  # as if the driver had died after the commit of the table and before that of the stream
    ingest.upsert_stream(spark.readStream.schema(SCHEMA).parquet(source), folder, check).awaitTermination()
    assert versions.commits(spark, folder)[-1] == last and ingest.latest(spark, folder).count() == 2
