"""Streams: incremental upserts, cooldowns that outlive a restart, and windowed counts of late events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import versions


def upsert_stream(postings: DataFrame, folder: str, checkpoint: str, key: str = "key", order: tuple[str, ...] = ("scraped",)) -> StreamingQuery:
    """Each batch is one commit to a table of postings in buckets by key, and writes only the buckets that it has keys of. A batch that comes again after a restart is known by its number and changes nothing."""

    def step(batch: DataFrame, number: int) -> None:
        versions.upsert_postings(folder, batch.select(*batch.columns), key, list(order), ("scraped",), f"{checkpoint}#{number}")

    return postings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The postings as of the last commit, or None before the first."""
    return versions.read(spark, folder, "postings")


def cooldowns(attempts: DataFrame, wait_seconds: int) -> DataFrame:
    """site, at, allowed of a stream of attempts (site, at): an attempt may go if the last one that went is `wait_seconds` old. The time is kept before the attempt is made, so one that fails waits as well."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for at in sorted(t for part in parts for t in part["at"]):
            go = last is None or at.value - last >= wait_seconds * 10**9
            last = at.value if go else last
            rows.append((key[0], at, go))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=["site", "at", "allowed"])

    return attempts.groupBy("site").applyInPandasWithState(run, "site string, at timestamp, allowed boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of each kind of event by tumbling windows; later events than `late` are dropped. An addition for streams, beyond the batch operators."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
