"""A Spark session with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(app: str = "quarry", **conf: str) -> SparkSession:
    """UTC, adaptive plans; all else is the cluster's choice."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over as many tasks as the session's default parallelism. For small compressed files of long texts, which arrive in one or two partitions and cost far more to work on than to shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if n > 1 else df
