"""Intermediate tables in the folder that driver and executors share, so that a lost executor costs no more than the task at hand."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one is made only where master is local and none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: How to write rows of megabytes: without these a writer and a reader hold a hundred of them at a time, whatever their size.
WIDE = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false"}


def kept(df: DataFrame, wide: bool = False) -> DataFrame:
    """The table as written and read again; it goes when the driver ends. Rows of a `wide` table have megabytes each."""
    spark, at = df.sparkSession, f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.options(**WIDE if wide else {}).parquet(at)
    path, files = _path(spark, at)
    files.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that was kept, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path, files = _path(df.sparkSession, folder)
        files.delete(path, True)


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """The table, kept, with a number of its own for each row: what ids that repeat or are missing can't give."""
    return kept(df.withColumn(name, F.monotonically_increasing_id()))
