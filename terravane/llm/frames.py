"""Shared-folder tables and small DataFrame helpers of the llm operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one only where it is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "snappy", group_rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, lost executors cost nothing.

    Wide rows need a bound on the rows of a row group: a reader decodes a whole group (4096 rows at most) at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terravane/{uuid.uuid4().hex}/{name}"
    writer = df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._terravane_path = path
    return out


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write df as a table of the shared folder, bucketed by key: joins on key read it without an exchange."""
    spark = df.sparkSession
    table = f"terravane_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/terravane/{table}"
    most = min(partitions(spark), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    df.write.format("parquet").bucketBy(most, key).option("path", path).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    out._terravane_path, out._terravane_table = path, table
    return out


def discard(*frames: DataFrame) -> None:
    """Delete materialised tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_terravane_path", None)
        if path:
            spark = df.sparkSession
            if getattr(df, "_terravane_table", None):
                spark.sql(f"DROP TABLE IF EXISTS {df._terravane_table}")
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def named(column: str) -> Column:
    """A column by its whole name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; equal texts, equal keys."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, jobs hand Python at most so many rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand Python at most so many texts at a time; a batch is then a few MB."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
