"""What several operators need: a cut lineage, running sums over any key, broadcasts of a counted size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of its own only in local mode, as in tests: a cluster must name one."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder that all executors share."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def running(df: DataFrame, by: list[str], order: list[str], value: Column, name: str = "sum") -> DataFrame:
    """df with the sum of value over the rows of the same ``by`` (null is a key too) up to and with each row in ``order``, which tells rows apart.

    Rows are dealt by ranges of (by, order), so a key with most of the rows, or no key at all, spreads over tasks; sums of the
    earlier ranges, at most one row a range and key, are added to the sums inside a range.
    """
    dealt = checkpointed(df.withColumn("_value", value).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "_part").agg(F.sum("_value").alias("_own"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_own").over(earlier), F.lit(0))).drop("_own")
    inside = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = dealt.withColumn(name, F.sum("_value").over(inside)).alias("r")
    same = F.col("r._part") == F.col("b._part")
    for c in by:
        same = same & F.col(f"r.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    total = (F.col(f"r.`{name}`") + F.col("b._before")).alias(name)
    return rows.join(before.alias("b"), same).select(*(F.col(f"r.`{c}`") for c in df.columns), total)


def latest(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """df with, for each name, the last value that isn't null among the earlier rows of the same ``by`` in ``order``, the row left out.

    Dealt as in ``running``: a key with most of the rows spreads over tasks, and only the last values of a range, one row a range
    and key, are carried on to later ranges.
    """
    dealt = checkpointed(df.withColumns({f"_v_{n}": v for n, v in values.items()}).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    place = F.struct(*order)
    ends = dealt.groupBy(*by, "_part").agg(*(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_l_{n}") for n in values))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*by, "_part", *(F.last(f"_l_{n}", True).over(earlier).alias(f"_c_{n}") for n in values))
    inside = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = dealt.withColumns({f"_w_{n}": F.last(f"_v_{n}", True).over(inside) for n in values}).alias("r")
    same = F.col("r._part") == F.col("b._part")
    for c in by:
        same = same & F.col(f"r.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    return rows.join(carried.alias("b"), same).select(*(F.col(f"r.`{c}`") for c in df.columns), *(F.coalesce(F.col(f"r._w_{n}"), F.col(f"b._c_{n}")).alias(n) for n in values))
