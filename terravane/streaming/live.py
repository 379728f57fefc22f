"""Tables kept up to date by Structured Streaming: counts from a change log, a capped log, a spaced sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import sampling, spatial

CHANGES = "version long, id long, before struct<id:long,event_type:string,heading:double>, after struct<id:long,event_type:string,heading:double>"


def signed(log: DataFrame, selected) -> DataFrame:
    """(key, delta): what each change adds to and takes from the selected rows; ``selected`` makes a boolean column from a struct column's name."""
    gone = F.when(F.col("before").isNotNull() & selected("before"), F.struct(F.col("before.event_type").alias("key"), F.lit(-1).alias("delta")))
    come = F.when(F.col("after").isNotNull() & selected("after"), F.struct(F.col("after.event_type").alias("key"), F.lit(1).alias("delta")))
    return log.select(F.explode(F.filter(F.array(gone, come), lambda x: x.isNotNull())).alias("x")).select("x.key", "x.delta")


def heading_over(limit: float):
    def of(side: str) -> Column:
        return F.coalesce(F.col(f"{side}.heading") > limit, F.lit(False))

    return of


def live_counts(spark, log_path: str, out_path: str, checkpoint: str, selected) -> None:
    """Read what is new in the log, keep signed sums by key as state, and write the counts as a table after each batch."""
    stream = spark.readStream.schema(CHANGES).parquet(log_path)
    counts = signed(stream, selected).groupBy("key").agg(F.sum("delta").alias("n"))

    def keep(batch: DataFrame, _: int) -> None:
        batch.filter("n <> 0").write.mode("overwrite").parquet(out_path)

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def capped_log(spark, in_path: str, schema: str, out_path: str, checkpoint: str, most: int = 10_000) -> None:
    """Append visits to a log that keeps the newest ``most``: a batch writes the next generation beside the last."""
    stream = spark.readStream.schema(schema).parquet(in_path)

    def keep(batch: DataFrame, n: int) -> None:
        old = spark.read.schema(schema).parquet(f"{out_path}/{n - 1}") if n else batch.limit(0)
        old.unionByName(batch).orderBy(F.desc("at"), F.desc("id")).limit(most).write.mode("overwrite").parquet(f"{out_path}/{n}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def spaced_stream(spark, in_path: str, schema: str, out_path: str, checkpoint: str, metres: float) -> None:
    """Of points (id, lat, lng, …) as they arrive, keep those at least metres, straight through the sphere, from all kept before.

    A batch drops what is too close to earlier batches by a semi join on cells, then takes points in the order of ids. Its picks
    are a folder of their own, so a batch that runs twice writes the same folder again.
    """
    stream = spark.readStream.schema(schema).parquet(in_path)

    def keep(batch: DataFrame, n: int) -> None:
        points = batch.dropDuplicates(["id"])
        if n:
            earlier = spark.read.schema(schema).parquet(*(f"{out_path}/{k}" for k in range(n)))
            crowded = spatial.near_ids(points, earlier, metres * 1.01, _chord() < metres * metres)
            points = points.join(crowded, "id", "left_anti")
        sampling.spread_by(points, metres, _chord() < metres * metres, F.col("id")).write.mode("overwrite").parquet(f"{out_path}/{n}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _chord() -> Column:
    return geo.chord_m2(F.col("p_lat"), F.col("p_lng"), F.col("i_lat"), F.col("i_lng"))
