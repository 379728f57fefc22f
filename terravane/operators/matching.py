"""Search of places by the vectors of their pictures' crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_QUERIES = 256


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def probability(scale: float, bias: float):
    """A cosine as the probability that a text fits."""
    return lambda cosine: F.lit(1.0) / (F.lit(1.0) + F.exp(-(cosine * scale + bias)))


def image_queries(crops: DataFrame, place: str, vector: str) -> DataFrame:
    """(query_id, query) of each place: the mean of its crops, of length 1 (a mean of zeros stays)."""
    parts = crops.select(F.col(place).alias("query_id"), F.posexplode(vector).alias("k", "x"))
    means = parts.groupBy("query_id", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = means.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("mean"))
    norm = F.sqrt(_dot(F.col("mean"), F.col("mean")))
    return mean.withColumn("norm", norm).select("query_id", F.transform("mean", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(x)).alias("query"))


def search(crops: DataFrame, place: str, vector: str, queries: DataFrame, k: int | None = None, threshold: float | None = None, score=lambda cosine: cosine, exclude_self: bool = False) -> DataFrame:
    """(query_id, place, score, rank): the best places for each query (query_id, query), by the largest product over a place's crops.

    Scores are rounded to four places before threshold and rank; ties go to the smaller place. At most MOST_QUERIES queries: they
    go to every task as one row. Every crop is scored, and of each place and task one row a query is shuffled. exclude_self leaves
    out the place that has the query's id. Null vectors and those with null components give no score; without one a place isn't found.
    """
    n = queries.limit(MOST_QUERIES + 1).count()
    if n > MOST_QUERIES:
        raise ValueError(f"at most {MOST_QUERIES} queries at a time")
    all_queries = queries.agg(F.collect_list(F.struct("query_id", "query")).alias("queries"))
    pairs = crops.select(F.col(place).alias("place"), F.col(vector).alias("vector")).join(F.broadcast(all_queries), F.lit(True))
    pairs = pairs.select("place", "vector", F.explode("queries").alias("q")).select("place", "q.query_id", _dot(F.col("vector"), F.col("q.query")).alias("dot"))
    if exclude_self:
        pairs = pairs.filter(F.col("place") != F.col("query_id"))
    best = pairs.filter(F.col("dot").isNotNull()).groupBy("query_id", "place").agg(F.max("dot").alias("dot"))
    scored = best.select("query_id", "place", F.round(score(F.col("dot")), 4).alias("score"))
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold)
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "place")))
    return ranked.filter(F.col("rank") <= k) if k is not None else ranked
