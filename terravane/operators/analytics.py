"""Statistics of groups: rank, circular and categorical separation, pivots, vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import running


def pivot(df: DataFrame, row: Column, col: Column) -> DataFrame:
    """(row, col, n, row_total): absent values are N/A."""
    cells = df.groupBy(F.coalesce(row.cast("string"), F.lit("N/A")).alias("row"), F.coalesce(col.cast("string"), F.lit("N/A")).alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("row_total", F.sum("n").over(W.partitionBy("row")))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """epsilon squared of the tie-corrected Kruskal-Wallis statistic, on counts by value, ranked by running counts."""
    tally = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    by = tally.groupBy("v").agg(F.sum("c").alias("t"))
    ranks = running(by, [], ["v"], F.col("t"), "upto").withColumn("rank", F.col("upto") - F.col("t") + (F.col("t") + 1) / 2)
    sums = tally.join(ranks, "v").groupBy("g").agg(F.sum(F.col("rank") * F.col("c")).alias("r"), F.sum("c").alias("size"))
    ties = by.agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    a = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("size")).alias("x"), F.sum("size").cast("double").alias("n"), F.count(F.lit(1)).alias("k")).join(F.broadcast(ties), F.lit(True))
    n = F.col("n")
    h = (F.col("x") * 12 / (n * (n + 1)) - (n + 1) * 3) / F.greatest(F.lit(1) - F.col("ties") / (n * n * n - n), F.lit(1e-300))
    return a.select(F.when(F.col("k") < 2, None).otherwise(F.least(F.greatest(h / (n - 1), F.lit(0.0)), F.lit(1.0))).alias("eps2"))


def circular(df: DataFrame, group: str, value: str, period: float = 360.0) -> DataFrame:
    """(group, mean, concentration) of a circular field."""
    t = F.col(value) * (2 * math.pi / period)
    a = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.sum(F.cos(t)).alias("c"), F.sum(F.sin(t)).alias("s"), F.count(F.lit(1)).alias("n"))
    return a.select(group, (F.pmod(F.atan2("s", "c"), F.lit(2 * math.pi)) / (2 * math.pi) * period).alias("mean"), (F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n")).alias("concentration"))


def cramers_v(df: DataFrame, group: str, value: str) -> DataFrame:
    """Bias-corrected Cramér's V from a contingency table."""
    cell = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("o"))
    g, v = cell.groupBy("g").agg(F.sum("o").alias("gt")), cell.groupBy("v").agg(F.sum("o").alias("vt"))
    total = cell.agg(F.sum("o").cast("double").alias("n"), F.countDistinct("g").alias("r"), F.countDistinct("v").alias("k"))
    # Σ (o - e)² / e = n Σ o² / (gt vt) - n, so cells without rows need not exist
    x = cell.join(g, "g").join(v, "v").agg(F.sum(F.col("o").cast("double") * F.col("o") / F.col("gt") / F.col("vt")).alias("q")).join(F.broadcast(total), F.lit(True))
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    phi = F.greatest(F.lit(0.0), F.col("q") - 1 - (k - 1) * (r - 1) / (n - 1))
    d = F.least(k - (k - 1) * (k - 1) / (n - 1) - 1, r - (r - 1) * (r - 1) / (n - 1) - 1)
    return x.select(F.when((r < 2) | (k < 2) | (d <= 0), 0.0).otherwise(F.least(F.sqrt(phi / d), F.lit(1.0))).alias("v"))


def quartiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, p25, p50, p75), interpolated between neighbouring places; from counts by value, so no task holds the values of a group."""
    tally = df.groupBy(group, value).agg(F.count(value).alias("c"))
    upto = running(tally.filter(F.col(value).isNotNull()), [group], [value], F.col("c"), "upto")
    sizes = tally.groupBy(group).agg(F.sum("c").alias("n"))
    j = sizes.alias("s").join(upto.alias("u"), F.col(f"s.{group}").eqNullSafe(F.col(f"u.{group}")), "left")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("c") <= place) & (place < F.col("upto")), F.col(value).cast("double")))

    places = {"p25": (F.col("n") - 1) * 0.25, "p50": (F.col("n") - 1) * 0.5, "p75": (F.col("n") - 1) * 0.75}
    ends = [f(x).alias(f"{k}_{side}") for k, x in places.items() for side, f in (("lo", lambda x: at(F.floor(x))), ("hi", lambda x: at(F.ceil(x))))]
    found = j.groupBy(f"s.{group}", "n").agg(*ends)
    return found.select(group, *((F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * (x - F.floor(x))).alias(k) for k, x in places.items()))


def spread(df: DataFrame, key: str) -> DataFrame:
    """1 minus the total-variation distance of a field's shares from equal shares."""
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    a = c.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    return c.join(F.broadcast(a), F.lit(True)).agg((F.lit(1.0) - F.sum(F.abs(F.col("c") / F.col("n") - F.lit(1.0) / F.col("k"))) / 2).alias("spread"))


def vector_top(df: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(vec_id, dot): the k largest dot products with one query vector, the query left out."""
    one = query.select("vec_id", "embedding").limit(2).collect()
    if len(one) != 1:
        raise ValueError(f"one query vector is needed, not {len(one) or 'none'}")
    q = F.array(*(F.lit(float(x)) for x in one[0]["embedding"]))
    dot = F.aggregate(F.zip_with("embedding", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    return df.filter(F.col("vec_id") != one[0]["vec_id"]).select("vec_id", F.round(dot, 4).alias("dot")).orderBy(F.desc("dot"), "vec_id").limit(k)


BUCKETS = {"least": 10, "forced": 100, "usual": 10}


def bucket_count(distinct: int, chosen: int | None) -> int | None:
    """Few different values need no buckets, many force them, in between the choice holds."""
    if distinct < BUCKETS["least"]:
        return None
    return chosen if distinct < BUCKETS["forced"] or chosen is not None else BUCKETS["usual"]


def shares(cells: DataFrame) -> DataFrame:
    """Cells (row, col, n) of a pivot without N/A, with their share of the row and of the column (0 of an empty one)."""
    kept = cells.filter("row <> 'N/A' AND col <> 'N/A'").select("row", "col", "n")
    share = lambda by: F.col("n") / F.sum("n").over(W.partitionBy(by))
    return kept.withColumns({"row_share": share("row"), "col_share": share("col")})


def exclusive(chosen: dict[str, Column]) -> dict[str, Column]:
    """Each group without the rows of the others."""
    out = {}
    for name, c in chosen.items():
        others = F.lit(False)
        for other, x in chosen.items():
            if other != name:
                others = others | x
        out[name] = c & ~others
    return out


def circular_eta2(df: DataFrame, group: str, value: str, period: float = 360.0) -> DataFrame:
    """How far groups part a circular field: what the groups' own resultants gain over the one of all, 0 to 1; null below two groups."""
    t = F.col(value) * (2 * math.pi / period)
    by = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.sum(F.cos(t)).alias("c"), F.sum(F.sin(t)).alias("s"), F.count(F.lit(1)).alias("n"))
    length = lambda c, s: F.sqrt(c * c + s * s)
    a = by.agg(F.sum(length(F.col("c"), F.col("s"))).alias("own"), length(F.sum("c"), F.sum("s")).alias("all"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    rest = F.col("n") - F.col("all")
    value_ = F.when(rest <= 1e-9, 0.0).otherwise(F.least(F.greatest((F.col("own") - F.col("all")) / rest, F.lit(0.0)), F.lit(1.0)))
    return a.select(F.when(F.col("k") >= 2, value_).alias("eta2"))


def coverage_v(df: DataFrame, group: str, value: str) -> DataFrame:
    """Cramér's V of holding a field or not."""
    return cramers_v(df.select(group, F.col(value).isNotNull().alias("held")), group, "held")


MIN_PRESENT = 8


def ranked_fields(scores: DataFrame) -> DataFrame:
    """Fields (field, value_score, coverage_score, least_present) by how well they part the groups: trusted value scores first, then coverage."""
    doubtful = F.col("least_present") < MIN_PRESENT
    key = F.when(F.col("value_score").isNotNull() & ~doubtful, 1 + F.col("value_score")).otherwise(F.col("coverage_score"))
    return scores.withColumns({"low_confidence": doubtful, "sort_key": key}).orderBy(F.desc("sort_key"), "field")
