"""Pivots of any two axes: values of a field, equal bins of a number, or selections by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analytics import bucket_count
from .shared import small

NA = "N/A"


@dataclass(frozen=True)
class Axis:
    """keys: the array of a row's members; fixed: members that are shown without rows too; field: whether rows may lack a value."""

    keys: Column
    fixed: tuple[str, ...] = ()
    field: bool = True


def values(c: Column, listed: bool = False) -> Axis:
    """The values of a field; a list counts once for each different value, nulls and empty lists as N/A."""
    found = F.array_distinct(F.filter(c.cast("array<string>"), lambda x: x.isNotNull())) if listed else F.array_compact(F.array(c.cast("string")))
    return Axis(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NA))))


def selections(named: dict[str, Column]) -> Axis:
    """Selections by name, which may overlap; a row outside all of them is in no member, and N/A is none."""
    inside = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in named.items())))
    return Axis(inside, tuple(named), False)


def numbers(df: DataFrame, c: str, chosen: int | None = None) -> Axis:
    """A number by its values, or by equal bins numbered from 0 where the policy of ``bucket_count`` says so; bins stay without rows too."""
    number = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    told = df.agg(F.count_distinct(number).alias("n"), F.min(number).alias("least"), F.max(number).alias("most")).first()
    bins = bucket_count(told["n"], chosen)
    if not bins or not told["least"] < told["most"]:
        return values(F.col(c))
    step = (told["most"] - told["least"]) / bins
    at = F.when(number.isNotNull(), F.least(F.floor((number - told["least"]) / step), F.lit(bins - 1)))
    return Axis(values(at).keys, tuple(str(k) for k in range(bins)))



def cross(df: DataFrame, rows: Axis, cols: Axis) -> DataFrame:
    """(row, col, n, row_total, col_total) of each pair of members.

    A row's total is its member's size, so overlapping columns don't add up to it; a column's total is the sum of its cells.
    Values appear with the cells that aren't 0; fixed members (selections, bins) appear in every row and column that is shown.
    A row of df counts once a cell. An empty table gives the fixed members only.
    """
    held = df.select(rows.keys.alias("row"), cols.keys.alias("col"))
    # each different pair of key lists is counted before lists are taken apart
    packed = held.groupBy("row", "col").agg(F.count(F.lit(1)).alias("w"))
    cells = packed.select(F.explode("row").alias("row"), "col", "w").select("row", F.explode("col").alias("col"), "w").groupBy("row", "col").agg(F.sum("w").alias("n"))
    sizes = packed.select(F.explode("row").alias("row"), "w").groupBy("row").agg(F.sum("w").alias("row_total"))

    def members(side: str, axis: Axis) -> DataFrame:
        fixed = df.sparkSession.createDataFrame([(k,) for k in axis.fixed], f"{side} string")
        return cells.select(side).union(fixed).distinct()

    if rows.fixed or cols.fixed:
        frame = cells.select("row", "col")
        if cols.fixed:
            frame = frame.union(members("row", rows).select("row", F.explode(F.array(*(F.lit(k) for k in cols.fixed)))))
        if rows.fixed:
            frame = frame.union(members("col", cols).select(F.explode(F.array(*(F.lit(k) for k in rows.fixed))), "col"))
        cells = frame.distinct().join(cells, ["row", "col"], "left")
    whole = cells.withColumn("n", F.coalesce("n", F.lit(0)))
    totals = whole.groupBy("col").agg(F.sum("n").alias("col_total"))
    out = whole.join(small(sizes), "row", "left").join(small(totals), "col")
    return out.select("row", "col", "n", F.coalesce("row_total", F.lit(0)).alias("row_total"), "col_total")


def without_na(cells: DataFrame) -> DataFrame:
    """Cells of ``cross`` without the row and column of missing values, and totals less what these held."""
    missing = cells.filter(F.col("col") == NA).select("row", F.col("n").alias("no_col"))
    absent = cells.filter(F.col("row") == NA).select("col", F.col("n").alias("no_row"))
    kept = cells.filter((F.col("row") != NA) & (F.col("col") != NA)).join(small(missing), "row", "left").join(small(absent), "col", "left")
    less = lambda total, gone: (F.col(total) - F.coalesce(gone, F.lit(0))).alias(total)
    return kept.select("row", "col", "n", less("row_total", "no_col"), less("col_total", "no_row"))


def shares(cells: DataFrame) -> DataFrame:
    """Cells with their share of the row's and of the column's total; 0 of an empty one."""
    part = lambda total: F.coalesce(F.try_divide(F.col("n"), F.col(total)), F.lit(0.0))
    return cells.withColumns({"row_share": part("row_total"), "col_share": part("col_total")})
