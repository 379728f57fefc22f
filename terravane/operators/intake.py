"""Bringing rows in: what a file holds, what lands of it, and what another table already has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .asks import held

# What each destination keeps, from the smallest to the largest.
SHAPES = ["geoguessr", "mapmaking", "local"]
_FROM_MAPMAKING = ["tags", "pano_date", "flags"]


def sniff(spark: SparkSession, path: str) -> str:
    """json or csv, by the first character that isn't white space."""
    head = spark.read.text(path).filter(F.length(F.trim("value")) > 0).limit(1).collect()
    return "json" if head and head[0]["value"].lstrip("﻿ \t")[0] in "[{" else "csv"


def preview(df: DataFrame, carried: dict[str, Column], extra: str = "extra") -> DataFrame:
    """(field, n): the rows in all, those that carry each droppable field, and those with each key of the open column; only fields that some row carries."""
    named = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(n) for n, c in carried.items()))
    fixed = named.unpivot([], ["rows", *carried], "field", "n").filter("n > 0 OR field = 'rows'")
    keys = df.select(F.explode(F.json_object_keys(extra)).alias("key")).groupBy(F.concat(F.lit("extra."), "key").alias("field")).agg(F.count(F.lit(1)).alias("n"))
    return fixed.unionByName(keys)


def land(df: DataFrame, drop_fields: list[str], drop_tags: list[int], add_tags: list[int]) -> DataFrame:
    """Staged rows as they land: fields emptied, tags taken out, tags put on every row once."""
    tags = F.array_except("tags", F.array(*(F.lit(t).cast("long") for t in drop_tags))) if drop_tags else F.col("tags")
    tags = F.array_union(tags, F.array(*(F.lit(t).cast("long") for t in add_tags))) if add_tags else tags
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in drop_fields} | {"tags": tags})


def shaped(df: DataFrame, shape: str) -> DataFrame:
    """What a destination of this shape keeps: tags, unpinned panorama ids, dates and further flag bits from mapmaking on, open fields in local only."""
    level = SHAPES.index(shape)
    out = df
    if level < 1:
        pinned = F.col("flags").bitwiseAND(1) != 0
        out = out.withColumn("pano_id", F.when(pinned, F.col("pano_id"))).withColumn("flags", F.col("flags").bitwiseAND(1))
        out = out.drop(*(c for c in _FROM_MAPMAKING if c in df.columns and c != "flags"))
    return out if level == 2 else out.drop("extra")


def copy_missing(rows: DataFrame, into: DataFrame) -> DataFrame:
    """into with the rows that it doesn't hold yet (by panorama id, else by exact coordinates)."""
    new = held(rows, into).filter("NOT held").select("id")
    return into.unionByName(rows.join(new, "id", "left_semi").select(*into.columns))


def by_name(rows: DataFrame, name: str, records: DataFrame) -> DataFrame:
    """rows with the id of the record (id, name) that their name means: white space around it and case don't count; the least id of equal names."""
    folded = lambda c: F.lower(F.trim(c))
    known = records.groupBy(folded("name").alias("folded")).agg(F.min("id").alias("record_id"))
    return rows.withColumn("folded", folded(name)).join(known, "folded", "left").drop("folded")
