"""Layers over a table, edits of rows, commits, and the alignment of a copy that was changed elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import changes
from .shared import running


def overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """base under a layer (id, op, …): add gives a row, remove takes one, patch writes over a row that is there.

    A layer with ``written``, the names of the columns that a patch writes, writes nulls too and so clears fields; without it a
    patch writes what it holds.
    """
    cols = [c for c in base.columns if c != "id"]
    named = ["written"] if "written" in over.columns else []
    above = over.filter("op <> 'add'").select("id", "op", *named, *(F.col(c).alias(f"o_{c}") for c in cols))
    under = base.join(above, "id", "left").filter(~F.col("op").eqNullSafe("remove"))
    value = lambda c: F.when(F.coalesce(F.array_contains("written", c), F.lit(False)), F.col(f"o_{c}")).otherwise(F.col(c)) if named else F.coalesce(F.col(f"o_{c}"), F.col(c))
    kept = under.select("id", *(value(c).alias(c) for c in cols))
    return kept.unionByName(over.filter("op = 'add'").select("id", *cols))


def edited(table: DataFrame, edits: DataFrame) -> DataFrame:
    """table after row edits (id, seq, op, …) in their order: add and set give the whole row, remove takes it, put patches a row that is there.

    The last add, set or remove of an id is what later puts stand on; column by column the last put that writes it wins. A put
    writes the columns it names in ``written``, nulls too, or, where edits have no such column, the values it holds.
    """
    cols = [c for c in table.columns if c != "id"]
    reset = F.max(F.when(F.col("op") != "put", F.col("seq"))).over(W.partitionBy("id"))
    live = edits.withColumn("reset", reset).filter("reset IS NULL OR seq >= reset")
    writes = lambda c: (F.col("op") != "put") | F.coalesce(F.array_contains("written", c), F.lit(False)) if "written" in edits.columns else F.col(c).isNotNull()
    last = lambda c: F.max_by(F.struct(F.col(c).alias("v")), F.when(writes(c), F.col("seq"))).alias(f"e_{c}")
    by = live.groupBy("id").agg(F.max("reset").alias("reset"), F.max(F.when(F.col("seq") == F.col("reset"), F.col("op"))).alias("op"), *(last(c) for c in cols))
    both = table.withColumn("there", F.lit(True)).join(by, "id", "full_outer")
    out = both.filter(F.when(F.col("op") == "remove", False).when(F.col("reset").isNotNull(), True).otherwise(F.coalesce("there", F.lit(False))))
    value = lambda c: F.when(F.col("reset").isNotNull() | F.col(f"e_{c}").isNotNull(), F.col(f"e_{c}.v")).otherwise(F.col(c))
    return out.select("id", *(value(c).alias(c) for c in cols))


def commit(parent: DataFrame | None, now: DataFrame) -> DataFrame:
    """The delta (op, row): what went (0) and what came (1) since the parent; a first commit is the whole table."""
    if parent is None:
        return now.select(F.lit(1).alias("op"), *now.columns)
    moved = changes.between(parent, now)
    gone = moved.filter("before IS NOT NULL").select(F.lit(0).alias("op"), "before.*")
    return gone.unionByName(moved.filter("after IS NOT NULL").select(F.lit(1).alias("op"), "after.*"))


def baked(base: DataFrame, over: DataFrame) -> DataFrame:
    """A layer written into its table, in the order of ids: range-partitioned, then sorted inside each part, so files hold rising ids."""
    return overlay(base, over).repartitionByRange("id").sortWithinPartitions("id")


def counts_of_change(change: DataFrame, keys: Column) -> DataFrame:
    """(key, n): how a change moves the number of rows of each key; keys is an array computed from ``row``."""
    before = change.filter("before IS NOT NULL").select(F.col("before").alias("row"), F.lit(-1).alias("sign"))
    after = change.filter("after IS NOT NULL").select(F.col("after").alias("row"), F.lit(1).alias("sign"))
    each = before.unionByName(after).select(F.explode(keys).alias("key"), "sign")
    return each.groupBy("key").agg(F.sum("sign").alias("n")).filter("n <> 0")


def diff_counts(change: DataFrame, columns: list[str]) -> DataFrame:
    """(kind, field, n): rows added, removed and updated (field null), and in how many of these each column differs."""
    named = change.withColumn("kind", changes.kind())
    some = F.filter(F.array(F.lit(None).cast("string"), *(F.when((F.col("kind") == "updated") & ~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)).otherwise("") for c in columns)), lambda x: x.isNull() | (x != ""))
    return named.select("kind", F.explode(some).alias("field")).groupBy("kind", "field").agg(F.count(F.lit(1)).alias("n"))


def _nth(df: DataFrame, by: str, order: str) -> DataFrame:
    return running(df, [by], [order], F.lit(1), "nth")


def realigned(mapping: DataFrame, remote: DataFrame) -> DataFrame:
    """(i, local_id, step): which rows of a remote array (i, hash, pano) are those written before (local_id, seq, remote_id, hash, pano).

    1 the same content at the place it was written to; 2 the same content elsewhere, first come first served; 3 a panorama that is
    single among what is left on both sides; 4 the bare place, if the array is as long as it was.
    """
    m, r = mapping.alias("m"), remote.alias("r")
    one = m.join(r, (F.col("m.remote_id") == F.col("r.i")) & (F.col("m.hash") == F.col("r.hash"))).groupBy("r.i").agg(F.min_by("m.local_id", "m.seq").alias("local_id"))
    claims = one.select("i", "local_id", F.lit(1).alias("step"))

    def left(claimed: DataFrame) -> tuple[DataFrame, DataFrame]:
        return mapping.join(claimed.select("local_id"), "local_id", "left_anti"), remote.join(claimed.select("i"), "i", "left_anti")

    pending, free = left(claims)
    two = _nth(pending, "hash", "seq").join(_nth(free, "hash", "i").select("hash", "nth", "i"), ["hash", "nth"]).select("i", "local_id", F.lit(2).alias("step"))
    claims = claims.unionByName(two)
    pending, free = left(claims)
    single = lambda df, c: df.filter("pano IS NOT NULL").groupBy("pano").agg(F.min(c).alias(c), F.count(F.lit(1)).alias("n")).filter("n = 1").select("pano", c)
    three = single(pending, "local_id").join(single(free, "i"), "pano").select("i", "local_id", F.lit(3).alias("step"))
    claims = claims.unionByName(three)
    pending, free = left(claims)
    sizes = mapping.agg(F.count(F.lit(1)).alias("a")).join(F.broadcast(remote.agg(F.count(F.lit(1)).alias("b"))), F.lit(True)).filter("a = b")  # one row each
    four = pending.join(free.select("i"), F.col("remote_id") == F.col("i")).groupBy("i").agg(F.min_by("local_id", "seq").alias("local_id"))
    four = four.join(F.broadcast(sizes), F.lit(True)).select("i", "local_id", F.lit(4).alias("step"))
    return claims.unionByName(four)
