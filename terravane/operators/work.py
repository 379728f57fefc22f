"""Bulk edits: each takes rows and a selection column and gives rows with ``changed``; only real changes stamp modified_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import running


def _write(df: DataFrame, chosen: Column, column: str, value: Column, now: int) -> DataFrame:
    changed = chosen & ~F.col(column).eqNullSafe(value)
    stamped = F.when(changed, F.lit(now).cast("long")).otherwise(F.col("modified_at"))
    return df.withColumns({column: F.when(changed, value).otherwise(F.col(column)), "modified_at": stamped, "changed": changed})


def set_field(df: DataFrame, chosen: Column, column: str, value, now: int) -> DataFrame:
    return _write(df, chosen, column, F.lit(value).cast(df.schema[column].dataType), now)


def _open_write(df: DataFrame, chosen: Column, body: Column, now: int) -> DataFrame:
    was = F.from_json("extra", "map<string,variant>")
    new = F.to_json(body)
    changed = chosen & ~F.to_json(was).eqNullSafe(new)
    stamped = F.when(changed, F.lit(now).cast("long")).otherwise(F.col("modified_at"))
    return df.withColumns({"extra": F.when(changed, new).otherwise(F.col("extra")), "modified_at": stamped, "changed": changed})


def set_open(df: DataFrame, chosen: Column, key: str, json_value: str, now: int) -> DataFrame:
    """Set a key of the open JSON column ``extra``; other values, nested ones too, stay as they are."""
    held = F.coalesce(F.from_json("extra", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return _open_write(df, chosen, F.map_concat(F.map_filter(held, lambda k, _: k != key), F.create_map(F.lit(key), F.parse_json(F.lit(json_value)))), now)


def delete_open(df: DataFrame, chosen: Column, keys: list[str], now: int) -> DataFrame:
    """Take keys out of the open JSON column."""
    return _open_write(df, chosen, F.map_filter(F.from_json("extra", "map<string,variant>"), lambda k, _: ~k.isin(keys)), now)


def set_expression(df: DataFrame, chosen: Column, column: str, score: Column, now: int) -> DataFrame:
    """A row whose expression has no value stays, with ``failed`` true."""
    out = _write(df.withColumn("_value", score), chosen & F.col("_value").isNotNull(), column, F.col("_value").cast(df.schema[column].dataType), now)
    return out.withColumn("failed", chosen & F.col("_value").isNull()).drop("_value")


def move_field(df: DataFrame, chosen: Column, source: str, target: str, source_wins: bool, now: int) -> DataFrame:
    """Rename or merge a field; who wins matters only where both are held."""
    if source == target or not target:
        return df.withColumn("changed", F.lit(False))
    value = F.coalesce(source, target) if source_wins else F.coalesce(target, source)
    moved = chosen & F.col(source).isNotNull()
    stamped = F.when(moved, F.lit(now).cast("long")).otherwise(F.col("modified_at"))
    return df.withColumns({target: F.when(chosen, value).otherwise(F.col(target)), source: F.when(chosen, F.lit(None)).otherwise(F.col(source)), "modified_at": stamped, "changed": moved})


def delete_fields(df: DataFrame, chosen: Column, columns: list[str], now: int) -> DataFrame:
    any_held = F.lit(False)
    for c in columns:
        any_held = any_held | F.col(c).isNotNull()
    changed = chosen & any_held
    return df.withColumns({c: F.when(chosen, F.lit(None)).otherwise(F.col(c)) for c in columns} | {"modified_at": F.when(changed, F.lit(now).cast("long")).otherwise(F.col("modified_at")), "changed": changed})


def list_set(df: DataFrame, chosen: Column, column: str, add: list[int], remove: list[int], now: int) -> DataFrame:
    """Take members out and put members in, in order; what is both added and removed stays. Duplicates of others are kept."""
    out = [r for r in remove if r not in add]
    kept = F.filter(column, lambda x: ~x.isin(out)) if out else F.col(column)
    new = F.array(*(F.lit(a).cast("long") for a in add)) if add else F.array().cast("array<bigint>")
    return _write(df, chosen, column, F.concat(kept, F.filter(new, lambda x: ~F.array_contains(kept, x))), now)


def merge_groups(df: DataFrame, group: str, score: Column) -> DataFrame:
    """One row a group: the best score survives (then the older, then the smaller id), with the tags of all."""
    order = F.struct(score.alias("s"), (-F.col("created_at")).alias("c"), (-F.col("id")).alias("i"))
    best = F.max_by(F.struct(*(c for c in df.columns if c not in (group, "tags"))), order)
    out = df.groupBy(group).agg(best.alias("r"), F.count(F.lit(1)).alias("size"))
    each = df.select(group, F.explode("tags").alias("tag")).groupBy(group).agg(F.array_sort(F.collect_set("tag")).alias("tags"))  # no more than there are tags
    return out.join(each, group, "left").select(group, "r.*", F.coalesce("tags", F.array().cast(df.schema["tags"].dataType)).alias("tags"), "size")


def duplicate_score() -> Column:
    """Tags, a panorama id, pinned, panned: one point each."""
    one = lambda c: F.when(c, 1).otherwise(0)
    return F.size("tags") + one(F.col("pano_id").isNotNull()) + one(F.col("flags").bitwiseAND(1) != 0) + one(F.col("heading") != 0)


def remap_values(df: DataFrame, column: str, mapping: dict[int, int]) -> DataFrame:
    """Replace list members after values were merged; first occurrences stay."""
    table = F.create_map(*(F.lit(x).cast("long") for k, v in mapping.items() for x in (k, v)))
    return df.withColumn(column, F.array_distinct(F.transform(column, lambda x: F.coalesce(F.try_element_at(table, x), x))))


def invalidated(depends: dict[str, list[str]], changed: set[str], written: set[str]) -> set[str]:
    """Derived fields to null: those that changed fields feed, step by step, unless the same edit wrote them."""
    out, todo = set(), set(changed)
    while todo:
        todo = {f for f, needs in depends.items() if todo & set(needs)} - out - written
        out |= todo
    return out


def streaks(df: DataFrame, by: str, order: str, hit: Column) -> DataFrame:
    """(by, best): the longest run of hits in order, which tells rows apart; a null condition is no hit."""
    rows = df.select(by, order, F.coalesce(hit, F.lit(False)).alias("hit"))
    islands = running(rows, [by], [order], F.when(F.col("hit"), 0).otherwise(1), "island")
    runs = islands.filter("hit").groupBy(by, "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(by).agg(F.max("n").alias("best"))
