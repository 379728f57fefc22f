"""Questions over a selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_key(c: Column) -> Column:
    """A number as the key a browser prints: shortest digits, whole numbers without a point, exponents from 1e21 and below 1e-6, zero without a sign."""
    c = c.cast("double")
    printed = F.abs(c).cast("string")
    mantissa, power = F.substring_index(printed, "E", 1), F.try_element_at(F.split(printed, "E"), F.lit(2)).cast("int")
    short = F.regexp_replace(mantissa, r"\.0$", "")
    digits = F.replace(short, F.lit("."), F.lit(""))
    spread = F.when(F.length(digits) <= power + 1, F.rpad(digits, power + 1, "0")).otherwise(F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    shown = F.when(power.isNull(), short).when(power >= 21, F.concat(short, F.lit("e+"), power.cast("string"))).when(power >= 0, spread)
    shown = shown.when(power < -6, F.concat(short, F.lit("e"), power.cast("string"))).otherwise(small)
    return F.when(c < 0, F.concat(F.lit("-"), shown)).otherwise(shown)


def counts(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """One row per name: how many rows hold; one scan for all of them."""
    one = df.agg(*(F.count_if(c).alias(n) for n, c in named.items()))
    return one.unpivot([], list(named), "name", "n")


def count_by(df: DataFrame, keys: Column) -> DataFrame:
    """(key, n): a row counts once for each different key of its array."""
    return df.select(F.explode(F.array_distinct(keys)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def count_by_fields(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, key, n) of several fields in one pass; each column is an array of keys."""
    each = F.concat(*(F.transform(F.array_distinct(c), _pair(n)) for n, c in fields.items()))
    return df.select(F.explode(each).alias("x")).groupBy("x.field", "x.key").agg(F.count(F.lit(1)).alias("n"))


def _pair(name: str):
    return lambda k: F.struct(F.lit(name).alias("field"), k.cast("string").alias("key"))


def bins_by_count(df: DataFrame, c: str, n: int) -> DataFrame:
    """(bin, lo, hi, n) of n equal bins from least to largest, the last closed; none where all values are one."""
    values = df.select(F.col(c).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    ends = values.agg(F.min("v").alias("least"), F.max("v").alias("most"))
    step = (F.col("most") - F.col("least")) / n
    at = F.least(F.greatest(F.floor((F.col("v") - F.col("least")) / step), F.lit(0)), F.lit(n - 1)).cast("int")
    some = values.join(F.broadcast(ends), F.lit(True)).filter("most > least").groupBy(at.alias("bin"), "least", "most").agg(F.count(F.lit(1)).alias("n"))
    frame = ends.filter("most > least").select("least", "most", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    return frame.join(some.select("bin", "n"), "bin", "left").select("bin", (F.col("least") + F.col("bin") * step).alias("lo"), (F.col("least") + (F.col("bin") + 1) * step).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def bins_by_width(df: DataFrame, c: str, width: float) -> DataFrame:
    """(lo, n) of bins of a width, anchored at its multiples; bins with rows only."""
    if not width > 0:
        return df.sparkSession.createDataFrame([], "lo double, n long")
    return df.filter(F.col(c).isNotNull()).groupBy((F.floor(F.col(c) / width) * width).cast("double").alias("lo")).agg(F.count(F.lit(1)).alias("n"))


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset to offset + limit in an order that tells rows apart, each with the total of all rows; a page beyond the end has no rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total), F.lit(True))


DATE_PARTS = {"year": "yyyy", "yearMonth": "yyyy-MM", "day": "yyyy-MM-dd", "monthOfYear": "MM", "hourOfDay": "HH"}


def date_parts(df: DataFrame, c: str, part: str, zone: str | None = None) -> DataFrame:
    at = F.timestamp_seconds(c)
    if zone:
        at = F.from_utc_timestamp(at, F.col(zone))
    rows = df.filter(F.col(c).isNotNull() & (F.col(zone).isNotNull() if zone else F.lit(True)))
    return rows.groupBy(F.date_format(at, DATE_PARTS[part]).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(name, n) of the optional fields that some row holds."""
    return counts(df, fields).filter("n > 0")


def bounds(df: DataFrame) -> DataFrame:
    """west, south, east, north over the shorter longitude span; west > east where that crosses the antimeridian."""
    s = F.when(F.col("lng") < 0, F.col("lng") + 360).otherwise(F.col("lng"))
    a = df.agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("w"), F.max("lng").alias("e"), F.min(s).alias("ws"), F.max(s).alias("es"))
    back = lambda c: F.when(F.col(c) >= 180, F.col(c) - 360).otherwise(F.col(c))
    crosses = F.col("es") - F.col("ws") < F.col("e") - F.col("w")
    return a.select(F.when(crosses, back("ws")).otherwise(F.col("w")).alias("west"), "south", F.when(crosses, back("es")).otherwise(F.col("e")).alias("east"), "north")


def held(given: DataFrame, selected: DataFrame) -> DataFrame:
    """(id, held) of given rows: by panorama id where they have one, else by exact coordinates. Two equi-joins, never one on either."""
    pano = given.filter("pano_id IS NOT NULL").join(selected.select("pano_id").filter("pano_id IS NOT NULL").distinct(), "pano_id", "left_semi").select("id")
    spot = given.filter("pano_id IS NULL").join(selected.select("lat", "lng").distinct(), ["lat", "lng"], "left_semi").select("id")
    hits = pano.unionByName(spot).withColumn("held", F.lit(True))
    return given.select("id").join(hits, "id", "left").select("id", F.coalesce("held", F.lit(False)).alias("held"))


def folder_counts(df: DataFrame, paths: Column) -> DataFrame:
    """(folder, n) of every prefix of '/' paths; a row counts once a folder."""
    prefixes = F.flatten(F.transform(paths, lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, "/"))), lambda k: F.array_join(F.slice(F.split(p, "/"), F.lit(1), k), "/"))))
    return count_by(df, prefixes).withColumnRenamed("key", "folder")


def covered(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, covered): how many rows are in one group of the field at least; each column is an array of keys."""
    one = df.agg(*(F.count_if(F.size(c) > 0).alias(n) for n, c in fields.items()))
    return one.unpivot([], list(fields), "field", "covered")


EMPTY_BINS = 100


def without_empty(bins: DataFrame, n: int) -> DataFrame:
    """Bins without the empty ones, if there are more than 100."""
    return bins.filter("n > 0") if n > EMPTY_BINS else bins


def _bound(c: Column) -> Column:
    whole = c == F.floor(c)
    return F.when(whole, c.cast("long").cast("string")).otherwise(number_key(F.round(c, 2)))


def bin_label(lo: Column, hi: Column) -> Column:
    """lo–hi with two decimals at most."""
    return F.concat(_bound(lo), F.lit("–"), _bound(hi))


def painted(named: list[tuple[str, Column]]) -> Column:
    """The last of the live selections that holds a row."""
    return F.coalesce(*(F.when(c, n) for n, c in reversed(named)))


def with_unknown(df: DataFrame, key: Column) -> DataFrame:
    """(key, n), rows without a key as unknown."""
    return df.groupBy(F.coalesce(key, F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def spaced_ids(df: DataFrame, n: int, seed: int = 0, least: float = 0) -> DataFrame:
    """(id, metres): n rows as far apart as n fit, each with the spacing that was settled on."""
    from .sampling import spaced_count

    some, metres = spaced_count(df, n, seed, least)
    return some.select("id", F.lit(metres).alias("metres"))
