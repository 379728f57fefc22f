"""Samples spread over areas: the largest spacing at which each area's goal fits, goals by capacity, even and dense picks cell by cell.

A pass takes rows in an order, each unless it is closer than its distance to a row taken before. Here it runs in rounds, without
pairs of rows: rows lie in cells so small that two of one cell are always too close, so of a cell only the first row can be next;
it is taken if it comes before the first rows of all cells in reach, and what is too close to a taken row goes. Each row carries
the distance of its own pass, so any number of areas runs through the same rounds. Areas of a few thousand places don't need
rounds: each is one group, walked in order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .sampling import SPACINGS
from .shared import checkpointed, running

_M = geo.SAMPLING_EARTH_M * math.pi / 180  # metres of a degree
_TURNS = 720.0


def _step(d: Column) -> Column:
    return d / (_M * math.sqrt(2) * 1.0000001)


def _nearest_equator(band: Column, step: Column) -> Column:
    return F.least(F.greatest(band * step, -(band + 1) * step, F.lit(0.0)), F.lit(90.0))


def _width(band: Column, step: Column) -> Column:
    return F.least(step / F.greatest(F.cos(F.radians(_nearest_equator(band, step))), F.lit(1e-12)), F.lit(_TURNS))


def _in_cells(rows: DataFrame) -> DataFrame:
    step = _step(F.col("d"))
    band = F.floor(F.col("lat") / step).cast("long")
    return rows.withColumn("band", band).withColumn("col", F.floor((F.col("lng") + 180.0) / _width(F.col("band"), step)).cast("long"))


def _reach() -> Column:
    """The cells that may hold a row closer than d to (lat, lng)."""
    step = _step(F.col("d"))

    def of_band(b: Column) -> Column:
        far = F.least(F.greatest(F.abs(F.col("lat")), F.abs(b * step), F.abs((b + 1) * step)), F.lit(90.0))
        reach = F.least(F.col("d") / _M / F.greatest(F.cos(F.radians(far)), F.lit(1e-9)), F.lit(360.0))
        at = lambda lng: F.floor((lng + 180.0) / _width(b, step)).cast("long")
        return F.transform(F.sequence(at(F.col("lng") - reach), at(F.col("lng") + reach)), lambda c: F.struct(b.alias("band"), c.alias("col")))

    band = F.floor(F.col("lat") / step).cast("long")
    return F.explode(F.flatten(F.transform(F.sequence(band - 2, band + 2), of_band)))


def _too_close(a: str, b: str) -> Column:
    """The sampling metric, as ``geo.closer_than``, with the distance of the row."""
    lat1, lng1, lat2, lng2, d = F.col(f"{a}.lat"), F.col(f"{a}.lng"), F.col(f"{b}.lat"), F.col(f"{b}.lng"), F.col(f"{a}.d")
    dlat = lat2 - lat1
    x = (lng2 - lng1) * F.cos((lat1 + lat2) * (math.pi / 360))
    return (dlat * dlat <= d * d / 110000.0**2) & (_M * _M * (x * x + dlat * dlat) < d * d)


def geo_cell(lat: Column, lng: Column, precision: int) -> tuple[Column, Column, int]:
    """(x, y, columns): the numbers of a geohash cell and how many there are round the earth."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    x = F.greatest(F.least(F.floor((lng + 180.0) / 360.0 * float(1 << nx)), F.lit((1 << nx) - 1)), F.lit(0)).cast("long")
    y = F.greatest(F.least(F.floor((lat + 90.0) / 180.0 * float(1 << ny)), F.lit((1 << ny) - 1)), F.lit(0)).cast("long")
    return x, y, 1 << nx


def _linked(a: str, b: str, columns: int) -> Column:
    """One geohash cell, or two that touch."""
    apart = F.pmod(F.col(f"{a}.x") - F.col(f"{b}.x"), F.lit(columns))
    return apart.isin(0, 1, columns - 1) & (F.abs(F.col(f"{a}.y") - F.col(f"{b}.y")) <= 1)


_BOUNDED = 4096  # places of an area that is walked in one task


def _walk(columns: int | None):
    """The pass over one area, in order, against an array of what is taken."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("o", "ascending"), ("id", "ascending")]) if not any(pa.types.is_struct(group[c].type) for c in ("o", "id")) else group.take(pa.array(sorted(range(len(group)), key=[(_plain(o), _plain(i)) for o, i in zip(group["o"].to_pylist(), group["id"].to_pylist())].__getitem__)))
        lat, lng, d = (group[c].to_numpy() for c in ("lat", "lng", "d"))
        x, y = (group[c].to_numpy() for c in ("x", "y")) if columns else (np.zeros(len(lat), np.int64),) * 2
        taken = np.zeros(len(lat), np.int64)
        n = 0
        for i in range(len(lat)):
            t = taken[:n]
            dlat = lat[i] - lat[t]
            dx = (lng[i] - lng[t]) * np.cos((lat[t] + lat[i]) * (math.pi / 360))
            close = (dlat * dlat <= d[i] * d[i] / 110000.0**2) & (_M * _M * (dx * dx + dlat * dlat) < d[i] * d[i])
            if columns:
                close &= (np.abs(y[i] - y[t]) <= 1) & np.isin((x[i] - x[t]) % columns, (0, 1, columns - 1))
            if not close.any():
                taken[n] = i
                n += 1
        return group.select(["part", "o", "id"]).take(pa.array(taken[:n]))

    return run


def _plain(value):
    """A struct as a tuple of its fields, as Spark orders it."""
    return tuple(map(_plain, value.values())) if isinstance(value, dict) else value


def spaced_pass(rows: DataFrame, placed: DataFrame | None = None, columns: int | None = None, bounded: int | None = None) -> DataFrame:
    """(part, o, id): the rows (part, o, id, lat, lng, d) that a pass in the order of (o, id) takes, each part for itself.

    d is the distance of a part. placed (part, lat, lng) was taken before. With columns, rows also have x and y, the numbers of
    geohash cells (columns round the earth), and only rows of one cell or of cells that touch are ever too close. Of rows at one
    place the first is taken at most; rows without coordinates are none. Parts of at most ``bounded`` places are walked, each in
    one task, larger ones run in rounds; the rows are the same.
    """
    bounded = _BOUNDED if bounded is None else bounded
    inner = ["x", "y"] if columns else []
    own = F.min(F.struct("o", "id")).alias("k")
    places = rows.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~F.isnan("lat") & ~F.isnan("lng"))
    places = places.groupBy("part", "d", *inner, "lat", "lng").agg(own).select("part", "d", *inner, "lat", "lng", "k")
    left = places
    cell = lambda a, b: F.col(f"{a}.part").eqNullSafe(F.col(f"{b}.part")) & (F.col(f"{a}.band") == F.col(f"{b}.band")) & (F.col(f"{a}.col") == F.col(f"{b}.col"))
    near = lambda a, b: _linked(a, b, columns) if columns else F.lit(True)

    def without(left: DataFrame, taken: DataFrame) -> DataFrame:
        around = taken.select("part", "lat", "lng", *inner, _reach().alias("c")).select("part", "lat", "lng", *inner, "c.band", "c.col")
        return left.alias("r").join(around.alias("t"), cell("r", "t") & _too_close("r", "t") & near("r", "t"), "left_anti")

    if placed is not None:
        distances = rows.select("part", "d").distinct().withColumnRenamed("part", "_part")
        before = placed.join(distances, F.col("part").eqNullSafe(F.col("_part"))).select("part", "lat", "lng", "d")
        left = without(_in_cells(left), before).drop("band", "col")
    left = checkpointed(left)
    sizes = left.groupBy(F.col("part").alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    sized = left.join(sizes, F.col("part").eqNullSafe(F.col("_part")))
    few = sized.filter(F.col("_size") <= bounded).select("part", "k.o", "k.id", "lat", "lng", "d", *inner)
    found = rows.select("part", "o", "id")
    walked = few.groupBy("part").applyInArrow(_walk(columns), found.schema)
    left, out = checkpointed(_in_cells(sized.filter(F.col("_size") > bounded).drop("_part", "_size"))), []
    while not left.isEmpty():
        firsts = left.groupBy("part", *inner, "band", "col").agg(F.min(F.struct("k", "lat", "lng", "d")).alias("f")).select("part", *inner, "band", "col", "f.*")
        asks = firsts.select("part", *inner, "k", _reach().alias("c")).select("part", *inner, "k", "c.band", "c.col")
        earlier = asks.alias("a").join(firsts.alias("f"), cell("a", "f") & near("a", "f") & (F.col("f.k") < F.col("a.k"))).select("a.part", "a.k").distinct()
        taken = firsts.alias("f").join(earlier.alias("e"), F.col("f.part").eqNullSafe(F.col("e.part")) & (F.col("f.k") == F.col("e.k")), "left_anti")
        taken = checkpointed(taken.select("part", *inner, "k", "lat", "lng", "d"))
        out.append(taken.select("part", "k.o", "k.id"))
        left = checkpointed(without(left, taken))
    for t in out:
        walked = walked.unionByName(t)
    return walked


def _first(taken: DataFrame, goals: DataFrame) -> DataFrame:
    """(part, id, place): the first goal rows of each part."""
    numbered = running(taken, ["part"], ["o", "id"], F.lit(1), "place")
    return numbered.join(goals.withColumnRenamed("part", "_part"), F.col("part").eqNullSafe(F.col("_part"))).filter(F.col("place") <= F.col("goal")).select("part", "id", "place")


def spread(df: DataFrame, by: str, goals: DataFrame, order: Column, least: int = 0, placed: DataFrame | None = None) -> DataFrame:
    """(by, id, place, metres): each area's goal of rows at the largest of ``SPACINGS``, not under least, at which that many fit.

    goals (by, goal, and least if areas differ in it). A search by halves from a guess (the side of a square with the area of the
    rows' box shared by the goal), all areas in the same rounds: a table holds where each search stands. Where the goal fits at no
    spacing the rows that fit at the smallest are taken; areas whose least is above all spacings, or with a goal of 0, give none.
    placed (by, lat, lng) is kept clear of.
    """
    sizes = F.array(*(F.lit(s) for s in SPACINGS))
    rows = checkpointed(df.select(F.col(by).alias("part"), order.alias("o"), "id", "lat", "lng"))
    before = placed.select(F.col(by).alias("part"), "lat", "lng") if placed is not None else None
    wanted = goals.select(F.col(by).alias("_part"), F.col("goal").cast("long").alias("goal"), (F.col("least") if "least" in goals.columns else F.lit(least)).alias("least"))
    box = rows.groupBy("part").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lng").alias("w"), F.max("lng").alias("e"))
    state = box.join(wanted, F.col("part").eqNullSafe(F.col("_part"))).filter(F.col("goal") > 0)
    high, wide = F.greatest((F.col("n") - F.col("s")) * _M, F.lit(1.0)), F.greatest((F.col("e") - F.col("w")) * _M * F.cos((F.col("s") + F.col("n")) * 0.5 * math.pi / 180), F.lit(1.0))
    guess = F.sqrt(high * wide / F.col("goal"))
    start = F.size(F.filter(sizes, lambda s: s < F.col("least")))
    off = F.transform(F.slice(sizes, F.col("low") + 1, len(SPACINGS)), lambda s: F.abs(s - guess))
    state = state.withColumn("low", start).filter(F.col("low") < len(SPACINGS)).withColumn("high", F.lit(len(SPACINGS) - 1))
    state = state.withColumn("probe", F.col("low") + (F.array_position(off, F.array_min(off)) - 1).cast("int"))
    state = checkpointed(state.select("part", "goal", F.col("low").alias("start"), "low", "high", "probe", F.lit(-1).alias("best")))

    def at(index: Column, states: DataFrame) -> DataFrame:
        of = states.select(F.col("part").alias("_part"), F.element_at(sizes, index + 1).cast("double").alias("d"))
        return spaced_pass(rows.join(of, F.col("part").eqNullSafe(F.col("_part"))).drop("_part"), before)

    while not (live := state.filter("low <= high")).isEmpty():
        fits = at(F.col("probe"), live).groupBy(F.col("part").alias("_part")).agg(F.count(F.lit(1)).alias("n"))
        told = state.join(fits, F.col("part").eqNullSafe(F.col("_part")), "left").drop("_part")
        searching, enough = F.col("low") <= F.col("high"), F.coalesce("n", F.lit(0)) >= F.col("goal")
        told = told.withColumns({
            "best": F.when(searching & enough, F.col("probe")).otherwise(F.col("best")),
            "low": F.when(searching & enough, F.col("probe") + 1).otherwise(F.col("low")),
            "high": F.when(searching & ~enough, F.col("probe") - 1).otherwise(F.col("high")),
        })
        state = checkpointed(told.withColumn("probe", F.floor((F.col("low") + F.col("high")) / 2).cast("int")).drop("n"))
    settled = state.withColumn("at", F.when(F.col("best") >= 0, F.col("best")).otherwise(F.col("start")))
    picked = _first(at(F.col("at"), settled), settled.select("part", "goal"))
    metres = settled.select(F.col("part").alias("_part"), F.element_at(sizes, F.col("at") + 1).alias("metres"))
    return picked.join(metres, F.col("part").eqNullSafe(F.col("_part"))).select(F.col("part").alias(by), "id", "place", "metres")


def spread_preferences(df: DataFrame, by: str, goals: DataFrame, preferences: list[tuple[Column, int | None, str | None, int | None]], order: Column, least: int = 0) -> DataFrame:
    """(by, id, tag, metres): preference after preference spread over what earlier ones left.

    A preference is (condition, percent, tag, its own least spacing or None). It gets its percentage of the goal, halves to even,
    or what is left of the goal if percent is None, and keeps clear of all rows that earlier ones placed.
    """
    placed = df.select(by, "id", F.lit(None).cast("string").alias("tag"), F.lit(0).alias("metres"), "lat", "lng").limit(0)
    for condition, percent, tag, own in preferences:
        part = goals.select(F.col(by), F.col("goal").cast("long").alias("goal"))
        if percent is not None:
            part = part.withColumn("goal", F.bround(F.col("goal").cast("decimal(20,0)") * percent / F.lit(100).cast("decimal(3,0)"), 0).cast("long"))
        else:
            used = placed.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("used"))
            part = part.join(used, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, (F.col("goal") - F.coalesce("used", F.lit(0))).alias("goal"))
        found = spread(df.filter(condition), by, part, order, least if own is None else own, placed)
        now = found.join(df.select("id", "lat", "lng"), "id").select(by, "id", F.lit(tag).cast("string").alias("tag"), "metres", "lat", "lng")
        placed = checkpointed(placed.unionByName(now))
    return placed.select(by, "id", "tag", "metres")


def capacities(df: DataFrame, by: str, metres: float, order: Column) -> DataFrame:
    """(by, n): how many rows of each area fit at a spacing."""
    rows = df.select(F.col(by).alias("part"), order.alias("o"), "id", "lat", "lng", F.lit(float(metres)).alias("d"))
    return spaced_pass(rows).groupBy(F.col("part").alias(by)).agg(F.count(F.lit(1)).alias("n"))


FIRST_TOTAL, MOST_TRIES = 110_000, 10  # fixed values of the search for the largest goal


def largest_goal(df: DataFrame, by: str, weights: DataFrame, metres: float, order: Column) -> tuple[int, DataFrame]:
    """(total, goals (by, goal)): the largest total, of at most ten tried, whose weighted shares fit every area at a spacing.

    weights (by, weight); a share is total · weight / sum of weights, halves to even. Totals are tried from 110 000 down by halves
    until one fits, then by halves between it and the least that didn't. If none fits, the least one tried stays. What fits is
    counted once an area; only those counts, a row an area, come to the driver.
    """
    fit = capacities(df, by, metres, order).withColumnRenamed(by, "_by")
    areas = weights.join(fit, F.col(by).eqNullSafe(F.col("_by")), "left").select(F.col("weight").cast("long").alias("w"), F.coalesce("n", F.lit(0)).alias("n"))
    known = [(r["w"], r["n"]) for r in areas.collect()]
    whole = sum(w for w, _ in known) or 1

    def share(total: int, w: int) -> int:
        q, r = divmod(total * w, whole)
        return q + (2 * r > whole or (2 * r == whole and q % 2 == 1))

    tried: dict[int, bool] = {}
    total = FIRST_TOTAL
    for _ in range(MOST_TRIES):
        tried[total] = all(n >= share(total, w) for w, n in known)
        good = [t for t, ok in tried.items() if ok]
        if good == [FIRST_TOTAL]:
            break
        total = max(good) + (min(t for t, ok in tried.items() if not ok and t > max(good)) - max(good)) // 2 if good else min(tried) // 2
    best = max((t for t, ok in tried.items() if ok and t), default=min(tried))
    shares = weights.select(by, F.bround(F.lit(best).cast("decimal(20,0)") * F.col("weight").cast("decimal(16,0)") / F.lit(whole).cast("decimal(18,0)"), 0).cast("long").alias("goal"))
    return best, shares


def _precision(metres: float) -> int:
    """The geohash length of the cells for a spacing."""
    return 6 if metres <= 200 else 5 if metres <= 1000 else 4 if metres <= 15000 else 3


def even(df: DataFrame, metres: float, order: Column) -> DataFrame:
    """(id): rows spread cell by cell, cells in the order of their first rows, each clear of what the cells around it placed.

    That is one pass in the order of (first row of the cell, row) in which only rows of one cell, or of two that touch, can be too
    close; so cells run side by side and wait for earlier neighbours only.
    """
    x, y, columns = geo_cell(F.col("lat"), F.col("lng"), _precision(metres))
    rows = df.select("id", order.alias("o"), "lat", "lng", x.alias("x"), y.alias("y"))
    first = rows.groupBy("x", "y").agg(F.min(F.struct("o", "id")).alias("first"))
    rows = rows.join(first, ["x", "y"]).select(F.lit(0).alias("part"), F.struct("first", "o").alias("o"), "id", "lat", "lng", F.lit(float(metres)).alias("d"), "x", "y")
    return spaced_pass(rows, columns=columns).select("id")


def densified(df: DataFrame, metres: float, files: int, order: Column, total: int = 120_000) -> DataFrame:
    """(id): in each cell of about one kilometre at most total / files rows (halves to even), half the spacing apart."""
    x, y, _ = geo_cell(F.col("lat"), F.col("lng"), 6)
    rows = df.select(F.struct(x.alias("x"), y.alias("y")).alias("part"), order.alias("o"), "id", "lat", "lng", F.lit(float(metres // 2)).alias("d"))
    q, r = divmod(total, files)
    goal = q + (2 * r > files or (2 * r == files and q % 2 == 1))
    taken = rows.select("part", "o", "id") if metres // 2 == 0 else spaced_pass(rows)
    return running(taken, ["part"], ["o", "id"], F.lit(1), "place").filter(F.col("place") <= goal).select("id")


def density_goals(df: DataFrame, goal: int, tuning: float) -> DataFrame:
    """(cell, n, goal): a goal shared among the geohash cells of three letters in proportion to n^(1 - tuning), halves to even."""
    cells = df.groupBy(geo.geohash(F.col("lat"), F.col("lng"), 3).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(1.0) / F.pow(F.col("n").cast("double"), F.lit(float(tuning))) * F.col("n")
    cells = cells.withColumn("_w", weight)
    whole = cells.agg(F.sum("_w").alias("_all"))
    return cells.join(F.broadcast(whole), F.lit(True)).select("cell", "n", F.rint(F.lit(float(goal)) * (F.col("_w") / F.col("_all"))).cast("long").alias("goal"))  # one row


def by_density(df: DataFrame, goal: int, tuning: float, order: Column, least: int = 0) -> DataFrame:
    """(cell, id, place, metres): each cell's goal at the largest spacing at which it fits."""
    celled = df.withColumn("cell", geo.geohash(F.col("lat"), F.col("lng"), 3))
    return spread(celled, "cell", density_goals(df, goal, tuning).select("cell", "goal"), order, least)
