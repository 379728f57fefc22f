"""Range joins by cells: the indexed side has one cell a row, the probe side nine, and the distance is what is left to test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .shared import checkpointed


def _band(lat: Column, step: float) -> Column:
    return F.floor(lat / step).cast("long")


def _columns(band: Column, step: float) -> Column:
    """How many cells a band has: each is at least step / cos(latitude) wide, also for points one band off."""
    far = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * step, F.lit(90.0))
    width = F.lit(step) / F.greatest(F.cos(F.radians(far)), F.lit(1e-6))
    return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1)).cast("long")


def _cell(lng: Column, n: Column) -> Column:
    return F.pmod(F.floor((lng + 180.0) / 360.0 * n), n).cast("long")


def indexed(df: DataFrame, metres: float) -> DataFrame:
    step = metres / 110000.0
    band = _band(F.col("lat"), step)
    return df.withColumn("band", band).withColumn("cell", _cell(F.col("lng"), _columns(band, step)))


def probing(df: DataFrame, metres: float) -> DataFrame:
    """df once for each cell that may hold a point within metres."""
    step = metres / 110000.0
    df = df.withColumn("band", F.explode(F.transform(F.array(*(F.lit(k) for k in (-1, 0, 1))), lambda k: _band(F.col("lat"), step) + k)))
    n = _columns(F.col("band"), step)
    near = F.array_distinct(F.transform(F.array(*(F.lit(k) for k in (-1, 0, 1))), lambda k: F.pmod(_cell(F.col("lng"), n) + k, n)))
    return df.withColumn("cell", F.explode(near))


def _points(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("band", "cell", *(F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in ("band", "cell")))


def within(probe: DataFrame, index: DataFrame, metres: float, distance=geo.flat_m2, by: str | None = None) -> DataFrame:
    """Inner join: p_* and i_* columns and d2, the squared distance, of each pair at most metres apart (equal points are).

    With by only rows of one value of it meet.
    """
    p = _points(probing(probe, metres), "p")
    i = _points(indexed(index, metres), "i")
    d2 = distance(F.col("p_lat"), F.col("p_lng"), F.col("i_lat"), F.col("i_lng"))
    if by:
        p, i = p.withColumn("_by", F.col(f"p_{by}")), i.withColumn("_by", F.col(f"i_{by}"))
    return p.join(i, ["band", "cell", *(["_by"] if by else [])]).drop("_by").withColumn("d2", d2).filter(F.col("d2") <= metres * metres)


def far_from(df: DataFrame, others: DataFrame, metres: float, by: str) -> DataFrame:
    """The rows of df (by, lat, lng) that no row of others with the same value of by is within metres of.

    It is others that goes to all cells in reach, so df may be much the longer one.
    """
    near = _points(probing(others.select(by, "lat", "lng"), metres), "o").withColumnsRenamed({"band": "o_band", "cell": "o_cell"})
    close = geo.flat_m2(F.col("lat"), F.col("lng"), F.col("o_lat"), F.col("o_lng")) <= metres * metres
    same = (F.col("band") == F.col("o_band")) & (F.col("cell") == F.col("o_cell")) & (F.col(by) == F.col(f"o_{by}"))
    return indexed(df, metres).join(near, same & close, "left_anti").drop("band", "cell")


def _place(df: DataFrame) -> DataFrame:
    return df.select("id", "lat", "lng")


def _tight(df: DataFrame, metres: float) -> DataFrame:
    """df with (b, c), cells so small that two places of one are within metres of each other, whichever comes first."""
    step = metres / math.sqrt(2) * 0.999 / (math.pi / 180 * geo.EARTH_M)
    band = F.floor(F.col("lat") / step).cast("long")
    low = F.greatest(F.col("b") * step, -(F.col("b") + 1) * step, F.lit(0.0))
    wide = F.lit(step) / F.greatest(F.cos(F.radians(F.least(low, F.lit(90.0)))), F.lit(1e-12))
    return df.withColumn("b", band).withColumn("c", F.floor((F.col("lng") + 180.0) / F.least(wide, F.lit(720.0))).cast("long"))


def duplicate_ids(df: DataFrame, metres: float) -> DataFrame:
    """Ids of rows with another row within metres; at 0, with the same coordinates (0.0 and -0.0 are the same, NaN is none).

    Rows that share a tight cell are duplicates without a test; only the others, one row a cell, look around.
    """
    exact = _place(df).filter(~F.isnan("lat") & ~F.isnan("lng"))
    if metres <= 0:
        exact = exact.withColumns({"lat": F.col("lat") + 0.0, "lng": F.col("lng") + 0.0})
        many = exact.groupBy("lat", "lng").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("lat", "lng")
        return exact.join(many, ["lat", "lng"], "left_semi").select("id")
    celled = _tight(exact, metres)
    counts = celled.groupBy("b", "c").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    shared = celled.join(counts.filter("n > 1").select("b", "c"), ["b", "c"], "left_semi").select("id")
    p, i = _points(probing(counts.filter("n = 1").select("id", "lat", "lng"), metres), "p"), _points(indexed(exact, metres), "i")
    near = geo.flat_m2(F.col("p_lat"), F.col("p_lng"), F.col("i_lat"), F.col("i_lng")) <= metres * metres
    hit = p.join(i, (p["band"] == i["band"]) & (p["cell"] == i["cell"]) & (F.col("p_id") != F.col("i_id")) & near, "left_semi")
    return shared.unionByName(hit.select(F.col("p_id").alias("id")).distinct())


def pairs(df: DataFrame, metres: float) -> DataFrame:
    """(a, b) with a < b within metres."""
    p = within(_place(df), _place(df), metres).filter("p_id < i_id")
    return p.select(F.col("p_id").alias("a"), F.col("i_id").alias("b"))


def near_ids(probe: DataFrame, index: DataFrame, metres: float, near: Column) -> DataFrame:
    """Ids of probe rows for which ``near``, on p_* and i_* columns, holds of some row of index at most metres away.

    A semi join, so no pair is made; places of index that are one are one row, so a place with many rows weighs no more than others.
    """
    p = _points(probing(_place(probe), metres), "p")
    i = _points(indexed(index.select("lat", "lng").distinct(), metres), "i")
    return p.join(i, (p["band"] == i["band"]) & (p["cell"] == i["cell"]) & near, "left_semi").select(F.col("p_id").alias("id")).distinct()


def matching_ids(probe: DataFrame, index: DataFrame, metres: float, matches: Column) -> DataFrame:
    """Ids of probe rows for which ``matches``, on any p_* and i_* columns, holds of some row of index at most metres away; a semi join."""
    p, i = _points(probing(probe, metres), "p"), _points(indexed(index, metres), "i")
    return p.join(i, (p["band"] == i["band"]) & (p["cell"] == i["cell"]) & matches, "left_semi").select(F.col("p_id").alias("id")).distinct()


def near_any(probe: DataFrame, selected: DataFrame, metres: float) -> DataFrame:
    """Each probe row's id and whether a selected row lies within metres."""
    near = geo.flat_m2(F.col("p_lat"), F.col("p_lng"), F.col("i_lat"), F.col("i_lng")) <= metres * metres
    hits = near_ids(probe, selected, metres, near).withColumn("near", F.lit(True))
    return probe.select("id").join(hits, "id", "left").select("id", F.coalesce("near", F.lit(False)).alias("near"))


def neighbours(df: DataFrame, metres: float, fields: list[str] | None = None) -> DataFrame:
    """(id, neighbours): ids within metres, nearest first, ties by id, the row itself among them.

    With fields, a neighbour is a struct of its id, its distance in metres and those fields of its row.
    """
    wanted = fields or []
    w = within(_place(df), df.select("id", "lat", "lng", *(f for f in wanted if f not in ("id", "lat", "lng"))), metres)
    each = F.struct("d2", "i_id", *(F.col(f"i_{f}").alias(f) for f in wanted if f != "id"))
    shown = (lambda x: x["i_id"]) if fields is None else lambda x: F.struct(x["i_id"].alias("id"), F.sqrt(x["d2"]).alias("metres"), *(x[f].alias(f) for f in wanted if f != "id"))
    return w.groupBy(F.col("p_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(each)), shown).alias("neighbours"))


def components(edges: DataFrame) -> DataFrame:
    """(id, group): the connected components of edges (a, b), which hold both directions, named by their least node.

    Least labels with pointer jumping; each round is checkpointed to the shared folder.
    """
    edges = checkpointed(edges)
    now = checkpointed(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("group")))
    while True:
        seen = edges.join(now.select(F.col("id").alias("b"), "group"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group").alias("seen"))
        step = now.join(seen, "id").select("id", F.col("group").alias("was"), F.least("group", "seen").alias("group"))
        jump = now.select(F.col("id").alias("group"), F.col("group").alias("root"))
        step = checkpointed(step.join(jump, "group", "left").select("id", "was", F.least("group", F.coalesce("root", "group")).alias("group")))
        now = step.select("id", "group")
        if not step.filter("was <> group").limit(1).count():
            return now


def groups(df: DataFrame, metres: float) -> DataFrame:
    """(id, group): connected components of rows within metres of each other, named by their least id; rows without a neighbour are left out.

    Rows of a tight cell are one node from the start, and equal places one row. Two cells are linked if any place of one is near
    one of the other: a semi join, which stops at the first, so no pair of rows is made, however dense a place is. The distance is
    taken at the latitude of the smaller id, as in ``pairs``.
    """
    if metres <= 0:
        ids = duplicate_ids(df, 0)
        same = _place(df).join(ids, "id", "left_semi").withColumns({"lat": F.col("lat") + 0.0, "lng": F.col("lng") + 0.0})
        first = same.groupBy("lat", "lng").agg(F.min("id").alias("group"))
        return same.join(first, ["lat", "lng"]).select("id", "group")
    rows = checkpointed(_tight(_place(df).filter(~F.isnan("lat") & ~F.isnan("lng")), metres))
    nodes = rows.groupBy("b", "c").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    places = rows.groupBy("b", "c", "lat", "lng").agg(F.min("id").alias("low"), F.max("id").alias("high")).join(nodes.select("b", "c", "node"), ["b", "c"]).drop("b", "c")
    p, i = _points(probing(places, metres * 1.001), "p"), _points(indexed(places, metres * 1.001), "i")
    d = metres * metres
    forth = (F.col("p_low") < F.col("i_high")) & (geo.flat_m2(F.col("p_lat"), F.col("p_lng"), F.col("i_lat"), F.col("i_lng")) <= d)
    back = (F.col("i_low") < F.col("p_high")) & (geo.flat_m2(F.col("i_lat"), F.col("i_lng"), F.col("p_lat"), F.col("p_lng")) <= d)
    # for a place the cells in reach, then whether any place of such a cell is near
    targets = p.join(i.select("band", "cell", F.col("i_node").alias("to")).distinct(), ["band", "cell"]).filter("p_node < to OR p_node > to")
    met = targets.join(i, (targets["band"] == i["band"]) & (targets["cell"] == i["cell"]) & (F.col("to") == F.col("i_node")) & (forth | back), "left_semi")
    links = met.select(F.col("p_node").alias("a"), F.col("to").alias("b")).distinct()
    found = components(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    named = nodes.join(found.withColumnRenamed("id", "node"), "node", "left").filter("n > 1 OR group IS NOT NULL")
    return rows.join(named.select("b", "c", F.coalesce("group", "node").alias("group")), ["b", "c"]).select("id", "group")


def classify(df: DataFrame, areas: list[tuple[str, list]], otherwise: str | None = None) -> DataFrame:
    """df with the code of the first area (rings of (lng, lat)) that contains each row; a row-local CASE, no join."""
    out = F.lit(otherwise)
    for code, rings in reversed(areas):
        out = F.when(geo.in_polygon(F.col("lat"), F.col("lng"), rings), code).otherwise(out)
    return df.withColumn("area", out)


def honeycomb(spark, west: float, south: float, east: float, north: float, metres: float) -> DataFrame:
    """Centres of a hexagonal lattice in a box: rows √3/2 spacing apart, every other row shifted by half."""
    dlat = metres * math.sqrt(3) / 2 / 111194.92664455873
    rows = int((north - south) / dlat) + 1
    df = spark.range(rows).withColumn("lat", F.lit(south) + F.col("id") * dlat)
    df = df.withColumn("dlng", F.lit(metres / 111194.92664455873) / F.cos(F.radians("lat"))).withColumn("shift", F.col("dlng") / 2 * (F.col("id") % 2))
    count = F.floor((F.lit(east - west) - F.col("shift")) / F.col("dlng")).cast("int")
    return df.filter(count >= 0).select(F.col("id").alias("row"), "lat", "dlng", "shift", F.explode(F.sequence(F.lit(0), count)).alias("col")).select("row", "col", "lat", (F.lit(west) + F.col("shift") + F.col("col") * F.col("dlng")).alias("lng"))
