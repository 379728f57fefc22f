"""Distances, headings and cells as columns. Two metrics that must not be swapped: each names its radius."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
SAMPLING_EARTH_M = 6371137.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def wrap_dlng(d: Column) -> Column:
    """Longitude difference in [-180, 180)."""
    return F.pmod(d + 180.0, F.lit(360.0)) - 180.0


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    s1, s2 = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    return 2 * EARTH_M * F.asin(F.sqrt(s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2))


def flat_m2(lat1, lng1, lat2, lng2) -> Column:
    """Squared equirectangular distance at the first point's latitude."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    x, y = F.radians(wrap_dlng(lng2 - lng1)) * F.cos(F.radians(lat1)), F.radians(lat2 - lat1)
    return (x * x + y * y) * (EARTH_M * EARTH_M)


def closer_than(lat1, lng1, lat2, lng2, metres: float) -> Column:
    """The sampling metric: strict, mean latitude, no wrap at the antimeridian, early exit on latitude."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    dlat = lat2 - lat1
    x = (lng2 - lng1) * F.cos((lat1 + lat2) * (math.pi / 360))
    scale = (SAMPLING_EARTH_M * math.pi / 180) ** 2
    return (dlat * dlat <= metres * metres / 110000.0**2) & (scale * (x * x + dlat * dlat) < metres * metres)


def chord_m2(lat1, lng1, lat2, lng2) -> Column:
    """Squared straight distance through the sphere."""
    lat1, lng1, lat2, lng2 = (F.radians(_c(x)) for x in (lat1, lng1, lat2, lng2))
    x = F.cos(lat1) * F.cos(lng1) - F.cos(lat2) * F.cos(lng2)
    y = F.cos(lat1) * F.sin(lng1) - F.cos(lat2) * F.sin(lng2)
    z = F.sin(lat1) - F.sin(lat2)
    return (x * x + y * y + z * z) * (EARTH_M * EARTH_M)


def folded(lng: float) -> float:
    """A longitude in [-180, 180)."""
    return (lng + 180.0) % 360.0 - 180.0


def ring_bounds(rings: list[list[tuple[float, float]]]) -> tuple[float, float, float, float] | None:
    """(west, south, east, north) of outer rings of (lng, lat); west may exceed east; a full turn is the whole world."""
    points = [p for r in rings for p in r]
    if not points:
        return None
    xs, ys = [x for x, _ in points], [y for _, y in points]
    if max(xs) - min(xs) >= 360.0:
        return -180.0, min(ys), 180.0, max(ys)
    return folded(min(xs)), min(ys), folded(max(xs)), max(ys)


def bearing(lat1, lng1, lat2, lng2) -> Column:
    lat1, lng1, lat2, lng2 = (F.radians(_c(x)) for x in (lat1, lng1, lat2, lng2))
    d = lng2 - lng1
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(lat2), F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(d))), F.lit(360.0))


def in_ring(lat: Column, lng: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd ray cast against one ring of (lng, lat); of a level edge the upper one belongs to the ring, of an upright one the western."""
    inside = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        crosses = ((F.lit(y1) >= lat) != (F.lit(y2) >= lat)) & (lng < (lat - y1) * ((x2 - x1) / (y2 - y1) if y2 != y1 else 0.0) + x1)
        inside = inside + F.when(crosses, 1).otherwise(0)
    return inside % 2 == 1


def in_polygon(lat: Column, lng: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Outer ring and holes of (lng, lat), even-odd over all; a box test, which reaches the scan, comes first."""
    xs, ys = [x for x, _ in rings[0]], [y for _, y in rings[0]]
    hit = in_ring(lat, lng, rings[0])
    for hole in rings[1:]:
        hit = hit & ~in_ring(lat, lng, hole)
    return F.coalesce(lat.between(min(ys), max(ys)) & lng.between(min(xs), max(xs)) & hit, F.lit(False))


_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lng: Column, precision: int) -> Column:
    """Geohash cell by bit arithmetic."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lng + 180.0) / 360.0 * float(1 << nx)), F.lit((1 << nx) - 1)).cast("long")
    y = F.least(F.floor((lat + 90.0) / 180.0 * float(1 << ny)), F.lit((1 << ny) - 1)).cast("long")
    signs = []
    for k in range(precision):
        code = F.lit(0).cast("long")
        for j in range(5):
            at = 5 * k + j
            source, left = (x, nx - 1 - at // 2) if at % 2 == 0 else (y, ny - 1 - at // 2)
            code = code * 2 + F.shiftright(source, left).bitwiseAND(F.lit(1).cast("long"))
        signs.append(F.substring(F.lit(_BASE32), (code + 1).cast("int"), F.lit(1)))
    return F.concat(*signs)


def score(distance_m: Column, max_error: float = 185.34781) -> Column:
    """Game points for a distance: 5000 up to 25 m, then an exponential fall."""
    base = 0.99866017
    return F.when(distance_m <= 25, 5000.0).otherwise(F.floor(5000 * F.pow(F.lit(base), distance_m / (max_error * math.log(base) * -1e4)) + 0.5).cast("double"))


def wrap_degrees(degrees: Column, least: float = -180.0) -> Column:
    """Degrees shifted by whole turns to [least, least + 360)."""
    return least + F.pmod(degrees - least, F.lit(360.0))


def heading_gap(a: Column, b: Column) -> Column:
    """The angle between two headings, 0 to 180."""
    return F.abs(wrap_degrees(a - b))


def reversed_heading(heading: Column) -> Column:
    return wrap_degrees(heading + 180.0)


def nearest_heading(headings: Column, target: Column) -> Column:
    """Of an array the heading next to a target, the first of equals; null if there is none."""
    told = F.filter(headings, lambda h: h.isNotNull())
    return F.array_min(F.transform(told, lambda h, k: F.struct(heading_gap(h, target).alias("gap"), k.alias("k"), h.alias("heading"))))["heading"]


def box_width(west: Column, east: Column) -> Column:
    """Degrees of longitude from west to east; a box whose east is less crosses the antimeridian."""
    return east - west + F.when(east < west, 360.0).otherwise(0.0)


def joined_boxes(a: Column, b: Column) -> Column:
    """The least box (west, south, east, north) around two of the same fields; it closes the smaller of the two gaps between them."""

    def reach(of: Column, other: Column) -> Column:
        return F.greatest(box_width(of["west"], of["east"]), wrap_degrees(other["west"] - of["west"], 0.0) + box_width(other["west"], other["east"]))

    from_a, from_b = reach(a, b), reach(b, a)
    west, width = F.when(from_a <= from_b, a["west"]).otherwise(b["west"]), F.least(from_a, from_b)
    whole = width >= 360
    return F.struct(
        F.when(whole, -180.0).otherwise(west).alias("west"),
        F.least(a["south"], b["south"]).alias("south"),
        F.when(whole, 180.0).otherwise(wrap_degrees(west + width)).alias("east"),
        F.greatest(a["north"], b["north"]).alias("north"),
    )


def densified(ring: Column) -> Column:
    """A ring, an array of (lng, lat), with edges of 180 degrees of longitude or more cut into equal parts below that."""

    def edge(k: Column) -> Column:
        p, q = F.get(ring, k), F.get(ring, k + 1)
        parts = F.coalesce(F.floor(F.abs(q["lng"] - p["lng"]) / 180).cast("int") + 1, F.lit(1))

        def cut(i: Column) -> Column:
            t = F.coalesce(i / parts, F.lit(0.0))
            at = lambda name: F.when(i == 0, p[name]).otherwise(p[name] + (q[name] - p[name]) * t).alias(name)
            return F.struct(at("lng"), at("lat"))

        return F.transform(F.sequence(F.lit(0), parts - 1), cut)

    return F.when(F.size(ring) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(ring) - 1), edge))).otherwise(ring)
