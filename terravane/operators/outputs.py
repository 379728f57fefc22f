"""Sampled places as they are written out: one row a node, with headings by expressions and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import compile_number
from ..functions.properties import KINDS
from ..functions.tagging import output_tags

# Properties that may be absent; the others are 0 where an expression of a heading can't see them.
_ABSENT = {"ClosestCoast", "ClosestLake", "ClosestRiver", "ClosestRailway", "Elevation", "DescriptionLength"}


def heading(text: str, default: Column, driving: Column, country: Column) -> Column:
    """A heading by an expression, which sees the rounded default heading, the driving direction and the country; other numbers are 0 or absent."""
    shown = {n: (k, F.lit(None if n in _ABSENT else 0).cast(k)) for n, k in KINDS.items() if k in ("int", "double")}
    shown |= {"Heading": ("int", default), "DrivingDirectionAngle": ("int", driving.cast("int")), "CountryCode": ("text", country)}
    return compile_number(text, shown)


def written(places: DataFrame, order: str, tags: list[str] = (), everywhere: str = "", by_country: dict[str, str] | None = None, pano_countries: list[str] = (), zoom: float | None = None, pitch: float | None = None) -> DataFrame:
    """(node, lat, lng, heading, zoom, pitch, pano_id, tags) of each node, by its first row in order.

    places: node, tag, pano_id, the column named by order, and columns by the names of the properties that tags ask for, with
    Lat, Lng, Heading, DrivingDirectionAngle and CountryCode. A country's expression of the heading goes before the one for
    everywhere; without one the default, rounded halves to even, stays. Headings lose whole turns and keep their sign. Panoramas
    are named in the countries given, or everywhere by '*'.
    """
    rest = [c for c in places.columns if c not in ("node", order)]
    first = places.groupBy("node").agg(F.min_by(F.struct(*rest), order).alias("r")).select("node", "r.*")
    default, country = F.rint("Heading").cast("int"), F.col("CountryCode")
    turned = default if not everywhere else heading(everywhere, default, F.col("DrivingDirectionAngle"), country)
    for code, text in (by_country or {}).items():
        turned = F.when(country == code, heading(text, default, F.col("DrivingDirectionAngle"), country)).otherwise(turned)
    named = F.lit(True) if "*" in pano_countries else F.coalesce(country.isin(list(pano_countries)), F.lit(False))
    columns = {c: F.col(c) for c in first.columns} | {"Heading": default}
    return first.select(
        "node",
        F.col("Lat").alias("lat"),
        F.col("Lng").alias("lng"),
        (turned.cast("double") % 360).alias("heading"),
        F.lit(zoom).cast("double").alias("zoom"),
        F.lit(pitch).cast("double").alias("pitch"),
        F.when(named, F.col("pano_id")).alias("pano_id"),
        output_tags(list(tags), columns, F.col("tag")).alias("tags"),
    )
