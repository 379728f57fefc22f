"""Tags that sampled places are written out with: values, ranges of them, seasons, flags."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bits of the kinds of road, from the lowest.
ROADS = [
    "Motorway", "Trunk", "Primary", "Secondary", "Tertiary", "Motorway_link", "Trunk_link", "Primary_link", "Secondary_link",
    "Tertiary_link", "Unclassified", "Residential", "Living_street", "Service", "Track", "Road",
]
# Countries with southern seasons.
SOUTHERN = [
    "EC", "BR", "PE", "CL", "AR", "UY", "PY", "BO", "UG", "ZA", "SZ", "LS", "BW", "NA", "ZW", "MZ",
    "ZM", "AO", "TZ", "MG", "CG", "CD", "GA", "ID", "AU", "NZ", "CC", "CX", "PG", "TL", "AS", "TV",
    "FJ", "PF", "TO", "CK", "VU", "NC", "BI", "MW", "MU", "SC", "KM", "GQ", "KI", "NR", "RW", "SB",
]
# Numbers that may be written bare or by ranges.
NUMBERS = [
    "DrivingDirectionAngle", "Heading", "Buildings200", "Buildings100", "Buildings25", "Buildings10", "Roads200", "Roads100",
    "Roads50", "Roads25", "Roads10", "Roads0", "Tunnels200", "Tunnels10", "ClosestCoast", "ClosestLake", "ClosestRiver",
    "ClosestRailway", "HighwayTypeCount", "Year", "Month", "ResolutionHeight",
]
SEASONS = ["Winter", "Spring", "Summer", "Autumn"]


def season(country: Column, month: Column) -> Column:
    """The season of a month; southern countries are half a year off, other months than 1 to 12 have none."""
    quarter = F.floor((month % 12) / 3)
    shifted = F.when(F.coalesce(country.isin(SOUTHERN), F.lit(False)), (quarter + 2) % 4).otherwise(quarter)
    return F.when(month.between(1, 12), F.element_at(F.array(*(F.lit(s) for s in SEASONS)), (shifted + 1).cast("int")))


def ranged(name: str, number: Column, size: str, unit: str = "") -> Column:
    """``Name[ low-high]`` of the range of a size around a number, cut towards zero; nothing if the size is no whole number above 0."""
    if not re.fullmatch(r"\+?[0-9]+", size) or not 0 < int(size) < 2**31:
        return F.lit(None).cast("string")
    step = int(size)
    k = F.when(number < 0, -F.floor(-number / step)).otherwise(F.floor(number / step)).cast("long")
    return F.when(number.isNotNull(), F.format_string(f"{name}[%4d-%4d]{unit}", k * step, (k + 1) * step - 1))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _one(spec: str, c: dict[str, Column]) -> list[Column]:
    yes = lambda x: F.when(x, F.lit("Yes")).otherwise(F.lit("No"))
    if spec in ("CountryCode", "SubdivisionCode", "County", "Surface", "Year", "Month", "Elevation"):
        return [_text(c[spec])]
    if spec == "YearMonth":
        return [F.concat(c["Year"].cast("string"), F.lit("-"), F.lpad(c["Month"].cast("string"), 2, "0"))]
    if spec.startswith("Elevation"):
        return [ranged("Elevation", c["Elevation"], spec.replace("Elevation", ""), "m")]
    if spec in ("IsScout", "IsResidential"):
        return [F.concat(F.lit(spec + "-"), yes(c[spec]))]
    if spec == "DescriptionLength":
        return [F.concat(F.lit("DescriptionLength-"), F.coalesce(c[spec].cast("string"), F.lit("null")))]
    if spec in ("ArrowCount", "ResolutionHeight"):
        return [F.concat(F.lit(spec + "-"), c[spec].cast("string"))]
    if spec == "PanoramaCount":
        return [F.lit("PanoramaCount-0")]
    if spec == "Season":
        return [season(c["CountryCode"], c["Month"])]
    if spec == "HighwayType":
        return [F.when(c["HighwayType"].cast("long").bitwiseAND(1 << k) != 0, F.lit(name)) for k, name in enumerate(ROADS)]
    if spec == "WayId":
        return [F.concat(F.lit("WayId-"), F.array_join(F.transform(c["WayId"], lambda w: w.cast("string")), "|"))]
    for name in NUMBERS:
        if spec.startswith(name):
            number = F.bit_count(c["HighwayType"]).cast("int") if name == "HighwayTypeCount" else c[name]
            return [ranged(name, number, spec.replace(f"{name}-", "")) if "-" in spec else F.concat(F.lit(f"{name}-"), number.cast("string"))]
    return []


def output_tags(specs: list[str], columns: dict[str, Column], location_tag: Column | None = None) -> Column:
    """The array of a place's tags by the names asked for, then its own tag; null if there are none.

    columns: by the names of the properties; a name that isn't known gives nothing, nor does a missing or empty value.
    """
    made = [x for spec in specs for x in _one(spec, columns)] + ([] if location_tag is None else [location_tag])
    if not made:
        return F.lit(None).cast("array<string>")
    kept = F.filter(F.array(*made), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, kept)
