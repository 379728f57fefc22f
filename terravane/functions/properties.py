"""The properties that sampling definitions may ask for, and the rules that apply to every definition by default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import compile_filter, flags_any

# The properties and their kinds.
KINDS = {
    "Surface": "text",
    "Buildings10": "int", "Buildings25": "int", "Buildings100": "int", "Buildings200": "int",
    "Roads0": "int", "Roads10": "int", "Roads25": "int", "Roads50": "int", "Roads100": "int", "Roads200": "int",
    "Tunnels10": "int", "Tunnels200": "int", "IsResidential": "bool",
    "ClosestCoast": "int", "ClosestLake": "int", "ClosestRiver": "int", "ClosestRailway": "int",
    "HighwayType": "flags", "HighwayTypeCount": "int", "WayId": "text",
    "Month": "int", "Year": "int", "Lat": "double", "Lng": "double", "Heading": "int", "DrivingDirectionAngle": "int",
    "ArrowCount": "int", "Elevation": "int", "DescriptionLength": "int", "IsScout": "bool", "ResolutionHeight": "int",
    "CountryCode": "text", "SubdivisionCode": "text", "County": "text",
}
# The height of the fourth camera generation, and codes that need no description.
FOURTH_GENERATION = 8192
COUNTRIES_WITHOUT_DESCRIPTION = [
    "CX", "CC", "MP", "GU", "EG", "ML", "MG", "PN", "GL", "MN", "KR", "FO", "UG", "KG", "RW", "LB",
    "RE", "MQ", "NP", "PK", "BY", "UM", "XK",
]
SUBDIVISIONS_WITHOUT_DESCRIPTION = ["NO-21", "CA-NU", "US-AK", "BR-PE"]


def properties(prefix: str = "", roads: dict[str, int] | None = None) -> dict[str, tuple]:
    """The schema for ``compile_filter`` over columns of the same names (HighwayType a whole number, WayId an array), with a prefix.

    roads: the bits of the kinds of road. The heading is rounded, halves to even; ways are joined by a bar.
    """
    cast = {"int": "int", "double": "double", "text": "string", "bool": "boolean"}
    out: dict[str, tuple] = {}
    for name, kind in KINDS.items():
        c = F.col(prefix + name)
        if kind == "flags":
            out[name] = kind, lambda names, c=c: flags_any(c.cast("long"), names, roads or {})
        elif name == "HighwayTypeCount":
            out[name] = kind, F.bit_count(F.col(f"{prefix}HighwayType")).cast("int")
        elif name == "WayId":
            out[name] = kind, F.array_join(F.transform(c, lambda w: w.cast("string")), "|")
        elif name == "Heading":
            out[name] = kind, F.rint(c.cast("double")).cast("int")
        else:
            out[name] = kind, c.cast(cast[kind])
    return out


def default_rules(text: str = "", enabled: bool = True) -> Column:
    """The rules of every definition: no tunnel at the place, unless the text speaks of tunnels; a description and no scout, unless
    it speaks of these or the country or subdivision is known to do without; and, if enabled, fourth-generation pictures in three
    countries (from 2022, or 2021)."""
    passes = F.lit(True)
    if enabled:
        tall, country = F.col("ResolutionHeight") >= FOURTH_GENERATION, F.col("CountryCode")
        passes = F.when(country == "FI", tall | (F.col("Year") < 2022)).when(country.isin("EC", "NG"), tall | (F.col("Year") < 2021)).otherwise(True)
    if "Tunnels" not in text:
        passes = passes & (F.col("Tunnels10") == 0)
    if "DescriptionLength" not in text and "IsScout" not in text:
        told = (F.col("DescriptionLength").isNull() | (F.col("DescriptionLength") >= 1)) & ~F.col("IsScout")
        excused = F.col("CountryCode").isin(COUNTRIES_WITHOUT_DESCRIPTION) | F.col("SubdivisionCode").isin(SUBDIVISIONS_WITHOUT_DESCRIPTION)
        passes = passes & (told | F.coalesce(excused, F.lit(False)))
    return F.coalesce(passes, F.lit(False))


def filtered(df: DataFrame, text: str = "", roads: dict[str, int] | None = None, enabled: bool = True) -> DataFrame:
    """Rows that pass a definition's filter (none: all) and the default rules, one row an id."""
    out = df.filter(default_rules(text, enabled))
    return (out.filter(compile_filter(text, properties(roads=roads))) if text else out).dropDuplicates(["id"])
