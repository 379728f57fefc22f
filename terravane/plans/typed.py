"""Registered queries of the typed filter language: its properties over columns derived from locations, its kinds, its default rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.filters import compile_filter
from ..functions.properties import filtered, properties
from ..operators import neighbours
from .catalog import _L, _query

ROADS = {"motorway": 1, "trunk": 2, "primary": 4, "track": 8}
# The columns of a survey of each location, as one text for both engines.
_SURVEY = {
    "Surface": "CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'asphalt' WHEN id % 4 = 2 THEN 'gravel' ELSE 'dirt' END",
    "Buildings10": "id % 2", "Buildings25": "id % 5", "Buildings100": "id % 23", "Buildings200": "id % 41",
    "Roads0": "id % 2", "Roads10": "id % 3", "Roads25": "id % 4", "Roads50": "id % 6", "Roads100": "id % 9", "Roads200": "id % 14",
    "Tunnels10": "CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END", "Tunnels200": "id % 3", "IsResidential": "id % 3 = 0",
    "ClosestCoast": "CASE WHEN id % 3 = 0 THEN NULL ELSE id * 37 % 5000 END", "ClosestLake": "CASE WHEN id % 5 = 0 THEN NULL ELSE id * 13 % 900 END",
    "ClosestRiver": "id * 7 % 800", "ClosestRailway": "CASE WHEN id % 2 = 0 THEN NULL ELSE id % 700 END", "HighwayType": "id % 16",
    "Month": "id % 12 + 1", "Year": "2008 + id % 17", "DrivingDirectionAngle": "id * 11 % 360", "ArrowCount": "id % 5",
    "Elevation": "CASE WHEN id % 9 = 0 THEN NULL ELSE id * 31 % 4000 - 100 END", "DescriptionLength": "CASE WHEN id % 4 = 1 THEN NULL WHEN id % 4 = 2 THEN 0 ELSE id % 30 END",
    "IsScout": "id % 19 = 0", "ResolutionHeight": "CASE WHEN id % 3 = 0 THEN 8192 ELSE 6656 END",
    "CountryCode": "CASE id % 6 WHEN 0 THEN 'FI' WHEN 1 THEN 'NG' WHEN 2 THEN 'MN' WHEN 3 THEN 'EC' WHEN 4 THEN 'NO' ELSE 'FR' END",
    "SubdivisionCode": "CASE id % 7 WHEN 0 THEN 'NO-21' WHEN 1 THEN 'FR-1' ELSE 'XX-2' END", "County": "CASE WHEN id % 8 = 0 THEN NULL ELSE concat('County ', id % 8) END",
}
_S = f"{_L}, s AS (SELECT id, lat, lng, heading + 0.5 AS Heading, " + ", ".join(f"{sql} AS {name}" for name, sql in _SURVEY.items()) + " FROM locations)"


def survey(df):
    """Locations with every column that the properties ask for."""
    columns = {name: F.expr(sql) for name, sql in _SURVEY.items()}
    ways = F.array(F.col("id"), F.col("id") % 3)
    return df.select("id", F.col("lat").alias("Lat"), F.col("lng").alias("Lng"), (F.col("heading") + 0.5).alias("Heading"), *(c.alias(n) for n, c in columns.items()), ways.alias("WayId"))


_GROUPS = {
    "surface": ("Surface eq 'gravel' or Surface eq null and IsResidential eq true", "Surface = 'gravel' OR (Surface IS NULL AND IsResidential)"),
    "buildings": ("Buildings10 + Buildings25 gt 2 and Buildings100 modulo 7 eq 3 or Buildings200 lt Buildings100", "(Buildings10 + Buildings25 > 2 AND Buildings100 % 7 = 3) OR Buildings200 < Buildings100"),
    "roads": ("Roads0 eq 1 and Roads10 gte 1 and Roads25 neq 2 and Roads50 / 4 eq 1 or Roads100 * Roads200 gt 60", "(Roads0 = 1 AND Roads10 >= 1 AND Roads25 <> 2 AND Roads50 // 4 = 1) OR Roads100 * Roads200 > 60"),
    "tunnels": ("Tunnels10 eq 0 and Tunnels200 in [1, 2]", "Tunnels10 = 0 AND Tunnels200 IN (1, 2)"),
    "closest": ("ClosestCoast lt 900 or ClosestLake eq null and ClosestRiver lte ClosestRailway", "coalesce(ClosestCoast < 900, false) OR (ClosestLake IS NULL AND coalesce(ClosestRiver <= ClosestRailway, false))"),
    "highway": ("HighwayType eq 'Motorway,Track' and HighwayTypeCount lt 3", "(HighwayType % 2 = 1 OR HighwayType >= 8) AND bit_count(HighwayType) < 3"),
    "ways": ("WayId eq '7|1' or WayId + '!' eq '20|2!' or HighwayType neq 'trunk' and Month eq 3", "id = 7 OR id = 20 OR (HighwayType // 2 % 2 = 0 AND Month = 3)"),
    "dates": ("Year gte 2015 and Month in [6, 7, 8] or Year * 12 + Month eq 24100", "(Year >= 2015 AND Month IN (6, 7, 8)) OR Year * 12 + Month = 24100"),
    "places": ("Lat gt 20.5 and Lng lt 0 or Lat / 2 lt -30.25", "(lat > 20.5 AND lng < 0) OR lat / 2 < -30.25"),
    "headings": ("Heading gt 180 and DrivingDirectionAngle - Heading lt 5 and ArrowCount neq 0", "round_even(Heading, 0) > 180 AND DrivingDirectionAngle - round_even(Heading, 0) < 5 AND ArrowCount <> 0"),
    "pictures": ("Elevation gt 1000 and IsScout eq false and (DescriptionLength eq null or DescriptionLength gt 20) and ResolutionHeight eq 8192", "Elevation > 1000 AND NOT IsScout AND (DescriptionLength IS NULL OR DescriptionLength > 20) AND ResolutionHeight = 8192"),
    "codes": ("CountryCode in ['FI', 'NO'] and SubdivisionCode neq 'XX-2' or County eq 'County 3'", "(CountryCode IN ('FI', 'NO') AND SubdivisionCode <> 'XX-2') OR coalesce(County = 'County 3', false)"),
}
for _name, (_text, _sql) in _GROUPS.items():
    _query(f"i03_{_name}", f"{_S} SELECT id FROM s WHERE {_sql}")(lambda df, *, t=_text: survey(df).filter(compile_filter(t, properties(roads=ROADS))).select("id"))


# --- kinds: what wraps, and at which width

_WRAP = "(({0}) + 2147483648 - 4294967296 * CAST(floor((({0}) + 2147483648) / 4294967296.0) AS BIGINT) - 2147483648)"
_KINDS = {
    "int_wraps": ("Buildings200 * 100000000 gt 0", _WRAP.format("Buildings200 * 100000000") + " > 0"),
    "long_does_not": ("Id * 100000000 gt 0", "id > 0"),
    "literal_is_long": ("Buildings200 * 3000000000 gte 3000000000", "Buildings200 >= 1"),
    "least_int": ("Buildings10 + 2147483647 lt 0", "Buildings10 = 1"),
    "least_long": ("Id eq -9223372036854775808 or Id neq 5", "id <> 5"),
    "halves": ("-Buildings100 / 2 eq -3", "Buildings100 IN (6, 7)"),
}
for _name, (_text, _sql) in _KINDS.items():
    _query(f"i04_{_name}", f"{_S} SELECT id FROM s WHERE {_sql}")(lambda df, *, t=_text: survey(df).filter(compile_filter(t, properties(roads=ROADS) | {"Id": ("long", F.col("id"))})).select("id"))


# --- default rules

_TALL = "CASE CountryCode WHEN 'FI' THEN ResolutionHeight >= 8192 OR Year < 2022 WHEN 'EC' THEN ResolutionHeight >= 8192 OR Year < 2021 WHEN 'NG' THEN ResolutionHeight >= 8192 OR Year < 2021 ELSE true END"
_TOLD = "((DescriptionLength IS NULL OR DescriptionLength >= 1) AND NOT IsScout OR CountryCode = 'MN' OR SubdivisionCode = 'NO-21')"
_RULES = {
    "all": ("", True, f"{_TALL} AND Tunnels10 = 0 AND {_TOLD}"),
    "without_generation": ("", False, f"Tunnels10 = 0 AND {_TOLD}"),
    "tunnels_asked": ("Tunnels200 gt 0", True, f"{_TALL} AND {_TOLD} AND Tunnels200 > 0"),
    "description_asked": ("DescriptionLength gt 10", True, f"{_TALL} AND Tunnels10 = 0 AND DescriptionLength > 10"),
    "scouts_asked": ("IsScout eq true", True, f"{_TALL} AND Tunnels10 = 0 AND IsScout"),
}
for _name, (_text, _on, _sql) in _RULES.items():
    _query(f"i10_rules_{_name}", f"{_S} SELECT id FROM s WHERE {_sql}")(lambda df, *, t=_text, on=_on: filtered(survey(df), t, ROADS, on).select("id"))


# --- neighbour filters of whole conditions: parts that don't ask of the centre go before the pairing

_CLOSE = "b.id <> a.id AND b.lat BETWEEN a.lat - 0.01 AND a.lat + 0.01 AND pow(b.lat - a.lat, 2) <= pow(400.0 / 110000.0, 2) AND pow(6371137.0 * pi() / 180, 2) * (pow((b.lng - a.lng) * cos((a.lat + b.lat) * (pi() / 360)), 2) + pow(b.lat - a.lat, 2)) < 400.0 * 400.0"
_ASK = "Heading gt 90 and (Zoom lt 3 or Zoom eq null) and Heading gt current:Heading"
_FITS = "b.heading > 90 AND b.zoom < 3 AND b.heading > a.heading"
_BOUNDS = {
    "some": (None, f"EXISTS (SELECT 1 FROM locations b WHERE {_CLOSE} AND {_FITS})"),
    "none": (None, f"NOT EXISTS (SELECT 1 FROM locations b WHERE {_CLOSE} AND {_FITS})"),
    "gte": (3, f"(SELECT count(*) FROM locations b WHERE {_CLOSE} AND {_FITS}) >= 3"),
    "percentage-gte": (40, f"(SELECT 100 * count(*) FILTER (WHERE {_FITS}) >= 40 * count(*) AND count(*) > 0 FROM locations b WHERE {_CLOSE})"),
}
for _bound, (_limit, _sql) in _BOUNDS.items():
    _query(f"i09_{_bound.replace('-', '_')}", f"{_L} SELECT a.id FROM locations a WHERE {_sql}")(
        lambda df, *, b=_bound, n=_limit: neighbours.neighbour_filter_by(df.select("id", "lat", "lng", "heading", "zoom"), 400.0, b, _ASK, {"Heading": ("double", "heading"), "Zoom": ("double", "zoom")}, n).select("id")
    )
