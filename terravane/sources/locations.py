"""The locations table: derived from events, or read from JSON, zipped JSON and CSV files; polygons from GeoJSON."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = range(1, 9)
PINNED = 1  # flag bit: the row loads by its panorama id
_SQL = """
SELECT event_id + 1 AS id,
  CAST((user_id * 7919) % 150000 AS DOUBLE) / CAST(1000 AS DOUBLE) - CAST(75 AS DOUBLE) + CAST((event_id * 31) % 97 AS DOUBLE) * CAST(0.0002 AS DOUBLE) AS lat,
  CAST((user_id * 104729) % 340000 AS DOUBLE) / CAST(1000 AS DOUBLE) - CAST(170 AS DOUBLE) + CAST((event_id * 17) % 89 AS DOUBLE) * CAST(0.0002 AS DOUBLE) AS lng,
  CASE WHEN event_id % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((event_id * 37) % 360 AS DOUBLE) END AS heading,
  CAST(event_id % 61 - 30 AS DOUBLE) AS pitch, CAST(event_id % 4 AS DOUBLE) AS zoom,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat('pano', CAST(event_id % 700 AS STRING)) END AS pano_id,
  event_id % 3 AS flags, event_type, value, props AS extra,
  <EPOCH> AS created_at, CASE WHEN event_id % 6 = 0 THEN NULL ELSE <EPOCH> + 3600 END AS modified_at,
  CASE user_id % 5 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Asia/Tokyo' WHEN 2 THEN 'America/New_York' WHEN 3 THEN 'Asia/Kathmandu' ELSE NULL END AS timezone
FROM {events}
"""
DUCKDB = "locations AS (" + _SQL.replace("<EPOCH>", "CAST(floor(epoch(ts)) AS BIGINT)").format(events="events") + "), location_tags AS (SELECT l.id AS id, t.tag AS tag FROM locations l CROSS JOIN (SELECT * FROM (VALUES (1),(2),(3),(4),(5),(6),(7),(8)) v(tag)) t WHERE (l.id * t.tag) % 7 < 2 AND l.id % 9 <> 0)"


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event, with a list of tags (empty where it has none)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sql = _SQL.replace("<EPOCH>", "unix_timestamp(CAST(ts AS TIMESTAMP))").format(events="{events}")
    tags = F.when(F.col("id") % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.filter(F.array(*(F.lit(t).cast("long") for t in TAGS)), lambda t: (F.col("id") * t) % 7 < 2))
    return spark.sql(sql, events=events).withColumn("tags", tags)


def normalised(df: DataFrame) -> DataFrame:
    """Empty panorama ids become null and null tag lists empty: both say absent."""
    return df.withColumn("pano_id", F.when(F.col("pano_id") == "", None).otherwise(F.col("pano_id"))).withColumn("tags", F.coalesce("tags", F.array().cast("array<bigint>")))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


_ITEM = "struct<lat:double,latitude:double,lng:double,longitude:double,lon:double,heading:double,pitch:double,zoom:double,panoId:string,pano:string,pano_id:string,countryCode:string,stateCode:string,extra:string>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Map documents {customCoordinates | locations: [...]} or bare arrays, each file one row; see ``from_documents``."""
    return from_documents(spark.read.text(path, wholetext=True))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One location object a line, so files split; like ``read_json`` otherwise. ``pos`` is 0."""
    return from_documents(spark.read.text(path).filter(F.ltrim("value").startswith("{")).select(F.concat(F.lit("["), "value", F.lit("]")).alias("value")))


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """Archives of map documents: each .json entry is a document; ``entry`` is its name, ``pos`` the place in it. An archive is read by one task, entry by entry."""

    def entries(batches):
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith(".json")):
                        yield pd.DataFrame({"entry": [name], "value": [z.read(name).decode("utf-8-sig")]})

    return from_documents(spark.read.format("binaryFile").load(path).select("content").mapInPandas(entries, "entry string, value string"), "entry")


def polygons(df: DataFrame, column: str = "value") -> DataFrame:
    """(rings): a row for each polygon of GeoJSON texts: the outer ring and its holes, of [lng, lat]; any other geometry, or none, fails."""
    shape = "struct<type:string,features:array<struct<geometry:string>>,geometry:string,geometries:array<string>,coordinates:string>"
    top = df.select(F.from_json(column, shape).alias("g"), F.col(column).alias("text"))
    texts = F.when(F.col("g.type") == "FeatureCollection", F.transform("g.features", lambda f: f["geometry"])).when(F.col("g.type") == "Feature", F.array("g.geometry")).otherwise(F.array("text"))
    left = top.select(F.explode(texts).alias("text"))
    out, kind = None, F.col("g.type")
    while True:  # one round for each level of nested collections
        left = left.select(F.coalesce(F.from_json("text", shape), F.from_json(F.lit("{}"), shape)).alias("g"))
        several = F.from_json("g.coordinates", "array<array<array<array<double>>>>")
        one = F.array(F.from_json("g.coordinates", "array<array<array<double>>>"))
        other = F.raise_error(F.concat(F.lit("unsupported GeoJSON geometry: "), F.coalesce(kind, F.lit("none")))).cast("array<array<array<array<double>>>>")
        found = left.filter(~kind.eqNullSafe("GeometryCollection")).select(F.explode(F.when(kind == "Polygon", one).when(kind == "MultiPolygon", several).otherwise(other)).alias("rings"))
        out = found if out is None else out.unionByName(found)
        left = left.filter(kind == "GeometryCollection").select(F.explode("g.geometries").alias("text"))
        if not left.limit(1).count():
            return out.select(F.transform("rings", lambda ring: F.transform(ring, lambda p: F.slice(p, 1, 2))).alias("rings"))


def from_documents(text: DataFrame, *keep: str) -> DataFrame:
    """Rows of map documents in ``value``; malformed objects and coordinates that aren't finite are skipped."""
    item = _ITEM
    doc = F.from_json("value", f"struct<customCoordinates:array<{item}>,locations:array<{item}>>")
    bare = F.from_json("value", f"array<{item}>")
    rows = text.select(*keep, F.posexplode(F.coalesce(F.when(F.ltrim("value").startswith("["), bare), doc["customCoordinates"], doc["locations"])).alias("pos", "r")).select(*keep, "pos", "r.*")
    pano = F.coalesce("panoId", "pano", "pano_id")
    lat, lng = F.coalesce("lat", "latitude"), F.coalesce("lng", "longitude", "lon")
    out = rows.select(
        *keep,
        "pos",
        lat.alias("lat"),
        lng.alias("lng"),
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("heading", "pitch", "zoom")),
        F.coalesce(F.when(pano != "", pano), F.get_json_object("extra", "$.panoId")).alias("pano_id"),
        F.when(pano != "", PINNED).otherwise(0).cast("long").alias("flags"),
        F.coalesce(F.from_json(F.get_json_object("extra", "$.tags"), "array<string>"), F.array().cast("array<string>")).alias("tag_names"),
        F.map_filter(F.create_map(F.lit("countryCode"), F.col("countryCode"), F.lit("stateCode"), F.col("stateCode")), lambda k, v: v.isNotNull()).alias("codes"),
        "extra",
    )
    return out.filter(_finite(F.col("lat")) & _finite(F.col("lng")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header of the usual names; rows without finite coordinates are skipped."""
    raw = spark.read.csv(path, header=True)
    names = {c.strip().lstrip("﻿").lower(): c for c in raw.columns}
    pick = lambda *of: next((F.col(f"`{names[n]}`") for n in of if n in names), F.lit(None).cast("string"))
    number = lambda c: c.try_cast("double")
    pano = F.nullif(pick("pano", "panoid", "pano_id"), F.lit(""))
    out = raw.select(number(pick("lat", "latitude")).alias("lat"), number(pick("lng", "longitude", "lon")).alias("lng"), *(F.coalesce(number(pick(c)), F.lit(0.0)).alias(c) for c in ("heading", "pitch", "zoom")), pano.alias("pano_id"), F.when(pano.isNotNull(), PINNED).otherwise(0).cast("long").alias("flags"))
    return out.filter(_finite(F.col("lat")) & _finite(F.col("lng")))


def to_json_rows(df: DataFrame, unpanned: bool = False) -> DataFrame:
    """One JSON object a row, as map files hold them; a panorama id only of pinned rows."""
    pinned = (F.col("flags").bitwiseAND(PINNED) != 0) & F.col("pano_id").isNotNull()
    heading = F.when((F.col("heading") == 0) & F.lit(unpanned), 0.001).otherwise(F.col("heading"))
    body = F.struct("lat", "lng", heading.alias("heading"), "pitch", "zoom", F.when(pinned, F.col("pano_id")).alias("panoId"))
    return df.select("id", F.to_json(body).alias("json"))


def to_geojson_rows(df: DataFrame) -> DataFrame:
    """One GeoJSON feature a row."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"), F.struct("tags").alias("properties"))
    return df.select("id", F.to_json(feature).alias("feature"))


def write_csv(df: DataFrame, path: str) -> None:
    df.select("lat", "lng").write.csv(path, header=True)
