"""Further registered queries: spaced samples and quotas, documents and polygons, the rest of the field expressions, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.expr import compile_expression
from ..operators import changes, sampling, spatial, work
from ..sources import locations as src
from .catalog import _L, _query
from .selectors import field

# --- samples: what a spaced sample must hold of, since its members depend on a hash

_LAWS = "SELECT CAST(0 AS BIGINT) AS too_close, CAST(0 AS BIGINT) AS would_fit"


def _laws(df: DataFrame, some: DataFrame, metres: float) -> DataFrame:
    """How many rows of the sample have another one too near, and how many others could still be taken."""
    close = geo.closer_than(F.col("p_lat"), F.col("p_lng"), F.col("i_lat"), F.col("i_lng"), metres)
    place = lambda t: t.select("id", "lat", "lng")
    clash = spatial.within(place(some), place(some), metres * 1.01).filter(close & (F.col("p_id") < F.col("i_id"))).agg(F.count(F.lit(1)).alias("too_close"))
    covered = spatial.near_ids(df, some, metres * 1.01, close)
    return clash.join(F.broadcast(df.join(covered, "id", "left_anti").agg(F.count(F.lit(1)).alias("would_fit"))), F.lit(True))  # one row each


@_query("e05_spaced", _LAWS)
def _e05(df):
    return _laws(df, sampling.spaced(df, 400.0, 11), 400.0)


@_query("e06_spaced_count", "SELECT CAST(150 AS BIGINT) AS n, true AS spaced")
def _e06(df):
    some, metres = sampling.spaced_count(df, 150, 5)
    return some.agg(F.count(F.lit(1)).alias("n"), F.lit(metres in sampling.SPACINGS).alias("spaced"))


@_query("e07_even", f"{_L} SELECT CAST(0 AS BIGINT) AS crowded, true AS some")
def _e07(df):
    picks = sampling.even_picks(df, 50_000.0).join(df.select("id", "lat", "lng"), "id")
    d = geo.haversine_m(F.col("p_lat"), F.col("p_lng"), F.col("i_lat"), F.col("i_lng"))
    crowded = spatial.within(picks.select("id", "lat", "lng"), picks.select("id", "lat", "lng"), 25_500.0).filter((d < 25_000.0) & (F.col("p_id") < F.col("i_id")))
    return crowded.agg(F.count(F.lit(1)).alias("crowded")).join(F.broadcast(picks.agg((F.count(F.lit(1)) > 0).alias("some"))), F.lit(True))  # one row each


@_query("e09_weighted", f"{_L} SELECT count(*) AS n, count(DISTINCT id) AS different FROM locations")
def _e09(df):
    return sampling.weighted_order(df, F.col("heading")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("different"))


_U = "(id * 7919) % 1000 / 1000.0"


@_query("m10_thinned", f"{_L}, c AS (SELECT *, floor(lat) AS y, floor(lng) AS x, count(*) OVER (PARTITION BY floor(lat), floor(lng)) AS n FROM locations) SELECT id FROM c WHERE {_U} < 0.25 * 0.4 + least(1.0, 3.0 / n) * 0.75")
def _m10(df):
    cells = df.withColumns({"y": F.floor("lat"), "x": F.floor("lng")})
    return sampling.thinned(cells, ["y", "x"], 0.4, 0.75, 3, (F.col("id") * 7919) % 1000 / 1000.0).select("id")


@_query("i15_by_area", f"{_L} SELECT CAST(0 AS BIGINT) AS too_close")
def _i15(df):
    """Spaced inside each area only."""
    some = sampling.spaced(df, 400.0, 2, "event_type").select("id", "lat", "lng", "event_type")
    close = geo.closer_than(F.col("p_lat"), F.col("p_lng"), F.col("i_lat"), F.col("i_lng"), 400.0)
    near = spatial.within(some, some, 404.0).filter(close & (F.col("p_id") < F.col("i_id")) & (F.col("p_event_type") == F.col("i_event_type")))
    return near.agg(F.count(F.lit(1)).alias("too_close"))


@_query("i16_preferences", f"{_L}, q AS (SELECT event_type, CAST(round_even(CAST(100 * count(*) AS DOUBLE) / (SELECT count(*) FROM locations), 0) AS BIGINT) AS quota FROM locations GROUP BY 1) SELECT event_type, 'high' AS tag, CAST(round_even(quota * 30 / 100.0, 0) AS BIGINT) AS n FROM q UNION ALL SELECT event_type, 'rest', quota - CAST(round_even(quota * 30 / 100.0, 0) AS BIGINT) FROM q")
def _i16(df):
    goals = sampling.quotas(df, "event_type", 100)
    out = sampling.preferred(df, "event_type", goals, [(F.col("heading") > 180, 30, "high"), (F.lit(True), None, "rest")], 50.0, 3)
    return out.groupBy("event_type", "tag").agg(F.count(F.lit(1)).alias("n"))


_BOX = [(-20.0, -10.0), (30.0, -10.0), (30.0, 40.0), (-20.0, 40.0)]


@_query("o02_random_points", "SELECT CAST(500 AS BIGINT) AS n, CAST(500 AS BIGINT) AS inside")
def _o02(spark, d):
    p = sampling.random_points(spark, [_BOX], 500, 4)
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(geo.in_polygon(F.col("lat"), F.col("lng"), [_BOX])).alias("inside"))


@_query("o03_poisson_points", "SELECT CAST(0 AS BIGINT) AS too_close, true AS dense")
def _o03(spark, d):
    """Discs of the radius that fit a box of one degree: a maximal set has at least a quarter of the closest packing."""
    box = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    p = sampling.poisson_points(spark, [box], 5_000.0, 1)
    closest = 111_194.9**2 / (5_000.0**2 * 3**0.5 / 2)
    return _laws(p, p, 5_000.0).select("too_close").join(F.broadcast(p.agg((F.count(F.lit(1)) > closest / 4).alias("dense"))), F.lit(True))  # one row each


# --- documents and polygons

@_query("a06_documents", f"{_L} SELECT lat, lng, heading, 'p' AS pano_id, CAST(1 AS BIGINT) AS flags FROM locations")
def _a06(df):
    """Each row written as a document of two locations, one of them broken, and read back."""
    item = F.to_json(F.struct("lat", F.col("lng").alias("longitude"), "heading", F.lit("p").alias("pano")))
    doc = F.concat(F.lit('{"customCoordinates":[{"lat":null,"lng":1},'), item, F.lit("]}"))
    return src.from_documents(df.select(doc.alias("value"))).select("lat", "lng", "heading", "pano_id", "flags")


@_query("a20_geojson", f"{_L}, k AS (SELECT id, unnest([1, 2, 3]) AS k FROM locations) SELECT CAST(floor(k) AS BIGINT) AS k, count(*) AS n FROM k GROUP BY 1")
def _a20(df):
    """A polygon, two in one, and a collection of one for each row; polygons are told by their first corner."""
    ring = lambda k: F.format_string("[[[%s,0],[9,0],[9,9,5],[%s,0]]]", F.lit(str(k)), F.lit(str(k)))
    one = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":'), ring(1), F.lit("}}"))
    more = F.concat(F.lit('{"type":"FeatureCollection","features":[{"geometry":{"type":"GeometryCollection","geometries":[{"type":"MultiPolygon","coordinates":['), ring(2), F.lit(","), ring(3), F.lit("]}]}}]}"))
    docs = df.select(F.explode(F.array(one, more)).alias("value"))
    return src.polygons(docs).groupBy(F.col("rings")[0][0][0].cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


# --- field expressions


def _expression(text: str):
    def of(df):
        return df.select("id", compile_expression(text, lambda n: field(df, n)).cast("double").alias("score"))

    return of


for _name, _text, _sql in (
    ("h01_arithmetic", "-heading + 2 * (pitch - 3) / 4", "-heading + 2 * (pitch - 3) / 4"),
    ("h01_by_zero", "heading / pitch", "CASE WHEN pitch <> 0 THEN heading / pitch END"),
    ("h01_remainder", "pitch % 7", "CASE WHEN pitch < 0 THEN -(-pitch % 7) ELSE pitch % 7 END"),
    ("h02_compare", "(heading >= 90) + (zoom != 2)", "CAST(heading >= 90 AS INTEGER) + CAST(zoom <> 2 AS INTEGER)"),
    ("h02_missing", "modified_at > 5", "CASE WHEN modified_at > 5 THEN 1 ELSE 0 END"),
    ("h03_floor_mod", "mod(pitch, -7)", "pitch - floor(pitch / -7) * -7"),
    ("h04_bounds", "clamp(pitch, -10, 10) + min(heading, 90) + abs(pitch) + max(zoom, 2) + floor(heading / 7)", "greatest(-10, least(10, pitch)) + least(heading, 90) + abs(pitch) + greatest(zoom, 2) + floor(heading / 7)"),
    ("h05_round", "round(pitch / 4)", "floor(pitch / 4 + 0.5)"),
    ("h06_if", "if(has(modified_at), heading, zoom)", "CASE WHEN modified_at IS NOT NULL THEN heading ELSE zoom END"),
    ("h07_lists", "tagCount * 10", "10 * coalesce((SELECT count(*) FROM location_tags t WHERE t.id = locations.id), 0)"),
    ("h08_text", 'event_type == "click"', "CASE WHEN event_type = 'click' THEN 1 ELSE 0 END"),
):
    _query(_name, f"{_L} SELECT id, CAST({_sql} AS DOUBLE) AS score FROM locations")(_expression(_text))


# --- edits


@_query("j02_move", f"{_L} SELECT id, coalesce(zoom, pitch) AS zoom, CAST(NULL AS DOUBLE) AS pitch, pitch IS NOT NULL AS changed FROM locations")
def _j02(df):
    return work.move_field(df, F.lit(True), "pitch", "zoom", False, 1).select("id", "zoom", "pitch", "changed")


@_query("j10_remap", f"{_L}, t AS (SELECT id, CASE WHEN tag = 4 THEN 2 WHEN tag = 6 THEN 5 ELSE tag END AS tag FROM location_tags) SELECT DISTINCT id, CAST(tag AS BIGINT) AS tag FROM t")
def _j10(df):
    return work.remap_values(df, "tags", {4: 2, 6: 5}).select("id", F.explode("tags").alias("tag"))


@_query("k05_stale", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0")
def _k05(spark, d):
    """A change of every third row, of which every second one was edited since."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    change = changes.between(o, o.withColumn("status", F.when(F.col("id") % 3 == 0, "Z").otherwise(F.col("status"))))
    return changes.stale(o.withColumn("status", F.when(F.col("id") % 2 == 0, "Y").otherwise(F.col("status"))), change)


@_query("k06_layer", """WITH l AS (SELECT user_id AS id, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'remove' WHEN 1 THEN 'set' ELSE 'put' END AS op, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events),
r AS (SELECT *, coalesce(max(CASE WHEN op <> 'put' THEN seq END) OVER (PARTITION BY id), -1) AS reset FROM l)
SELECT id, arg_max(op, seq) = 'remove' AS removed, arg_max(value, seq) FILTER (WHERE value IS NOT NULL) AS value FROM r WHERE seq >= reset GROUP BY id""")
def _k06(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    op = F.when(F.col("event_id") % 5 == 0, "remove").when(F.col("event_id") % 5 == 1, "set").otherwise("put")
    value = F.when((F.col("event_id") % 5 != 0) & (F.col("event_id") % 7 != 0), F.col("value"))
    return changes.layer(e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), op.alias("op"), value.alias("value")))
