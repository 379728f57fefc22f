
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.expr import compile_expression
from ..operators import analytics, asks, changes, spatial, work
from ..sources import locations as src
from .selectors import And, Duplicates, Filter, Ids, Invert, Nearby, Nearest, Or, Polygon, Ranked, column, field, select

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
TAG_SQL = "list(tag ORDER BY tag)"
_L = "WITH " + src.DUCKDB
RADIUS = "12742000.0"
BOX = ((-60.0, -30.0), (60.0, -30.0), (60.0, 40.0), (-60.0, 40.0))
HOLE = ((-20.0, -10.0), (20.0, -10.0), (20.0, 10.0), (-20.0, 10.0))
NOW = 1_800_000_000


def _query(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = lambda spark, d: f(src.locations(spark, d)) if f.__code__.co_argcount == 1 else f(spark, d)
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _hav(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return f"{RADIUS} * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2)))"


def _flat(a: str, b: str) -> str:
    wrap = f"radians((({b}.lng - {a}.lng + 180.0) - 360.0 * floor(({b}.lng - {a}.lng + 180.0) / 360.0)) - 180.0) * cos(radians({a}.lat))"
    return f"(pow({wrap}, 2) + pow(radians({b}.lat - {a}.lat), 2)) * 6371000.0 * 6371000.0"


_PAIR = f"SELECT a.id AS a, b.id AS b FROM locations a JOIN locations b ON b.lat BETWEEN a.lat - 0.001 AND a.lat + 0.001 WHERE a.id <> b.id AND {_flat('a', 'b')} <= 625.0"
_IN_BOX = "lat BETWEEN -30.0 AND 40.0 AND lng BETWEEN -60.0 AND 60.0"
_IN_HOLE = "lat > -10.0 AND lat <= 10.0 AND lng >= -20.0 AND lng < 20.0"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = src.locations(spark, sf_dir)
    chosen = And((Filter("event_type", "eq", "purchase"), Invert((Filter("tags", "contains", 3),)), Nearby(0.0, 0.0, 8_000_000.0)))
    return select(df, chosen).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_QUERIES["flagship"] = flagship
_SQL["flagship"] = f"{_L} SELECT event_type, count(*) AS n FROM locations WHERE event_type = 'purchase' AND id NOT IN (SELECT id FROM location_tags WHERE tag = 3) AND {_hav('lat', 'lng', '0.0', '0.0')} <= 8000000.0 GROUP BY event_type"

_COLS = "id, lat, lng, heading, pano_id"


def _filter(name: str, f, where: str) -> None:
    _QUERIES[name] = lambda spark, d: select(src.locations(spark, d), f).select("id", "heading", "pano_id")
    _SQL[name] = f"{_L} SELECT id, heading, pano_id FROM locations WHERE {where}"


_MD = "strftime(make_timestamp(created_at * 1000000), '%m-%d')"
_HM = "strftime(make_timestamp(created_at * 1000000), '%H:%M')"
_TAG3 = "id IN (SELECT id FROM location_tags WHERE tag = 3)"
_HAS_TAGS = "id IN (SELECT id FROM location_tags)"
_filter("b02_ids", Ids((1, 5, 77, 500, 10**9)), "id IN (1, 5, 77, 500, 1000000000)")
_filter("b05_polygon", Polygon((BOX, HOLE)), f"lat > -30.0 AND lat <= 40.0 AND lng >= -60.0 AND lng < 60.0 AND NOT ({_IN_HOLE})")
_filter("b06_has", Filter("pano_id", "has"), "pano_id IS NOT NULL")
_filter("b06_nothas_tags", Filter("tags", "nothas"), f"NOT {_HAS_TAGS}")
_filter("b07_eq", Filter("event_type", "eq", "click"), "event_type = 'click'")
_filter("b08_neq", Filter("pano_id", "neq", "pano1"), "pano_id IS NOT NULL AND pano_id <> 'pano1'")
_filter("b09_contains", Filter("tags", "contains", 3), _TAG3)
_filter("b09_notcontains", Filter("tags", "notcontains", 3), f"{_HAS_TAGS} AND NOT {_TAG3}")
_filter("b09_contains_scalar", Filter("heading", "contains", 3), "false")
_filter("b10_gt", Filter("heading", "gt", 180.0), "heading > 180")
_filter("b10_lte", Filter("pitch", "lte", -10.0), "pitch <= -10")
_filter("b11_between", Filter("value", "between", (20.0, 60.0)), "value BETWEEN 20.0 AND 60.0")
_filter("b12_length", Filter("tags", "gte", 3), "id IN (SELECT id FROM location_tags GROUP BY id HAVING count(*) >= 3)")
_filter("b13_anyyear_wraps", Filter("created_at", "between_anyyear", ("12-01", "02-01")), f"({_MD} >= '12-01' OR {_MD} <= '02-01')")
_filter("b14_anytime", Filter("created_at", "between_anytime", ("22:00", "02:00")), f"({_HM} >= '22:00' OR {_HM} <= '02:00')")
_filter("b15_local_time", Filter("created_at", "between_anytime", ("08:00", "12:00"), True), "timezone IS NOT NULL AND strftime((make_timestamptz(created_at * 1000000) AT TIME ZONE timezone), '%H:%M') BETWEEN '08:00' AND '12:00'")
_filter("b16_nearby", Nearby(10.0, 20.0, 3_000_000.0), f"{_hav('lat', 'lng', '10.0', '20.0')} <= 3000000.0")
_filter("b17_pinned", And((Filter("loadAsPanoId", "eq", True), Filter("pano_id", "has"))), "flags % 2 = 1 AND pano_id IS NOT NULL")
_filter("b18_extra", Filter("k", "gt", 50.0), "CAST(json_extract_string(extra, '$.k') AS DOUBLE) > 50")
_filter("d01_and_empty", And(()), "false")
_filter("d02_or", Or((Filter("event_type", "eq", "click"), Filter("heading", "gt", 300.0))), "event_type = 'click' OR heading > 300")
_filter("d03_invert_absent", Invert((Filter("pano_id", "neq", "pano1"),)), "NOT (pano_id IS NOT NULL AND pano_id <> 'pano1')")
_filter("d03_invert_none", Invert(()), "true")
_filter("c01_duplicates", Duplicates(25.0), f"id IN (SELECT a FROM ({_PAIR}))")
_filter("c01_duplicates_exact", Duplicates(0.0), "(lat, lng) IN (SELECT (lat, lng) FROM locations GROUP BY lat, lng HAVING count(*) > 1)")
_filter("d07_clipped", And((Duplicates(25.0), Filter("event_type", "eq", "click"))), f"event_type = 'click' AND id IN (SELECT a FROM ({_PAIR}))")
_filter("c06_nearest", Nearest(5.0, 5.0), f"id = (SELECT id FROM locations ORDER BY {_hav('lat', 'lng', '5.0', '5.0')}, id LIMIT 1)")
_filter("e02_ranked", Ranked(Filter("event_type", "eq", "view"), "heading * 2 - pitch", 50), "id IN (SELECT id FROM locations WHERE event_type = 'view' ORDER BY heading * 2 - pitch DESC NULLS LAST, id LIMIT 50)")
_filter("e02_ranked_none", Ranked(Filter("event_type", "eq", "view"), "heading", 0), "false")


@_query("d04_forest_counts", f"{_L}, t AS (SELECT l.*, coalesce(c.n, 0) AS tags FROM locations l LEFT JOIN (SELECT id, count(*) n FROM location_tags GROUP BY id) c USING (id)) SELECT 'clicks' AS name, count(*) FILTER (event_type = 'click') AS n FROM t UNION ALL SELECT 'untagged', count(*) FILTER (tags = 0) FROM t UNION ALL SELECT 'panned', count(*) FILTER (heading <> 0) FROM t")
def _(df):
    return asks.counts(df, {"clicks": column(df, Filter("event_type", "eq", "click")), "untagged": column(df, Filter("tags", "nothas")), "panned": F.col("heading") != 0})


@_query("c02_pairs", f"{_L} SELECT a, b FROM ({_PAIR}) WHERE a < b")
def _(df):
    return spatial.pairs(df, 25.0)


@_query("c03_near_any", f"{_L}, p AS (SELECT * FROM locations WHERE event_type = 'click'), s AS (SELECT * FROM locations WHERE event_type = 'view') SELECT id, EXISTS (SELECT 1 FROM s WHERE s.lat BETWEEN p.lat - 0.001 AND p.lat + 0.001 AND {_flat('p', 's')} <= 2500.0) AS near FROM p")
def _(df):
    return spatial.near_any(df.filter("event_type = 'click'"), df.filter("event_type = 'view'"), 50.0)


@_query("c04_held", f"{_L}, g AS (SELECT * FROM locations WHERE event_type = 'click'), s AS (SELECT * FROM locations WHERE event_type = 'view') SELECT id, CASE WHEN pano_id IS NOT NULL THEN pano_id IN (SELECT pano_id FROM s WHERE pano_id IS NOT NULL) ELSE EXISTS (SELECT 1 FROM s WHERE s.lat = g.lat AND s.lng = g.lng) END AS held FROM g")
def _(df):
    return asks.held(df.filter("event_type = 'click'"), df.filter("event_type = 'view'"))


@_query("c05_neighbours", f"{_L} SELECT a.id AS id, array_to_string(list(b.id ORDER BY {_flat('a', 'b')}, b.id), ',') AS neighbours FROM locations a JOIN locations b ON b.lat BETWEEN a.lat - 0.001 AND a.lat + 0.001 WHERE {_flat('a', 'b')} <= 2500.0 GROUP BY a.id")
def _(df):
    return spatial.neighbours(df, 50.0).select("id", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@_query("c07_areas", f"{_L} SELECT CASE WHEN {_IN_HOLE} THEN 'in' WHEN lat > -30.0 AND lat <= 40.0 AND lng >= -60.0 AND lng < 60.0 THEN 'out' END AS area, count(*) AS n FROM locations GROUP BY 1 HAVING area IS NOT NULL")
def _(df):
    out = spatial.classify(df, [("in", [list(HOLE)]), ("out", [list(BOX)])])
    return out.filter("area IS NOT NULL").groupBy("area").agg(F.count(F.lit(1)).alias("n"))


@_query("e01_rank_order", f"{_L} SELECT id, heading - pitch AS score FROM locations ORDER BY score DESC, id LIMIT 100")
def _(df):
    return df.withColumn("score", F.col("heading") - F.col("pitch")).orderBy(F.desc_nulls_last("score"), "id").limit(100).select("id", "score")


@_query("e08_page", f"{_L} SELECT id, created_at FROM locations ORDER BY created_at DESC, id LIMIT 50 OFFSET 100")
def _(df):
    return df.orderBy(F.desc("created_at"), "id").offset(100).limit(50).select("id", "created_at")


@_query("f05_values", f"{_L} SELECT DISTINCT json_extract_string(extra, '$.k') AS value FROM locations WHERE json_extract_string(extra, '$.k') IS NOT NULL")
def _(df):
    return df.select(field(df, "k")[0].alias("value")).filter("value IS NOT NULL AND value <> ''").distinct()


@_query("f06_group_by_tag", f"{_L} SELECT tag AS key, count(*) AS n, min(id) AS first, max(id) AS last FROM location_tags GROUP BY tag")
def _(df):
    return df.select("id", F.explode(F.array_distinct("tags")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@_query("f07_count_by_fields", f"{_L} SELECT 'tag' AS field, CAST(tag AS VARCHAR) AS key, count(*) AS n FROM location_tags GROUP BY tag UNION ALL SELECT 'type', event_type, count(*) FROM locations GROUP BY event_type UNION ALL SELECT 'zone', timezone, count(*) FROM locations WHERE timezone IS NOT NULL GROUP BY timezone")
def _(df):
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c))).otherwise(F.array().cast("array<string>"))
    return asks.count_by_fields(df, {"tag": F.col("tags"), "type": one("event_type"), "zone": one("timezone")})


@_query("f08_bins_by_count", f"{_L}, e AS (SELECT min(pitch) a, max(pitch) b FROM locations), k AS (SELECT CAST(least(greatest(floor((pitch - a) / ((b - a) / 7)), 0), 6) AS INTEGER) AS bin FROM locations, e), f AS (SELECT CAST(range AS INTEGER) AS bin FROM range(7)) SELECT f.bin AS bin, a + f.bin * ((b - a) / 7) AS lo, a + (f.bin + 1) * ((b - a) / 7) AS hi, (SELECT count(*) FROM k WHERE k.bin = f.bin) AS n FROM f, e")
def _(df):
    return asks.bins_by_count(df, "pitch", 7)


@_query("f09_bins_by_width", f"{_L} SELECT floor(pitch / 7.0) * 7.0 AS lo, count(*) AS n FROM locations GROUP BY 1")
def _(df):
    return asks.bins_by_width(df, "pitch", 7.0)


for _part, _fmt in (("year", "%Y"), ("yearMonth", "%Y-%m"), ("day", "%Y-%m-%d"), ("monthOfYear", "%m"), ("hourOfDay", "%H")):
    _QUERIES[f"f12_{_part.lower()}"] = lambda spark, d, p=_part: asks.date_parts(src.locations(spark, d), "created_at", p)
    _SQL[f"f12_{_part.lower()}"] = f"{_L} SELECT strftime(make_timestamp(created_at * 1000000), '{_fmt}') AS key, count(*) AS n FROM locations GROUP BY 1"


@_query("f13_coverage", f"{_L} SELECT 'pano_id' AS name, count(pano_id) AS n FROM locations UNION ALL SELECT 'modified_at', count(modified_at) FROM locations UNION ALL SELECT 'timezone', count(timezone) FROM locations UNION ALL SELECT 'tags', count(DISTINCT id) FROM location_tags")
def _(df):
    return asks.coverage(df, {"pano_id": F.col("pano_id").isNotNull(), "modified_at": F.col("modified_at").isNotNull(), "timezone": F.col("timezone").isNotNull(), "tags": F.size("tags") > 0})


@_query("f14_bounds", f"{_L} SELECT CASE WHEN es - ws < e - w THEN CASE WHEN ws >= 180 THEN ws - 360 ELSE ws END ELSE w END AS west, south, CASE WHEN es - ws < e - w THEN CASE WHEN es >= 180 THEN es - 360 ELSE es END ELSE e END AS east, north FROM (SELECT min(lat) south, max(lat) north, min(lng) w, max(lng) e, min(CASE WHEN lng < 0 THEN lng + 360 ELSE lng END) ws, max(CASE WHEN lng < 0 THEN lng + 360 ELSE lng END) es FROM locations WHERE event_type = 'click')")
def _(df):
    return asks.bounds(df.filter("event_type = 'click'"))


@_query("f15_duplicate_groups", f"{_L}, RECURSIVE_PAIRS AS ({_PAIR}) SELECT a AS id, min(b) AS nearest, count(*) AS n FROM RECURSIVE_PAIRS GROUP BY a")
def _(df):
    p = spatial.pairs(df, 25.0)
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("nearest"), F.count(F.lit(1)).alias("n"))


@_query("f15_components", "WITH RECURSIVE " + src.DUCKDB + f", e AS ({_PAIR}), r AS (SELECT DISTINCT a AS id, a AS g FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id) SELECT id, min(g) AS \"group\" FROM r GROUP BY id")
def _(df):
    return spatial.groups(df, 25.0)


@_query("f24_geohash", f"{_L} SELECT substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(1 + 16 * (CAST(floor((lng + 180) / 360 * 8) AS INT) // 4) + 8 * (CAST(floor((lat + 90) / 180 * 4) AS INT) // 2) + 4 * (CAST(floor((lng + 180) / 360 * 8) AS INT) // 2 % 2) + 2 * (CAST(floor((lat + 90) / 180 * 4) AS INT) % 2) + CAST(floor((lng + 180) / 360 * 8) AS INT) % 2 AS INT), 1) AS cell, count(*) AS n FROM locations GROUP BY 1")
def _(df):
    return df.groupBy(geo.geohash(F.col("lat"), F.col("lng"), 1).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@_query("g01_pivot", f"{_L} SELECT event_type AS row, coalesce(timezone, 'N/A') AS col, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY event_type) AS BIGINT) AS row_total FROM locations GROUP BY 1, 2")
def _(df):
    return analytics.pivot(df, F.col("event_type"), F.col("timezone"))


@_query("g05_kruskal", f"{_L}, y AS (SELECT event_type g, pitch v FROM locations), b AS (SELECT v, count(*) t FROM y GROUP BY v), r AS (SELECT v, t, coalesce(sum(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS rank FROM b), s AS (SELECT g, sum(rank) r, count(*) n FROM y JOIN r USING (v) GROUP BY g), q AS (SELECT sum(CAST(r AS DOUBLE) * r / n) x, CAST(sum(n) AS DOUBLE) n FROM s), z AS (SELECT sum(CAST(t AS DOUBLE) * t * t - t) ties FROM b) SELECT round(least(greatest((12 * x / (n * (n + 1)) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) / (n - 1), 0), 1), 9) AS eps2 FROM q, z")
def _(df):
    return analytics.kruskal(df, "event_type", "pitch").select(F.round("eps2", 9).alias("eps2"))


@_query("g06_circular", f"{_L}, a AS (SELECT event_type, sum(cos(radians(heading))) c, sum(sin(radians(heading))) s, count(*) n FROM locations GROUP BY 1) SELECT event_type, round(CASE WHEN degrees(atan2(s, c)) < 0 THEN degrees(atan2(s, c)) + 360 ELSE degrees(atan2(s, c)) END, 5) AS mean, round(sqrt(c * c + s * s) / n, 8) AS concentration FROM a")
def _(df):
    return analytics.circular(df, "event_type", "heading").select("event_type", F.round("mean", 5).alias("mean"), F.round("concentration", 8).alias("concentration"))


@_query("g07_cramers_v", f"{_L}, o AS (SELECT event_type g, zoom v, count(*) o FROM locations GROUP BY 1, 2), g AS (SELECT g, sum(o) gt FROM o GROUP BY g), v AS (SELECT v, sum(o) vt FROM o GROUP BY v), t AS (SELECT CAST(sum(o) AS DOUBLE) n, count(DISTINCT g) r, count(DISTINCT v) k FROM o), q AS (SELECT sum(CAST(o AS DOUBLE) * o / gt / vt) - 1 AS p FROM o JOIN g USING (g) JOIN v USING (v)) SELECT round(least(sqrt(greatest(0, p - (k - 1) * (r - 1) / (n - 1)) / least(k - (k - 1) * (k - 1) / (n - 1) - 1, r - (r - 1) * (r - 1) / (n - 1) - 1)), 1), 7) AS v FROM q, t")
def _(df):
    return analytics.cramers_v(df, "event_type", "zoom").select(F.round("v", 7).alias("v"))


@_query("g08_quartiles", f"{_L} SELECT event_type, quantile_cont(pitch, 0.25) AS p25, quantile_cont(pitch, 0.5) AS p50, quantile_cont(pitch, 0.75) AS p75 FROM locations GROUP BY 1")
def _(df):
    return analytics.quartiles(df, "event_type", "pitch")


@_query("g11_spread", f"{_L}, c AS (SELECT event_type, count(*) c FROM locations GROUP BY 1), a AS (SELECT CAST(sum(c) AS DOUBLE) n, CAST(count(*) AS DOUBLE) k FROM c) SELECT round(1 - sum(abs(c / n - 1 / k)) / 2, 9) AS spread FROM c, a")
def _(df):
    return analytics.spread(df, "event_type").select(F.round("spread", 9).alias("spread"))


@_query("g13_score", f"{_L}, d AS (SELECT id, {_hav('lat', 'lng', '0.0', '0.0')} AS m FROM locations) SELECT id, CASE WHEN m <= 25 THEN 5000.0 ELSE floor(5000 * pow(0.99866017, m / (185.34781 * ln(0.99866017) * -1e4)) + 0.5) END AS score FROM d")
def _(df):
    return df.select("id", geo.score(geo.haversine_m(F.col("lat"), F.col("lng"), 0.0, 0.0)).alias("score"))


@_query("g14_streaks", f"{_L}, r AS (SELECT event_type, id, heading > 90 AS hit, sum(CASE WHEN heading > 90 THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY id) AS island FROM locations), s AS (SELECT event_type, island, count(*) n FROM r WHERE hit GROUP BY 1, 2) SELECT event_type, max(n) AS best FROM s GROUP BY 1")
def _(df):
    return work.streaks(df, "event_type", "id", F.col("heading") > 90)


@_query("g16_vector_search", "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 4) AS dot FROM embeddings, q WHERE vec_id <> 0) SELECT vec_id, dot FROM d ORDER BY dot DESC, vec_id LIMIT 10")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return analytics.vector_top(e, e.filter("vec_id = 0"), 10)


@_query("h_expression", f"{_L}, t AS (SELECT l.*, coalesce(c.n, 0) AS k FROM locations l LEFT JOIN (SELECT id, count(*) n FROM location_tags GROUP BY id) c USING (id)) SELECT id, CASE WHEN pano_id IS NOT NULL THEN floor(pitch / 4.0 + 0.5) + k * 2 ELSE (((pitch % 7) + 7) % 7) END AS score FROM t")
def _(df):
    return df.select("id", compile_expression("if(has(pano_id), round(pitch / 4) + tagCount * 2, mod(pitch, 7))", lambda n: field(df, n)).alias("score"))


@_query("j01_set", f"{_L} SELECT id, CASE WHEN heading > 180 THEN 7.0 ELSE zoom END AS zoom, CASE WHEN heading > 180 THEN {NOW} ELSE modified_at END AS modified_at, heading > 180 AS changed FROM locations")
def _(df):
    return work.set_field(df, F.col("heading") > 180, "zoom", 7.0, NOW).select("id", "zoom", "modified_at", "changed")


@_query("j03_delete", f"{_L} SELECT id, CASE WHEN heading > 180 THEN NULL ELSE timezone END AS timezone, heading > 180 AND timezone IS NOT NULL AS changed FROM locations")
def _(df):
    return work.delete_fields(df, F.col("heading") > 180, ["timezone"], NOW).select("id", "timezone", "changed")


@_query("j04_expression", f"{_L} SELECT id, CASE WHEN value IS NULL OR pitch = 0 THEN zoom ELSE value / pitch END AS zoom, pitch = 0 OR value IS NULL AS failed FROM locations")
def _(df):
    return work.set_expression(df, F.lit(True), "zoom", compile_expression("value / pitch", lambda n: field(df, n)), NOW).select("id", "zoom", "failed")


@_query("j05_list_set", f"{_L}, t AS (SELECT l.id, coalesce(c.tags, []) AS tags FROM locations l LEFT JOIN (SELECT id, list(tag ORDER BY tag) tags FROM location_tags GROUP BY id) c USING (id)) SELECT id, array_to_string(list_concat(list_filter(tags, lambda x: x <> 2), CASE WHEN list_contains(tags, 8) THEN [] ELSE [8] END), ',') AS tags FROM t")
def _(df):
    return work.list_set(df, F.lit(True), "tags", [8], [2, 8], NOW).select("id", F.array_join(F.transform("tags", lambda x: x.cast("string")), ",").alias("tags"))


@_query("j06_merge", f"{_L}, t AS (SELECT l.*, coalesce(c.tags, []) AS tags, coalesce(len(c.tags), 0) + CASE WHEN pano_id IS NULL THEN 0 ELSE 1 END + CASE WHEN flags % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN heading <> 0 THEN 1 ELSE 0 END AS score FROM locations l LEFT JOIN (SELECT id, list(tag ORDER BY tag) tags FROM location_tags GROUP BY id) c USING (id)), r AS (SELECT *, row_number() OVER (PARTITION BY pano_id ORDER BY score DESC, created_at, id) AS rn FROM t WHERE pano_id IS NOT NULL), g AS (SELECT pano_id, count(*) AS size FROM r GROUP BY pano_id) SELECT r.pano_id, r.id, g.size, coalesce(array_to_string((SELECT list(DISTINCT tag ORDER BY tag) FROM location_tags lt JOIN locations x ON x.id = lt.id WHERE x.pano_id = r.pano_id), ','), '') AS tags FROM r JOIN g USING (pano_id) WHERE rn = 1")
def _(df):
    return work.merge_groups(df.filter("pano_id IS NOT NULL"), "pano_id", work.duplicate_score()).select("pano_id", "id", "size", F.array_join(F.transform("tags", lambda x: x.cast("string")), ",").alias("tags"))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    return o.filter("id % 3 <> 0"), o.filter("id % 4 <> 0").withColumn("status", F.when(F.col("id") % 5 == 0, "X").otherwise(F.col("status")))


_OLD_NEW = "WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders), a AS (SELECT * FROM o WHERE id % 3 <> 0), b AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'X' ELSE status END AS status FROM o WHERE id % 4 <> 0)"


@_query("k01_between", f"{_OLD_NEW} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'updated' END AS kind FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.status IS DISTINCT FROM b.status")
def _(spark, d):
    return changes.between(*_halves(spark, d)).select("id", changes.kind().alias("kind"))


@_query("k02_apply", f"{_OLD_NEW} SELECT id, status FROM b")
def _(spark, d):
    old, new = _halves(spark, d)
    return changes.apply(old, changes.between(old, new)).select("id", "status")


@_query("k03_undo", f"{_OLD_NEW} SELECT id, status FROM a")
def _(spark, d):
    old, new = _halves(spark, d)
    return changes.apply(new, changes.inverse(changes.between(old, new))).select("id", "status")


@_query("k04_compose", f"{_OLD_NEW} SELECT count(*) AS n FROM a WHERE false")
def _(spark, d):
    old, new = _halves(spark, d)
    there = changes.between(old, new)
    steps = there.withColumn("seq", F.lit(1)).unionByName(changes.inverse(there).withColumn("seq", F.lit(2)))
    return changes.compose(steps).agg(F.count(F.lit(1)).alias("n"))


@_query(
    "k09_checkout",
    """WITH l AS (SELECT event_id // 1000 AS c, user_id AS id, value, event_id, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END AS op FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id DESC) rn FROM l) SELECT id, value FROM k WHERE rn = 1 AND op <> 0""",
)
def _k09(spark, d):
    """Every thousand events are a commit, users are the rows."""
    e = spark.read.parquet(f"{d}/events.parquet")
    last = F.max_by(F.struct(F.when(F.col("event_id") % 11 == 0, 0).otherwise(1).alias("op"), "value"), "event_id").alias("r")
    log = e.groupBy(F.floor(F.col("event_id") / 1000).alias("commit_id"), F.col("user_id").alias("id")).agg(last).select("commit_id", "id", "r.op", "r.value")
    return changes.checkout(log, log.select("commit_id").distinct().withColumn("depth", F.col("commit_id")))


@_query("c11_three_way", "WITH o AS (SELECT o_orderkey AS key, o_orderstatus AS h FROM orders), b AS (SELECT * FROM o WHERE key % 2 = 0), l AS (SELECT key, CASE WHEN key % 7 = 0 THEN 'L' ELSE h END AS h FROM o WHERE key % 3 <> 0), r AS (SELECT key, CASE WHEN key % 5 = 0 THEN 'R' ELSE h END AS h FROM o WHERE key % 11 <> 0), j AS (SELECT coalesce(b.key, l.key, r.key) AS key, b.h b, l.h l, r.h r FROM b FULL JOIN l ON b.key = l.key FULL JOIN r ON r.key = coalesce(b.key, l.key)) SELECT key, CASE WHEN l IS NOT DISTINCT FROM r THEN 'none' WHEN b IS NOT DISTINCT FROM l THEN CASE WHEN r IS NULL THEN 'remove_local' WHEN l IS NULL THEN 'add_local' ELSE 'update_local' END WHEN b IS NOT DISTINCT FROM r THEN CASE WHEN l IS NULL THEN 'remove_remote' WHEN r IS NULL THEN 'add_remote' ELSE 'update_remote' END ELSE 'conflict' END AS plan FROM j")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("hash"))
    mark = lambda df, n, m: df.withColumn("hash", F.when(F.col("key") % n == 0, m).otherwise(F.col("hash")))
    return changes.three_way(o.filter("key % 2 = 0"), mark(o.filter("key % 3 <> 0"), 7, "L"), mark(o.filter("key % 11 <> 0"), 5, "R"))


@_query("c12_numbered", f"{_L} SELECT id, concat(event_type, '#', CAST(row_number() OVER (PARTITION BY event_type ORDER BY id) AS VARCHAR)) AS key FROM locations")
def _(df):
    return changes.numbered(df, "event_type", "id").select("id", "key")


@_query("c14_proximity", f"{_L}, p AS (SELECT * FROM locations WHERE id % 50 = 0) SELECT DISTINCT l.id AS id FROM locations l JOIN p ON abs(p.lat - l.lat) <= 1000.0 / 110000.0 WHERE pow(6371137.0 * pi() / 180, 2) * (pow((p.lng - l.lng) * cos((p.lat + l.lat) * (pi() / 360)), 2) + pow(p.lat - l.lat, 2)) < 1000.0 * 1000.0")
def _(df):
    return spatial.near_ids(df, df.filter("id % 50 = 0"), 1100.0, geo.closer_than(F.col("p_lat"), F.col("p_lng"), F.col("i_lat"), F.col("i_lng"), 1000.0))


@_query("q07_folders", f"{_L}, p AS (SELECT id, unnest([concat('t/', CAST(tag % 3 AS VARCHAR)), 't', concat('t/', CAST(tag % 3 AS VARCHAR), '/', CAST(tag AS VARCHAR))]) AS folder FROM location_tags) SELECT folder, count(DISTINCT id) AS n FROM p GROUP BY folder")
def _(df):
    return asks.folder_counts(df, F.transform("tags", lambda t: F.concat(F.lit("t/"), (t % 3).cast("string"), F.lit("/"), t.cast("string"))))


@_query("a13_export_json")
def _(df):
    return src.to_json_rows(df, unpanned=True)


@_query("a15_export_geojson")
def _(df):
    return src.to_geojson_rows(df)


@_query("o01_honeycomb")
def _(spark, d):
    return spatial.honeycomb(spark, -10.0, -5.0, 10.0, 5.0, 50_000.0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import extended, forests, polygonal, reports, rows, spreading, typed, wider  # noqa: F401, register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import extended, forests, polygonal, reports, rows, spreading, typed, wider  # noqa: F401

    return dict(_SQL)
