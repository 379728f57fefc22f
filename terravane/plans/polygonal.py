"""Registered queries of polygons in a table: a feature for each supplier, some with holes, second parts, or across the antimeridian."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import areas
from .catalog import _L, _query

# A feature is a diamond about (cx, cy) with an inner diamond as its hole; every third has a second diamond 30° to the east. Every
# vertex is moved a little, so edges are slanted.
_SHAPE = """SELECT s_suppkey AS pos, concat('n', CAST(s_nationkey AS {text})) AS code, s_suppkey % 2 AS odd,
  CAST((s_suppkey * 7919) % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(180.05 AS DOUBLE) AS cx, CAST((s_suppkey * 104729) % 801 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(40.05 AS DOUBLE) AS cy,
  CAST(s_suppkey % 13 * 2 + 10 AS DOUBLE) AS r FROM {supplier}"""
_CORNERS = [(-1.0, 0.1), (0.05, -0.8), (1.0, -0.05), (0.2, 0.9)]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, code, odd, parts): longitudes are in [-180, 180), so rings across 180° jump."""
    base = spark.sql(_SHAPE.format(text="STRING", supplier="{supplier}"), supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    fold = lambda x: F.pmod(x + 180.0, F.lit(360.0)) - 180.0

    def ring(x, y, r):
        return F.array(*(F.array(fold(x + F.lit(a) * r), y + F.lit(b) * r) for a, b in _CORNERS))

    cx, cy, r = F.col("cx"), F.col("cy"), F.col("r")
    one = F.array(ring(cx, cy, r), ring(cx, cy, r * 0.25))
    two = F.array(ring(cx + 30.0, cy, r * 0.5))
    return base.select("pos", "code", "odd", F.when(F.col("pos") % 3 == 0, F.array(one, two)).otherwise(F.array(one)).alias("parts"))


def _edge_rows() -> str:
    """(pos, code, odd, part, ring, x, y, px, py): the edges in SQL, in continued longitudes."""
    out = []
    for part, ring, shift, scale, where in ((0, 0, 0.0, 1.0, "true"), (0, 1, 0.0, 0.25, "true"), (1, 0, 30.0, 0.5, "pos % 3 = 0")):
        for k, (a, b) in enumerate(_CORNERS):
            pa, pb = _CORNERS[k - 1]
            at = lambda u, v: f"cx + {shift} + CAST({u} AS DOUBLE) * (r * {scale}), cy + CAST({v} AS DOUBLE) * (r * {scale})"
            out.append(f"SELECT pos, code, odd, {part}, {ring}, {at(a, b)}, {at(pa, pb)} FROM shapes WHERE {where}")
    return " UNION ALL ".join(out)


_SHAPES = "shapes AS (" + _SHAPE.format(text="VARCHAR", supplier="supplier") + f"), edges(pos, code, odd, part, ring, x, y, px, py) AS ({_edge_rows()})"
# hits (id, pos, code, odd): every location with every feature that contains it, by crossings on a ray, in three turns of longitude.
_HITS = f"""{_SHAPES}, t AS (SELECT id, lat, lng + 360.0 * k AS lng FROM locations, (VALUES (-1), (0), (1)) v(k)),
rings AS (SELECT t.id, t.lng, e.pos, any_value(e.code) AS code, any_value(e.odd) AS odd, e.part, e.ring FROM t JOIN edges e ON (e.y > t.lat) <> (e.py > t.lat) AND t.lng < (e.px - e.x) * (t.lat - e.y) / (e.py - e.y) + e.x GROUP BY t.id, t.lng, e.pos, e.part, e.ring HAVING count(*) % 2 = 1),
hits AS (SELECT id, pos, any_value(code) AS code, any_value(odd) AS odd FROM (SELECT id, pos, part, any_value(code) AS code, any_value(odd) AS odd FROM rings GROUP BY id, pos, part HAVING max(ring) = 0) GROUP BY id, pos)"""
_FIRST = f"{_HITS}, first AS (SELECT id, arg_min(code, pos) AS code, min(pos) AS pos FROM hits GROUP BY id)"


@_query("b05_multi", f"{_L}, {_HITS} SELECT DISTINCT id FROM hits")
def _b05(spark, d):
    """Locations in any of the features."""
    return areas.inside(_locations(spark, d), areas.cover(features(spark, d), 5.0)).select("id")


def _locations(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.locations import locations

    return locations(spark, d).select("id", "lat", "lng")


@_query("c07_table", f"{_L}, {_FIRST} SELECT l.id, coalesce(f.code, 'none') AS code FROM locations l LEFT JOIN first f ON f.id = l.id")
def _c07(spark, d):
    """The code of the first feature that contains each location."""
    f = features(spark, d)
    return areas.classified(_locations(spark, d), f, areas.cover(f), otherwise="none").select("id", "code")


@_query("f18_table", f"{_L}, {_FIRST} SELECT code, CAST(count(*) AS BIGINT) AS n FROM first GROUP BY code")
def _f18(spark, d):
    f = features(spark, d)
    return areas.tally(_locations(spark, d), f, areas.cover(f))


@_query("o04_flags", f"{_L}, {_HITS} SELECT id, id IN (SELECT id FROM hits) AS inside FROM locations")
def _o04(spark, d):
    return areas.flagged(_locations(spark, d), areas.cover(features(spark, d), 10.0)).select("id", "inside")


def _geometry(mode: str):
    def of(spark, d):
        f = features(spark, d)
        odd, rest = areas.cover(f.filter("odd = 1")), areas.cover(f.filter("odd = 0"))
        return areas.geometry_filter(_locations(spark, d), [(True, odd), (False, rest)], mode).select("id")

    return of


_ODD, _REST = "id IN (SELECT id FROM hits WHERE odd = 1)", "id NOT IN (SELECT id FROM hits WHERE odd = 0)"
_query("i11_geometry", f"{_L}, {_HITS} SELECT id FROM locations WHERE {_ODD} AND {_REST}")(_geometry("intersection"))
_query("i11_union", f"{_L}, {_HITS} SELECT id FROM locations WHERE {_ODD} OR {_REST}")(_geometry("union"))


@_query("q09_border", f"{_L}, {_FIRST} SELECT f.id, CAST(CASE WHEN f.pos % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS parts, s.cy + CAST(0.1 AS DOUBLE) * s.r AS lat FROM first f JOIN shapes s ON s.pos = f.pos")
def _q09(spark, d):
    """The border at each location: how many parts it has, and its first vertex's latitude."""
    f = features(spark, d)
    border = f.select("pos", F.struct(F.size("parts").alias("parts"), F.col("parts")[0][0][0][1].alias("lat")).alias("border"))
    found = areas.classified(_locations(spark, d), border, areas.cover(f), "border").filter("border IS NOT NULL")
    return found.select("id", "border.parts", "border.lat")


_M = "(6371000.0 * pi() / 180)"
_ROW = f"(90000.0 * sqrt(3) / 2 / {_M})"


@_query("o01_runs", f"""WITH {_SHAPES}, outer_ AS (SELECT pos, part, min(y) AS s, max(y) AS n, min(x) AS w, max(x) AS e FROM edges WHERE ring = 0 GROUP BY 1, 2),
box AS (SELECT pos, (min(s) + max(n)) / 2 AS lat0, (min(w) + max(e)) / 2 - 360 * floor(((min(w) + max(e)) / 2 + 180) / 360) AS lng0 FROM outer_ GROUP BY pos),
rw AS (SELECT o.pos, o.part, b.lat0, b.lng0, unnest(range(CAST(ceil((o.s - b.lat0) / {_ROW}) AS BIGINT), CAST(floor((o.n - b.lat0) / {_ROW}) AS BIGINT) + 1)) AS row FROM outer_ o JOIN box b ON b.pos = o.pos),
rl AS (SELECT *, lat0 + row * {_ROW} AS lat, 90000.0 / ({_M} * cos(radians(lat0 + row * {_ROW}))) AS st, CASE WHEN row % 2 = 0 THEN 0.0 ELSE 0.5 END AS phase FROM rw),
turns AS (SELECT e.pos, e.part, e.ring, round((any_value(b.lng0) - (min(e.x) + max(e.x)) / 2) / 360) * 360 AS turn FROM edges e JOIN box b ON b.pos = e.pos GROUP BY 1, 2, 3),
xs AS (SELECT r.pos, r.part, r.row, r.lat, r.lng0, r.st, r.phase, (e.px - e.x) * (r.lat - e.y) / (e.py - e.y) + e.x + t.turn AS x FROM rl r JOIN edges e ON e.pos = r.pos AND e.part = r.part AND (e.y > r.lat) <> (e.py > r.lat) JOIN turns t ON t.pos = e.pos AND t.part = e.part AND t.ring = e.ring),
o AS (SELECT *, row_number() OVER w AS i, lead(x) OVER w AS x2 FROM xs WINDOW w AS (PARTITION BY pos, part, row ORDER BY x)),
sp AS (SELECT *, ceil((x - lng0) / st - phase) AS f, floor((x2 - lng0) / st - phase) AS t FROM o WHERE i % 2 = 1),
pt AS (SELECT pos, part, row, lat, st, lng0 + (f + phase) * st AS lng, t - f + 1 AS n FROM sp WHERE t >= f),
fo AS (SELECT *, lng + 180 - 360 * floor((lng + 180) / 360) - 180 AS w FROM pt),
each AS (SELECT pos, part, row, lat, st, w, unnest(range(0, CAST(n AS BIGINT))) AS m FROM fo),
side AS (SELECT *, w + m * st >= 180 AS past FROM each)
SELECT pos, CAST(part AS INTEGER) AS part, row, lat, min(CASE WHEN past THEN w + m * st - 360 ELSE w + m * st END) AS lng, st AS lng_step, CAST(count(*) AS BIGINT) AS count FROM side GROUP BY pos, part, row, lat, st, w, past""")
def _o01(spark, d):
    """Runs of a honeycomb of 90 kilometres in every feature."""
    return areas.honeycomb_runs(features(spark, d), 90_000.0)


@_query("o02_table", "SELECT s_suppkey AS pos, CAST(40 AS BIGINT) AS n, CAST(40 AS BIGINT) AS inside FROM supplier")
def _o02(spark, d):
    """Forty random points in each feature, all inside it."""
    f = features(spark, d)
    c = areas.cover(f, 5.0)
    p = areas.owned(areas.random_points(f, 40, 7, c), f, "own", c.degrees)
    return p.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("inside"))


@_query("o03_table", "SELECT s_suppkey AS pos, CAST(0 AS BIGINT) AS too_close, CAST(0 AS BIGINT) AS uncovered FROM supplier")
def _o03(spark, d):
    """Points 500 kilometres apart in each feature: none too close, and no point of a lattice inside it farther than twice that from all."""
    from ..operators import spatial
    from ..operators.shared import checkpointed

    f = features(spark, d)
    p = checkpointed(areas.poisson_points(f, 500_000.0, 3)).select(F.struct("pos", "k").alias("id"), "lat", "lng", "pos")
    probe = areas.honeycomb_points(areas.honeycomb_runs(f, 120_000.0))
    pairs = spatial.within(p, p, 505_000.0, by="pos").filter(_near(500_000.0) & (F.col("p_id") < F.col("i_id")))
    close = pairs.groupBy(F.col("p_pos").alias("pos")).agg(F.count(F.lit(1)).alias("c"))
    bare = spatial.far_from(probe, p, 1_000_000.0, "pos").groupBy("pos").agg(F.count(F.lit(1)).alias("u"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return f.select("pos").join(close, "pos", "left").join(bare, "pos", "left").select("pos", zero("c", "too_close"), zero("u", "uncovered"))


def _near(metres: float):
    from ..functions import geo

    return geo.closer_than(F.col("p_lat"), F.col("p_lng"), F.col("i_lat"), F.col("i_lng"), metres)
