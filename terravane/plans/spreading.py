"""Registered queries of samples spread over areas: customers as points, nations as areas, keys as the order, so that SQL states every id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distribution
from ..operators.sampling import SPACINGS
from .catalog import _L, _query

_SQL = """SELECT c_custkey AS id, c_nationkey AS area, (c_custkey * 7919) % 100003 AS o,
  CAST(40 AS DOUBLE) + CAST((c_custkey * 104729) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) AS lat,
  CAST(7 AS DOUBLE) + CAST((c_custkey * 1299709) % 20011 AS DOUBLE) / CAST(20011 AS DOUBLE) AS lng FROM {customer}"""
_P = "WITH RECURSIVE p AS MATERIALIZED (" + _SQL.format(customer="customer") + ")"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SQL, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def _close(a: str, b: str, d: str) -> str:
    dlat = f"({b}.lat - {a}.lat)"
    x = f"(({b}.lng - {a}.lng) * cos(({a}.lat + {b}.lat) * (pi() / 360)))"
    return f"{dlat} * {dlat} <= {d} * {d} / (110000.0 * 110000.0) AND pow(6371137.0 * pi() / 180, 2) * ({x} * {x} + {dlat} * {dlat}) < {d} * {d}"


# One step a row of an area: k is its place in the order, blocks the earlier rows that are too close to it. The rows taken at
# spacing s are the ones in `taken` at the last step.
def _pass(states: str) -> str:
    """CTEs: taken (area, s, taken), the whole pass of each (area, s, d) of states."""
    return f"""
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY area ORDER BY o, id) AS k, count(*) OVER (PARTITION BY area) AS size FROM q),
s AS MATERIALIZED ({states}),
b AS MATERIALIZED (SELECT n.area, s.s, n.k, list(m.k) AS blocks FROM n JOIN s ON s.area = n.area JOIN n m ON m.area = n.area AND m.k < n.k AND {_close('m', 'n', 's.d')} GROUP BY ALL),
steps(area, s, k, size, taken) AS (
  SELECT DISTINCT n.area, s.s, CAST(0 AS BIGINT), n.size, CAST([] AS BIGINT[]) FROM n JOIN s ON s.area = n.area
  UNION ALL
  SELECT t.area, t.s, t.k + 1, t.size, CASE WHEN b.blocks IS NULL OR NOT list_has_any(t.taken, b.blocks) THEN list_append(t.taken, t.k + 1) ELSE t.taken END
  FROM steps t LEFT JOIN b ON b.area = t.area AND b.s = t.s AND b.k = t.k + 1 WHERE t.k < t.size),
taken AS MATERIALIZED (SELECT area, s, taken FROM steps WHERE k = size)"""


_ALL = "SELECT a.area, CAST(s AS BIGINT) AS s, CAST([" + ", ".join(map(str, SPACINGS)) + "][s + 1] AS DOUBLE) AS d FROM (SELECT DISTINCT area FROM q) a, range(53) r(s)"


def _search(goal: str, least: int = 0) -> str:
    """CTEs: found (area, goal, at), where the search by halves of each area ends; after ``_pass`` over all spacings."""
    start = sum(s < least for s in SPACINGS)
    return f"""
boxes AS (SELECT area, {goal} AS goal, greatest((max(lat) - min(lat)) * (6371137.0 * pi() / 180), 1.0) * greatest((max(lng) - min(lng)) * (6371137.0 * pi() / 180) * cos((min(lat) + max(lat)) * 0.5 * pi() / 180), 1.0) AS box FROM q GROUP BY area),
guess AS (SELECT x.area, x.goal, arg_min(s.s, (abs(s.d - sqrt(x.box / x.goal)), s.s)) AS probe FROM boxes x JOIN s ON s.area = x.area WHERE s.s >= {start} AND x.goal > 0 GROUP BY ALL),
search(area, goal, low, high, probe, best) AS (
  SELECT area, goal, CAST({start} AS BIGINT), CAST(52 AS BIGINT), probe, CAST(-1 AS BIGINT) FROM guess
  UNION ALL
  SELECT area, goal, low, high, (low + high) // 2, best FROM (
    SELECT x.area, x.goal, CASE WHEN len(t.taken) >= x.goal THEN x.probe + 1 ELSE x.low END AS low, CASE WHEN len(t.taken) >= x.goal THEN x.high ELSE x.probe - 1 END AS high, CASE WHEN len(t.taken) >= x.goal THEN x.probe ELSE x.best END AS best
    FROM search x JOIN taken t ON t.area = x.area AND t.s = x.probe WHERE x.low <= x.high)),
found AS (SELECT area, goal, CASE WHEN best >= 0 THEN best ELSE {start} END AS at FROM search WHERE low > high)"""


_IDS = "SELECT n.area, n.id, list_position(t.taken, n.k) AS place, CAST(s.d AS INTEGER) AS metres FROM found f JOIN taken t ON t.area = f.area AND t.s = f.at JOIN s ON s.area = f.area AND s.s = f.at JOIN n ON n.area = f.area AND list_contains(t.taken, n.k) WHERE list_position(t.taken, n.k) <= f.goal"


@_query("i15_max_spacing", f"{_P}, q AS MATERIALIZED (SELECT * FROM p), {_pass(_ALL)}, {_search('any_value(area) % 9 * 2 + 3')} SELECT area, id, CAST(place AS BIGINT) AS place, metres FROM ({_IDS})")
def _i15(spark, d):
    """Each nation's goal at the largest spacing at which it fits."""
    p = points(spark, d)
    goals = p.groupBy("area").agg((F.first("area") % 9 * 2 + 3).cast("long").alias("goal"))
    return distribution.spread(p, "area", goals, F.col("o")).select("area", "id", "place", "metres")


@_query("i15_least", f"{_P}, q AS MATERIALIZED (SELECT * FROM p), {_pass(_ALL)}, {_search('CAST(12 AS BIGINT)', 9000)} SELECT area, id, CAST(place AS BIGINT) AS place, metres FROM ({_IDS})")
def _i15_least(spark, d):
    """No spacing under nine kilometres: where twelve don't fit at it, what does."""
    p = points(spark, d)
    goals = p.select("area").distinct().withColumn("goal", F.lit(12))
    return distribution.spread(p, "area", goals, F.col("o"), least=9000).select("area", "id", "place", "metres")


_SHARE = "CAST(round_even(CAST(t.total * w.weight AS DOUBLE) / w.whole, 0) AS BIGINT)"
_ONE = "SELECT a.area, CAST(0 AS BIGINT) AS s, CAST(7000 AS DOUBLE) AS d FROM (SELECT DISTINCT area FROM q) a"


@_query("i17_largest_goal", f"""{_P}, q AS MATERIALIZED (SELECT * FROM p), {_pass(_ONE)},
w AS (SELECT area, area % 4 + 1 AS weight, sum(area % 4 + 1) OVER () AS whole FROM (SELECT DISTINCT area FROM q)),
fits AS MATERIALIZED (SELECT w.area, w.weight, w.whole, len(t.taken) AS n FROM w JOIN taken t ON t.area = w.area),
tries(i, total, good, bad) AS (
  SELECT 1, CAST(110000 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT i + 1, CASE WHEN good IS NULL THEN bad // 2 ELSE good + (bad - good) // 2 END, good, bad FROM (
    SELECT t.i, CASE WHEN bool_and(w.n >= {_SHARE}) THEN greatest(coalesce(t.good, t.total), t.total) ELSE t.good END AS good, CASE WHEN bool_and(w.n >= {_SHARE}) THEN t.bad ELSE least(coalesce(t.bad, t.total), t.total) END AS bad
    FROM tries t, fits w WHERE t.i <= 10 GROUP BY t.i, t.total, t.good, t.bad) WHERE bad IS NOT NULL),
last AS (SELECT coalesce(good, bad) AS total FROM tries ORDER BY i DESC LIMIT 1)
SELECT w.area, t.total, {_SHARE} AS goal FROM fits w, last t""")
def _i17(spark, d):
    """The largest total whose shares fit all nations seven kilometres apart."""
    p = points(spark, d)
    weights = p.select("area").distinct().withColumn("weight", F.col("area") % 4 + 1)
    total, goals = distribution.largest_goal(p, "area", weights, 7000.0, F.col("o"))
    return goals.select("area", F.lit(total).cast("long").alias("total"), "goal")


def _hash(precision: int) -> str:
    nx, ny = (5 * precision + 1) // 2, 5 * precision // 2
    return f"CAST(floor((lng + 180.0) / 360.0 * {1 << nx}) AS BIGINT) AS x, CAST(floor((lat + 90.0) / 180.0 * {1 << ny}) AS BIGINT) AS y"


@_query("i18_even", f"""{_P}, c AS (SELECT *, {_hash(4)} FROM p), g AS (SELECT *, min((o, id)) OVER (PARTITION BY x, y) AS first FROM c),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY first, o, id) AS k FROM g),
b AS MATERIALIZED (SELECT n.k, list(m.k) AS blocks FROM n JOIN n m ON m.k < n.k AND abs(m.x - n.x) <= 1 AND abs(m.y - n.y) <= 1 AND {_close('m', 'n', '4000.0')} GROUP BY n.k),
steps(k, taken) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT t.k + 1, CASE WHEN b.blocks IS NULL OR NOT list_has_any(t.taken, b.blocks) THEN list_append(t.taken, t.k + 1) ELSE t.taken END FROM steps t LEFT JOIN b ON b.k = t.k + 1 WHERE t.k < (SELECT count(*) FROM n))
SELECT n.id FROM n, (SELECT taken FROM steps ORDER BY k DESC LIMIT 1) t WHERE list_contains(t.taken, n.k)""")
def _i18(spark, d):
    """Four kilometres apart, cell after cell."""
    return distribution.even(points(spark, d), 4000.0, F.col("o"))


@_query("i18_densified", f"""{_P}, q AS MATERIALIZED (SELECT id, o, lat, lng, x || '/' || y AS area FROM (SELECT *, {_hash(6)} FROM p)), {_pass("SELECT a.area, CAST(0 AS BIGINT) AS s, CAST(400 AS DOUBLE) AS d FROM (SELECT DISTINCT area FROM q) a")}
SELECT n.id FROM taken t JOIN n ON n.area = t.area AND list_contains(t.taken, n.k) WHERE list_position(t.taken, n.k) <= 2""")
def _i18_dense(spark, d):
    """At most two rows a cell of a kilometre, half of 800 metres apart."""
    return distribution.densified(points(spark, d), 800, 60_000, F.col("o"))


@_query("i18_density_goals", f"{_L}, c AS (SELECT CAST(floor((lng + 180.0) / 360.0 * 256) AS BIGINT) AS x, CAST(floor((lat + 90.0) / 180.0 * 128) AS BIGINT) AS y, count(*) AS n FROM locations GROUP BY 1, 2), w AS (SELECT *, 1.0 / pow(CAST(n AS DOUBLE), 0.3) * n AS w FROM c) SELECT n, CAST(round_even(500.0 * (w / sum(w) OVER ()), 0) AS BIGINT) AS goal FROM w")
def _i18_goals(df):
    """Shares of a goal that favour sparse cells."""
    return distribution.density_goals(df, 500, 0.3).select("n", "goal")
