"""More registered queries: intake, layers and history, neighbourhoods, procedures, search, the second expression language."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import filters, geo
from ..operators.shared import running
from ..operators import analytics, asks, changes, history, intake, neighbours, procedures, sampling, search, spatial, work
from .catalog import _L, _OLD_NEW, _QUERIES, _SQL, _filter, _halves, _hav, _query
from ..sources import locations as _src
from .selectors import Everything, Filter, Or, Sample, select

_TAGGED = "t AS (SELECT l.*, coalesce(c.tags, []) AS tags FROM locations l LEFT JOIN (SELECT id, list(tag ORDER BY tag) tags FROM location_tags GROUP BY id) c USING (id))"


def _joined(c: str = "tags"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias("tags")


# --- layers, edits, history

_OVER = "o AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'add' WHEN id % 7 = 0 THEN 'remove' ELSE 'patch' END AS op, CASE WHEN id % 2 = 0 THEN heading + 1 END AS heading, zoom FROM locations WHERE id % 3 = 0 AND id % 5 = 0 OR id % 3 <> 0 AND (id % 7 = 0 OR id % 11 = 0))"


def _layer(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    cols = df.select("id", "heading", "zoom")
    op = F.when(F.col("id") % 3 == 0, "add").when(F.col("id") % 7 == 0, "remove").otherwise("patch")
    over = cols.filter("id % 3 = 0 AND id % 5 = 0 OR id % 3 <> 0 AND (id % 7 = 0 OR id % 11 = 0)").select("id", op.alias("op"), F.when(F.col("id") % 2 == 0, F.col("heading") + 1).alias("heading"), "zoom")
    return cols.filter("id % 3 <> 0"), over


_OVERLAID = f"{_L}, {_OVER} SELECT l.id AS id, coalesce(o.heading, l.heading) AS heading, l.zoom AS zoom FROM locations l LEFT JOIN o ON o.id = l.id WHERE l.id % 3 <> 0 AND o.op IS DISTINCT FROM 'remove' UNION ALL SELECT id, heading, zoom FROM o WHERE op = 'add'"


@_query("a01_overlay", _OVERLAID)
def _a01(df):
    return history.overlay(*_layer(df))


@_query("k10_bake", _OVERLAID)
def _k10(df):
    return history.baked(*_layer(df))


@_query("b04_uncommitted", f"{_L}, {_OVER} SELECT id, event_type FROM locations WHERE id IN (SELECT id FROM o WHERE op <> 'remove')")
def _b04(df):
    over = _layer(df)[1].filter("op <> 'remove'")
    return df.join(over.select("id"), "id", "left_semi").select("id", "event_type")


_filter("b03_selected", Or((Filter("event_type", "eq", "click"), Filter("zoom", "gte", 3.0), Filter("tags", "contains", 5))), "event_type = 'click' OR zoom >= 3 OR id IN (SELECT id FROM location_tags WHERE tag = 5)")


@_query(
    "j09_edits",
    """WITH t AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 2 = 0)
SELECT id, CASE WHEN id % 5 = 1 THEN 'S' WHEN id % 5 = 2 THEN 'P' ELSE status END AS status, CASE WHEN id % 5 = 1 THEN 'set' WHEN id % 5 = 2 AND id % 3 = 0 THEN 'late' ELSE priority END AS priority
FROM t WHERE id % 5 <> 3
UNION ALL SELECT o_orderkey, 'S', 'set' FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 = 1
UNION ALL SELECT o_orderkey, 'P', CASE WHEN o_orderkey % 3 = 0 THEN 'late' ELSE 'new' END FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 = 4""",
)
def _j09(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    table, odd = o.filter("id % 2 = 0"), o.filter("id % 2 = 1")
    text = lambda v: F.lit(v).cast("string")
    row = lambda df, seq, op, status, priority: df.select("id", F.lit(seq).alias("seq"), F.lit(op).alias("op"), text(status).alias("status"), text(priority).alias("priority"))
    some = lambda m: F.col("id") % 5 == m
    edits = row(o.filter(some(1)), 2, "set", "S", "set").unionByName(row(o.filter(some(1)), 1, "remove", None, None))
    edits = edits.unionByName(row(table.filter(some(2)), 1, "put", "P", None)).unionByName(row(table.filter(some(2) & (F.col("id") % 3 == 0)), 2, "put", None, "late"))
    edits = edits.unionByName(row(table.filter(some(3)), 1, "put", "X", None)).unionByName(row(table.filter(some(3)), 2, "remove", None, None))
    edits = edits.unionByName(row(odd.filter(some(4)), 1, "add", "N", "new")).unionByName(row(odd.filter(some(4)), 2, "put", "P", None)).unionByName(row(odd.filter(some(4) & (F.col("id") % 3 == 0)), 3, "put", None, "late"))
    edits = edits.unionByName(row(odd.filter(some(2)), 1, "put", "never", None))
    return history.edited(table, edits)


@_query("k08_commit", f"{_OLD_NEW} SELECT CAST(0 AS INTEGER) AS op, a.id AS id, a.status AS status FROM a LEFT JOIN b ON a.id = b.id WHERE b.id IS NULL OR a.status IS DISTINCT FROM b.status UNION ALL SELECT 1, b.id, b.status FROM b LEFT JOIN a ON a.id = b.id WHERE a.id IS NULL OR a.status IS DISTINCT FROM b.status")
def _k08(spark, d):
    old, new = (t.select("id", "status") for t in _halves(spark, d))
    return history.commit(old, new)


@_query("k11_counts", f"{_OLD_NEW}, x AS (SELECT status AS key, -1 AS s FROM a UNION ALL SELECT status, 1 FROM b) SELECT key, CAST(sum(s) AS BIGINT) AS n FROM x GROUP BY key HAVING sum(s) <> 0")
def _k11(spark, d):
    return history.counts_of_change(changes.between(*(t.select("id", "status") for t in _halves(spark, d))), F.array("row.status"))


@_query("f20_pending", f"{_OLD_NEW} SELECT CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'updated' END AS kind, count(*) AS n FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.status IS DISTINCT FROM b.status GROUP BY 1")
def _f20(spark, d):
    return changes.between(*_halves(spark, d)).groupBy(changes.kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@_query("g17_diff_counts", f"{_OLD_NEW}, c AS (SELECT CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'updated' END AS kind FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.status IS DISTINCT FROM b.status) SELECT kind, CAST(NULL AS VARCHAR) AS field, count(*) AS n FROM c GROUP BY kind UNION ALL SELECT kind, 'status', count(*) FROM c WHERE kind = 'updated' GROUP BY kind")
def _g17(spark, d):
    return history.diff_counts(changes.between(*_halves(spark, d)), ["status", "o_totalprice"])


@_query("k04_partial_undo", f"{_OLD_NEW} SELECT b.id AS id, a.status AS before, b.status AS after FROM a JOIN b ON a.id = b.id WHERE a.status <> b.status AND b.id % 2 = 0")
def _k04(spark, d):
    """A change, then half of it undone: what is left of it."""
    old, new = (t.select("id", "status") for t in _halves(spark, d))
    there = changes.between(old, new)
    back = changes.inverse(there.filter("before IS NULL OR after IS NULL OR id % 2 = 1"))
    left = changes.compose(there.withColumn("seq", F.lit(1)).unionByName(back.withColumn("seq", F.lit(2))))
    return left.select("id", F.col("before.status").alias("before"), F.col("after.status").alias("after"))


_REALIGN = """
WITH o AS (SELECT o_orderkey AS k, o_custkey % 40 AS c, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS n FROM orders),
m AS (SELECT k AS local_id, n AS seq, n AS remote_id, concat('h', CAST(c AS VARCHAR)) AS hash, CASE WHEN k % 3 = 0 THEN concat('p', CAST(k // 2 AS VARCHAR)) END AS pano FROM o),
r AS (SELECT CASE WHEN k % 10 < 5 THEN n ELSE (n + 7) % (SELECT count(*) FROM o) END AS i, CASE WHEN k % 4 = 0 THEN concat('x', CAST(k AS VARCHAR)) ELSE concat('h', CAST(c AS VARCHAR)) END AS hash, CASE WHEN k % 3 = 0 THEN concat('p', CAST(k // 2 AS VARCHAR)) END AS pano FROM o
  QUALIFY row_number() OVER (PARTITION BY CASE WHEN k % 10 < 5 THEN n ELSE (n + 7) % (SELECT count(*) FROM o) END ORDER BY k) = 1),
c1 AS (SELECT r.i, min_by(m.local_id, m.seq) AS local_id, 1 AS step FROM m JOIN r ON m.remote_id = r.i AND m.hash = r.hash GROUP BY r.i),
m1 AS (SELECT * FROM m WHERE local_id NOT IN (SELECT local_id FROM c1)), r1 AS (SELECT * FROM r WHERE i NOT IN (SELECT i FROM c1)),
c2 AS (SELECT b.i, a.local_id, 2 AS step FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY seq) AS nth FROM m1) a JOIN (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY i) AS nth FROM r1) b USING (hash, nth)),
m2 AS (SELECT * FROM m1 WHERE local_id NOT IN (SELECT local_id FROM c2)), r2 AS (SELECT * FROM r1 WHERE i NOT IN (SELECT i FROM c2)),
c3 AS (SELECT b.i, a.local_id, 3 AS step FROM (SELECT pano, min(local_id) AS local_id FROM m2 WHERE pano IS NOT NULL GROUP BY pano HAVING count(*) = 1) a JOIN (SELECT pano, min(i) AS i FROM r2 WHERE pano IS NOT NULL GROUP BY pano HAVING count(*) = 1) b USING (pano)),
m3 AS (SELECT * FROM m2 WHERE local_id NOT IN (SELECT local_id FROM c3)), r3 AS (SELECT * FROM r2 WHERE i NOT IN (SELECT i FROM c3)),
c4 AS (SELECT r3.i, min_by(m3.local_id, m3.seq) AS local_id, 4 AS step FROM m3 JOIN r3 ON m3.remote_id = r3.i WHERE (SELECT count(*) FROM m) = (SELECT count(*) FROM r) GROUP BY r3.i)
SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4
"""


@_query("c13_realign", _REALIGN)
def _c13(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 40).alias("c"))
    o = running(orders, [], ["k"], F.lit(1), "n").withColumn("n", F.col("n") - 1)
    o = o.join(F.broadcast(o.agg(F.count(F.lit(1)).alias("all"))), F.lit(True))  # one row
    content = F.concat(F.lit("h"), F.col("c").cast("string"))
    pano = F.when(F.col("k") % 3 == 0, F.concat(F.lit("p"), F.floor(F.col("k") / 2).cast("string")))
    mapping = o.select(F.col("k").alias("local_id"), F.col("n").alias("seq"), F.col("n").alias("remote_id"), content.alias("hash"), pano.alias("pano"))
    i = F.when(F.col("k") % 10 < 5, F.col("n")).otherwise((F.col("n") + 7) % F.col("all"))
    remote = o.select(i.alias("i"), F.struct("k", F.when(F.col("k") % 4 == 0, F.concat(F.lit("x"), F.col("k").cast("string"))).otherwise(content).alias("hash"), pano.alias("pano")).alias("r"))
    remote = remote.groupBy("i").agg(F.min_by("r", "r.k").alias("r")).select("i", "r.hash", "r.pano")
    return history.realigned(mapping, remote)


# --- edits of the open column


_MERGED = """replace(CAST(json_merge_patch(CAST(extra AS JSON), CAST('{"m": 5}' AS JSON)) AS VARCHAR), ' ', '')"""


@_query("j01_extra", f"{_L} SELECT id, CASE WHEN heading > 180 THEN {_MERGED} ELSE replace(extra, ' ', '') END AS extra, heading > 180 AS changed FROM locations")
def _j01x(df):
    out = work.set_open(df, F.col("heading") > 180, "m", "5", 1_800_000_000)
    return out.select("id", F.regexp_replace("extra", r"\s", "").alias("extra"), "changed")


@_query("j03_extra", f"{_L} SELECT id, CASE WHEN heading > 180 THEN '{{}}' ELSE replace(extra, ' ', '') END AS extra, heading > 180 AND json_extract_string(extra, '$.k') IS NOT NULL AS changed FROM locations")
def _j03x(df):
    out = work.delete_open(df, F.col("heading") > 180, ["k", "m"], 1_800_000_000)
    return out.select("id", F.regexp_replace("extra", r"\s", "").alias("extra"), "changed")


# --- intake

@_query("a10_preview", f"{_L}, {_TAGGED} SELECT 'rows' AS field, count(*) AS n FROM t UNION ALL SELECT 'pano_id', count(pano_id) FROM t UNION ALL SELECT 'heading', count(*) FROM t WHERE heading <> 0 UNION ALL SELECT 'tags', count(*) FROM t WHERE len(tags) > 0 UNION ALL SELECT 'extra.k', count(*) FROM t WHERE json_extract_string(extra, '$.k') IS NOT NULL")
def _a10(df):
    return intake.preview(df, {"pano_id": F.col("pano_id").isNotNull(), "heading": F.col("heading") != 0, "tags": F.size("tags") > 0, "never": F.lit(False)})


@_query("a11_land", f"{_L}, {_TAGGED} SELECT id, CAST(NULL AS VARCHAR) AS pano_id, heading, array_to_string(list_concat(list_filter(tags, lambda x: x NOT IN (2, 4)), CASE WHEN list_contains(tags, 7) THEN [9] ELSE [7, 9] END), ',') AS tags FROM t")
def _a11(df):
    return intake.land(df, ["pano_id"], [2, 4], [7, 9]).select("id", "pano_id", "heading", _joined())


@_query("a17_shape", f"{_L} SELECT id, CASE WHEN flags % 2 = 1 THEN pano_id END AS pano_id, flags % 2 AS flags, heading FROM locations")
def _a17(df):
    out = intake.shaped(df, "geoguessr")
    assert "tags" not in out.columns and "extra" not in out.columns
    return out.select("id", "pano_id", "flags", "heading")


@_query("a18_copy", f"{_L}, g AS (SELECT id, lat, lng, pano_id FROM locations WHERE event_type = 'click'), s AS (SELECT id, lat, lng, pano_id FROM locations WHERE event_type = 'view') SELECT * FROM s UNION ALL SELECT * FROM g WHERE NOT CASE WHEN pano_id IS NOT NULL THEN pano_id IN (SELECT pano_id FROM s WHERE pano_id IS NOT NULL) ELSE EXISTS (SELECT 1 FROM s WHERE s.lat = g.lat AND s.lng = g.lng) END")
def _a18(df):
    rows = df.select("id", "lat", "lng", "pano_id", "event_type")
    return intake.copy_missing(rows.filter("event_type = 'click'").drop("event_type"), rows.filter("event_type = 'view'").drop("event_type"))


@_query("c10_by_name", f"{_L}, r AS (SELECT n_nationkey AS id, lower(trim(n_name)) AS name FROM nation) SELECT l.id AS id, r.id AS record_id FROM locations l LEFT JOIN r ON r.name = concat('nation_', CAST(l.id % 40 AS VARCHAR))")
def _c10(spark, d):
    rows = _src.locations(spark, d).select("id", F.concat(F.lit("  Nation_"), (F.col("id") % 40).cast("string"), F.lit(" ")).alias("name"))
    records = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return intake.by_name(rows, "name", records).select("id", "record_id")


# --- asks and statistics

@_query("d05_paint", f"{_L} SELECT id, CASE WHEN event_type = 'click' THEN 'clicks' WHEN heading > 180 THEN 'back' WHEN zoom > 1 THEN 'near' END AS paint FROM locations")
def _d05(df):
    return df.select("id", asks.painted([("near", F.col("zoom") > 1), ("back", F.col("heading") > 180), ("clicks", F.col("event_type") == "click")]).alias("paint"))


@_query("f07_covered", f"{_L} SELECT 'tag' AS field, count(DISTINCT id) AS covered FROM location_tags UNION ALL SELECT 'zone', count(timezone) FROM locations UNION ALL SELECT 'pano', count(pano_id) FROM locations")
def _f07(df):
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    return asks.covered(df, {"tag": F.col("tags"), "zone": one("timezone"), "pano": one("pano_id")})


_BINS = "e AS (SELECT min(pitch) a, max(pitch) b FROM locations), k AS (SELECT CAST(least(greatest(floor((pitch - a) / ((b - a) / {n})), 0), {n} - 1) AS INTEGER) AS bin FROM locations, e), f AS (SELECT CAST(range AS INTEGER) AS bin FROM range({n})), g AS (SELECT f.bin AS bin, a + f.bin * ((b - a) / {n}) AS lo, a + (f.bin + 1) * ((b - a) / {n}) AS hi, (SELECT count(*) FROM k WHERE k.bin = f.bin) AS n FROM f, e)"


@_query("f10_many_bins", f"{_L}, {_BINS.format(n=150)} SELECT bin, n FROM g WHERE n > 0")
def _f10(df):
    return asks.without_empty(asks.bins_by_count(df, "pitch", 150), 150).select("bin", "n")


_PRINT = "CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST(round({c}, 2) AS VARCHAR) END"


@_query("f11_labels", f"{_L}, {_BINS.format(n=7)} SELECT concat({_PRINT.format(c='lo')}, '–', {_PRINT.format(c='hi')}) AS label, n FROM g")
def _f11(df):
    return asks.bins_by_count(df, "pitch", 7).select(asks.bin_label(F.col("lo"), F.col("hi")).alias("label"), "n")


@_query("f12_local_hour", f"{_L} SELECT strftime((make_timestamptz(created_at * 1000000) AT TIME ZONE timezone), '%H') AS key, count(*) AS n FROM locations WHERE timezone IS NOT NULL GROUP BY 1")
def _f12(df):
    return asks.date_parts(df, "created_at", "hourOfDay", "timezone")


@_query("f19_held_values", f"{_L} SELECT tag AS key, count(*) AS n FROM location_tags WHERE id % 2 = 0 GROUP BY tag")
def _f19(df):
    return asks.count_by(df.filter("id % 2 = 0"), F.col("tags"))


@_query("f23_report", f"{_L} SELECT CASE WHEN lat >= 0 AND lat < 60 AND lng >= 0 AND lng < 90 THEN 'north east' ELSE 'elsewhere' END AS area, event_type AS value, count(*) AS n FROM locations GROUP BY 1, 2 ORDER BY 1, 2")
def _f23(df):
    rows = spatial.classify(df, [("north east", [[(0.0, 0.0), (90.0, 0.0), (90.0, 60.0), (0.0, 60.0)]])], "elsewhere")
    return rows.groupBy("area", F.col("event_type").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy("area", "value")


@_query("g03_shares", f"{_L}, c AS (SELECT event_type AS row, timezone AS col, count(*) AS n FROM locations WHERE timezone IS NOT NULL GROUP BY 1, 2) SELECT row, col, n, round(n / sum(n) OVER (PARTITION BY row), 9) AS row_share, round(n / sum(n) OVER (PARTITION BY col), 9) AS col_share FROM c")
def _g03(df):
    cells = analytics.shares(analytics.pivot(df, F.col("event_type"), F.col("timezone")))
    return cells.select("row", "col", "n", F.round("row_share", 9).alias("row_share"), F.round("col_share", 9).alias("col_share"))


@_query("g04_exclusive", f"{_L} SELECT 'a' AS name, count(*) AS n FROM locations WHERE heading > 180 AND NOT (zoom > 1) AND NOT (event_type = 'click') UNION ALL SELECT 'b', count(*) FROM locations WHERE zoom > 1 AND NOT (heading > 180) AND NOT (event_type = 'click') UNION ALL SELECT 'c', count(*) FROM locations WHERE event_type = 'click' AND NOT (heading > 180) AND NOT (zoom > 1)")
def _g04(df):
    return asks.counts(df, analytics.exclusive({"a": F.col("heading") > 180, "b": F.col("zoom") > 1, "c": F.col("event_type") == "click"}))


@_query("g06_eta2", f"{_L}, g AS (SELECT event_type, sum(cos(radians(heading))) c, sum(sin(radians(heading))) s, count(*) n FROM locations GROUP BY 1), a AS (SELECT sum(sqrt(c * c + s * s)) own, sqrt(sum(c) * sum(c) + sum(s) * sum(s)) al, sum(n) n FROM g) SELECT round(least(greatest((own - al) / (n - al), 0), 1), 8) AS eta2 FROM a")
def _g06(df):
    return analytics.circular_eta2(df, "event_type", "heading").select(F.round("eta2", 8).alias("eta2"))


@_query("g07_coverage_v", f"{_L}, y AS (SELECT event_type g, modified_at IS NOT NULL v FROM locations), o AS (SELECT g, v, count(*) o FROM y GROUP BY 1, 2), g AS (SELECT g, sum(o) gt FROM o GROUP BY g), v AS (SELECT v, sum(o) vt FROM o GROUP BY v), t AS (SELECT CAST(sum(o) AS DOUBLE) n, count(DISTINCT g) r, count(DISTINCT v) k FROM o), q AS (SELECT sum(CAST(o AS DOUBLE) * o / gt / vt) - 1 AS p FROM o JOIN g USING (g) JOIN v USING (v)), z AS (SELECT greatest(0, p - (k - 1) * (r - 1) / (n - 1)) AS phi, least(k - (k - 1) * (k - 1) / (n - 1) - 1, r - (r - 1) * (r - 1) / (n - 1) - 1) AS d FROM q, t) SELECT round(least(sqrt(phi / d), 1), 7) AS v FROM z")
def _g07(df):
    return analytics.coverage_v(df, "event_type", "modified_at").select(F.round("v", 7).alias("v"))


@_query("g09_ranking", "SELECT n_name AS field, n_nationkey < 8 AS low_confidence, round(CASE WHEN n_nationkey % 4 <> 0 AND n_nationkey >= 8 THEN 1 + n_nationkey / 25.0 ELSE (n_nationkey * 7 % 25) / 25.0 END, 9) AS sort_key FROM nation ORDER BY sort_key DESC, field")
def _g09(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    key = F.col("n_nationkey")
    scores = n.select(F.col("n_name").alias("field"), F.when(key % 4 != 0, key / 25.0).alias("value_score"), ((key * 7) % 25 / 25.0).alias("coverage_score"), key.alias("least_present"))
    return analytics.ranked_fields(scores).select("field", "low_confidence", F.round("sort_key", 9).alias("sort_key"))


@_query("g12_unknown", f"{_L} SELECT coalesce(timezone, 'unknown') AS key, count(*) AS n FROM locations GROUP BY 1")
def _g12(df):
    return asks.with_unknown(df, F.col("timezone"))


@_query("e04_sample", f"{_L} SELECT least(count(*), 200) AS n, least(count(*), 200) AS different FROM locations")
def _e04(df):
    return select(df, Sample(Everything(), 200, 7)).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("different"))


@_query("i14_quotas", f"{_L}, c AS (SELECT event_type, count(*) AS n FROM locations GROUP BY 1), t AS (SELECT sum(n) AS s FROM c) SELECT event_type, CAST(round_even(CAST(1000 * n AS DOUBLE) / CAST(s AS DOUBLE), 0) AS BIGINT) AS quota FROM c, t")
def _i14(df):
    return sampling.quotas(df, "event_type", 1000)


# --- neighbourhoods and the second expression language

_NEAR = f"{_L}, p AS (SELECT * FROM locations WHERE id % 3 = 0), w AS (SELECT p.id AS id, n.event_type = 'click' AS good, p.lng < n.lng AS west, p.lng > n.lng AS east, p.lat > n.lat AS north, p.lat < n.lat AS south FROM p JOIN locations n ON n.lat BETWEEN p.lat - 0.0008 AND p.lat + 0.0008 AND n.id <> p.id AND abs(n.lat - p.lat) <= 80.0 / 110000.0 AND pow(6371137.0 * pi() / 180, 2) * (pow((n.lng - p.lng) * cos((p.lat + n.lat) * (pi() / 360)), 2) + pow(n.lat - p.lat, 2)) < 6400.0), c AS (SELECT p.id AS id, count(w.id) AS al, count(*) FILTER (good) AS n, count(*) FILTER (good AND west) AS s1, count(*) FILTER (good AND east) AS s2, count(*) FILTER (good AND north) AS s3, count(*) FILTER (good AND south) AS s4 FROM p LEFT JOIN w ON w.id = p.id GROUP BY p.id)"
for _name, _bound, _limit, _apart, _where in (
    ("some", "some", None, False, "n > 0"),
    ("none", "none", None, False, "n = 0"),
    ("gte", "gte", 2, False, "n >= 2"),
    ("lte", "lte", 1, False, "n <= 1"),
    ("all", "all", None, False, "al > 0 AND n = al"),
    ("percentage_gte", "percentage-gte", 30, False, "al > 0 AND n * 100 >= 30 * al"),
    ("percentage_lte", "percentage-lte", 30, False, "n * 100 <= 30 * al OR al = 0"),
    ("gte_separately", "gte", 1, True, "s1 >= 1 OR s2 >= 1 OR s3 >= 1 OR s4 >= 1"),
    ("lte_separately", "lte", 1, True, "s1 <= 1 OR s2 <= 1 OR s3 <= 1 OR s4 <= 1"),
    ("no_limit", "gte", None, False, "false"),
):

    def _bounded(df, b=_bound, n=_limit, apart=_apart):
        rows = df.select("id", "lat", "lng", "event_type")
        click = filters.compile_filter("Kind eq 'click'", {"Kind": ("text", F.col("i_event_type"))})
        return neighbours.neighbour_filter(rows, 80.0, b, n, click, apart, rows.filter("id % 3 = 0")).select("id")

    _QUERIES[f"i06_{_name}"] = lambda spark, d, f=_bounded: f(_src.locations(spark, d))
    _SQL[f"i06_{_name}"] = f"{_NEAR} SELECT id FROM c WHERE {_where}"


def _properties(df: DataFrame) -> dict:
    return {"Heading": ("long", F.rint("heading").cast("long")), "Kind": ("text", F.col("event_type")), "Zone": ("text", F.col("timezone")), "Zoom": ("long", F.col("zoom").cast("long")), "Value": ("double", F.col("value")), "Id": ("long", F.col("id")), "Changed": ("long", F.col("modified_at"))}


for _name, _text, _where in (
    ("and_or", "Heading gt 180 and (Kind eq 'click' or Zoom in [1, 2])", "heading > 180 AND (event_type = 'click' OR zoom IN (1, 2))"),
    ("nulls", "Zone eq null or Changed lt 1704100000", "timezone IS NULL OR coalesce(modified_at < 1704100000, false)"),
    ("neq_null", "Zone neq 'UTC'", "timezone IS DISTINCT FROM 'UTC'"),
    ("arithmetic", "Heading / 7 modulo 3 eq 1 and Id * 2 - 1 gt 99", "CAST(heading AS BIGINT) // 7 % 3 = 1 AND id * 2 - 1 > 99"),
    ("wraps", "Id * 9223372036854775807 eq -1 or Id * 9223372036854775807 lt -5", "id % 2 = 0 AND id > 5"),
    ("text", "Kind + '/' + Zone eq 'view/UTC'", "concat(event_type, '/', coalesce(timezone, '')) = 'view/UTC'"),
    ("named", filters.expanded("$$back and Zoom gte 2", {"back": "$$turned gt 90", "turned": "Heading - 90"}), "heading - 90 > 90 AND zoom >= 2"),
):
    _QUERIES[f"i04_{_name}"] = lambda spark, d, t=_text: (lambda df: df.filter(filters.compile_filter(t, _properties(df))).select("id"))(_src.locations(spark, d))
    _SQL[f"i04_{_name}"] = f"{_L} SELECT id FROM locations WHERE {_where}"


@_query("i05_flags", f"{_L} SELECT id, flags % 4 >= 2 OR flags % 2 = 1 AS known FROM locations")
def _i05(df):
    return df.select("id", filters.flags_any(F.col("flags"), "Pinned, OTHER", {"pinned": 1, "other": 2}).alias("known"))


@_query("i10_pipeline", f"{_L}, s AS (SELECT *, id % 500 AS node FROM locations WHERE heading > 90 AND {_hav('lat', 'lng', '0.0', '0.0')} <= 9000000.0), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY id) AS nth FROM s) SELECT node, id, heading FROM r WHERE nth = 1 ORDER BY node")
def _i10(df):
    """Expression, then proximity, then one row a node, in the order of nodes."""
    kept = df.filter(filters.compile_filter("Heading gt 90", _properties(df))).filter(geo.haversine_m(F.col("lat"), F.col("lng"), 0.0, 0.0) <= 9_000_000.0)
    return search.first_by(kept.select((F.col("id") % 500).alias("node"), "id", "heading"), "node", "id").orderBy("node")


@_query("j07_prune", f"{_L}, p AS (SELECT * FROM locations WHERE event_type = 'click') SELECT CAST(0 AS BIGINT) AS left_over, (SELECT count(*) FROM p) AS rows")
def _j07(df):
    """No two rows within reach are left, and no row outside the groups of neighbours is touched."""
    rows = df.filter("event_type = 'click'")
    gone = neighbours.pruned(rows, 25.0, work.duplicate_score())
    kept = rows.join(gone, "id", "left_anti")
    left = spatial.duplicate_ids(kept, 25.0).agg(F.count(F.lit(1)).alias("left_over"))
    return left.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("rows"))), F.lit(True))  # one row each


# --- procedures

_HALF = procedures.Provider("half", {"half": "double"}, ("value",), lambda rows: pd.DataFrame({"half": rows["value"] / 2}))
_LABEL = procedures.Provider("label", {"label": "string"}, ("half", "pano_id"), lambda rows: pd.DataFrame({"label": rows["pano_id"] + ":" + (rows["half"] >= 20).map({True: "high", False: "low"})}))
_ONCE = procedures.Provider("once", {"first": "bigint"}, ("created_at",), lambda rows: pd.DataFrame({"first": rows["created_at"]}), once_by="pano_id")
_REGISTRY = procedures.Registry({p.name: p for p in (_LABEL, _HALF, _ONCE)})


@_query("n05_procedures", f"{_L}, h AS (SELECT id, pano_id, CASE WHEN id % 5 = 0 THEN 1.0 ELSE value / 2 END AS half, CASE WHEN id % 5 = 0 THEN 'skipped' WHEN value IS NULL THEN 'failed' ELSE 'done' END AS half_status FROM locations) SELECT id, half, half_status, CASE WHEN pano_id IS NOT NULL AND half IS NOT NULL THEN concat(pano_id, CASE WHEN half >= 20 THEN ':high' ELSE ':low' END) END AS label, CASE WHEN pano_id IS NULL OR half IS NULL THEN 'failed' ELSE 'done' END AS label_status FROM h")
def _n05(df):
    rows = df.select("id", "value", "pano_id", F.when(F.col("id") % 5 == 0, 1.0).alias("half"))
    return procedures.run(rows, _REGISTRY, ["label", "half"]).select("id", "half", "half_status", "label", "label_status")


@_query("n03_once_by", f"{_L} SELECT id, CASE WHEN pano_id IS NULL THEN created_at ELSE first(created_at) OVER (PARTITION BY pano_id ORDER BY id) END AS first FROM locations")
def _n03(df):
    return procedures.applied(df.select("id", "pano_id", "created_at"), _ONCE).select("id", "first")


@_query("n07_stale_guard", f"{_L} SELECT id, CASE WHEN id % 3 = 0 THEN 1.0 ELSE zoom END AS zoom, id % 3 = 0 AS landed FROM locations")
def _n07(df):
    table = df.select("id", "value", "zoom")
    made = table.select("id", F.xxhash64(F.when(F.col("id") % 3 == 0, F.col("value")).otherwise(F.coalesce("value", F.lit(0.0)) + 1)).alias("input_hash"), F.lit(1.0).alias("zoom"))
    return procedures.landed(table, made, ["zoom"], ["value"]).drop("value")


@_query("n10_findings", f"{_L} SELECT id, CASE WHEN heading > 180 THEN 1 ELSE 0 END + CASE WHEN pano_id IS NULL THEN 64 ELSE 0 END + CASE WHEN zoom = 2 THEN 16 ELSE 0 END AS found FROM locations")
def _n10(df):
    return df.select("id", procedures.findings(newer=F.col("heading") > 180, not_found=F.col("pano_id").isNull(), unofficial=F.col("zoom") == 2).alias("found"))


# --- search and lists


def _visits(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("location_id"), (F.col("o_custkey") % 20).alias("map_id"), F.concat(F.lit("C"), (F.col("o_custkey") % 7).cast("string")).alias("country"), F.col("o_orderpriority").alias("address"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("seen_at"))


_VISITS = "WITH v AS (SELECT o_orderkey AS location_id, o_custkey % 20 AS map_id, concat('C', CAST(o_custkey % 7 AS VARCHAR)) AS country, o_orderpriority AS address, CAST(epoch(o_orderdate) AS BIGINT) AS seen_at FROM orders)"


@_query("c16_seen_maps", f"{_VISITS} SELECT DISTINCT v.map_id AS map_id, n.n_name AS name FROM v JOIN nation n ON n.n_nationkey = v.map_id")
def _c16(spark, d):
    maps = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("map_id"), F.col("n_name").alias("name"))
    return _visits(spark, d).select("map_id").distinct().join(maps, "map_id")


@_query("f21_countries", f"{_VISITS} SELECT country, count(DISTINCT map_id) AS maps FROM v GROUP BY country ORDER BY country")
def _f21(spark, d):
    return _visits(spark, d).select("country", "map_id").distinct().groupBy("country").agg(F.count(F.lit(1)).alias("maps")).orderBy("country")


@_query("q01_stats", "SELECT count(*) AS maps, coalesce(CAST(sum(n) AS BIGINT), 0) AS locations FROM (SELECT o_custkey % 20 AS m, count(*) AS n FROM orders GROUP BY 1)")
def _q01(spark, d):
    return _visits(spark, d).groupBy("map_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("maps"), F.coalesce(F.sum("n"), F.lit(0)).alias("locations"))


@_query("q02_newest", f"{_VISITS} SELECT location_id, seen_at FROM v ORDER BY seen_at DESC, location_id DESC LIMIT 100")
def _q02(spark, d):
    return _visits(spark, d).select("location_id", "seen_at").orderBy(F.desc("seen_at"), F.desc("location_id")).limit(100)


@_query("q03_visits", f"{_VISITS} SELECT location_id, country, address FROM v WHERE country = 'C3' AND lower(address) LIKE '%low%' AND seen_at >= 800000000")
def _q03(spark, d):
    return search.visits(_visits(spark, d), country="C3", address="LOW", since=800_000_000).select("location_id", "country", "address")


def _token_sql(hay: str, token: str) -> str:
    loose = token[0] + "".join(f"[^{c}]*{c}" for c in token[1:])
    span = f"length(regexp_extract({hay}, '{loose}'))"
    return f"CASE WHEN strpos({hay}, '{token}') = 1 THEN CASE WHEN length({hay}) = {len(token)} THEN 1.0 ELSE 0.9 END WHEN strpos({hay}, '{token}') > 1 THEN CASE WHEN regexp_matches(substr({hay}, strpos({hay}, '{token}') - 1, 1), '[\\p{{L}}\\p{{N}}]') THEN 0.5 ELSE 0.8 END WHEN {span} > 0 THEN {0.3 * len(token)!r} / {span} ELSE 0.0 END"


_FOUND = " , ".join(f"greatest({_token_sql('a', t)}, 0.7 * ({_token_sql('b', t)})) AS s{k}" for k, t in enumerate(("red", "brn")))


@_query("q04_search", f"WITH x AS (SELECT p_partkey, lower(p_name) AS a, lower(p_brand) AS b FROM part), s AS (SELECT p_partkey, {_FOUND} FROM x) SELECT p_partkey, round((s0 + s1) / 2, 9) AS score FROM s WHERE s0 > 0 AND s1 > 0")
def _q04(spark, d):
    return search.search(spark.read.parquet(f"{d}/part.parquet"), "Red brn", ["p_name", "p_brand"], "p_partkey").select("p_partkey", F.round("score", 9).alias("score"))


_AT = "least(CASE WHEN strpos(lower(text), 'the') > 0 THEN strpos(lower(text), 'the') ELSE 1073741824 END, CASE WHEN strpos(lower(text), 'zebra') > 0 THEN strpos(lower(text), 'zebra') ELSE 1073741824 END)"


@_query("q05_snippet", f"WITH x AS (SELECT item_id, text, {_AT} AS pos, length(text) AS n FROM benchmark) SELECT item_id, CASE WHEN pos = 1073741824 THEN concat(trim(substr(text, 1, 120)), CASE WHEN n > 120 THEN '…' ELSE '' END) ELSE concat(CASE WHEN pos > 51 THEN '…' ELSE '' END, trim(substr(text, greatest(pos - 50, 1), least(pos + 89, n) - greatest(pos - 51, 0))), CASE WHEN pos + 89 < n THEN '…' ELSE '' END) END AS snippet FROM x")
def _q05(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", search.snippet(F.col("text"), "the zebra").alias("snippet"))


@_query("q06_tag_order", "WITH t AS (SELECT p_brand AS name, count(*) AS amount, CASE WHEN length(p_brand) = 7 THEN max(p_size) END AS \"order\" FROM part GROUP BY p_brand) SELECT name, amount, row_number() OVER (ORDER BY \"order\" NULLS LAST, name) AS place FROM t")
def _q06(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("name")).agg(F.count(F.lit(1)).alias("amount"), F.when(F.length("p_brand") == 7, F.max("p_size")).alias("order"))
    ordered = search.tags_in_order(t, "manual")
    return ordered.select("name", "amount", F.row_number().over(W.orderBy(F.asc_nulls_last("order"), "name")).alias("place"))  # a few tags


@_query("q10_rebase", "SELECT p_partkey, CASE WHEN p_type LIKE 'ECONOMY%' THEN concat('new/root', substr(path, 4)) ELSE path END AS path FROM (SELECT p_partkey, p_type, CASE WHEN p_type LIKE 'ECONOMY%' THEN concat('old/', p_name) ELSE concat('older/', p_name) END AS path FROM part)")
def _q10(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    path = F.concat(F.when(F.startswith("p_type", F.lit("ECONOMY")), "old/").otherwise("older/"), F.col("p_name"))
    return p.select("p_partkey", search.rebased(path, "old", "new/root").alias("path"))


@_query("q11_duplicate_map", f"{_VISITS} SELECT CAST(99 AS BIGINT) AS map_id, location_id, country FROM v WHERE map_id = 3")
def _q11(spark, d):
    return _visits(spark, d).filter("map_id = 3").select(F.lit(99).cast("long").alias("map_id"), "location_id", "country")


@_query("q13_output", f"{_L}, s AS (SELECT id % 700 AS node, id, CASE WHEN id % 4 = 0 THEN '*' ELSE pano_id END AS pano, heading + 200 - 360 * floor((heading + 200) / 360) AS heading FROM locations) SELECT node, min(id) AS id, min_by(coalesce(pano, ''), id) AS pano, min_by(heading, id) AS heading FROM s GROUP BY node")
def _q13(df):
    out = df.select((F.col("id") % 700).alias("node"), "id", F.coalesce(F.when(F.col("id") % 4 == 0, "*").otherwise(F.col("pano_id")), F.lit("")).alias("pano"), F.pmod(F.col("heading") + 200, F.lit(360.0)).alias("heading"))
    return search.first_by(out, "node", "id")


@_query("q08_bearing", f"{_L}, b AS (SELECT id, degrees(atan2(sin(radians(10.0 - lng)) * cos(radians(5.0)), cos(radians(lat)) * sin(radians(5.0)) - sin(radians(lat)) * cos(radians(5.0)) * cos(radians(10.0 - lng)))) AS d FROM locations) SELECT id, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 6) AS bearing FROM b")
def _q08(df):
    return df.select("id", F.round(geo.bearing(F.col("lat"), F.col("lng"), 5.0, 10.0), 6).alias("bearing"))
