"""Registered queries of patches that clear, derived fields, the change feed, and searches with accents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import feed, history, neighbours, search, spatial, work
from .catalog import _L, _query



def _patches(df: DataFrame) -> DataFrame:
    """Every third row's panorama goes or becomes another; every sixth row's heading is set."""
    rows = df.filter(F.col("id") % 3 == 0)
    names = F.when(F.col("id") % 6 == 0, F.array(F.lit("pano_id"), F.lit("heading"))).otherwise(F.array(F.lit("pano_id")))
    pano = F.when(F.col("id") % 2 == 0, F.concat(F.lit("new"), F.col("id").cast("string")))
    return rows.select("id", names.alias("written"), "lat", (F.col("pitch") + 7).alias("heading"), pano.alias("pano_id"))


@_query("a01_clear", f"{_L} SELECT id, lat, CASE WHEN id % 6 = 0 THEN pitch + 7 ELSE heading END AS heading, CASE WHEN id % 3 <> 0 THEN pano_id WHEN id % 2 = 0 THEN concat('new', CAST(id AS VARCHAR)) END AS pano_id FROM locations WHERE id % 10 <> 1")
def _a01(df):
    """A layer of patches that clear fields, and of removals."""
    base = df.select("id", "lat", "heading", "pano_id")
    gone = df.filter(F.col("id") % 10 == 1).select("id", F.lit("remove").alias("op"))
    layer = _patches(df).join(gone, "id", "left_anti").withColumn("op", F.lit("patch"))
    return history.overlay(base, layer.unionByName(gone, allowMissingColumns=True))


@_query("a01_then", f"{_L} SELECT id, CASE WHEN id % 6 = 0 THEN pitch + 7 ELSE heading END AS heading, CASE WHEN id % 2 = 0 THEN 'late' WHEN id % 3 <> 0 THEN pano_id END AS pano_id FROM locations")
def _a01_then(df):
    """Two patches as one: what the later one writes wins, what it doesn't stays."""
    later = df.filter(F.col("id") % 2 == 0).select("id", F.array(F.lit("pano_id")).alias("written"), "lat", "heading", F.lit("late").alias("pano_id"))
    return feed.patched(df.select("id", "heading", "pano_id"), feed.then(_patches(df), later).drop("lat"))


@_query("a01_merge", f"""{_L} SELECT id, CASE WHEN id % 3 = 0 THEN '{{"seen":{{"by":"me"}}}}' WHEN id % 3 = 1 THEN concat('{{"k":', CAST(json_extract(extra, '$.k') AS VARCHAR), ',"seen":1}}') ELSE extra END AS extra FROM (SELECT id, concat('{{"k":', CAST(json_extract(extra, '$.k') AS VARCHAR), '}}') AS extra FROM locations)""")
def _a01_merge(df):
    """Merge patches of the open JSON column: a null takes a key out, an object goes inside."""
    patch = F.when(F.col("id") % 3 == 0, F.lit('{"k":null,"seen":{"by":"me","at":null}}')).when(F.col("id") % 3 == 1, F.lit('{"seen":1}')).otherwise(F.lit("{}"))
    return df.select("id", feed.merge_patch(F.col("extra"), patch).alias("extra"))




def _edits(spark, d) -> DataFrame:
    """Events as edits of their users' rows: (batch of 50 events, seq, id, op, written, kind, value)."""
    e = spark.read.parquet(f"{d}/events.parquet")
    op = F.when(F.col("event_id") % 11 == 0, "remove").when(F.col("event_id") % 5 == 0, "set").otherwise("put")
    names = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("value"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("kind"))).otherwise(F.array().cast("array<string>"))
    value = F.when(F.col("event_id") % 4 != 0, F.col("value"))
    return e.select(F.floor(F.col("event_id") / 50).alias("batch"), F.col("event_id").alias("seq"), F.col("user_id").alias("id"), op.alias("op"), names.alias("written"), F.col("event_type").alias("kind"), value.alias("value"))


_LOG = """WITH e AS (SELECT event_id // 50 AS batch, event_id AS seq, user_id AS id, CASE WHEN event_id % 11 = 0 THEN 'remove' WHEN event_id % 5 = 0 THEN 'set' ELSE 'put' END AS op, event_id % 3 AS m, event_type AS kind, CASE WHEN event_id % 4 <> 0 THEN value END AS value FROM events),
v AS (SELECT batch, row_number() OVER (ORDER BY batch) AS version FROM (SELECT DISTINCT batch FROM e)),
a AS (SELECT *, last_value(CASE WHEN op <> 'put' THEN op <> 'remove' END IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS alive FROM e),
r AS (SELECT * FROM a WHERE op <> 'put' OR alive),
w AS (SELECT *, CASE WHEN op = 'remove' THEN {'v': CAST(NULL AS VARCHAR)} WHEN op = 'set' OR m = 1 THEN {'v': kind} END AS wk, CASE WHEN op = 'remove' THEN {'v': CAST(NULL AS DOUBLE)} WHEN op = 'set' OR m = 0 THEN {'v': value} END AS wv FROM r),
s AS (SELECT *, last_value(wk IGNORE NULLS) OVER b AS bk, last_value(wv IGNORE NULLS) OVER b AS bv, last_value(wk IGNORE NULLS) OVER n AS ak, last_value(wv IGNORE NULLS) OVER n AS av FROM w
  WINDOW b AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY id ORDER BY seq)),
c AS (SELECT v.version, s.id, arg_min(coalesce(alive, false), seq) AS was, arg_max(op <> 'remove', seq) AS is_, arg_min({'k': bk.v, 'v': bv.v}, seq) AS b, arg_max({'k': ak.v, 'v': av.v}, seq) AS a FROM s JOIN v ON v.batch = s.batch GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN was AND is_ THEN CASE WHEN b IS DISTINCT FROM a THEN 'updated' END WHEN was THEN 'removed' WHEN is_ THEN 'added' END AS did FROM c)"""


@_query("m04_feed", _LOG + " SELECT v.version, count(*) FILTER (WHERE did = 'added') AS added, count(*) FILTER (WHERE did = 'removed') AS removed, count(*) FILTER (WHERE did = 'updated') AS updated FROM v LEFT JOIN f ON f.version = v.version GROUP BY v.version")
def _m04(spark, d):
    """What each version of the feed touched."""
    return feed.counts(feed.change_log(_edits(spark, d)))


@_query("m04_resumed", _LOG + ", last AS (SELECT id, arg_max(is_, version) AS is_, arg_max(a, version) AS a FROM c WHERE version <= (SELECT max(version) - 3 FROM v) GROUP BY id) SELECT id, a.k AS kind, a.v AS value FROM last WHERE is_")
def _m04_resumed(spark, d):
    """The table three versions before the last, from the table at version 4 and the changes since."""
    log = feed.change_log(_edits(spark, d))
    upto = F.max("version") - 3
    last = log.agg(upto).first()[0]
    return feed.state_at(log, last, feed.state_at(log, 4), 4)


@_query("j11_derived", f"{_L} SELECT id, CASE WHEN id % 4 = 0 THEN 90.0 ELSE heading END AS heading, CASE WHEN id % 4 = 0 AND heading <> 90.0 THEN NULL ELSE value END AS value, CASE WHEN id % 4 = 0 AND heading <> 90.0 THEN NULL ELSE timezone END AS timezone FROM locations")
def _j11(df):
    """A heading is set: what is derived from it goes, and what is derived from that."""
    edit = lambda t: work.set_field(t, F.col("id") % 4 == 0, "heading", 90.0, 5)
    return feed.derived(df, edit, {"value": ["heading"], "timezone": ["value"], "pano_id": ["pitch"]}, {"heading"}).select("id", "heading", "value", "timezone")


@_query("j11_edits", f"{_L} SELECT id, heading + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS heading, CASE WHEN id % 10 = 0 THEN 'kept' WHEN id % 5 = 0 THEN NULL ELSE pano_id END AS pano_id, CASE WHEN id % 5 = 0 THEN NULL ELSE value END AS value FROM locations")
def _j11_edits(df):
    """Row edits of headings, some of which write the derived panorama too; the value derived from both goes."""
    base = df.select("id", "heading", "pano_id", "value")
    names = F.when(F.col("id") % 10 == 0, F.array(F.lit("heading"), F.lit("pano_id"))).otherwise(F.array(F.lit("heading")))
    edits = df.filter(F.col("id") % 5 == 0).select("id", F.lit(1).alias("seq"), F.lit("put").alias("op"), names.alias("written"), (F.col("heading") + 1).alias("heading"), F.lit("kept").alias("pano_id"), "value")
    return feed.derived_after(base, history.edited(base, edits), {"pano_id": ["heading"], "value": ["pano_id"]})


def _accent_sql(token: str) -> str:
    loose = token[0] + "".join(f"[^{c}]*{c}" for c in token[1:])
    span = f"length(regexp_extract(t, '{loose}'))"
    return f"CASE WHEN strpos(t, '{token}') = 1 THEN CASE WHEN length(t) = {len(token)} THEN 1.0 ELSE 0.9 END WHEN strpos(t, '{token}') > 1 THEN CASE WHEN regexp_matches(substr(t, strpos(t, '{token}') - 1, 1), '[\\p{{L}}\\p{{N}}]') THEN 0.5 ELSE 0.8 END WHEN {span} > 0 THEN {0.3 * len(token)!r} / {span} ELSE 0.0 END"


@_query("q04_accents", f"WITH x AS (SELECT item_id, lower(strip_accents(text)) AS t FROM benchmark), s AS (SELECT item_id, {_accent_sql('cion')} AS s0, {_accent_sql('lae')} AS s1 FROM x) SELECT item_id, round((s0 + s1) / 2, 9) AS score FROM s WHERE s0 > 0 AND s1 > 0")
def _q04(spark, d):
    """Accents and case differ between query and texts, and don't matter."""
    return search.search(spark.read.parquet(f"{d}/benchmark.parquet"), "CÍÓN läé", ["text"], "item_id").select("item_id", F.round("score", 9).alias("score"))


_NEAR = """n AS (SELECT a.id AS id, b.id AS other, b.heading, pow(radians(b.lng - a.lng) * cos(radians(a.lat)), 2) + pow(radians(b.lat - a.lat), 2) AS d FROM locations a JOIN locations b ON b.lat BETWEEN a.lat - 0.01 AND a.lat + 0.01 WHERE 6371000.0 * 6371000.0 * (pow(radians(b.lng - a.lng) * cos(radians(a.lat)), 2) + pow(radians(b.lat - a.lat), 2)) <= 500.0 * 500.0)"""


@_query("c05_fields", f"{_L}, {_NEAR} SELECT id, count(*) AS n, max(heading) AS most, round(6371000.0 * sqrt(max(d)), 2) AS metres FROM n GROUP BY id")
def _c05(df):
    """Neighbours within 500 metres with a requested field and their distance: how many, their largest heading, how far the last is."""
    found = spatial.neighbours(df, 500.0, ["heading"])
    last = F.element_at("neighbours", -1)
    return found.select("id", F.size("neighbours").cast("long").alias("n"), F.array_max(F.transform("neighbours", lambda x: x["heading"])).alias("most"), F.round(last["metres"], 2).alias("metres"))


_CLOSER = "pow(b.lat - a.lat, 2) <= pow(300.0 / 110000.0, 2) AND pow(6371137.0 * pi() / 180, 2) * (pow((b.lng - a.lng) * cos((a.lat + b.lat) * (pi() / 360)), 2) + pow(b.lat - a.lat, 2)) < 300.0 * 300.0"


@_query("c15_some", f"{_L} SELECT a.id FROM locations a WHERE EXISTS (SELECT 1 FROM locations b WHERE b.id <> a.id AND b.lat BETWEEN a.lat - 0.01 AND a.lat + 0.01 AND b.heading > a.heading AND {_CLOSER})")
def _c15_some(df):
    """Rows with a neighbour of a larger heading within 300 metres: a semi join."""
    return neighbours.neighbour_filter(df, 300.0, "some", matches=F.col("i_heading") > F.col("p_heading")).select("id")


@_query("c15_none", f"{_L} SELECT a.id FROM locations a WHERE NOT EXISTS (SELECT 1 FROM locations b WHERE b.id <> a.id AND b.lat BETWEEN a.lat - 0.01 AND a.lat + 0.01 AND b.heading > a.heading AND {_CLOSER})")
def _c15_none(df):
    return neighbours.neighbour_filter(df, 300.0, "none", matches=F.col("i_heading") > F.col("p_heading")).select("id")
