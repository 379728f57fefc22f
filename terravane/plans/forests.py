"""Registered queries of forests of selections, saved rules, review sessions, synchronisation and paged procedures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes, procedures, reviews
from ..operators.shared import checkpointed, shared_folder
from ..sources import locations as src
from . import trees
from .catalog import _L, _query
from .extended import _OVER, _layer
from .rows import _NEAR
from .selectors import And, Filter, Invert, Or, Ranked, Selected, Uncommitted, select
from .trees import Forest

_CLICK, _ZOOMED, _FIVE = Filter("event_type", "eq", "click"), Filter("zoom", "gte", 3.0), Filter("tags", "contains", 5)
_TAGGED = "id IN (SELECT id FROM location_tags WHERE tag = {})"
_FOREST = Forest.of(Or((_CLICK, _ZOOMED, _FIVE)), Filter("pano_id", "nothas"), Ranked(_CLICK, "heading", 100), Invert((And((_CLICK, _FIVE)),)), And((Selected(), _FIVE)))
_TOP = "id IN (SELECT id FROM locations WHERE event_type = 'click' ORDER BY heading DESC NULLS LAST, id LIMIT 100)"
_TREES = [f"event_type = 'click' OR zoom >= 3 OR {_TAGGED.format(5)}", "pano_id IS NULL", _TOP, f"NOT (event_type = 'click' AND {_TAGGED.format(5)})"]


def _count_sql(conditions: list[str], ghosted: set[int]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS place, {str(i in ghosted).lower()} AS ghosted, count(*) AS n FROM locations WHERE {c}" for i, c in enumerate(conditions))


_GHOSTED = _FOREST.ghost(0).ghost(3)


@_query("l01_counts", f"{_L} " + _count_sql([*_TREES, f"(pano_id IS NULL OR {_TOP}) AND {_TAGGED.format(5)}"], {0, 3}))
def _l01(df):
    """What each tree of a forest selects; the last one narrows what the active ones select together."""
    return trees.counts(df, _GHOSTED)


_EDITED = (
    _FOREST.remove_at((4,))
    .compose((1,), (0, 1), And)  # no panorama and zoomed
    .invert_at((0, 0))
    .move((0, 2), (1,), after=True)
    .remove(Invert((And((_CLICK, _FIVE)),)))
)
_LEFT = ["event_type <> 'click' OR (zoom >= 3 AND pano_id IS NULL)", _TOP, "event_type = 'click'", _TAGGED.format(5)]


@_query(
    "l02_edited",
    f"{_L} " + _count_sql([*_LEFT[:3], " OR ".join(f"({c})" for c in _LEFT), _LEFT[3]], set()),
)
def _l02(df):
    """The same forest after trees were grouped, negated, moved out of a group, and taken apart; groups that go leave their members."""
    return trees.counts(df, _EDITED)


@_query("l03_active", f"{_L} SELECT id FROM locations WHERE {_TOP} OR (event_type = 'click' AND zoom >= 3)")
def _l03(df):
    """Edits of the active trees leave ghosted ones where they are."""
    forest = Forest.of(_CLICK, _FIVE, _ZOOMED, _FOREST.rows[2].tree).ghost(1).on_active(lambda f: f.combine(And, [_CLICK, _ZOOMED]))
    return trees.selected(df, forest).select("id")


def _tag_names(spark, d, shift: int) -> DataFrame:
    """Part names stand for tags, told apart from table to table by a shift of their keys."""
    p = spark.read.parquet(f"{d}/part.parquet").filter("p_partkey <= 8")
    return p.select(F.lit("tags").alias("field"), ((F.col("p_partkey") + shift) % 8 + 1).cast("long").alias("value_id"), F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")).alias("name"))


@_query("l04_saved", f"{_L} SELECT id FROM locations WHERE {_TAGGED.format(5)} OR (event_type = 'click' AND NOT ({_TAGGED.format(6)}))")
def _l04(spark, d):
    """A rule saved where tags are numbered otherwise finds them by name; a tag that isn't here selects nothing."""
    here, there = _tag_names(spark, d, 0), _tag_names(spark, d, 2)
    rule = trees.saved(Or((Filter("tags", "contains", 3), And((_CLICK, Invert((Filter("tags", "contains", 4),)))), Filter("tags", "contains", 2))), here)
    kept = there.filter("value_id <> 4")
    return select(src.locations(spark, d), trees.resolved(rule, kept)).select("id")


@_query("b03_bound", f"{_L} SELECT id FROM locations WHERE NOT (event_type = 'click' OR {_TAGGED.format(5)}) AND zoom >= 3")
def _b03(df):
    """Rows that the active trees don't select, narrowed by another one."""
    return select(df, trees.bound(And((Invert((Selected(),)), _ZOOMED)), Forest.of(_CLICK, Filter("pano_id", "nothas"), _FIVE).ghost(1))).select("id")


@_query("b04_layer", f"{_L}, {_OVER} SELECT id FROM locations WHERE id IN (SELECT id FROM o WHERE op = 'patch') AND coalesce((SELECT o.heading FROM o WHERE o.id = locations.id), heading) >= 180 UNION ALL SELECT id FROM o WHERE op = 'add' AND heading >= 180")
def _b04(df):
    """Uncommitted rows as a node of a tree."""
    return select(trees.with_layer(*_layer(df)), And((Uncommitted(), Filter("heading", "gte", 180.0)))).select("id")


@_query(
    "m01_deltas",
    f"""{_L}, o AS (SELECT id, pano_id, event_type, heading FROM locations WHERE id % 10 <> 3), n AS (SELECT id, pano_id, CASE WHEN id % 7 = 0 THEN 'click' ELSE event_type END AS event_type, CASE WHEN id % 13 = 0 THEN 359.5 ELSE heading END AS heading FROM locations WHERE id % 10 <> 4),
m AS (SELECT 0 AS place, id, -1 AS s FROM o WHERE event_type = 'click' UNION ALL SELECT 0, id, 1 FROM n WHERE event_type = 'click'
UNION ALL SELECT 1, id, -1 FROM (SELECT id FROM o WHERE event_type <> 'click' ORDER BY heading DESC NULLS LAST, id LIMIT 200) UNION ALL SELECT 1, id, 1 FROM (SELECT id FROM n WHERE event_type <> 'click' ORDER BY heading DESC NULLS LAST, id LIMIT 200)
UNION ALL SELECT 2, id, -1 FROM o WHERE pano_id IS NULL AND event_type = 'click' UNION ALL SELECT 2, id, 1 FROM n WHERE pano_id IS NULL AND event_type = 'click')
SELECT place, id, CAST(sum(s) AS INTEGER) AS sign FROM m GROUP BY place, id HAVING sum(s) <> 0""",
)
def _m01(df):
    """What a change moves in a forest: two trees by the changed rows alone, one ranked again."""
    forest = Forest.of(_CLICK, Ranked(Invert((_CLICK,)), "heading", 200), And((Filter("pano_id", "nothas"), _CLICK)))
    old = df.select("id", "pano_id", "event_type", "heading")
    new = old.filter("id % 10 <> 4").withColumn("event_type", F.expr("CASE WHEN id % 7 = 0 THEN 'click' ELSE event_type END")).withColumn("heading", F.expr("CASE WHEN id % 13 = 0 THEN 359.5D ELSE heading END"))
    old = old.filter("id % 10 <> 3")
    return trees.deltas(new, changes.between(old, new), trees.members(old, forest), forest)


_SOURCES = "m AS (SELECT event_type AS source, id, heading, pitch FROM locations)"
_ORDER = "OVER (PARTITION BY source ORDER BY heading, id)"
_FIRST = f"{_L}, {_SOURCES}, w AS (SELECT source, 0 AS run, row_number() {_ORDER} AS place, id FROM m WHERE id % 3 = 0)"
_GROWN = f"{_FIRST}, g AS (SELECT * FROM w UNION ALL SELECT source, 1, row_number() {_ORDER}, id FROM m WHERE id % 3 = 1)"


def _session(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(worklist, cursors, matches): reviews by event type, begun over a third of the rows; the cursors went three steps on and one back."""
    matches = df.select(F.col("event_type").alias("source"), "id", "heading")
    work, cursors = reviews.begin(matches.filter("id % 3 = 0"), ["heading"])
    for _ in range(3):
        work, cursors = reviews.advance(work, cursors)
    return work, reviews.retreat(work, cursors), matches


@_query("p01_begin", f"{_FIRST} SELECT source, run, place, id, place <= 3 AS reviewed FROM w")
def _p01(df):
    """Worklists in the order of headings; the rows that the cursors left are reviewed."""
    return _session(df)[0]


@_query("p02_append", f"{_GROWN} SELECT source, run, place, id FROM g WHERE run = 1 OR place > 3")
def _p02(df):
    """New matches go to the end of each list, nothing is numbered again; what is still to review."""
    work, _, matches = _session(df)
    return reviews.ids(reviews.append(work, matches.filter("id % 3 < 2"), ["heading"]), False)


@_query(
    "p03_prune",
    f"""{_GROWN}, live AS (SELECT * FROM g WHERE NOT (run = 0 AND place IN (1, 3)) AND id % 5 <> 2),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run, place) AS nth FROM live) SELECT source, run, place, id, false AS done FROM n WHERE nth = 3""",
)
def _p03(df):
    """Each cursor stands on a row that goes, with one before it and others: it takes the row at its old position."""
    work, cursors, matches = _session(df)
    grown = checkpointed(reviews.append(work, matches.filter("id % 3 < 2"), ["heading"]))
    gone = grown.filter("run = 0 AND place IN (1, 3) OR id % 5 = 2").select("id")
    return reviews.prune(grown, cursors, matches.select("id").join(gone, "id", "left_anti"))[1]


_SIDES = """b AS (SELECT o_orderkey AS key, o_orderstatus AS h FROM orders WHERE o_orderkey % 2 = 0), l AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'L' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 3 <> 0),
r AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'R' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 11 <> 0)"""
_THREE = "coalesce(b.key, l.key, r.key) AS key, b.h AS b, l.h AS l, r.h AS r FROM b FULL JOIN l ON b.key = l.key FULL JOIN r ON r.key = coalesce(b.key, l.key)"


def _sides(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("hash"))
    mark = lambda df, n, m: df.withColumn("hash", F.when(F.col("key") % n == 0, m).otherwise(F.col("hash")))
    return o.filter("key % 2 = 0"), mark(o.filter("key % 3 <> 0"), 7, "L"), mark(o.filter("key % 11 <> 0"), 5, "R")


def _first_sync(first: str, only_local: str, only_remote: str):
    sql = f"""WITH {_SIDES} SELECT coalesce(l.key, r.key) AS key, CASE WHEN l.h = r.h THEN 'none' WHEN r.key IS NULL THEN '{only_local}' WHEN l.key IS NULL THEN '{only_remote}' ELSE 'conflict' END AS plan,
CASE WHEN l.h = r.h THEN l.h WHEN r.key IS NULL AND '{only_local}' = 'add_remote' THEN l.h WHEN l.key IS NULL AND '{only_remote}' = 'add_local' THEN r.h END AS hash FROM l FULL JOIN r ON l.key = r.key"""

    @_query(f"p04_first_{first}", sql)
    def _p04(spark, d):
        """A first synchronisation: both tables merged, or one the mirror of the other."""
        base, local, remote = _sides(spark, d)
        return changes.synchronised(base.limit(0), local, remote, first)


_first_sync("merge", "add_remote", "add_local")
_first_sync("remote", "remove_local", "add_local")
_first_sync("local", "add_remote", "remove_remote")


@_query(
    "p05_resolved",
    f"""WITH {_SIDES}, j AS (SELECT {_THREE}), s AS (SELECT *, CASE WHEN key % 4 = 0 THEN 'local' WHEN key % 4 <> 2 THEN 'remote' END AS side, l IS NOT DISTINCT FROM r AS same, b IS NOT DISTINCT FROM l AS kept_l, b IS NOT DISTINCT FROM r AS kept_r FROM j),
t AS (SELECT *, CASE WHEN same THEN 'none' WHEN kept_l OR NOT kept_r AND side = 'remote' THEN 'local' WHEN kept_r OR side = 'local' THEN 'remote' ELSE 'conflict' END AS t FROM s)
SELECT key, CASE t WHEN 'local' THEN CASE WHEN r IS NULL THEN 'remove_local' WHEN l IS NULL THEN 'add_local' ELSE 'update_local' END WHEN 'remote' THEN CASE WHEN l IS NULL THEN 'remove_remote' WHEN r IS NULL THEN 'add_remote' ELSE 'update_remote' END ELSE t END AS plan,
CASE t WHEN 'local' THEN r WHEN 'conflict' THEN b ELSE l END AS hash FROM t""",
)
def _p05(spark, d):
    """A later synchronisation; some conflicts go to a named side."""
    base, local, remote = _sides(spark, d)
    keys = base.unionByName(local).unionByName(remote).select("key").distinct()
    sides = keys.filter("key % 4 <> 2").withColumn("side", F.when(F.col("key") % 4 == 0, "local").otherwise("remote"))
    return changes.synchronised(base, local, remote, sides=sides)


_HALF = procedures.Provider("half", {"half": "double"}, ("value",), lambda rows: pd.DataFrame({"half": rows["value"] / 2}), batch=500)


@_query("n04_collect", f"{_L} SELECT id, value / 2 AS half FROM locations WHERE value IS NOT NULL AND id % 3 <> 0")
def _n04(df):
    """Results handed back, the table left as it is; rows that hold the field already have none."""
    held = df.withColumn("half", F.when(F.col("id") % 3 == 0, 0.0))
    return procedures.collected(held, _HALF).select("id", "half")


@_query("m06_pages", f"{_L}, n AS (SELECT id, value, row_number() OVER (ORDER BY id) AS n FROM locations WHERE value IS NOT NULL) SELECT id, value / 2 AS half FROM n WHERE n <= 2 * (SELECT ceil(count(*) / 4.0) FROM locations)")
def _m06(spark, d):
    """A run over four pages, stopped after one and gone on with: what can be read after the second."""
    df = src.locations(spark, d)
    folder = shared_folder(spark, "pages")
    page = -(-df.count() // 4)
    for _ in range(2):
        procedures.paged(df.select("id", "value"), _HALF, folder, page, most=1)
    return procedures.partial(spark, _HALF, folder).select("id", "half")


def _spread(rows: pd.DataFrame) -> pd.DataFrame:
    far = lambda near, own: max((abs(n["heading"] - own) for n in near), default=0.0)
    return pd.DataFrame({"spread": [far(near, own) for near, own in zip(rows["neighbours"], rows["heading"], strict=True)]})


@_query("n02_neighbours", f"{_L}, {_NEAR} SELECT n.id, max(abs(n.heading - l.heading)) AS spread FROM n JOIN locations l ON l.id = n.id GROUP BY n.id")
def _n02(df):
    """A procedure that is given each row's neighbours: how far their headings are from its own."""
    near = procedures.Provider("near", {"spread": "double"}, ("heading",), _spread, around=(500.0, ("heading",)))
    return procedures.applied(df.select("id", "lat", "lng", "heading"), near).select("id", "spread")
