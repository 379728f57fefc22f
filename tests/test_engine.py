"""Edge cases of selectors, expressions, edits, changes, sampling, sources and streams."""

import math

import pytest
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.functions.expr import ExpressionError, compile_expression
from terravane.operators import asks, changes, sampling, spatial, work
from terravane.plans import selectors as s
from terravane.sources import locations as src
from terravane.streaming import live

COLUMNS = "id long, lat double, lng double, heading double, pitch double, zoom double, pano_id string, flags long, tags array<bigint>, extra string, created_at long, modified_at long, timezone string"


def rows(spark, *some):
    base = dict(id=1, lat=0.0, lng=0.0, heading=0.0, pitch=0.0, zoom=0.0, pano_id=None, flags=0, tags=[], extra=None, created_at=0, modified_at=None, timezone=None)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple((base | {"id": k + 1} | r)[n] for n in names) for k, r in enumerate(some)], COLUMNS)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_two_valued_logic(spark):
    df = rows(spark, {}, {"extra": '{"k":""}'}, {"extra": '{"k":0}'}, {"extra": '{"k":"0"}'}, {"extra": '{"k":null}'}, {"extra": '{"k":"x"}', "tags": [1, 1]})
    assert ids(s.select(df, s.Filter("k", "has"))) == [3, 4, 6]
    assert ids(s.select(df, s.Filter("k", "nothas"))) == [1, 2, 5]
    assert ids(s.select(df, s.Filter("k", "eq", 0))) == [3, 4]
    assert ids(s.select(df, s.Filter("k", "neq", 0))) == [6]
    assert ids(s.select(df, s.invert(s.Filter("k", "neq", 0)))) == [1, 2, 3, 4, 5]
    assert ids(s.select(df, s.Filter("tags", "eq", 2))) == [6]
    assert ids(s.select(df, s.Filter("tags", "notcontains", 2))) == [6]
    assert ids(s.select(df, s.Filter("tagCount", "gte", 1))) == [6]


def test_trees():
    a, b = s.Filter("x", "has"), s.Filter("y", "has")
    assert s.invert(s.invert(a)) == a
    assert s.combine(s.And, []) == s.Everything()
    assert s.combine(s.Or, []) == s.Or(())
    assert s.combine(s.And, [s.And((a, b)), s.Everything(), a]) == s.And((b, a))
    assert s.rename_field(s.Or((a, s.Nearby(0, 0, 1, a))), "x", "z") == s.Or((s.Filter("z", "has"), s.Nearby(0, 0, 1, s.Filter("z", "has"))))


def test_ranked_keeps_unscored_last(spark):
    df = rows(spark, {"heading": 5.0, "pitch": 1.0}, {"heading": 5.0}, {"heading": 9.0, "pitch": 3.0})
    for up, want in ((False, [1, 3, 2]), (True, [3, 1, 2])):
        assert [r.id for r in s.ranked(df, "heading / pitch", up).collect()] == want
    assert ids(s.select(df, s.Ranked(s.Everything(), "nonsense(", 2))) == [1, 2]


@pytest.mark.parametrize(
    "text,want",
    [("round(-2.5)", -2.0), ("mod(-7, 3)", 2.0), ("-7 % 3", -1.0), ("1 / 0", None), ("missing == 1", 0.0), ("missing + 1", None), ("has(missing)", 0.0), ("if(has(missing), 1 / 0, 7)", 7.0), ("min(1, missing)", None), ("clamp(9, 0, 5)", 5.0), ('event == "a"', 1.0), ("2 + 3 * 4", 14.0), ("true + true", 2.0)],
)
def test_expressions(spark, text, want):
    df = spark.createDataFrame([("a", None)], "event string, missing double")
    got = df.select(compile_expression(text, lambda n: (F.col(n), df.schema[n].dataType.simpleString())).alias("v")).first().v
    assert got == want


@pytest.mark.parametrize("text", ["", "1 +", "1 < 2 < 3", "nope(1)", "mod(1)", '"a"', "(1", "1 2", "#"])
def test_expression_errors(text):
    with pytest.raises((ExpressionError, AttributeError)):
        compile_expression(text, lambda n: (None, "double"))


def test_spatial_joins_cross_the_antimeridian_and_dense_cells(spark):
    df = rows(spark, {"lat": 60.0, "lng": 179.9999}, {"lat": 60.0, "lng": -179.9999}, {"lat": 60.0, "lng": 179.0}, {"lat": 89.99995, "lng": 10.0}, {"lat": 89.99995, "lng": -170.0})
    assert [tuple(r) for r in spatial.pairs(df, 25.0).collect()] in ([(1, 2), (4, 5)], [(4, 5), (1, 2)])
    line = rows(spark, *({"lat": k * 0.0001, "lng": 0.0} for k in range(12)))
    assert {r.group for r in spatial.groups(line, 25.0).collect()} == {1}
    same = rows(spark, {"lat": -0.0, "lng": 0.0}, {}, {"lat": float("nan")}, {"lat": float("nan")})
    assert ids(s.select(same, s.Duplicates(0.0))) == [1, 2]


def test_polygon_hole_and_geohash(spark):
    square, hole = ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)), ((4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0))
    df = rows(spark, {"lat": 1.0, "lng": 1.0}, {"lat": 5.0, "lng": 5.0}, {"lat": 11.0, "lng": 5.0}, {"lat": 57.64911, "lng": 10.40744})
    assert ids(s.select(df, s.Polygon((square, hole)))) == [1]
    assert df.filter("id = 4").select(geo.geohash(F.col("lat"), F.col("lng"), 6).alias("h")).first().h == "u4pruy"


def test_bins_and_bounds(spark):
    df = rows(spark, {"pitch": 5.0}, {"pitch": 5.0})
    assert asks.bins_by_count(df, "pitch", 4).count() == 0
    assert asks.bins_by_width(df, "pitch", -1.0).count() == 0
    over = rows(spark, {"lng": 179.0}, {"lng": -178.0})
    b = asks.bounds(over).first()
    assert (b.west, b.east) == (179.0, -178.0)


def test_edits(spark):
    df = rows(spark, {"tags": [1, 1, 2]}, {"tags": []})
    out = {r.id: (r.tags, r.changed) for r in work.list_set(df, F.lit(True), "tags", [3], [2, 3], 9).collect()}
    assert out == {1: ([1, 1, 3], True), 2: ([3], True)}
    moved = work.move_field(rows(spark, {"timezone": "UTC", "pano_id": "p"}), F.lit(True), "timezone", "pano_id", False, 9).first()
    assert (moved.pano_id, moved.timezone, moved.modified_at) == ("p", None, 9)
    assert work.invalidated({"b": ["a"], "c": ["b"], "d": ["x"]}, {"a"}, set()) == {"b", "c"}
    assert work.invalidated({"b": ["a"], "c": ["b"]}, {"a"}, {"b"}) == set()
    assert work.remap_values(df, "tags", {2: 1}).first().tags == [1]


def test_three_way_truth_table(spark):
    state = {"same": "h", "edit_l": "l", "edit_r": "r", "none": None}
    table = [(f"{b}/{x}/{y}", state[b], state[x], state[y]) for b in ("same", "none") for x in ("same", "edit_l", "none") for y in ("same", "edit_r", "none")]
    make = lambda k: spark.createDataFrame([(r[0], r[k]) for r in table if r[k] is not None], "key string, hash string")
    got = {r.key: r.plan for r in changes.three_way(make(1), make(2), make(3)).collect()}
    assert got["same/same/edit_r"] == "update_local" and got["same/same/none"] == "remove_local" and got["same/edit_l/same"] == "update_remote"
    assert got["same/none/same"] == "remove_remote" and got["same/edit_l/edit_r"] == "conflict" and got["same/none/none"] == "none"
    assert got["none/none/edit_r"] == "add_local" and got["none/edit_l/none"] == "add_remote" and got["none/same/same"] == "none" and "none/none/none" not in got


def test_change_laws_and_layer(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    change = changes.between(old, new)
    assert sorted(map(tuple, changes.apply(old, change).collect())) == [(2, "c"), (3, "d")]
    assert changes.stale(new, change).count() == 3 and changes.stale(old, change).count() == 0
    ops = spark.createDataFrame([(1, 1, "put", "x"), (1, 2, "remove", None), (1, 3, "put", "y"), (2, 1, "set", "z"), (2, 2, "remove", None)], "id long, seq long, op string, value string")
    assert {r.id: (r.removed, r.value) for r in changes.layer(ops).collect()} == {1: (False, "y"), 2: (True, None)}


def test_spaced_sample_is_maximal(spark):
    df = rows(spark, *({"lat": (k % 20) * 0.0001, "lng": (k // 20) * 0.0001} for k in range(200)))
    some = sampling.spaced(df, 30.0, seed=3)
    assert spatial.pairs(some, 29.999).count() == 0
    assert spatial.near_any(df, some, 30.0).filter("NOT near").count() == 0
    assert ids(some) == ids(sampling.spaced(df, 30.0, seed=3))
    assert sampling.even_picks(df, 50.0).count() > 1
    assert {r.pitch: r.quota for r in sampling.quotas(rows(spark, {"pitch": 1.0}, {"pitch": 2.0}, {"pitch": 2.0}, {"pitch": 2.0}), "pitch", 10).collect()} == {1.0: 2, 2.0: 8}


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"customCoordinates":[{"lat":1,"lng":2,"panoId":"p","extra":{"tags":["a","b"]},"countryCode":"NO"},{"lat":"x","lng":1},{"lat":3,"longitude":4,"heading":9}]}')
    out = src.read_json(spark, str(tmp_path / "m.json")).orderBy("pos").collect()
    assert [(r.lat, r.lng, r.pano_id, r.flags, r.tag_names) for r in out] == [(1.0, 2.0, "p", 1, ["a", "b"]), (3.0, 4.0, None, 0, [])]
    (tmp_path / "c.csv").write_text("Latitude,lon,pano\n1.5,2.5,q\nbad,1,\n3,4,\n")
    assert sorted((r.lat, r.lng, r.pano_id, r.flags) for r in src.read_csv(spark, str(tmp_path / "c.csv")).collect()) == [(1.5, 2.5, "q", 1), (3.0, 4.0, None, 0)]
    src.write_csv(rows(spark, {"lat": 7.0, "lng": 8.0}), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().lat == "7.0"


def test_live_counts_follow_the_log(spark, tmp_path):
    log, out, mark = (str(tmp_path / n) for n in ("log", "out", "mark"))
    row = lambda i, t, h: (i, t, h)
    spark.createDataFrame([(1, 1, None, row(1, "a", 90.0)), (1, 2, None, row(2, "a", 10.0)), (1, 3, None, row(3, "b", 80.0))], live.CHANGES).write.parquet(log)
    live.live_counts(spark, log, out, mark, live.heading_over(50.0))
    assert {r.key: r.n for r in spark.read.parquet(out).collect()} == {"a": 1, "b": 1}
    spark.createDataFrame([(2, 1, row(1, "a", 90.0), row(1, "a", 20.0)), (2, 2, row(2, "a", 10.0), row(2, "b", 99.0))], live.CHANGES).write.mode("append").parquet(log)
    live.live_counts(spark, log, out, mark, live.heading_over(50.0))
    assert {r.key: r.n for r in spark.read.parquet(out).collect()} == {"b": 2}


def test_haversine(spark):
    d = spark.range(1).select(geo.haversine_m(0.0, 0.0, 0.0, 180.0).alias("d")).first().d
    assert math.isclose(d, math.pi * geo.EARTH_M, rel_tol=1e-12)
