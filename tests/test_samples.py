"""Sequential sampling rules against brute force, the spaced stream, archives and polygons."""

import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import changes, sampling, work
from terravane.operators.shared import running, small
from terravane.sources import locations as src
from terravane.streaming import live

SCHEMA = "id long, lat double, lng double, kind string"


def _points(n=150, seed=2, spread=0.01):
    rnd = random.Random(seed)
    rows = [(k, rnd.random() * spread, rnd.random() * spread, rnd.choice("ab")) for k in range(n)]
    return rows + [(n + k, rows[0][1], rows[0][2], "a") for k in range(5)] + [(900, None, 1.0, "a"), (901, float("nan"), 1.0, "b")]


def _closer(a, b, m):
    dlat = b[1] - a[1]
    x = (b[2] - a[2]) * math.cos((a[1] + b[1]) * math.pi / 360)
    return dlat * dlat <= m * m / 110000.0**2 and (6371137.0 * math.pi / 180) ** 2 * (x * x + dlat * dlat) < m * m


def _real(p):
    return p[1] is not None and not math.isnan(p[1])


def _pass(points, close, order=lambda p: p[0]):
    kept = []
    for p in sorted(points, key=order):
        if not _real(p) or not any(_real(q) and close(p, q) for q in kept):
            kept.append(p)
    return {p[0] for p in kept}


def _ids(df):
    return {r.id for r in df.select("id").collect()}


def test_spacing_is_the_greedy_pass(spark):
    points = _points()
    df = spark.createDataFrame(points, SCHEMA)
    assert _ids(sampling.spaced(df, 120.0, order=F.col("id"))) == _pass(points, lambda a, b: _closer(a, b, 120.0))
    apart = _pass(points, lambda a, b: a[3] == b[3] and _closer(a, b, 120.0))
    assert _ids(sampling.spaced(df, 120.0, by="kind", order=F.col("id"))) == apart
    assert _ids(sampling.spaced(df.limit(0), 120.0)) == set()


def test_spacing_by_count(spark):
    df = spark.createDataFrame([p for p in _points() if _real(p)], SCHEMA)
    some, metres = sampling.spaced_count(df, 12, seed=1, least=150)
    fits = {d: sampling.spaced(df, d, 1).count() for d in sampling.SPACINGS[sampling.SPACINGS.index(metres) :][:2]}
    assert some.count() == 12 and fits[metres] >= 12 and all(n < 12 for d, n in fits.items() if d > metres)
    assert sampling.spaced_count(df, 10_000)[1] == 0 and sampling.spaced_count(df, 0)[0].count() == 0
    assert sampling.spaced_count(df, 5, least=80_000)[0].count() == 0
    few, metres = sampling.spaced_count(df, 50, seed=1, least=65_000)  # wider than the points lie
    assert metres == 65_000 and few.count() == 1


def _haversine(a, b):
    s1, s2 = math.sin(math.radians(b[0] - a[0]) / 2), math.sin(math.radians(b[1] - a[1]) / 2)
    return 2 * 6371000.0 * math.asin(math.sqrt(s1 * s1 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * s2 * s2))


def test_even_picks_are_the_best_centred(spark):
    points = [p for p in _points(400, 7) if _real(p)]
    m = 200.0
    step = m * 3**0.5 / 2 / (math.pi * 6371000.0 / 180)
    centres = [(r, c, r * step, (c + r % 2 * 0.5) * m / (math.pi * 6371000.0 / 180 * math.cos(math.radians(r * step)))) for r in range(-1, 9) for c in range(-1, 9)]
    cells = {}
    for p in points:
        d, r, c = min((_haversine(p[1:3], x[2:]), x[0], x[1]) for x in centres)
        cells.setdefault((r, c), []).append((d, p[0], p))
    kept = []
    for d, i, p in sorted(min(v) for v in cells.values()):
        if all(_haversine(p[1:3], q[1:3]) >= m / 2 for q in kept):
            kept.append(p)
    assert _ids(sampling.even_picks(spark.createDataFrame(points, SCHEMA), m)) == {p[0] for p in kept}


def test_preferences_share_what_is_taken(spark):
    df = spark.createDataFrame([p for p in _points() if _real(p)], SCHEMA)
    goals = spark.createDataFrame([("a", 7), ("b", 4)], "kind string, quota long")
    out = sampling.preferred(df, "kind", goals, [(F.col("lat") > 0.005, 50, "north"), (F.lit(True), None, None)], 60.0).collect()
    n = lambda k, t: sum(r.kind == k and r.tag == t for r in out)
    assert (n("a", "north"), n("a", None), n("b", "north"), n("b", None)) == (4, 3, 2, 2)
    by = {p[0]: p for p in _points()}
    assert not any(a.kind == b.kind and a.id < b.id and _closer(by[a.id], by[b.id], 60.0) for a in out for b in out)


def test_spaced_stream(spark, tmp_path):
    points = [p for p in _points(60) if _real(p)]
    out, mark, into = (str(tmp_path / x) for x in ("out", "mark", "in"))
    halves = [points[:30], points[30:]]
    for k, half in enumerate(halves):
        spark.createDataFrame(half, SCHEMA).coalesce(1).write.parquet(f"{into}/{k}")
        live.spaced_stream(spark, f"{into}/*", SCHEMA, out, mark, 150.0)

    def chord(a, b):
        v = lambda p: [math.cos(math.radians(p[1])) * math.cos(math.radians(p[2])), math.cos(math.radians(p[1])) * math.sin(math.radians(p[2])), math.sin(math.radians(p[1]))]
        return math.dist(v(a), v(b)) * 6371000.0 < 150.0

    assert _ids(spark.read.schema(SCHEMA).parquet(f"{out}/0", f"{out}/1")) == _pass(points, chord)


def test_capped_log_keeps_the_newest(spark, tmp_path):
    into, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for k in range(2):
        spark.createDataFrame([(10 * k + i, 100 * k + i) for i in range(4)], "id long, at long").coalesce(1).write.parquet(f"{into}/{k}")
        live.capped_log(spark, f"{into}/*", "id long, at long", out, mark, most=5)
    assert _ids(spark.read.parquet(f"{out}/1")) == {3, 10, 11, 12, 13}


def test_archives_lines_and_polygons(spark, tmp_path):
    doc = lambda *lats: json.dumps({"customCoordinates": [{"lat": x, "lng": 1} for x in lats]})
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("b.json", doc(3, 4))
        z.writestr("a.JSON", "﻿" + doc(1))
        z.writestr("note.txt", "no")
        z.writestr("broken.json", "{")
    assert [(r.entry, r.pos, r.lat) for r in src.read_zip(spark, str(tmp_path / "m.zip")).orderBy("entry", "pos").collect()] == [("a.JSON", 0, 1.0), ("b.json", 0, 3.0), ("b.json", 1, 4.0)]
    (tmp_path / "l.json").write_text('{"lat":1,"lng":2}\n\n{"lat":3,"lng":4,"pano":"p"}\n{broken\n')
    assert sorted((r.lat, r.pano_id) for r in src.read_json_lines(spark, str(tmp_path / "l.json")).collect()) == [(1.0, None), (3.0, "p")]
    for bad in ('{"type":"Point","coordinates":[1,2]}', '{"type":"Feature","geometry":null}'):
        with pytest.raises(Exception, match="unsupported GeoJSON"):
            src.polygons(spark.createDataFrame([(bad,)], "value string")).collect()


def test_bounds_and_keys_and_sums(spark):
    assert geo.ring_bounds([[(170.0, -1.0), (190.0, 2.0)]]) == (170.0, -1.0, -170.0, 2.0)
    assert geo.ring_bounds([[(-200.0, 0.0), (200.0, 1.0)]]) == (-180.0, 0.0, 180.0, 1.0) and geo.ring_bounds([]) is None
    rows = [(None if k % 3 == 0 else "x", k, k % 5) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {r.k: r.s for r in running(df, ["g"], ["k"], F.col("v"), "s").collect()}
    assert got == {k: sum(v for g2, k2, v in rows if g2 == g and k2 <= k) for g, k, _ in rows}
    assert running(df.limit(0), ["g"], ["k"], F.lit(1)).count() == 0
    keyed = {r.k: r.key for r in changes.numbered(df.select("g", "k"), "g", "k").collect()}
    assert keyed[1] == "x#1" and keyed[2] == "x#2" and keyed[0] == "1"
    assert small(df, 10) is df and small(df, 300) is not df
    best = {r.g: r.best for r in work.streaks(df, "g", "k", F.col("v") != 0).collect()}

    def longest(g):
        most = now = 0
        for g2, _, v in rows:
            if g2 == g:
                now = now + 1 if v else 0
                most = max(most, now)
        return most

    assert best == {g: longest(g) for g in (None, "x")}
