"""Spread samples against sequential passes, in one task and in rounds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terravane.operators import distribution
from terravane.operators.sampling import SPACINGS

M = 6371137.0 * math.pi / 180


def close(a, b, d):
    dlat = b[0] - a[0]
    x = (b[1] - a[1]) * math.cos((a[0] + b[0]) * (math.pi / 360))
    return dlat * dlat <= d * d / 110000.0**2 and M * M * (x * x + dlat * dlat) < d * d


def walk(rows, d, placed=()):
    """ids of one pass; rows are (id, lat, lng) in order."""
    taken = []
    for i, lat, lng in rows:
        if not any(close((a, b), (lat, lng), d) for a, b in placed) and not any(close((a, b), (lat, lng), d) for _, a, b in taken):
            taken.append((i, lat, lng))
    return [i for i, _, _ in taken]


def search(rows, goal, least=0, placed=()):
    """(ids, spacing) by halves from a guess."""
    sizes = [d for d in SPACINGS if d >= least]
    if not sizes or goal <= 0:
        return [], 0
    lats, lngs = [r[1] for r in rows], [r[2] for r in rows]
    area = max((max(lats) - min(lats)) * M, 1.0) * max((max(lngs) - min(lngs)) * M * math.cos((min(lats) + max(lats)) * 0.5 * math.pi / 180), 1.0)
    probe = min(range(len(sizes)), key=lambda k: abs(sizes[k] - math.sqrt(area / goal)))
    low, high, best = 0, len(sizes) - 1, None
    while low <= high:
        ids = walk(rows, sizes[probe], placed)
        if len(ids) >= goal:
            best, low = (ids[:goal], sizes[probe]), probe + 1
        else:
            high = probe - 1
        probe = (low + high) // 2
    return best or (walk(rows, sizes[0], placed)[:goal], sizes[0])


def points(n, seed, spread=1.0, at=45.0):
    rng = random.Random(seed)
    out = [(i, at + rng.random() * spread, 7 + rng.random() * spread) for i in range(n)]
    return out + [(n + k, *out[k][1:]) for k in range(5)]  # a few at one place


def table(spark, rows, part="a"):
    return spark.createDataFrame([(part, i, i, lat, lng) for i, lat, lng in rows], "part string, o long, id long, lat double, lng double")


@pytest.mark.parametrize(("bounded", "d", "at"), [(4096, 9000.0, 45.0), (0, 9000.0, -0.5), (0, 40000.0, -89.9)])
def test_a_pass_equals_the_sequential_one(spark, bounded, d, at):
    rows = points(150, 3, 1.0 if d > 1000 else 0.02, at)
    rows = [(i, min(90.0, max(-90.0, lat)), (lng * 40 % 360) - 180 if abs(at) > 80 else lng) for i, lat, lng in rows]
    got = distribution.spaced_pass(table(spark, rows).withColumn("d", F.lit(d)), bounded=bounded)
    assert sorted(r.id for r in got.collect()) == sorted(walk(rows, d))


def test_a_pass_keeps_clear_of_what_is_placed_and_of_its_own_area_only(spark):
    one, two = points(60, 1), points(50, 2)
    rows = table(spark, one, "one").unionByName(table(spark, [(i + 1000, a, b) for i, a, b in two], "two")).withColumn("d", F.when(F.col("part") == "one", 8000.0).otherwise(15000.0))
    placed = spark.createDataFrame([("one", 45.5, 7.5), ("two", 45.2, 7.1), ("other", 45.0, 7.0)], "part string, lat double, lng double")
    for bounded in (4096, 0):
        got = distribution.spaced_pass(rows, placed, bounded=bounded).collect()
        assert sorted(r.id for r in got if r.part == "one") == sorted(walk(one, 8000.0, [(45.5, 7.5)]))
        assert sorted(r.id - 1000 for r in got if r.part == "two") == sorted(walk(two, 15000.0, [(45.2, 7.1)]))
    assert distribution.spaced_pass(rows.limit(0)).count() == 0


def test_largest_spacing_of_each_area(spark):
    areas = {"a": points(90, 4), "b": points(200, 5, 0.3), "c": points(6, 6), None: points(40, 7)}
    goals = {"a": 11, "b": 25, "c": 50, None: 3, "gone": 4, "none": 0}
    df, at = None, 0
    for name, rows in areas.items():
        t = table(spark, [(i + at, *p) for i, *p in rows], name)
        df, at = t if df is None else df.unionByName(t), at + 1000
    asked = spark.createDataFrame(list(goals.items()), "part string, goal long")
    got = distribution.spread(df, "part", asked, F.col("o")).collect()
    for k, (name, rows) in enumerate(areas.items()):
        ids, metres = search(rows, goals[name])
        mine = sorted((r.place, r.id - 1000 * k, r.metres) for r in got if r.part == name)
        assert mine == [(n + 1, i, metres) for n, i in enumerate(ids)]
    assert distribution.spread(df, "part", asked, F.col("o"), least=80_000).count() == 0


def test_preferences_take_turns(spark):
    rows = points(150, 8)
    df = table(spark, rows)
    goals = spark.createDataFrame([("a", 15)], "part string, goal long")
    got = distribution.spread_preferences(df, "part", goals, [(F.col("id") % 2 == 0, 30, "even", None), (F.lit(True), None, "rest", 2000)], F.col("o")).collect()
    first, m1 = search([r for r in rows if r[0] % 2 == 0], 4)  # 4.5, halves to even
    where = {r[0]: r[1:] for r in rows}
    second, m2 = search(rows, 11, 2000, [where[i] for i in first])
    assert sorted((r.id, r.tag, r.metres) for r in got) == sorted([(i, "even", m1) for i in first] + [(i, "rest", m2) for i in second])


def test_the_largest_goal(spark):
    df = table(spark, points(60, 1), "a").unionByName(table(spark, [(i + 500, *p) for i, *p in points(90, 2)], "b"))
    weights = spark.createDataFrame([("a", 1), ("b", 2)], "part string, weight long")
    fit = {r.part: r.n for r in distribution.capacities(df, "part", 9000.0, F.col("o")).collect()}
    assert fit == {"a": len(walk(points(60, 1), 9000.0)), "b": len(walk(points(90, 2), 9000.0))}
    total, goals = distribution.largest_goal(df, "part", weights, 9000.0, F.col("o"))
    shares = {r.part: r.goal for r in goals.collect()}
    assert all(shares[p] <= fit[p] for p in fit) and sum(shares.values()) == total or total < 215
    none, _ = distribution.largest_goal(df.limit(0), "part", weights, 9000.0, F.col("o"))
    assert none == 110_000 // 2**9  # ten totals tried, none fits
    easy, _ = distribution.largest_goal(df, "part", spark.createDataFrame([("a", 0)], "part string, weight long"), 9000.0, F.col("o"))
    assert easy == 110_000


@pytest.mark.parametrize("bounded", [4096, 0])
def test_even_goes_cell_by_cell(spark, bounded, monkeypatch):
    monkeypatch.setattr(distribution, "_BOUNDED", bounded)
    rows = points(200, 9, 1.0, 74.0)
    got = distribution.even(table(spark, rows), 12_000.0, F.col("o"))
    cell = lambda lat, lng: (math.floor((lng + 180) / 360 * 1024), math.floor((lat + 90) / 180 * 1024))
    cells, placed = {}, {}
    for r in rows:
        cells.setdefault(cell(*r[1:]), []).append(r)
    for c, group in cells.items():  # in the order of their first rows
        around = [p for (x, y), ps in placed.items() if (x, y) != c and abs(x - c[0]) <= 1 and abs(y - c[1]) <= 1 for p in ps]
        ids = set(walk(group, 12_000.0, around))
        placed[c] = [r[1:] for r in group if r[0] in ids]
    where = {p for ps in placed.values() for p in ps}
    assert {r.id for r in got.collect()} == {min(r[0] for r in rows if r[1:] == p) for p in where}


def test_density_goals_favour_sparse_cells(spark):
    rows = points(80, 1, 0.5) + [(1000 + i, 10.0, 10.0) for i in range(5)]
    got = {r.n: r.goal for r in distribution.density_goals(table(spark, rows), 100, 0.5).collect()}
    w = {n: 1.0 / n**0.5 * n for n in got}
    assert len(got) > 1 and all(g == round(100 * w[n] / sum(w.values())) for n, g in got.items())
