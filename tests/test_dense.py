"""Components and duplicates of dense places against plain ones."""

import random

from pyspark.sql import functions as F

from terravane.operators import asks, neighbours, spatial


def test_groups_equal_those_of_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(44.999, 45.002), rng.uniform(6.999, 7.003)) for i in range(200)] + [(1000 + i, rng.uniform(-0.001, 0.001), rng.choice([179.9995, -179.9995]) + rng.uniform(-0.0005, 0.0005)) for i in range(50)]
    rows += [(2000 + i, 89.9999, lng) for i, lng in enumerate((0.0, 90.0, 179.0))] + [(3000, float("nan"), 7.0), (3001, 45.0, float("nan"))] + [(4000 + k, *rows[k][1:]) for k in range(5)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double")
    parent = {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    edges = [(r.a, r.b) for r in spatial.pairs(df, 25.0).collect()]
    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {i: root(i) for e in edges for i in e}
    assert {r.id: r.group for r in spatial.groups(df, 25.0).collect()} == want
    assert {r.id for r in spatial.duplicate_ids(df, 25.0).collect()} == set(want)
    exact = {r.id: r.group for r in spatial.groups(df, 0).collect()}
    assert exact == {i: k for k in range(5) for i in (k, 4000 + k)}


def test_one_place_with_many_rows_is_quick(spark):
    df = spark.range(60_000).select("id", (F.lit(45.0) + F.rand(1) * 0.0001).alias("lat"), (F.lit(7.0) + F.rand(2) * 0.0001).alias("lng"))
    assert spatial.groups(df, 25.0).filter("group = 0").count() == 60_000
    assert spatial.duplicate_ids(df, 25.0).count() == 60_000


def test_neighbours_carry_requested_fields(spark):
    df = spark.createDataFrame([(1, 45.0, 7.0, "a"), (2, 45.0001, 7.0, "b"), (3, 46.0, 7.0, "c")], "id long, lat double, lng double, name string")
    got = {r.id: [(n.id, round(n.metres, 1), n.name) for n in r.neighbours] for r in spatial.neighbours(df, 50.0, ["name"]).collect()}
    assert got == {1: [(1, 0.0, "a"), (2, 11.1, "b")], 2: [(2, 0.0, "b"), (1, 11.1, "a")], 3: [(3, 0.0, "c")]}


def test_a_null_condition_is_no_match(spark):
    df = spark.createDataFrame([(1, 45.0, 7.0, None), (2, 45.0001, 7.0, 5)], "id long, lat double, lng double, v int")
    matches = F.col("i_v") > 3
    for bound, want in (("some", [1]), ("none", [2])):
        assert [r.id for r in neighbours.neighbour_filter(df, 50.0, bound, matches=matches).collect()] == want


def test_spaced_ids_say_their_spacing(spark):
    df = spark.createDataFrame([(i, 45.0 + i * 0.01, 7.0) for i in range(30)], "id long, lat double, lng double")
    got = asks.spaced_ids(df, 5, 1).collect()
    assert len(got) == 5 and {r.metres for r in got} == {got[0].metres} and got[0].metres > 25
