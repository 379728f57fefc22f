"""Pivots, games, vector search, tags, keys and errors on small cases."""

import pytest
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.functions.expr import ExpressionError, compile_expression, number
from terravane.functions.filters import FilterError, compile_number
from terravane.functions.tagging import output_tags, ranged, season
from terravane.operators import asks, games, matching, outputs, pivots


def test_pivot_totals_and_missing_values(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"], "x"), (2, ["a"], None), (3, None, "x"), (4, [], "y")], "id long, tags array<string>, kind string")
    cells = pivots.cross(df, pivots.values(F.col("tags"), True), pivots.values(F.col("kind")))
    assert {(r.row, r.col): (r.n, r.row_total, r.col_total) for r in cells.collect()} == {
        ("a", "x"): (1, 2, 3), ("b", "x"): (1, 1, 3), ("a", "N/A"): (1, 2, 1), ("N/A", "x"): (1, 2, 3), ("N/A", "y"): (1, 2, 1),
    }
    kept = pivots.shares(pivots.without_na(cells)).collect()
    assert {(r.row, r.col): (r.n, r.row_total, r.col_total, r.row_share, r.col_share) for r in kept} == {("a", "x"): (1, 1, 2, 1.0, 0.5), ("b", "x"): (1, 1, 2, 1.0, 0.5)}


def test_pivot_of_selections_and_bins(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(200)] + [(200, None)], "id long, v double")
    cells = pivots.cross(df, pivots.selections({"low": F.col("v") < 20, "even": F.col("id") % 2 == 0, "no": F.lit(False)}), pivots.numbers(df, "v")).collect()
    assert len(cells) == 3 * 11
    at = {(r.row, r.col): r.n for r in cells}
    assert at["low", "0"] == 20 and at["low", "9"] == 0 and at["even", "N/A"] == 1 and at["no", "3"] == 0
    assert {r.row: r.row_total for r in cells} == {"low": 20, "even": 101, "no": 0}
    empty = pivots.cross(df.filter("false"), pivots.selections({"a": F.lit(True)}), pivots.selections({"b": F.lit(True), "c": F.lit(True)})).collect()
    assert {tuple(r) for r in empty} == {("a", "b", 0, 0, 0), ("a", "c", 0, 0, 0)}
    assert pivots.cross(df.filter("false"), pivots.values(F.col("id")), pivots.values(F.col("v"))).count() == 0
    assert pivots.numbers(df.filter("v < 5"), "v").fixed == () and len(pivots.numbers(df.filter("v < 50"), "v", 7).fixed) == 7


def test_games(spark):
    one = lambda g, at, score, truth, guessed, mode="country": (g, "m", "mode", g, at, score, truth, guessed, mode)
    schema = "game_id long, map string, mode string, finished_at long, at long, score double, truth string, guessed string, streak_mode string"
    rounds = spark.createDataFrame([one(1, 1, 5000.0, "fi", "fi"), one(1, 2, 0.0, "no", "no"), one(1, 3, 10.0, "fi", None), one(2, 4, 5000.0, "fi", "fi", "off"), one(3, 5, 20.0, None, None)], schema)
    got = games.overall(rounds).first()
    assert (got.games, got.rounds, got.average_score, got.best_game, got.perfect_rounds, got.best_streak) == (3, 5, 2006.0, 5010.0, 2, 2)
    assert {tuple(r) for r in games.countries(rounds).collect()} == {("fi", 3, 2, 10010 / 3), ("no", 1, 1, 0.0)}
    assert [r.game_id for r in games.trend(games.games(rounds)).collect()] == [1, 2, 3]
    none = games.overall(rounds.filter("false")).first()
    assert none.games == 0 and none.best_game is None and none.best_streak is None
    assert games.overall(rounds.filter("game_id = 2")).first().best_streak is None
    missed = spark.createDataFrame([one(1, 1, 1.0, "fi", "no")], schema)
    assert games.overall(missed).first().best_streak == 0


def test_vector_search_over_crops(spark):
    crops = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8]), (3, None), (4, [-1.0, 0.0]), (5, [0.6, 0.8])], "place long, v array<double>")
    queries = matching.image_queries(crops, "place", "v")
    told = {r.query_id: r.query for r in queries.collect()}
    assert told[1] == pytest.approx([0.5**0.5] * 2) and 3 not in told
    got = matching.search(crops, "place", "v", queries.filter("query_id = 1"), k=2, exclude_self=True).orderBy("rank").collect()
    assert [(r.place, r.score) for r in got] == [(2, 0.9899), (5, 0.9899)]
    sure = matching.search(crops, "place", "v", queries.filter("query_id = 2"), threshold=0.5, score=matching.probability(10.0, -5.0))
    assert {(r.place, r["rank"]) for r in sure.collect()} == {(2, 1), (5, 2), (1, 3)}
    assert matching.search(crops, "place", "v", queries.filter("false")).count() == 0
    with pytest.raises(ValueError):
        matching.search(crops, "place", "v", spark.range(300).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("query")))


def test_tags(spark):
    df = spark.createDataFrame([(-5, 12345, "NZ", 1, 0b10000001)], "a int, b int, c string, m int, h int")
    got = df.select(ranged("A", F.col("a"), "45").alias("a"), ranged("B", F.col("b"), "10", "m").alias("b"), ranged("A", F.col("a"), "x").alias("x"), season(F.col("c"), F.col("m")).alias("s"), season(F.lit(None).cast("string"), F.lit(13)).alias("none")).first()
    assert tuple(got) == ("A[   0-  44]", "B[12340-12349]m", None, "Summer", None)
    tags = df.select(output_tags(["HighwayType", "HighwayTypeCount", "Roads10", "Roads10-5"], {"HighwayType": F.col("h"), "Roads10": F.col("a")}, F.lit("mine")).alias("t"), output_tags([], {}).alias("n")).first()
    assert tags.t == ["Motorway", "Primary_link", "HighwayTypeCount-2", "Roads10--5", "Roads10[  -5-  -1]", "mine"] and tags.n is None


def test_number_keys(spark):
    cases = {0.0: "0", -0.0: "0", 1.0: "1", -1.5: "-1.5", 1e7: "10000000", 123456789.125: "123456789.125", 1e20: "100000000000000000000", 1e21: "1e+21", 1.5e22: "1.5e+22", 0.001: "0.001", 0.00012: "0.00012", 0.000001: "0.000001", 1e-7: "1e-7", -2.5e-8: "-2.5e-8"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "v double, want string")
    assert df.filter(asks.number_key(F.col("v")) != F.col("want")).collect() == []
    assert spark.range(1).select(asks.number_key(F.lit(float("-inf"))), asks.number_key(F.lit(None))).first()[:] == ("-Infinity", None)


def test_texts_as_numbers(spark):
    cases = {"1": 1.0, " 1": None, "1 ": None, "1\n": None, "1d": None, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, ".": None, "Infinity": float("inf"), "-inF": float("-inf"), "": None, "0x1": None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "v string, want double")
    assert df.filter(~number(F.col("v"), "string").eqNullSafe(F.col("want"))).collect() == []
    assert str(spark.range(1).select(number(F.lit("NAN"), "string")).first()[0]) == "nan"


@pytest.mark.parametrize(
    "text, kind, at",
    [
        ("1 + 2.", "invalidNumber", 4), ('x == "a', "unterminatedString", 5), ("1 # 2", "unexpectedCharacter", 2), ("(1", "expectedSymbol", 2),
        ("1 < 2 < 3", "chainedComparison", 6), ("1 +", "unexpectedEnd", 3), ("", "unexpectedEnd", 0), ("< 2", "missingLeftOperand", 0),
        ("has(1)", "hasTakesFieldName", 4), ("nope(1)", "unknownFunction", 0), ("mod(1)", "wrongArgCount", 0), ("max()", "wrongArgCount", 0),
        ("if(1, 2)", "wrongArgCount", 0), ("* 2", "unexpectedToken", 0), ("1 2", "trailingToken", 2), ("1e5", "trailingToken", 1), ("é", "unexpectedCharacter", 0),
    ],
)
def test_kinds_of_expression_errors(text, kind, at):
    with pytest.raises(ExpressionError) as e:
        compile_expression(text, lambda n: (F.lit(1.0), "double"))
    assert (e.value.kind, e.value.at) == (kind, at)


def test_texts_with_escapes_and_pages(spark):
    df = spark.createDataFrame([(1, 'a"b'), (2, "x")], "id long, name string")
    hit = compile_expression(r'name == "a\"b"', lambda n: (F.col(n), "string"))
    assert [r.id for r in df.filter(hit == 1).collect()] == [1]
    assert [tuple(r) for r in asks.page(df, [F.desc("id")], 1, 1).collect()] == [(1, 'a"b', 2)] and asks.page(df, ["id"], 5, 9).count() == 0


def test_headings_and_boxes(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert value(geo.wrap_degrees(lit(180.0))) == -180 and value(geo.wrap_degrees(lit(-541.0))) == 179 and value(geo.reversed_heading(lit(10.0))) == -170
    assert value(geo.heading_gap(lit(350.0), lit(-350.0))) == 20
    assert value(geo.nearest_heading(F.array(lit(10.0), lit(350.0), lit(180.0)), lit(0.0))) == 10 and value(geo.nearest_heading(F.array().cast("array<double>"), lit(0.0))) is None
    box = lambda w, s, e, n: F.struct(*(lit(float(x)).alias(k) for k, x in zip(("west", "south", "east", "north"), (w, s, e, n))))
    assert tuple(value(geo.joined_boxes(box(170, 0, 175, 1), box(-175, -5, -170, 0)))) == (170, -5, -170, 1)
    assert tuple(value(geo.joined_boxes(box(-10, 0, 10, 1), box(0, 0, 5, 1)))) == (-10, 0, 10, 1)
    assert tuple(value(geo.joined_boxes(box(-170, 0, 100, 1), box(90, 0, -160, 1)))) == (-180, 0, 180, 1)
    ring = lambda *ps: F.array(*(F.struct(lit(float(x)).alias("lng"), lit(float(y)).alias("lat")) for x, y in ps))
    assert [tuple(p) for p in value(geo.densified(ring((-170, 0), (190, 6), (0, 0))))] == [(-170, 0), (-50, 2), (70, 4), (190, 6), (95, 3), (0, 0)]
    assert [tuple(p) for p in value(geo.densified(ring((0, 0), (179, 1))))] == [(0, 0), (179, 1)]


def test_places_as_written(spark):
    schema = "node long, at long, Lat double, Lng double, Heading double, DrivingDirectionAngle int, CountryCode string, Month int, pano_id string, tag string"
    rows = [(1, 2, 0.0, 0.0, 1.5, 9, "FI", 3, "late", None), (1, 1, 5.0, 6.0, 2.5, 9, "FI", 4, "first", ""), (2, 3, 0.0, 0.0, 400.0, 7, None, 3, "p", "own")]
    df = spark.createDataFrame(rows, schema)
    got = {r.node: r for r in outputs.written(df, "at", ["Month"], "Heading + Elevation", {"FI": "0 - Heading - 359 + Roads10"}, ["FI"], zoom=1.0).collect()}
    assert tuple(got[1]) == (1, 5.0, 6.0, -1.0, 1.0, None, "first", ["4"])
    assert got[2].heading is None and got[2].pano_id is None and got[2].tags == ["3", "own"]
    plain = {r.node: r for r in outputs.written(df, "at", pano_countries=["*"]).collect()}
    assert (plain[1].heading, plain[2].heading, plain[2].pano_id, plain[1].tags) == (2.0, 40.0, "p", None)
    assert outputs.written(df.filter("false"), "at").count() == 0
    for text in ("Heading gt 1", "Lat + 1", "Heading Heading", ""):
        with pytest.raises(FilterError):
            compile_number(text, {"Heading": ("int", F.lit(1)), "Lat": ("double", F.lit(1.0))})
