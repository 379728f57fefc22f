"""Registered queries of pivots over any two axes, games, vector search over crops, pages with totals, tags of samples, keys of numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.tagging import SOUTHERN, output_tags
from ..operators import asks, games, matching, outputs, pivots
from .catalog import _L, _hav, _query
from .selectors import Filter, select
from .typed import _S, survey

_SELECTIONS = {"east": "lng > 0", "named": "pano_id IS NOT NULL", "high zoom": "zoom >= 2 AND heading > 350", "none": "zoom > 99"}
_NAMED = " UNION ALL ".join(f"SELECT id, '{n}' AS row FROM locations WHERE {sql}" for n, sql in _SELECTIONS.items())
_FRAME = "(VALUES " + ", ".join(f"('{n}')" for n in _SELECTIONS) + ") v(row)"


@_query("g01_overlap", f"""{_L}, r AS ({_NAMED}), c AS (SELECT l.id, coalesce(CAST(t.tag AS VARCHAR), 'N/A') AS col FROM locations l LEFT JOIN location_tags t USING (id)),
x AS (SELECT row, col, count(*) AS n FROM r JOIN c USING (id) GROUP BY 1, 2), f AS (SELECT v.row, m.col FROM {_FRAME} CROSS JOIN (SELECT DISTINCT col FROM x) m)
SELECT f.row, f.col, coalesce(x.n, 0) AS n, coalesce((SELECT count(*) FROM r WHERE r.row = f.row), 0) AS row_total, CAST(sum(coalesce(x.n, 0)) OVER (PARTITION BY f.col) AS BIGINT) AS col_total FROM f LEFT JOIN x ON x.row = f.row AND x.col = f.col""")
def _g01_overlap(df):
    """Selections that overlap, one of them empty, against the tags of rows."""
    return pivots.cross(df, pivots.selections({n: F.expr(sql) for n, sql in _SELECTIONS.items()}), pivots.values(F.col("tags"), listed=True))


@_query("g01_selections", f"""{_L}, r AS ({_NAMED}), x AS (SELECT a.row, b.row AS col, count(*) AS n FROM r a JOIN r b USING (id) GROUP BY 1, 2), f AS (SELECT a.row, b.row AS col FROM {_FRAME.replace('v(row)', 'a(row)')} CROSS JOIN {_FRAME.replace('v(row)', 'b(row)')})
SELECT f.row, f.col, coalesce(x.n, 0) AS n, coalesce((SELECT count(*) FROM r WHERE r.row = f.row), 0) AS row_total, CAST(sum(coalesce(x.n, 0)) OVER (PARTITION BY f.col) AS BIGINT) AS col_total FROM f LEFT JOIN x ON x.row = f.row AND x.col = f.col""")
def _g01_selections(df):
    """Selections against each other."""
    axis = pivots.selections({n: F.expr(sql) for n, sql in _SELECTIONS.items()})
    return pivots.cross(df, axis, axis)


@_query("g02_binned", f"""{_L}, e AS (SELECT *, min(heading) OVER () AS least, (max(heading) OVER () - min(heading) OVER ()) / 10 AS step, event_type AS col FROM locations), r AS (SELECT *, CAST(CAST(least(floor((heading - least) / step), 9) AS BIGINT) AS VARCHAR) AS row FROM e),
x AS (SELECT row, col, count(*) AS n FROM r GROUP BY 1, 2), f AS (SELECT CAST(b AS VARCHAR) AS row, col FROM (SELECT unnest(range(10)) AS b) CROSS JOIN (SELECT DISTINCT col FROM x))
SELECT f.row, f.col, coalesce(x.n, 0) AS n, coalesce((SELECT count(*) FROM r WHERE r.row = f.row), 0) AS row_total, CAST(sum(coalesce(x.n, 0)) OVER (PARTITION BY f.col) AS BIGINT) AS col_total FROM f LEFT JOIN x ON x.row = f.row AND x.col = f.col""")
def _g02_binned(df):
    """A number of more than a hundred different values falls into ten bins."""
    return pivots.cross(df, pivots.numbers(df, "heading"), pivots.values(F.col("event_type")))


_GAMES = f"""{_L}, g AS (SELECT *, (id - 1) // 5 AS game_id, CASE WHEN id % 23 <> 0 THEN concat('c', id % 6) END AS truth, concat('c', CASE WHEN id % 4 = 0 THEN 9 ELSE id % 6 END) AS guessed, {_hav('lat', 'lng', '(lat + id * 7 % 40 * 0.00002)', 'lng')} AS d FROM locations),
r AS (SELECT game_id, concat('map', game_id % 4) AS map, concat('mode', game_id % 3) AS mode, game_id * 600 AS finished_at, id AS "at", truth, guessed, CASE WHEN game_id % 5 = 0 THEN 'off' ELSE 'country' END AS streak_mode, CASE WHEN d <= 25 THEN 5000.0 ELSE floor(5000 * pow(0.99866017, d / (185.34781 * ln(0.99866017) * -1e4)) + 0.5) END AS score FROM g),
p AS (SELECT game_id, map, mode, finished_at, count(*) AS rounds, sum(score) AS score FROM r GROUP BY 1, 2, 3, 4)"""


def _rounds(df):
    """Each five rows are a game whose guesses lie up to some metres off."""
    game = F.floor((F.col("id") - 1) / 5)
    off = geo.haversine_m(F.col("lat"), F.col("lng"), F.col("lat") + F.col("id") * 7 % 40 * 0.00002, F.col("lng"))
    names = lambda text, c: F.concat(F.lit(text), c.cast("string"))
    return df.select(
        game.alias("game_id"), names("map", game % 4).alias("map"), names("mode", game % 3).alias("mode"), (game * 600).alias("finished_at"), F.col("id").alias("at"), geo.score(off).alias("score"),
        F.when(F.col("id") % 23 != 0, names("c", F.col("id") % 6)).alias("truth"), names("c", F.when(F.col("id") % 4 == 0, 9).otherwise(F.col("id") % 6)).alias("guessed"),
        F.when(game % 5 == 0, "off").otherwise("country").alias("streak_mode"),
    )


_TALLY = "count(*) AS games, CAST(sum(rounds) AS BIGINT) AS rounds, round(sum(score) / sum(rounds), 6) AS average_score, max(score) AS best_game"


def _rounded(df):
    return df.withColumn("average_score", F.round("average_score", 6))


@_query("g14_by_map", f"{_GAMES} SELECT map, {_TALLY} FROM p GROUP BY map")
def _g14_map(df):
    return _rounded(games.by(games.games(_rounds(df)), "map"))


@_query("g14_by_mode", f"{_GAMES} SELECT mode, {_TALLY} FROM p GROUP BY mode")
def _g14_mode(df):
    return _rounded(games.by(games.games(_rounds(df)), "mode"))


@_query("g14_countries", f"{_GAMES} SELECT truth AS country, count(*) AS rounds, count(*) FILTER (WHERE truth = guessed) AS hits, round(avg(score), 6) AS average_score FROM r WHERE truth IS NOT NULL GROUP BY 1")
def _g14_countries(df):
    return _rounded(games.countries(_rounds(df)))


@_query("g14_trend", f"{_GAMES} SELECT game_id, finished_at, map, round(score / rounds, 6) AS average_score FROM p")
def _g14_trend(df):
    return _rounded(games.trend(games.games(_rounds(df))))


@_query("g14_overall", f"""{_GAMES}, k AS (SELECT game_id FROM r GROUP BY 1 HAVING bool_and(truth IS NOT NULL) AND bool_and(streak_mode <> 'off')), i AS (SELECT *, sum(CASE WHEN coalesce(truth = guessed, false) THEN 0 ELSE 1 END) OVER (PARTITION BY game_id ORDER BY "at") AS island FROM r WHERE game_id IN (SELECT game_id FROM k)), b AS (SELECT count(*) AS n FROM i WHERE truth = guessed GROUP BY game_id, island)
SELECT {_TALLY}, (SELECT count(*) FROM r WHERE score = 5000) AS perfect_rounds, CASE WHEN EXISTS (SELECT 1 FROM k) THEN coalesce((SELECT max(n) FROM b), 0) END AS best_streak FROM p""")
def _g14_overall(df):
    return _rounded(games.overall(_rounds(df)))


_CROPS = "WITH c AS (SELECT vec_id, vec_id // 4 AS place, embedding FROM embeddings), e AS (SELECT place, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM c)"
_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda k: CAST({a}[k] AS DOUBLE) * CAST({b}[k] AS DOUBLE)))"


def _crops(spark, d):
    """Each four vectors are the crops of a place."""
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.floor(F.col("vec_id") / 4).alias("place"), "vec_id", "embedding")


@_query("g16_images", f"""{_CROPS}, u AS (SELECT place, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS k FROM e WHERE place < 5), m AS (SELECT place, k, avg(x) AS x FROM u GROUP BY 1, 2), q AS (SELECT place AS query_id, list(x / l ORDER BY k) AS query FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY place)) AS l FROM m) GROUP BY place),
s AS (SELECT query_id, place, round(max({_DOT.format(a='v', b='query')}), 4) AS score FROM e JOIN q ON place <> query_id GROUP BY 1, 2)
SELECT query_id, place, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank FROM s) WHERE rank <= 10""")
def _g16_images(spark, d):
    """Places like the first five, by all their crops."""
    crops = _crops(spark, d)
    return matching.search(crops, "place", "embedding", matching.image_queries(crops.filter("place < 5"), "place", "embedding"), k=10, exclude_self=True)


@_query("g16_texts", f"""{_CROPS}, q AS (SELECT vec_id AS query_id, embedding AS query FROM c WHERE vec_id IN (1, 6, 11)), s AS (SELECT query_id, place, round(1.0 / (1.0 + exp(-(max({_DOT.format(a='v', b='query')}) * 8.0 - 2.0))), 4) AS score FROM e CROSS JOIN q GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank FROM s WHERE score >= 0.3""")
def _g16_texts(spark, d):
    """Probabilities of at least 0.3 that a place fits a vector."""
    crops = _crops(spark, d)
    queries = crops.filter(F.col("vec_id").isin(1, 6, 11)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return matching.search(crops, "place", "embedding", queries, threshold=0.3, score=matching.probability(8.0, -2.0))


@_query("e08_total", f"{_L} SELECT id, created_at, (SELECT count(*) FROM locations WHERE pano_id IS NOT NULL) AS total FROM locations WHERE pano_id IS NOT NULL ORDER BY created_at DESC, id LIMIT 50 OFFSET 100")
def _e08_total(df):
    return asks.page(df.filter("pano_id IS NOT NULL").select("id", "created_at"), [F.desc("created_at"), "id"], 50, 100)


_TAKEN = "CASE id % 4 WHEN 0 THEN concat('2020-', lpad(CAST(id % 12 + 1 AS {s}), 2, '0')) WHEN 1 THEN concat('2019-', lpad(CAST(id % 12 + 1 AS {s}), 2, '0'), '-15') WHEN 2 THEN concat('2018-', lpad(CAST(id % 12 + 1 AS {s}), 2, '0'), '-01T10:00') ELSE CAST(id AS {s}) END"


@_query("b13_months", f"{_L}, t AS (SELECT id, {_TAKEN.format(s='VARCHAR')} AS taken FROM locations), d AS (SELECT id, CASE WHEN length(taken) >= 10 THEN substr(taken, 6, 5) ELSE concat(substr(taken, 6, 2), '-01') END AS day FROM t WHERE length(taken) >= 7 AND substr(taken, 5, 1) = '-') SELECT id FROM d WHERE day >= '11-10' OR day <= '02-01'")
def _b13_months(df):
    """Days of the year in texts; a month alone is its first day."""
    return select(df.withColumn("taken", F.expr(_TAKEN.format(s="STRING"))), Filter("taken", "between_anyyear", ("11-10", "02-01"))).select("id")


@_query("h11_keys", f"{_L} SELECT id, CASE WHEN id % 3 = 0 THEN CAST(CAST(id AS HUGEINT) * 1000000000000 AS VARCHAR) WHEN id % 3 = 1 THEN concat('-', CAST(id AS VARCHAR), '.5') ELSE concat('0.0000', CAST(id AS VARCHAR), '1') END AS key FROM locations")
def _h11(df):
    number = F.when(F.col("id") % 3 == 0, F.col("id") * 1e12).when(F.col("id") % 3 == 1, -F.col("id") - 0.5).otherwise(F.concat(F.lit("0.0000"), F.col("id").cast("string"), F.lit("1")).cast("double"))
    return df.select("id", asks.number_key(number).alias("key"))


_SOUTH = ", ".join(f"'{c}'" for c in SOUTHERN)
_RANGE = "concat('{n}[', lpad(CAST(({v} // {k}) * {k} AS VARCHAR), 4, ' '), '-', lpad(CAST(({v} // {k} + 1) * {k} - 1 AS VARCHAR), 4, ' '), ']{u}')"
_TAGS = [
    "CountryCode", "County", "YearMonth", "Season", "Heading-45", "Roads100-10", "ClosestCoast-500", "Elevation250", "Elevation", "IsScout", "HighwayType",
    "HighwayTypeCount", "DescriptionLength", "WayId", "Unknown", "Month",
]


@_query("i20_tags", f"""{_S}, t AS (SELECT id, [CountryCode, County, concat(Year, '-', lpad(CAST(Month AS VARCHAR), 2, '0')), ['Winter', 'Spring', 'Summer', 'Autumn'][(Month % 12 // 3 + CASE WHEN CountryCode IN ({_SOUTH}) THEN 2 ELSE 0 END) % 4 + 1],
{_RANGE.format(n='Heading', v='CAST(floor(Heading) AS BIGINT)', k=45, u='')}, {_RANGE.format(n='Roads100', v='Roads100', k=10, u='')}, CASE WHEN ClosestCoast IS NOT NULL THEN {_RANGE.format(n='ClosestCoast', v='ClosestCoast', k=500, u='')} END, CASE WHEN Elevation IS NOT NULL THEN {_RANGE.format(n='Elevation', v='Elevation', k=250, u='m')} END, CAST(Elevation AS VARCHAR),
CASE WHEN IsScout THEN 'IsScout-Yes' ELSE 'IsScout-No' END, CASE WHEN HighwayType % 2 = 1 THEN 'Motorway' END, CASE WHEN HighwayType // 2 % 2 = 1 THEN 'Trunk' END, CASE WHEN HighwayType // 4 % 2 = 1 THEN 'Primary' END, CASE WHEN HighwayType // 8 % 2 = 1 THEN 'Secondary' END,
concat('HighwayTypeCount-', bit_count(HighwayType)), concat('DescriptionLength-', coalesce(CAST(DescriptionLength AS VARCHAR), 'null')), concat('WayId-', id, '|', id % 3), CAST(Month AS VARCHAR)] AS tags FROM s)
SELECT id, array_to_string(list_filter(tags, lambda x: x IS NOT NULL), ';') AS tags FROM t""")
def _i20(df):
    """The tags that places are written out with."""
    s = survey(df)
    columns = {c: F.col(c) for c in s.columns} | {"Heading": F.floor("Heading")}
    return s.select("id", F.array_join(output_tags(_TAGS, columns), ";").alias("tags"))


@_query("q08_headings", f"{_L}, h AS (SELECT *, heading - pitch * 31 AS t, [heading, pitch * 5, zoom * 90] AS hs FROM locations), g AS (SELECT id, t, unnest(hs) AS h, unnest([1, 2, 3]) AS k FROM h), n AS (SELECT id, first(h ORDER BY abs((h - t + 180) - 360 * floor((h - t + 180) / 360) - 180), k) AS nearest FROM g GROUP BY id) SELECT id, (t + 180) - 360 * floor((t + 180) / 360) - 180 AS wrapped, t + 360 - 360 * floor((t + 360) / 360) - 180 AS reversed, nearest FROM h JOIN n USING (id)")
def _q08_headings(df):
    """Headings within half a turn, reversed, and the one next to them. (A column of the select named heading would hide the table's inside lambdas.)"""
    t = F.col("heading") - F.col("pitch") * 31
    return df.select("id", geo.wrap_degrees(t).alias("wrapped"), geo.reversed_heading(t).alias("reversed"), geo.nearest_heading(F.array(F.col("heading"), F.col("pitch") * 5, F.col("zoom") * 90), t).alias("nearest"))


def _box(of: str) -> str:
    return {"a": "CAST(id * 97 % 360 - 180 AS DOUBLE)", "b": "CAST(id * 61 % 360 - 180 AS DOUBLE)"}[of]


_WRAP = "(({x}) - ({m}) - 360.0 * floor((({x}) - ({m})) / 360.0) + ({m}))"


@_query("q08_boxes", f"""{_L}, x AS (SELECT id, {_box('a')} AS aw, {_WRAP.format(x=_box('a') + ' + id % 100', m='-180.0')} AS ae, {_box('b')} AS bw, {_WRAP.format(x=_box('b') + ' + id % 230', m='-180.0')} AS be FROM locations),
w AS (SELECT *, ae - aw + CASE WHEN ae < aw THEN 360.0 ELSE 0.0 END AS wa, be - bw + CASE WHEN be < bw THEN 360.0 ELSE 0.0 END AS wb FROM x), r AS (SELECT *, greatest(wa, {_WRAP.format(x='bw - aw', m='0.0')} + wb) AS ra, greatest(wb, {_WRAP.format(x='aw - bw', m='0.0')} + wa) AS rb FROM w)
SELECT id, CASE WHEN least(ra, rb) >= 360 THEN -180.0 WHEN ra <= rb THEN aw ELSE bw END AS west, CASE WHEN least(ra, rb) >= 360 THEN 180.0 ELSE {_WRAP.format(x='CASE WHEN ra <= rb THEN aw ELSE bw END + least(ra, rb)', m='-180.0')} END AS east FROM r""")
def _q08_boxes(df):
    """The least box around two, over the antimeridian if that is shorter."""

    def box(side, width):
        west = F.expr(_box(side))
        return F.struct(west.alias("west"), F.lit(0.0).alias("south"), geo.wrap_degrees(west + F.col("id") % width).alias("east"), F.lit(1.0).alias("north"))

    out = geo.joined_boxes(box("a", 100), box("b", 230))
    return df.select("id", out["west"].alias("west"), out["east"].alias("east"))


@_query("q13_written", f"""{_S}, o AS (SELECT *, id % 700 AS node FROM s), f AS (SELECT node, min(id) AS id FROM o GROUP BY node), r AS (SELECT o.*, l.pano_id, CAST(round_even(o.Heading, 0) AS BIGINT) AS h FROM o JOIN f USING (id) JOIN locations l USING (id))
SELECT node, lat, CAST((CASE WHEN CountryCode = 'FI' THEN h * 2 - 500 WHEN CountryCode = 'NO' THEN DrivingDirectionAngle ELSE h + 180 END) % 360 AS DOUBLE) AS heading, CASE WHEN CountryCode IN ('FI', 'FR') THEN pano_id END AS pano_id, concat(CountryCode, ';', Month, CASE WHEN id % 2 = 0 THEN ';mine' ELSE '' END) AS tags FROM r""")
def _q13_written(df):
    """One row a node with headings by country, panoramas of two countries, and tags."""
    more = df.select("id", "pano_id", (F.col("id") % 700).alias("node"), F.when(F.col("id") % 2 == 0, "mine").alias("tag"))
    out = outputs.written(survey(df).join(more, "id"), "id", ["CountryCode", "Month"], "Heading + 180", {"FI": "Heading * 2 - 500", "NO": "DrivingDirectionAngle"}, ["FI", "FR"])
    return out.select("node", "lat", "heading", "pano_id", F.array_join("tags", ";").alias("tags"))
