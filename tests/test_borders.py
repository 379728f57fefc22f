"""Points exactly on the edges of polygons, as the SQL of the queries has them."""

from terravane.operators import spatial
from terravane.plans import catalog
from terravane.plans.selectors import Polygon, select

EDGES = [(lat, lng) for lat in (-30.0, -10.0, 0.0, 10.0, 40.0) for lng in (-60.0, -20.0, 0.0, 20.0, 60.0)]


def table(spark):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(EDGES)], "id long, lat double, lng double")


def inside(lat, lng, ring):
    ys, xs = [y for _, y in ring], [x for x, _ in ring]
    return min(ys) < lat <= max(ys) and min(xs) <= lng < max(xs)


def test_b05_polygon_on_its_edges(spark):
    df = table(spark)
    got = {r.id for r in select(df, Polygon((catalog.BOX, catalog.HOLE))).collect()}
    assert got == {i for i, p in enumerate(EDGES) if inside(*p, catalog.BOX) and not inside(*p, catalog.HOLE)}
    where = catalog._SQL["b05_polygon"].split(" WHERE ")[-1]
    assert got == {r.id for r in df.filter(where).collect()}


def test_c07_areas_on_their_edges(spark):
    out = spatial.classify(table(spark), [("in", [list(catalog.HOLE)]), ("out", [list(catalog.BOX)])])
    assert {r.id: r.area for r in out.collect()} == {i: "in" if inside(*p, catalog.HOLE) else "out" if inside(*p, catalog.BOX) else None for i, p in enumerate(EDGES)}
