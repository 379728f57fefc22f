"""What SQL can't show: sequential rules against brute force, errors, procedures, intake."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terravane.functions import filters
from terravane.operators import analytics, history, intake, neighbours, procedures, search, work


def _metres2(a, b):
    x = math.radians(b[2] - a[2]) * math.cos(math.radians(a[1]))
    return (x * x + math.radians(b[1] - a[1]) ** 2) * 6371000.0**2


def _near(rows, d):
    return {a[0]: [b[0] for b in rows if b[0] != a[0] and min(_metres2(a, b), _metres2(b, a)) <= d * d] for a in rows}


def _relevance(rows, d):
    near, by, gone = _near(rows, d), {r[0]: r for r in rows}, set()
    for i in sorted(by):
        if i in gone:
            continue
        cluster = [i, *(j for j in near[i] if j not in gone)]
        if len(cluster) > 1:
            best = max(cluster, key=lambda j: (by[j][3], -by[j][4], -j))
            gone |= set(cluster) - {best}
    return gone


def _thinning(rows, d):
    near = {k: set(v) for k, v in _near(rows, d).items()}
    gone = set()
    while any(near.values()):
        i = max(near, key=lambda k: (len(near[k]), k))
        for j in near.pop(i):
            near[j].discard(i)
        gone.add(i)
    return gone


@pytest.mark.parametrize("metres, brute", [(20.0, _relevance), (60.0, _thinning)])
def test_pruning_is_the_sequential_rule(spark, metres, brute):
    rnd = random.Random(5)
    rows = [(i, rnd.random() * 0.002, rnd.random() * 0.002, float(rnd.randrange(3)), rnd.randrange(4)) for i in range(120)]
    rows += [(200 + i, 0.001, 0.001, 0.0, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double, s double, created_at long")
    assert {r.id for r in neighbours.pruned(df, metres, F.col("s")).collect()} == brute(rows, metres)


def test_filter_errors_and_names(spark):
    props = {"Heading": ("long", F.lit(1)), "Kind": ("text", F.lit("a"))}
    for text, at in (("Heding gt 1", 0), ("Heading gt", 10), ("Heading gt 1 )", 13), ("Heading # 1", 8), ("Kind gt 1", 5), ("Heading + 1", 11), ("Kind - 1 eq 2", 5), ("(Heading eq 1", 13)):
        with pytest.raises(filters.FilterError) as e:
            filters.compile_filter(text, props)
        assert e.value.at == at, text
    with pytest.raises(filters.FilterError, match="Heading is"):
        filters.compile_filter("Heding gt 1", props)
    assert filters.expanded("$$a or 1 eq 1", {"a": "$$b", "b": "x eq 2"}) == "((x eq 2)) or 1 eq 1"
    with pytest.raises(filters.FilterError):
        filters.expanded("$$a", {"a": "$$a"}, most=50)


def test_filters_divide_and_wrap(spark):
    one = spark.range(1)
    value = lambda t: one.select(filters.compile_filter(t, {"A": ("long", F.lit(-7).cast("long")), "N": ("long", F.lit(None).cast("long"))})).first()[0]
    assert value("A / 2 eq -3") and value("A modulo 3 eq -1") and value("9223372036854775807 + 1 lt 0")
    assert value("A / 0 eq null") and not value("N lt 1") and value("N eq null") and not value("N gte 0 or N lt 0")


def test_procedure_order_skip_and_failure(spark):
    double = procedures.Provider("double", {"b": "double"}, ("a",), lambda rows: pd.DataFrame({"b": rows["a"] * 2}))
    plus = procedures.Provider("plus", {"c": "double"}, ("b",), lambda rows: pd.DataFrame({"c": rows["b"] + 1}))
    registry = procedures.Registry({"plus": plus, "double": double})
    assert [p.name for p in registry.order(["plus", "double"])] == ["double", "plus"]
    df = spark.createDataFrame([(1, 2.0, None), (2, None, None), (3, 5.0, 7.0)], "id long, a double, b double")
    out = {r.id: (r.b, r.c, r.double_status, r.plus_status) for r in procedures.run(df, registry, ["plus", "double"]).collect()}
    assert out == {1: (4.0, 5.0, "done", "done"), 2: (None, None, "failed", "failed"), 3: (7.0, 8.0, "skipped", "done")}


def test_sniffing_and_shapes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n  [1]")
    (tmp_path / "b.txt").write_text("lat,lng\n1,2")
    assert intake.sniff(spark, str(tmp_path / "a.txt")) == "json" and intake.sniff(spark, str(tmp_path / "b.txt")) == "csv"
    df = spark.createDataFrame([(1, "p", 2, [1], "{}")], "id long, pano_id string, flags long, tags array<long>, extra string")
    assert set(intake.shaped(df, "mapmaking").columns) == {"id", "pano_id", "flags", "tags"}
    assert intake.shaped(df, "local").columns == df.columns


def test_open_column_keeps_nested_values(spark):
    df = spark.createDataFrame([(1, '{"k":1.5,"o":{"a":[1,2]},"s":"x"}', None), (2, None, 5)], "id long, extra string, modified_at long")
    rows = {r.id: r for r in work.set_open(df, F.lit(True), "m", '"y"', 9).collect()}
    assert rows[1].extra == '{"k":1.5,"o":{"a":[1,2]},"s":"x","m":"y"}' and rows[1].modified_at == 9
    assert rows[2].extra == '{"m":"y"}' and rows[2].changed
    same = work.set_open(df.filter("id = 1"), F.lit(True), "s", '"x"', 9).first()
    gone = {r.id: r for r in work.delete_open(df, F.lit(True), ["k", "o"], 9).collect()}
    assert gone[1].extra == '{"s":"x"}' and not gone[2].changed and same.extra is not None


def test_small_rules():
    assert [analytics.bucket_count(*x) for x in ((5, 3), (20, None), (20, 4), (200, None), (200, 7))] == [None, None, 4, 10, 7]


def test_baked_files_hold_rising_ids(spark):
    base = spark.createDataFrame([(3, "a"), (1, "b"), (2, "c")], "id long, v string")
    over = spark.createDataFrame([(2, "remove", None), (3, "patch", "z"), (0, "add", "n"), (9, "patch", "lost")], "id long, op string, v string")
    assert [(r.id, r.v) for r in history.baked(base, over).collect()] == [(0, "n"), (1, "b"), (3, "z")]


def test_snippet_and_order(spark):
    df = spark.createDataFrame([("x" * 60 + " Zebra " + "y" * 100,), ("no term " * 30,), ("short",)], "t string")
    a, b, c = (r[0] for r in df.select(search.snippet(F.col("t"), "zebra")).collect())
    assert a.startswith("…") and a.endswith("…") and "Zebra" in a and b.endswith("…") and c == "short"
