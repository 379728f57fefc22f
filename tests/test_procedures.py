"""Procedures by pages, with results handed back, and with neighbours."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terravane.operators import procedures
from terravane.operators.procedures import Provider


def times(n):
    return lambda rows: pd.DataFrame({"b": rows["a"] * n})


DOUBLE = Provider("double", {"b": "double"}, ("a",), times(2), batch=3)


def table(spark, n=50):
    return spark.range(n).select("id", F.when(F.col("id") % 7 != 0, F.col("id").cast("double")).alias("a"))


WANT = {i: 2.0 * i for i in range(50) if i % 7}


def test_pages_go_on_after_a_stop(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    assert procedures.partial(spark, DOUBLE, folder).count() == 0
    assert procedures.paged(table(spark), DOUBLE, folder, 10, most=2) == 3
    part = {r.id: r.b for r in procedures.partial(spark, DOUBLE, folder).collect()}
    assert part == {i: WANT[i] for i in sorted(WANT)[:20]}

    def broken(rows):
        if (rows["a"] > 40).any():
            raise ValueError("stop")
        return pd.DataFrame({"b": rows["a"] * 2})

    with pytest.raises(Exception, match="stop"):
        procedures.paged(table(spark), Provider("double", {"b": "double"}, ("a",), broken), folder, 10)
    assert procedures.partial(spark, DOUBLE, folder).count() == 30  # the third page is whole, the fourth isn't there
    # rows changed meanwhile: the run keeps the inputs it began with, and results of changed inputs don't land
    later = table(spark, 60).withColumn("a", F.when(F.col("id") == 41, 5.0).otherwise(F.col("a")))
    assert procedures.paged(later, DOUBLE, folder, 10) == 0 == procedures.paged(later, DOUBLE, folder, 10)
    done = procedures.partial(spark, DOUBLE, folder)
    assert {r.id: r.b for r in done.collect()} == WANT
    landed = procedures.landed(later.withColumn("b", F.lit(None).cast("double")), done, ["b"], ["a"])
    assert {r.id: r.b for r in landed.filter("landed").collect()} == {i: v for i, v in WANT.items() if i != 41}


def test_pages_of_an_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert procedures.paged(table(spark, 0), DOUBLE, folder) == 0
    assert procedures.partial(spark, DOUBLE, folder).count() == 0
    with pytest.raises(ValueError, match="several pages"):
        procedures.paged(table(spark), Provider("once", {"b": "double"}, ("a",), times(2), once_by="a"), folder)


def test_collected_leaves_the_table(spark):
    got = procedures.collected(table(spark), DOUBLE)
    assert got.columns == ["id", "b", "input_hash"] and {r.id: r.b for r in got.collect()} == WANT
    shared = Provider("shared", {"b": "double"}, ("a",), times(1), once_by="k")
    rows = spark.createDataFrame([(1, "x", 4.0), (2, "x", 9.0), (3, None, 5.0), (4, None, None)], "id long, k string, a double")
    assert {r.id: r.b for r in procedures.collected(rows, shared).collect()} == {1: 4.0, 2: 4.0, 3: 5.0}


def test_a_call_is_no_larger_than_its_batch(spark):
    sizes = Provider("sizes", {"n": "long"}, ("a",), lambda rows: pd.DataFrame({"n": [len(rows)] * len(rows)}), batch=4)
    assert {r.n for r in procedures.applied(table(spark), sizes).filter("status = 'done'").collect()} <= {1, 2, 3, 4}


def test_neighbours_come_before_the_call(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.0, 0.001, 2.0), (3, 0.0, 1.0, 4.0), (4, 0.0, 0.0, None)], "id long, lat double, lng double, a double")
    total = lambda r: pd.DataFrame({"sum": [sum(n["a"] or 0 for n in near if n["metres"] < 200) for near in r["neighbours"]]})
    near = Provider("near", {"sum": "double"}, ("a",), total, around=(200.0, ("a",)))
    assert {r.id: (r.sum, r.status) for r in procedures.applied(rows, near).collect()} == {1: (3.0, "done"), 2: (3.0, "done"), 3: (4.0, "done"), 4: (None, "failed")}
    with pytest.raises(ValueError, match="in common"):
        Provider("both", {"sum": "double"}, ("a",), total, once_by="a", around=(200.0, ()))
