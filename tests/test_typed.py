"""Kinds, places of errors and parts of conditions of the filter language."""

import pytest
from pyspark.sql import functions as F

from terravane.functions import filters, properties
from terravane.operators import neighbours


def test_parts_of_a_condition():
    parts = filters.conjuncts
    assert parts("A eq 1") == [("A eq 1", False)]
    assert parts("((A eq 'x and y' and current:B lt B))") == [("A eq 'x and y'", False), ("current:B lt B", True)]
    assert parts("(A eq 1) and (B eq 2 or current:C eq 3) and D in [1, 2]") == [("(A eq 1)", False), ("(B eq 2 or current:C eq 3)", True), ("D in [1, 2]", False)]
    assert parts("A eq 1 and B eq 2 or C eq 3") == [("A eq 1 and B eq 2 or C eq 3", False)]
    assert parts("A eq 'it\\'s'") == [("A eq 'it\\'s'", False)]


def test_errors_say_where(spark):
    props = {"Heading": ("int", F.lit(1)), "Name": ("text", F.lit("a")), "Road": ("flags", lambda names: F.lit(True))}
    for text, at, length in (("Heading eq 'x'", 8, 2), ("Name * 2", 5, 1), ("Headin gt 1", 0, 6), ("Heading gt 99999999999999999999", 11, 20), ("Road lt 'x'", 5, 2), ("Road + 'x' eq 'y'", 5, 1), ("Name lt null", 5, 2)):
        with pytest.raises(filters.FilterError) as e:
            filters.compile_filter(text, props)
        assert (e.value.at, e.value.length) == (at, length), text
    with pytest.raises(filters.FilterError, match="Heading is"):
        filters.compile_filter("headng gt 1", props)


def test_widths(spark):
    props = {"I": ("int", F.lit(2**31 - 1)), "L": ("long", F.lit(2**63 - 1).cast("long")), "M": ("int", F.lit(-(2**31))), "Z": ("int", F.lit(0))}
    holds = lambda t: spark.range(1).select(filters.compile_filter(t, props)).first()[0]
    for text in ("I + 1 eq -2147483648", "L + 1 eq -9223372036854775808", "I + L eq -9223372034707292162", "M / -1 eq -2147483648", "-M eq -2147483648", "I / Z eq null", "-7 / 2 eq -3", "-7 modulo 2 eq -1", "I + 1.0 eq 2147483648", "-2147483649 eq 2147483647", "-4294967296 lt 0", "3000000000 gt 0", "I modulo Z eq null"):
        assert holds(text), text


def test_every_property_has_a_kind_and_a_column(spark):
    assert len(properties.KINDS) == 35 and set(properties.properties()) == set(properties.KINDS)
    assert {k: v[0] for k, v in properties.properties().items()} == properties.KINDS


def test_one_sided_parts_go_first_only_where_they_may(spark):
    df = spark.createDataFrame([(1, 45.0, 7.0, 5), (2, 45.0001, 7.0, 1), (3, 45.0002, 7.0, 9)], "id long, lat double, lng double, v int")
    props = {"V": ("int", "v")}
    text = "V gt 3 and V gt current:V"
    ids = lambda bound, limit=None: sorted(r.id for r in neighbours.neighbour_filter_by(df, 100.0, bound, text, props, limit).collect())
    assert ids("some") == [1, 2] and ids("none") == [3] and ids("gte", 2) == [2] and ids("all") == [2] and ids("percentage-gte", 50) == [1, 2]
    assert sorted(r.id for r in neighbours.neighbour_filter_by(df, 100.0, "some", "*", props).collect()) == [1, 2, 3]
