"""Filters by what lies around a row, and pruning of rows that are too close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.filters import compile_filter, conjuncts
from . import spatial
from .shared import checkpointed

def _sides() -> dict[str, Column]:
    """The side of the centre (p) that a neighbour (i) counts for."""
    return {"west": F.col("p_lng") < F.col("i_lng"), "east": F.col("p_lng") > F.col("i_lng"), "north": F.col("p_lat") > F.col("i_lat"), "south": F.col("p_lat") < F.col("i_lat")}


def neighbour_filter(df: DataFrame, metres: float, bound: str, limit: int | None = None, matches: Column | None = None, separately: bool = False, candidates: DataFrame | None = None) -> DataFrame:
    """Rows of candidates (of df, if none are given) whose neighbours in df pass a bound.

    A neighbour is another id closer than metres by the sampling metric. ``matches`` is a condition on columns p_* of the centre
    and i_* of the neighbour. Bounds: some, none, gte, lte, all, percentage-gte, percentage-lte. With ``separately``, gte, lte and
    none pass if any one of the four sides does. No neighbour is 0 percent, and not all; a bound that needs a limit fails without.
    """
    rows = candidates if candidates is not None else df
    other = geo.closer_than(F.col("p_lat"), F.col("p_lng"), F.col("i_lat"), F.col("i_lng"), metres) & (F.col("p_id") != F.col("i_id"))
    good = matches if matches is not None else F.lit(True)
    if bound in ("some", "none") and not separately:  # the first neighbour that matches settles it: no pairs
        hit = spatial.matching_ids(rows, df, metres * 1.01, other & good)
        return rows.join(hit, "id", "left_semi" if bound == "some" else "left_anti").select(*rows.columns)
    near = spatial.within(rows, df, metres * 1.01).filter(other)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    found = near.groupBy(F.col("p_id").alias("id")).agg(F.count(F.lit(1)).alias("n_all"), count(good).alias("n_good"), *(count(good & side).alias(f"n_{name}") for name, side in _sides().items()))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_all, n, sides = zero("n_all"), zero("n_good"), [zero(f"n_{name}") for name in _sides()]
    some_side = lambda test: test(sides[0]) | test(sides[1]) | test(sides[2]) | test(sides[3])
    if limit is None and bound in ("gte", "lte", "percentage-gte", "percentage-lte"):
        passes = F.lit(False)
    elif bound == "some":
        passes = n > 0
    elif bound == "none":
        passes = some_side(lambda s: s == 0) if separately else n == 0
    elif bound == "gte":
        passes = some_side(lambda s: s >= limit) if separately else n >= limit
    elif bound == "lte":
        passes = some_side(lambda s: s <= limit) if separately else n <= limit
    elif bound == "all":
        passes = (n_all > 0) & (n == n_all)
    elif bound in ("percentage-gte", "percentage-lte"):
        share = n * 100  # compared as whole numbers: n / n_all * 100 against the limit
        passes = (share >= n_all * limit if bound.endswith("gte") else share <= n_all * limit) & ((n_all > 0) | F.lit(limit <= 0 if bound.endswith("gte") else limit >= 0))
    else:
        raise ValueError(f"no such bound: {bound}")
    return rows.join(found, "id", "left").filter(passes).select(*rows.columns)


COUNTING = ("some", "none", "gte", "lte")


def neighbour_filter_by(df: DataFrame, metres: float, bound: str, text: str, properties: dict[str, tuple[str, str]], limit: int | None = None, separately: bool = False, candidates: DataFrame | None = None) -> DataFrame:
    """``neighbour_filter`` with a condition of the filter language; properties: name -> (kind, column of df).

    For bounds that only count matches, the parts of the condition that don't ask of the centre row choose the neighbours before
    any are paired. For shares and ``all`` every neighbour counts, so nothing is taken out.
    """
    side = lambda prefix: {n: (kind, F.col(f"{prefix}{c}")) for n, (kind, c) in properties.items()}
    parts = [] if not text.strip() or text.strip() == "*" else conjuncts(text)
    rows = candidates if candidates is not None else df
    around = df
    if bound in COUNTING:
        for part, both in parts:
            if not both:
                around = around.filter(compile_filter(part, side("")))
        parts = [p for p in parts if p[1]]
    matches = F.lit(True)
    for part, _ in parts:
        matches = matches & compile_filter(part, side("i_"), side("p_"))
    return neighbour_filter(around, metres, bound, limit, matches, separately, rows)


def _links(df: DataFrame, metres: float) -> DataFrame:
    p = spatial.pairs(df, metres)
    return p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b")))


def pruned(df: DataFrame, metres: float, score: Column | None = None) -> DataFrame:
    """Ids to take out so that no two rows within metres of each other stay.

    Up to 25 m: rows in the order of ids, each not yet pruned forms a cluster with the neighbours that aren't either, and its best
    (score, then the older, then the smaller id) stays. Beyond: the row with the most neighbours goes (of equals the one with the
    largest id) until none has any. Both are sequential rules; rows whose turn can't touch each other's take it in one round.
    """
    rank = F.struct((score if score is not None else F.lit(0.0)).cast("double").alias("s"), (-F.coalesce(F.col("created_at"), F.lit(0))).alias("c"), (-F.col("id")).alias("i"))
    links = checkpointed(_links(df, metres))
    if metres > 25:
        return _thinned(links)
    ranked = df.select(F.col("id").alias("a"), rank.alias("rank"))
    live = checkpointed(links.select("a").distinct().join(ranked, "a").select("a", "rank", F.lit(False).alias("done"), F.lit(False).alias("gone")))
    while live.filter("NOT done AND NOT gone").limit(1).count():
        waiting = F.when(~F.col("done") & ~F.col("gone"), F.col("a"))
        around = links.join(live.select(F.col("a").alias("b"), waiting.alias("turn")), "b").groupBy("a").agg(F.min("turn").alias("turn"))
        one = live.join(around, "a").select(F.col("a"), F.least(F.coalesce(waiting, "turn"), F.coalesce("turn", waiting)).alias("turn"))
        two = links.join(one.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("turn").alias("turn"))
        ready = live.filter("NOT done AND NOT gone").join(two, "a").filter(F.col("turn").isNull() | (F.col("turn") >= F.col("a"))).select(F.col("a").alias("centre"), F.col("rank").alias("own"))
        members = links.join(ready, F.col("a") == F.col("centre")).join(live.filter("NOT gone").select(F.col("a").alias("b"), F.col("rank").alias("theirs")), "b").select("centre", "own", F.col("b").alias("member"), "theirs")
        best = members.groupBy("centre").agg(F.max(F.greatest("own", "theirs")).alias("best"))
        out = members.join(best, "centre").filter(F.col("theirs") != F.col("best")).select(F.col("member").alias("a")).unionByName(ready.join(best, "centre").filter(F.col("own") != F.col("best")).select(F.col("centre").alias("a"))).distinct()
        marks = ready.select(F.col("centre").alias("a"), F.lit(True).alias("now")).join(out.withColumn("out", F.lit(True)), "a", "full_outer")
        marked = live.join(marks, "a", "left").select("a", "rank", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"), (F.col("gone") | F.coalesce("out", F.lit(False))).alias("gone"))
        live = checkpointed(marked)
    return live.filter("gone").select(F.col("a").alias("id"))


def _thinned(links: DataFrame) -> DataFrame:
    gone = links.select("a").limit(0)
    while links.limit(1).count():
        degree = links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.struct("n", "a").alias("own"))
        one = links.join(degree.select(F.col("a").alias("b"), F.col("own").alias("theirs")), "b").groupBy("a").agg(F.max("theirs").alias("theirs")).join(degree, "a").select("a", "own", F.greatest("own", "theirs").alias("most"))
        two = links.join(one.select(F.col("a").alias("b"), "most"), "b").groupBy("a").agg(F.max("most").alias("most"))
        out = checkpointed(two.join(degree, "a").filter(F.col("own") >= F.col("most")).select("a"))
        links = checkpointed(links.join(out, "a", "left_anti").join(out.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"))
        gone = gone.unionByName(out)
    return gone.select(F.col("a").alias("id"))
