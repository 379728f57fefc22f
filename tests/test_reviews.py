"""Review sessions against lists walked one by one, and synchronisation against a plan made key by key."""

import random

import pytest
from pyspark.sql import functions as F

from terravane.operators import changes, reviews


class Plain:
    """One session as a list."""

    def __init__(self, order):
        self.order, self.reviewed, self.cursor, self.done = list(order), set(), order[0], False

    def prune(self, live):
        old = self.order.index(self.cursor)
        self.order = [i for i in self.order if i in live]
        self.reviewed &= live
        if self.order and self.cursor not in live:
            self.cursor = self.order[min(old, len(self.order) - 1)]

    def advance(self):
        self.reviewed.add(self.cursor)
        i = self.order.index(self.cursor)
        if i + 1 == len(self.order):
            self.done = True
        else:
            self.cursor = self.order[i + 1]

    def retreat(self):
        self.cursor = self.order[max(0, self.order.index(self.cursor) - 1)]


def held(work, cursors):
    out = {}
    for r in sorted(work.collect(), key=lambda r: (r.source, r.run, r.place)):
        out.setdefault(r.source, ([], set()))[0].append(r.id)
        if r.reviewed:
            out[r.source][1].add(r.id)
    at = {r.source: (r.id, r.done) for r in cursors.collect()}
    assert set(at) == set(out)
    return {s: (*v, *at[s]) for s, v in out.items()}


def test_sessions_against_plain_lists(spark):
    rng = random.Random(4)
    kind = "source string, id long, weight long"
    first = [(s, i, rng.randrange(4)) for s, n in (("hot", 60), ("b", 7), ("c", 1)) for i in rng.sample(range(100), n)]
    matches = spark.createDataFrame([*first, *first[:5], (None, 1, 1), ("b", None, 1)], kind)
    sort = lambda rows: [i for _, i, w in sorted(rows, key=lambda r: (r[2], r[1]))]
    plain = {s: Plain(sort([r for r in first if r[0] == s])) for s in "hot b c".split()}
    work, cursors = reviews.begin(matches, ["weight"])
    same = lambda: {s: (p.order, p.reviewed, p.cursor, p.done) for s, p in plain.items()}
    assert held(work, cursors) == same()
    live = set(range(100))
    for step in range(2):
        for _ in range(2):
            work, cursors = reviews.advance(work, cursors)
            for p in plain.values():
                p.advance()
        cursors = reviews.retreat(work, cursors)
        for p in plain.values():
            p.retreat()
        live -= set(rng.sample(sorted(live), 20)) | ({plain["hot"].cursor} if step else set())
        work, cursors = reviews.prune(work, cursors, spark.createDataFrame([(i,) for i in live], "id long"))
        for p in plain.values():
            p.prune(live)
        plain = {s: p for s, p in plain.items() if p.order}
        more = [(s, i, rng.randrange(3)) for s in ("hot", "b", "new") for i in rng.sample(sorted(live), 6)]
        work = reviews.append(work, spark.createDataFrame(more, kind), ["weight"])
        for s, p in plain.items():
            p.order += [i for i in sort([r for r in more if r[0] == s]) if i not in p.order]
        work, cursors = (spark.createDataFrame(x.collect(), x.schema) for x in (work, cursors))
        assert held(work, cursors) == same()
    assert {r.id for r in reviews.ids(work, True).filter("source = 'hot'").collect()} == plain["hot"].reviewed
    assert {r.id for r in reviews.reviewed_ids(work).collect()} == set().union(*(p.reviewed for p in plain.values()))


def test_chosen_cursors_and_empty_tables(spark):
    kind = "source string, id long"
    work, cursors = reviews.begin(spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], kind), [])
    marked, now = reviews.advance(work, cursors, F.col("source") == "a")
    assert held(marked, now) == {"a": ([1, 2], {1}, 2, False), "b": ([5], set(), 5, False)}
    left, now, new = reviews.resumed(marked, now, spark.createDataFrame([(2,), (7,)], "id long"), spark.createDataFrame([("a", 7), ("a", 2), ("b", 7)], kind))
    assert held(left, now) == {"a": ([2], set(), 2, False)} and [tuple(r) for r in new.collect()] == [("a", 7)]
    work, cursors = reviews.begin(spark.createDataFrame([], kind), [])
    assert work.count() == cursors.count() == 0 == reviews.append(work, spark.createDataFrame([("a", 1)], kind), []).count()


def plan_of(b, l, r, initial, first, pull_only, side):
    """(plan, base afterwards) of one key."""
    if l == r:
        plan = "none"
    elif b == l:
        plan = "remove_local" if r is None else "add_local" if l is None else "update_local"
    elif b == r:
        plan = "remove_remote" if l is None else "add_remote" if r is None else "update_remote"
    else:
        winner = "remote" if pull_only else side
        plan = "conflict"
        if winner:
            to, mine, theirs = ("remote", l, r) if winner == "local" else ("local", r, l)
            plan = ("remove_" if mine is None else "add_" if theirs is None else "update_") + to
    if initial and (first, plan) in (("remote", "add_remote"), ("local", "add_local")):
        plan = {"remote": "remove_local", "local": "remove_remote"}[first]
    if pull_only:
        plan = {"add_remote": "none", "update_remote": "held", "remove_remote": "held"}.get(plan, plan)
    after = b if plan in ("conflict", "held") else None if plan.startswith("remove") else r if plan.endswith("_local") else l
    return plan, after


@pytest.mark.parametrize("initial", [False, True])
@pytest.mark.parametrize("first,pull_only", [("merge", False), ("remote", False), ("local", False), ("merge", True), ("remote", True)])
def test_synchronisation_key_by_key(spark, initial, first, pull_only):
    hashes = [None, "x", "y", "z"]
    rows = [(i, *v) for i, v in enumerate((b, l, r, s) for b in ([None] if initial else hashes[:3]) for l in hashes for r in hashes for s in (None, "local", "remote"))]
    side = lambda n: spark.createDataFrame([(r[0], r[n]) for r in rows if r[n] is not None], "key long, hash string")
    sides = side(4).withColumnRenamed("hash", "side")
    got = {r.key: (r.plan, r.hash) for r in changes.synchronised(side(1), side(2), side(3), first, pull_only, sides).collect()}
    assert got == {k: plan_of(b, l, r, initial, first, pull_only, s) for k, b, l, r, s in rows if (b, l, r) != (None, None, None)}


def test_synchronisation_refuses_what_would_lose_a_table(spark):
    none, one = spark.createDataFrame([], "key long, hash string"), spark.createDataFrame([(1, "x")], "key long, hash string")
    with pytest.raises(ValueError, match="empty"):
        changes.synchronised(one, one, none)
    with pytest.raises(ValueError, match="only pulls"):
        changes.synchronised(none, one, one, "local", True)
    assert [tuple(r) for r in changes.synchronised(none, one, none).collect()] == [(1, "add_remote", "x")]
