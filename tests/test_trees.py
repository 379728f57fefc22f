"""Edits of forests: laws over random trees, and what the trees select before and after."""

import random

from pyspark.sql import functions as F

from terravane.operators import changes
from terravane.plans import selectors as sel
from terravane.plans import trees
from terravane.plans.selectors import And, Everything, Filter, Ids, Invert, Manual, Or, Ranked, Selected, Uncommitted
from terravane.plans.trees import Forest

A, B, C, D, E = (Filter("zoom", "eq", float(i)) for i in range(5))


def random_tree(rng, depth=3):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([A, B, C, D, E, Ids((rng.randrange(4),))])
    if rng.random() < 0.2:
        return Invert((random_tree(rng, depth - 1),))
    if rng.random() < 0.1:
        return Ranked(random_tree(rng, depth - 1), "zoom", 3)
    kids = [random_tree(rng, depth - 1) for _ in range(rng.randrange(2, 4))]
    return rng.choice([And, Or])(tuple(Forest.of(*kids).rows[i].tree for i in range(len(Forest.of(*kids).rows))))


def paths(level, at=()):
    for i, t in enumerate(level):
        yield (*at, i)
        yield from paths(trees.children(t), (*at, i))


def all_paths(f):
    return list(paths([r.tree for r in f.rows]))


def sound(f):
    """No list has equal trees, no group that an edit made has one member only."""
    keys = [r.tree.key() for r in f.rows]
    return len(keys) == len(set(keys))


def test_laws_of_edits_on_random_forests():
    rng = random.Random(5)
    for _ in range(400):
        f = Forest.of(*(random_tree(rng) for _ in range(rng.randrange(1, 5))))
        where = all_paths(f)
        p, q = rng.choice(where), rng.choice(where)
        kind = rng.choice([And, Or])
        done = [f.invert_at(p), f.remove_at(p), f.replace_at(p, D), f.compose(p, q, kind), f.move(p, q, rng.random() < 0.5), f.combine(kind), f.complement(), f.manual(7), f.toggle(A), f.isolate(0)]
        assert all(map(sound, done))
        assert f.replace_at(p, f.at(p)) == f
        n = f.at(p)
        if not isinstance(n, Invert) and sel.invert(n).key() not in {r.tree.key() for r in f.rows} and len(p) == 1:
            assert f.invert_at(p).invert_at(p) == f
        assert f.isolate(0).isolate(0).active() == f.active()
        assert f.manual(99).manual(99) == f
        moved = f.move(p, q, True)
        before, after = ({k for r in x.rows for k in map(lambda t: t.key(), trees.walk(r.tree)) if "children" not in k and "child=" not in k} for x in (f, moved))
        assert before == after  # a move loses no leaf
        assert f.at((99,)) is None and f.remove_at((99, 1)) == f


def test_single_edits():
    f = Forest.of(Or((A, B, C)), D)
    assert f.remove_at((0, 1)) == Forest.of(Or((A, C)), D)
    assert f.remove_at((0, 1)).remove_at((0, 0)) == Forest.of(C, D)  # a group of one is that one
    assert f.remove_at((0,)) == Forest.of(A, B, C, D)
    assert Forest.of(Invert((And((A, B)),)), D).remove(Invert((And((A, B)),))) == Forest.of(A, B, D)
    assert f.compose((1,), (0, 0), And) == Forest.of(Or((And((A, D)), B, C)))
    assert f.compose((1,), (0,), Or) == Forest.of(Or((A, B, C, D)))
    assert f.compose((0, 1), (0,), Or) == f
    assert f.move((0, 2), (1,), after=True) == Forest.of(Or((A, B)), D, C)
    assert f.move((1,), (0, 0)) == Forest.of(Or((D, A, B, C)))
    assert f.move((0, 0), (0,), after=True) == Forest.of(Or((B, C)), A, D)  # out of its own group
    assert f.move((0,), (0, 1)) == f
    assert f.replace_at((0, 0), C) == Forest.of(Or((B, C)), D)  # an equal sibling stays
    assert Forest.of(Invert((A,)), B).move((1,), (0, 0)) == Forest.of(Invert((A,)), B)  # a negation holds one
    assert f.invert_at((0, 0)).invert_at((0, 0)) == f
    assert Forest.of(A, And((A, B))).replace_at((1,), A) == Forest.of(A)
    assert Forest.of(A, B, C).combine(And, [A, C]) == Forest.of(And((A, C)), B)
    assert Forest.of(A, B).complement() == Forest.of(Invert((Or((A, B)),)))
    assert Forest.of(A, Everything()).combine(And) == Forest.of(A)
    g = Forest.of(A, B, C).ghost(1)
    assert g.on_active(lambda x: x.combine(Or)) == Forest((trees.Row(Or((A, C))), trees.Row(B, True)))
    assert g.on_active(lambda x: x.add(B, D)) == Forest((trees.Row(A), trees.Row(B, True), trees.Row(C), trees.Row(D)))
    assert Forest.of(A, B).isolate(1).active() == [B]
    assert Forest.of(A).isolate(None).active() == [] and Forest.of(A).isolate(None).isolate(None).active() == [A]
    assert Forest.of().manual(3).manual(4).manual(3) == Forest.of(Manual((4,)))
    assert Forest.of(A).manual(3).manual(3) == Forest.of(A)
    assert trees.without_field(And((A, Filter("lat", "has"))), "zoom") == Filter("lat", "has")
    assert trees.without_field(Invert((A,)), "zoom") is None


def rows(spark):
    return spark.range(40).select("id", (F.col("id") % 5).cast("double").alias("zoom"), F.array((F.col("id") % 3).cast("long")).alias("tags"))


def ids(df):
    return {r.id for r in df.collect()}


def test_selected_and_counts(spark):
    df = rows(spark)
    f = Forest.of(A, Or((B, C)), Ranked(D, "id", 2), And((Selected(), Filter("tags", "contains", 1)))).ghost(1)
    want = {i for i in range(40) if i % 5 == 0} | {33, 38}
    assert ids(trees.selected(df, f)) == want
    assert ids(sel.select(df, trees.bound(Invert((Selected(),)), f))) == set(range(40)) - want
    got = {r.place: (r.ghosted, r.n) for r in trees.counts(df, f).collect()}
    assert got == {0: (False, 8), 1: (True, 16), 2: (False, 2), 3: (False, len([i for i in want if i % 3 == 1]))}
    assert trees.counts(df, Forest()).count() == 0
    assert ids(trees.selected(df, Forest())) == set() == ids(sel.select(df, Selected()))


def test_uncommitted(spark):
    base = rows(spark).drop("tags")
    over = spark.createDataFrame([(1, "patch", 9.0), (2, "remove", None), (50, "add", 1.0), (60, "patch", 1.0)], "id long, op string, zoom double")
    df = trees.with_layer(base, over)
    assert ids(sel.select(df, Uncommitted())) == {1, 50}
    assert ids(sel.select(df, And((Uncommitted(), Filter("zoom", "gt", 5.0))))) == {1}
    assert ids(sel.select(base, Uncommitted())) == set()


def test_saved_rules_follow_names(spark):
    kind = "field string, value_id long, name string"
    here = spark.createDataFrame([("tags", 0, "red"), ("tags", 1, "blue"), ("tags", 2, None), ("other", 1, "x")], kind)
    there = spark.createDataFrame([("tags", 2, "red"), ("tags", 7, "red"), ("tags", 1, "green")], kind)
    has = lambda v, f="tags": Filter(f, "contains", v)
    rule = trees.saved(Or((has(0), And((has(1), A)), has(2), has(1, "other"))), here)
    assert rule.names == {"tags": {0: "red", 1: "blue"}, "other": {1: "x"}}
    assert trees.resolved(rule, here) == rule.tree
    now = trees.resolved(rule, there)
    assert now == Or((has(2), And((Ids(()), A)), has(2), has(1, "other")))
    assert trees.add_saved(Forest.of(B), rule, there) == Forest.of(B, has(2), And((Ids(()), A)), has(1, "other"))
    assert trees.resolved(trees.Saved(has(5)), there) == Ids(())
    assert ids(sel.select(rows(spark), now)) == {i for i in range(40) if i % 3 == 2}


def test_members_follow_changes_as_a_full_resolve(spark):
    rng = random.Random(3)
    kind = "id long, zoom double, tags array<long>"
    held_rows = {i: (float(rng.randrange(5)), [rng.randrange(3)]) for i in range(60)}
    frame = lambda rows: spark.createDataFrame([(i, *v) for i, v in rows.items()], kind)
    f = Forest.of(A, Or((B, Filter("tags", "contains", 2))), Ranked(Invert((A,)), "zoom", 9), Invert((Ranked(B, "id", 1),)), And((Selected(), C))).ghost(3)
    table = frame(held_rows)
    held = trees.members(table, f)
    for _ in range(3):
        after = {i: (float(rng.randrange(5)), v[1]) if rng.random() < 0.3 else v for i, v in held_rows.items() if rng.random() < 0.9}
        after |= {rng.randrange(100, 200): (0.0, [2]) for _ in range(4)}
        new = frame(after)
        signed = trees.deltas(new, changes.between(table, new), held, f)
        held = spark.createDataFrame(trees.moved(held, signed).collect(), "place int, id long")
        full = sorted(map(tuple, trees.members(new, f).collect()))
        assert sorted(map(tuple, held.collect())) == full and full
        table, held_rows = new, after
