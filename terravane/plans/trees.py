"""Forests: ordered lists of selection trees, edited by path, with saved rules and the counts of what each tree selects.

A forest is immutable, every edit gives a new one. A path is the place of a tree in the forest, then the places of children on the
way down. Two trees of one list are never equal. Edits are work on the plan and touch no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history
from . import selectors as sel
from .selectors import And, Filter, Ids, Invert, Manual, Or, Selector

Path = tuple[int, ...]


@dataclass(frozen=True)
class Row:
    """A tree of a forest; ghosted ones stay listed and select nothing."""

    tree: Selector
    ghosted: bool = False


def children(s: Selector) -> tuple[Selector, ...]:
    if isinstance(s, (And, Or, Invert)):
        return s.children
    return (s.child,) if hasattr(s, "child") else ()


def with_children(s: Selector, kids: Iterable[Selector]) -> list[Selector]:
    """What is left of a node over new children: a group of one is that one, an empty group, and any other node that lost its child, goes."""
    kids = tuple(kids)
    if isinstance(s, (And, Or)):
        return [type(s)(kids)] if len(kids) > 1 else list(kids)
    if not kids:
        return []
    return [replace(s, children=kids[:1]) if isinstance(s, Invert) else replace(s, child=kids[0])]


def transformed(s: Selector, change: Callable[[Selector], Selector]) -> Selector:
    """s with every node changed, children first; groups keep their number of children."""
    if isinstance(s, (And, Or, Invert)):
        s = replace(s, children=tuple(transformed(c, change) for c in s.children))
    elif hasattr(s, "child"):
        s = replace(s, child=transformed(s.child, change))
    return change(s)


def walk(s: Selector) -> Iterable[Selector]:
    yield s
    for c in children(s):
        yield from walk(c)


def without_field(s: Selector, name: str) -> Selector | None:
    """s without the filters on a field that is gone; None if nothing is left of it."""
    if isinstance(s, Filter) and s.field == name:
        return None
    kids = children(s)
    if not kids:
        return s
    left = with_children(s, [c for c in (without_field(k, name) for k in kids) if c is not None])
    return left[0] if left else None


def _last_of_equals(trees: list[Selector]) -> list[Selector]:
    keys = [t.key() for t in trees]
    return [t for i, t in enumerate(trees) if keys[i] not in keys[i + 1 :]]


def _spliced(trees: list[Selector], edits: dict[Path, list[Selector]]) -> list[list[Selector]]:
    """For each tree the trees that stand in its place after the edits (path -> replacements).

    Trees that no edit reaches stay; of equal trees among the replacements the rightmost stays.
    """
    below: dict[int, dict[Path, list[Selector]]] = {}
    for path, new in edits.items():
        below.setdefault(path[0], {})[path[1:]] = new
    taken = {t.key() for i, t in enumerate(trees) if i not in below}
    places = [[t] for t in trees]
    for i in sorted((i for i in below if i < len(trees)), reverse=True):
        if () in below[i]:
            new = below[i][()]
        else:
            kids = list(children(trees[i]))
            after = [t for place in _spliced(kids, below[i]) for t in place]
            new = [trees[i]] if after == kids else with_children(trees[i], after)
        places[i] = [t for t in _last_of_equals(new) if t.key() not in taken]
        taken |= {t.key() for t in places[i]}
    return places


def _parts(s: Selector) -> list[Selector]:
    """The members of a group, negated or not: what its removal leaves behind."""
    inner = s.children[0] if isinstance(s, Invert) and s.children else s
    return list(inner.children) if isinstance(inner, (And, Or)) else []


def _within(path: Path, other: Path) -> bool:
    return path[: len(other)] == other


@dataclass(frozen=True)
class Forest:
    rows: tuple[Row, ...] = ()

    @staticmethod
    def of(*trees: Selector) -> Forest:
        return Forest(tuple(Row(t) for t in _last_of_equals(list(trees))))

    def at(self, path: Path) -> Selector | None:
        level, node = [r.tree for r in self.rows], None
        for i in path:
            if not 0 <= i < len(level):
                return None
            node, level = level[i], children(level[i])
        return node

    def active(self) -> list[Selector]:
        return [r.tree for r in self.rows if not r.ghosted]

    def _place(self, tree: Selector) -> int | None:
        return next((i for i, r in enumerate(self.rows) if r.tree.key() == tree.key()), None)

    def spliced(self, edits: dict[Path, list[Selector]]) -> Forest:
        """Trees that come to the list keep the ghosting they had in it, new ones take that of the row they replace."""
        ghosts = {r.tree.key(): r.ghosted for r in self.rows}
        places = _spliced([r.tree for r in self.rows], edits)
        return Forest(tuple(Row(t, ghosts.get(t.key(), r.ghosted)) for r, new in zip(self.rows, places, strict=True) for t in new))

    def add(self, *trees: Selector) -> Forest:
        rows = list(self.rows)
        for t in trees:
            if all(r.tree.key() != t.key() for r in rows):
                rows.append(Row(t))
        return Forest(tuple(rows))

    def toggle(self, *trees: Selector) -> Forest:
        """Listed trees go, as in ``remove``; others are added."""
        out = self
        for t in trees:
            out = out.add(t) if out._place(t) is None else out.remove(t)
        return out

    def remove(self, *trees: Selector) -> Forest:
        """A group that goes leaves its members behind."""
        out = self
        for t in trees:
            if (i := out._place(t)) is not None:
                out = out.remove_at((i,))
        return out

    def manual(self, row_id: int) -> Forest:
        """An id goes into the hand-picked list, or out of it if it is there."""
        place = next((i for i, r in enumerate(self.rows) if isinstance(r.tree, Manual)), None)
        held = self.rows[place].tree.ids if place is not None else ()
        ids = tuple(i for i in held if i != row_id) if row_id in held else (*held, row_id)
        if place is None:
            return self.add(Manual(ids))
        return self.spliced({(place,): [Manual(ids)] if ids else []})

    def on_active(self, edit: Callable[[Forest], Forest]) -> Forest:
        """An edit of the forest of active trees. Ghosted ones keep their places; results fill the active places in order, the rest follows."""
        ghosts = {r.tree.key() for r in self.rows if r.ghosted}
        fresh = [r for r in edit(Forest(tuple(r for r in self.rows if not r.ghosted))).rows if r.tree.key() not in ghosts]
        out: list[Row] = []
        for r in self.rows:
            if r.ghosted:
                out.append(r)
            elif fresh:
                out.append(fresh.pop(0))
        return Forest((*out, *fresh))

    def _joined(self, trees: Iterable[Selector] | None, join: Callable[[list[Selector]], Selector]) -> Forest:
        keys = None if trees is None else {t.key() for t in trees}
        chosen = [i for i, r in enumerate(self.rows) if keys is None or r.tree.key() in keys]
        if not chosen:
            return self
        first = chosen[0]
        new = Row(join([self.rows[i].tree for i in chosen]), self.rows[first].ghosted)
        return Forest(tuple(new if i == first else r for i, r in enumerate(self.rows) if i == first or i not in chosen))

    def combine(self, kind: type, trees: Iterable[Selector] | None = None) -> Forest:
        """The given trees, or all, as one group at the place of the first."""
        return self._joined(trees, lambda ts: sel.combine(kind, ts))

    def complement(self, trees: Iterable[Selector] | None = None) -> Forest:
        """In place of the given trees, or all: what none of them selects."""
        return self._joined(trees, lambda ts: sel.invert(sel.combine(Or, ts)))

    def ghost(self, place: int) -> Forest:
        return Forest(tuple(replace(r, ghosted=r.ghosted ^ (i == place)) for i, r in enumerate(self.rows)))

    def isolate(self, place: int | None) -> Forest:
        """All but one are ghosted, or all (None); doing it again brings all back."""
        want = [i != place for i in range(len(self.rows))]
        done = want == [r.ghosted for r in self.rows]
        return Forest(tuple(replace(r, ghosted=w and not done) for r, w in zip(self.rows, want, strict=True)))

    def invert_at(self, path: Path) -> Forest:
        node = self.at(path)
        return self if node is None else self.spliced({path: [sel.invert(node)]})

    def remove_at(self, path: Path) -> Forest:
        node = self.at(path)
        return self if node is None else self.spliced({path: _parts(node)})

    def replace_at(self, path: Path, tree: Selector) -> Forest:
        return self if self.at(path) is None else self.spliced({path: [tree]})

    def compose(self, drag: Path, drop: Path, kind: type) -> Forest:
        """The tree at drag joins that at drop in a group; neither may hold the other."""
        source, target = self.at(drag), self.at(drop)
        if source is None or target is None or _within(drag, drop) or _within(drop, drag):
            return self
        members = list(target.children) if isinstance(target, kind) else [target]
        return self.spliced({drag: [], drop: [kind(tuple(_last_of_equals([*members, source])))]})

    def move(self, source: Path, target: Path, after: bool = False) -> Forest:
        """The tree at source goes before or after that at target: in the list or in a group, never into itself.

        Out of its own ancestor it leaves that one without it.
        """
        moved, beside = self.at(source), self.at(target)
        if moved is None or beside is None or _within(target, source):
            return self
        if len(target) > 1 and not isinstance(self.at(target[:-1]), (And, Or)):
            return self
        inside = _within(source, target)
        rest = _spliced([beside], {(0, *source[len(target) :]): []})[0] if inside else [beside]
        placed = [*rest, moved] if after else [moved, *rest]
        return self.spliced({target: placed} if inside else {source: [], target: placed})


def bound(s: Selector, forest: Forest) -> Selector:
    """s with the union of the forest's active trees for ``Selected``; inside these it selects nothing."""
    union = Or(tuple(transformed(t, lambda n: Or() if isinstance(n, sel.Selected) else n) for t in forest.active()))
    return transformed(s, lambda n: union if isinstance(n, sel.Selected) else n)


def with_layer(base: DataFrame, over: DataFrame) -> DataFrame:
    """base under a layer (see ``history.overlay``), with a boolean column for ``Uncommitted``: rows that the layer adds or patches."""
    marks = over.filter("op <> 'remove'").select("id", F.lit(True).alias("uncommitted")).distinct()
    return history.overlay(base, over).join(marks, "id", "left").withColumn("uncommitted", F.coalesce("uncommitted", F.lit(False)))


def selected(df: DataFrame, forest: Forest) -> DataFrame:
    """The rows that some active tree selects."""
    return sel.select(df, bound(sel.Selected(), forest))


def counts(df: DataFrame, forest: Forest) -> DataFrame:
    """(place, ghosted, n): how many rows each tree of a forest selects. Trees that rows decide alone share one scan."""
    local, others = [], []
    for i, r in enumerate(forest.rows):
        tree = bound(r.tree, forest)
        (local if sel.row_local(tree) else others).append((i, r.ghosted, tree))
    places = [F.struct(F.lit(i).alias("place"), F.lit(g).alias("ghosted"), F.count(F.when(sel.column(df, t), 1)).alias("n")) for i, g, t in local]
    parts = [df.agg(F.array(*places).alias("all")).select(F.inline("all"))] if places else []
    parts += [sel.select(df, t).agg(F.lit(i).alias("place"), F.lit(g).alias("ghosted"), F.count(F.lit(1)).alias("n")) for i, g, t in others]
    if not parts:
        return df.sparkSession.createDataFrame([], "place int, ghosted boolean, n long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class Saved:
    """A rule kept for other tables: names[field][id] is what a value it tests for was called."""

    tree: Selector
    names: dict[str, dict[int, str]] = field(default_factory=dict)


def _tested(s: Selector) -> dict[str, set[int]]:
    out: dict[str, set[int]] = {}
    for n in walk(s):
        if isinstance(n, Filter) and n.op == "contains":
            out.setdefault(n.field, set()).add(n.value)
    return out


def saved(tree: Selector, names: DataFrame) -> Saved:
    """tree with the names of the values it tests for, from a table (field, value_id, name). Only values that the rule names are read."""
    tested = _tested(tree)
    wanted = F.lit(False)
    for f, ids in tested.items():
        wanted = wanted | (F.col("field") == f) & F.col("value_id").isin(list(ids))
    out: dict[str, dict[int, str]] = {}
    for r in names.filter(wanted).filter("name IS NOT NULL").select("field", "value_id", "name").collect():
        out.setdefault(r.field, {})[r.value_id] = r.name
    return Saved(tree, out)


def resolved(rule: Saved, names: DataFrame) -> Selector:
    """The rule's tree over another table's values: each test follows its value's name (the least id of that name), one without a name its id.

    A test whose value isn't there selects nothing. A field that the table of names doesn't know is left alone.
    """
    tested = _tested(rule.tree)
    wanted = F.lit(False)
    for f, ids in tested.items():
        known = list(rule.names.get(f, {}).values())
        wanted = wanted | (F.col("field") == f) & (F.col("name").isin(known) | F.col("value_id").isin(list(ids)))
    fields = {r.field for r in names.filter(F.col("field").isin(list(tested))).select("field").distinct().collect()}
    by_name = {(r.field, r.name): r.id for r in names.filter(wanted).groupBy("field", "name").agg(F.min("value_id").alias("id")).collect()}
    held = {(r.field, r.value_id) for r in names.filter(wanted).select("field", "value_id").distinct().collect()}

    def follow(n: Selector) -> Selector:
        if not (isinstance(n, Filter) and n.op == "contains" and n.field in fields):
            return n
        name = rule.names.get(n.field, {}).get(n.value)
        now = by_name.get((n.field, name)) if name is not None else n.value if (n.field, n.value) in held else None
        return Ids(()) if now is None else replace(n, value=now)

    return transformed(rule.tree, follow)


def add_saved(forest: Forest, rule: Saved, names: DataFrame) -> Forest:
    """A saved union adds its members one by one, any other rule itself."""
    tree = resolved(rule, names)
    return forest.add(*tree.children) if isinstance(tree, Or) else forest.add(tree)


def members(df: DataFrame, forest: Forest) -> DataFrame:
    """(place, id): the rows each tree selects, once each. Trees that rows decide alone share one scan."""
    return _members(df, [(i, bound(r.tree, forest)) for i, r in enumerate(forest.rows)])


def _members(df: DataFrame, placed: list[tuple[int, Selector]]) -> DataFrame:
    local = [(i, t) for i, t in placed if sel.row_local(t)]
    parts = [sel.select(df, t).select(F.lit(i).alias("place"), "id") for i, t in placed if not sel.row_local(t)]
    if local:
        hits = F.array(*(F.when(sel.column(df, t), F.lit(i)) for i, t in local))
        parts.append(df.select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("place"), "id"))
    out = parts[0] if parts else df.select(F.lit(0).alias("place"), "id").limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def deltas(table: DataFrame, change: DataFrame, held: DataFrame, forest: Forest) -> DataFrame:
    """(place, id, sign): how a change (id, before, after) moves the members held before it; ``table`` is the table after it.

    Trees that rows decide alone look at the changed rows only: their sides are tested and what differs is told. A tree with a node
    that sees a set is resolved again over the whole table and compared with what it held.
    """
    placed = [(i, bound(r.tree, forest)) for i, r in enumerate(forest.rows)]
    local = [(i, t) for i, t in placed if sel.row_local(t)]
    wide = [(i, t) for i, t in placed if not sel.row_local(t)]
    key = ["place", "id"]
    was = _members(change.filter("before IS NOT NULL").select("before.*"), local)
    now = _members(change.filter("after IS NOT NULL").select("after.*"), local)
    if wide:
        was = was.unionByName(held.filter(F.col("place").isin([i for i, _ in wide])).select(*key))
        now = now.unionByName(_members(table, wide))
    signed = was.withColumn("sign", F.lit(-1)).unionByName(now.withColumn("sign", F.lit(1)))
    return signed.groupBy(*key).agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0")


def moved(held: DataFrame, signed: DataFrame) -> DataFrame:
    """Members after signed deltas; counts follow by adding up the signs of a place."""
    gone = signed.filter("sign < 0").select("place", "id")
    return held.join(gone, ["place", "id"], "left_anti").unionByName(signed.filter("sign > 0").select("place", "id"))
