"""The selector algebra: immutable trees, compiled to a boolean column where rows decide alone, else to a table of ids."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.expr import ExpressionError, compile_expression
from ..operators import spatial

ARRAYS, CALENDAR = {"tags"}, {"created_at", "modified_at"}


@dataclass(frozen=True)
class Selector:
    """A node of a selection tree."""

    def key(self) -> str:
        return repr(self)


@dataclass(frozen=True)
class Everything(Selector):
    pass


@dataclass(frozen=True)
class Selected(Selector):
    """What the active rows of a forest select together; ``trees.bound`` puts their union in its place. Alone it selects nothing."""


@dataclass(frozen=True)
class Uncommitted(Selector):
    """Rows that a layer adds or patches; see ``trees.with_layer``. A table without a layer has none."""


@dataclass(frozen=True)
class Ids(Selector):
    ids: tuple[int, ...]


@dataclass(frozen=True)
class Manual(Ids):
    """The ids picked by hand; a forest has one such list."""


@dataclass(frozen=True)
class Filter(Selector):
    """op: has nothas eq neq contains notcontains gt lt gte lte between between_anyyear between_anytime."""

    field: str
    op: str
    value: object = None
    tz_local: bool = False


@dataclass(frozen=True)
class Polygon(Selector):
    rings: tuple[tuple[tuple[float, float], ...], ...]


@dataclass(frozen=True)
class Nearby(Selector):
    lat: float
    lng: float
    radius_m: float
    child: Selector = Everything()


@dataclass(frozen=True)
class Nearest(Selector):
    lat: float
    lng: float
    child: Selector = Everything()


@dataclass(frozen=True)
class Duplicates(Selector):
    metres: float = 0.0


@dataclass(frozen=True)
class Ranked(Selector):
    child: Selector
    expression: str
    k: int | None = None
    ascending: bool = False


@dataclass(frozen=True)
class Sample(Selector):
    child: Selector
    n: int
    seed: int = 0


@dataclass(frozen=True)
class And(Selector):
    children: tuple[Selector, ...] = ()


@dataclass(frozen=True)
class Or(Selector):
    children: tuple[Selector, ...] = ()


@dataclass(frozen=True)
class Invert(Selector):
    children: tuple[Selector, ...] = ()


def invert(s: Selector) -> Selector:
    return s.children[0] if isinstance(s, Invert) and s.children else Invert((s,))


def combine(kind: type, children: list[Selector]) -> Selector:
    """Flatten groups of one kind, drop Everything from And, keep the last of equals; one child stands alone, an empty And is Everything."""
    flat: list[Selector] = []
    for c in children:
        flat += c.children if isinstance(c, kind) else [c]
    if kind is And:
        flat = [c for c in flat if not isinstance(c, Everything)]
    last = {c.key(): c for c in flat}
    kept = [c for k, c in enumerate(flat) if c.key() not in {x.key() for x in flat[k + 1 :]}]
    assert len(kept) == len(last)
    return kept[0] if len(kept) == 1 else Everything() if kind is And and not kept else kind(tuple(kept))


def rename_field(s: Selector, old: str, new: str) -> Selector:
    if isinstance(s, Filter):
        return replace(s, field=new) if s.field == old else s
    if isinstance(s, (And, Or, Invert)):
        return type(s)(tuple(rename_field(c, old, new) for c in s.children))
    if isinstance(s, (Nearby, Nearest, Ranked, Sample)):
        return replace(s, child=rename_field(s.child, old, new))
    return s


def field(df: DataFrame, name: str) -> tuple[Column, str]:
    """A column by name, the virtual fields, or a key of the open JSON column."""
    if name == "tagCount":
        return F.size("tags").cast("double"), "double"
    if name == "loadAsPanoId":
        return F.col("flags").bitwiseAND(1) != 0, "boolean"
    if name in df.columns:
        return F.col(name), df.schema[name].dataType.simpleString()
    return F.get_json_object("extra", f"$.{name}"), "string"


def present(c: Column, kind: str) -> Column:
    return F.size(c) > 0 if kind.startswith("array") else c.isNotNull() & (c != "") if kind == "string" else c.isNotNull()


def _equal(c: Column, kind: str, value) -> Column:
    if kind.startswith("array"):
        return F.size(c) == F.lit(value)
    if kind == "string" and isinstance(value, (int, float)):
        return c.try_cast("double") == F.lit(float(value))
    if kind == "string":
        number = F.lit(value).try_cast("double")
        return (c == F.lit(value)) | F.coalesce(c.try_cast("double") == number, F.lit(False)) & (c != "")
    if kind == "boolean":
        return c.cast("string") == F.lit(str(value).lower())
    return c.cast("double") == F.lit(value).try_cast("double")


def _ordered(c: Column, kind: str, op: str, value) -> Column:
    if kind.startswith("array"):
        c, kind = F.size(c), "int"
    lit = lambda v: F.lit(v)
    if kind == "string" and not isinstance(value if op != "between" else value[0], str):
        c = c.try_cast("double")
    if op == "between":
        return c.between(lit(value[0]), lit(value[1]))
    return {"gt": c > lit(value), "lt": c < lit(value), "gte": c >= lit(value), "lte": c <= lit(value)}[op]


def _wrapped(c: Column, lo: str, hi: str) -> Column:
    return c.between(F.lit(lo), F.lit(hi)) if lo <= hi else (c >= F.lit(lo)) | (c <= F.lit(hi))


def predicate(df: DataFrame, f: Filter) -> Column:
    """Two-valued: an absent value passes nothas only."""
    c, kind = field(df, f.field)
    there = present(c, kind)
    if f.op == "has":
        out = there
    elif f.op == "nothas":
        return ~F.coalesce(there, F.lit(False))
    elif f.op in ("contains", "notcontains"):
        if not kind.startswith("array"):
            return F.lit(False)
        hit = F.array_contains(c, F.lit(f.value).cast("long"))
        out = there & (hit if f.op == "contains" else ~hit)
    else:
        if kind == "string" and f.op == "between_anyyear" and f.field not in CALENDAR:
            # texts YYYY-MM-DD, with anything after it, or YYYY-MM, which is the first day
            day = F.when(F.length(c) >= 10, F.substring(c, 6, 5)).otherwise(F.concat(F.substring(c, 6, 2), F.lit("-01")))
            return F.coalesce(there & (F.length(c) >= 7) & (F.substring(c, 5, 1) == "-") & _wrapped(day, *f.value), F.lit(False))
        if f.field in CALENDAR:
            instant = F.timestamp_seconds(c)
            zone = F.when(F.col("timezone").isNotNull(), F.col("timezone")) if f.tz_local else None
            local = F.from_utc_timestamp(instant, zone) if f.tz_local else instant
            if f.op == "between_anyyear":
                return F.coalesce(there & _wrapped(F.date_format(local, "MM-dd"), *f.value), F.lit(False))
            if f.op == "between_anytime":
                return F.coalesce(there & _wrapped(F.date_format(local, "HH:mm"), *f.value), F.lit(False))
            c = F.unix_timestamp(local) if f.tz_local else c
        out = there & (_equal(c, kind, f.value) if f.op == "eq" else ~F.coalesce(_equal(c, kind, f.value), F.lit(False)) if f.op == "neq" else _ordered(c, kind, f.op, f.value))
    return F.coalesce(out, F.lit(False))


def row_local(s: Selector) -> bool:
    if isinstance(s, (Nearest, Duplicates, Ranked, Sample)):
        return False
    if isinstance(s, Nearby):
        return row_local(s.child)
    return all(map(row_local, s.children)) if isinstance(s, (And, Or, Invert)) else True


def column(df: DataFrame, s: Selector) -> Column:
    """The boolean column of a row-local tree."""
    if isinstance(s, Everything):
        return F.lit(True)
    if isinstance(s, Selected):
        return F.lit(False)
    if isinstance(s, Uncommitted):
        return F.coalesce(F.col("uncommitted"), F.lit(False)) if "uncommitted" in df.columns else F.lit(False)
    if isinstance(s, Ids):
        return F.col("id").isin(list(s.ids))
    if isinstance(s, Filter):
        return predicate(df, s)
    if isinstance(s, Polygon):
        return geo.in_polygon(F.col("lat"), F.col("lng"), [list(r) for r in s.rings])
    if isinstance(s, Nearby):
        box = F.col("lat").between(s.lat - s.radius_m / 110000.0, s.lat + s.radius_m / 110000.0)  # reaches the scan
        return F.coalesce(box & (geo.haversine_m(F.col("lat"), F.col("lng"), s.lat, s.lng) <= s.radius_m), F.lit(False)) & column(df, s.child)
    parts = [column(df, c) for c in s.children]
    if isinstance(s, Invert):
        return ~parts[0] if parts else F.lit(True)
    out = parts[0] if parts else F.lit(False)  # an empty group selects nothing
    for p in parts[1:]:
        out = out & p if isinstance(s, And) else out | p
    return out


def ranked(df: DataFrame, expression: str, ascending: bool = False) -> DataFrame:
    """df with its score, best first; rows without a score come last in both directions, ties by id."""
    try:
        score = compile_expression(expression, lambda n: field(df, n))
    except ExpressionError:
        score = F.lit(None).cast("double")
    df = df.withColumn("score", score)
    return df.orderBy(F.asc_nulls_last("score") if ascending else F.desc_nulls_last("score"), "id")


def select(df: DataFrame, s: Selector) -> DataFrame:
    """The rows of df that a tree selects; nodes that depend on a set see their whole pool before anything clips it."""
    if row_local(s):
        return df.filter(column(df, s))
    if isinstance(s, Nearest):
        d = geo.haversine_m(F.col("lat"), F.col("lng"), s.lat, s.lng)
        return select(df, s.child).orderBy(d, "id").limit(1)
    if isinstance(s, Duplicates):
        return df.join(spatial.duplicate_ids(df, s.metres), "id", "left_semi")
    if isinstance(s, Ranked):
        out = ranked(select(df, s.child), s.expression, s.ascending)
        return (out if s.k is None else out.limit(s.k)).drop("score")
    if isinstance(s, Sample):
        return select(df, s.child).orderBy(F.xxhash64(F.col("id"), F.lit(s.seed)), "id").limit(s.n)
    if isinstance(s, Nearby):
        return select(df, s.child).filter(column(df, replace(s, child=Everything())))
    ids = [select(df, c).select("id") for c in s.children]
    if isinstance(s, Invert):
        return df.join(ids[0], "id", "left_anti")
    if isinstance(s, Or):
        union = ids[0]
        for i in ids[1:]:
            union = union.unionByName(i)
        return df.join(union.distinct(), "id", "left_semi")
    for i in ids:
        df = df.join(i, "id", "left_semi")
    return df
