"""Patches that keep, clear or set fields, fields derived from others, and an ordered feed of changes that readers resume from a version.

A patch is a row (id, written, …): ``written`` names the columns it writes, so a null there clears a field, and columns it doesn't
name are kept.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from . import changes
from .shared import latest, running


def _columns(df: DataFrame, *without: str) -> list[str]:
    return [c for c in df.columns if c not in ("id", *without)]


def _writes(side: str, c: str) -> Column:
    return F.coalesce(F.array_contains(F.col(f"{side}.written"), c), F.lit(False))


def patched(table: DataFrame, patches: DataFrame) -> DataFrame:
    """table after patches, at most one a row; a patch without its row does nothing."""
    t, p = table.alias("t"), patches.alias("p")
    value = lambda c: F.when(_writes("p", c), F.col(f"p.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    return t.join(p, F.col("t.id") == F.col("p.id"), "left").select("t.id", *(value(c) for c in _columns(table)))


def patch_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """The patches that turn the rows of old into those of new, for ids that both hold; rows that are equal have none."""
    cols = _columns(old)
    o, n = old.alias("o"), new.alias("n")
    moved = F.filter(F.array(*(F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in cols)), lambda x: x.isNotNull())
    out = o.join(n, F.col("o.id") == F.col("n.id")).withColumn("_moved", moved).filter(F.size("_moved") > 0)
    return out.select("n.id", F.col("_moved").alias("written"), *(F.when(F.array_contains("_moved", c), F.col(f"n.{c}")).alias(c) for c in cols))


def then(first: DataFrame, later: DataFrame) -> DataFrame:
    """One patch for each id that does what first and then later do: later wins where it writes."""
    cols = _columns(first, "written")
    a, b = first.alias("a"), later.alias("b")
    none = F.array().cast("array<string>")
    value = lambda c: F.when(_writes("b", c), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    both = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
    return both.select(F.coalesce("a.id", "b.id").alias("id"), F.array_sort(F.array_union(F.coalesce("a.written", none), F.coalesce("b.written", none))).alias("written"), *(value(c) for c in cols))


def _merged(target, patch):
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for key, value in patch.items():
        if value is None:
            out.pop(key, None)
        else:
            out[key] = _merged(out.get(key), value)
    return out


@F.pandas_udf(StringType())
def merge_patch(target: pd.Series, patch: pd.Series) -> pd.Series:
    """JSON merge patches (RFC 7396) applied to JSON texts; a null target is an empty one, a null patch changes nothing."""
    done = [t if p is None else json.dumps(_merged(None if t is None else json.loads(t), json.loads(p)), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for t, p in zip(target, patch)]
    return pd.Series(done, dtype=object)


# --- derived fields


def reach(depends: dict[str, list[str]], written: set[str] = frozenset()) -> dict[str, set[str]]:
    """For each derived field (depends: field -> what it is computed from) the inputs whose change makes it stale.

    A change goes on through derived fields, but not through one that the same edit wrote.
    """
    found = {}
    for field in depends:
        if field in written:
            continue
        seen, todo = set(), [field]
        while todo:
            for need in depends.get(todo.pop(), []):
                if need not in seen:
                    seen.add(need)
                    if need not in written:
                        todo.append(need)
        found[field] = seen
    return found


def derived(df: DataFrame, edit: Callable[[DataFrame], DataFrame], depends: dict[str, list[str]], written: set[str] = frozenset()) -> DataFrame:
    """What an edit of rows (J1 to J5, and any other function of a table that keeps its columns) gives, with derived fields made null
    in rows where something they are computed from changed. All in the projection of the edit; the fields it writes itself stay.
    """
    inputs = sorted({n for needs in depends.values() for n in needs})
    out = edit(df.withColumns({f"_was_{c}": F.col(c) for c in inputs}))
    moved = {c: ~F.col(f"_was_{c}").eqNullSafe(F.col(c)) for c in inputs}
    nulls = {}
    for field, sources in reach(depends, written).items():
        stale = F.lit(False)
        for c in sorted(sources & set(inputs)):
            stale = stale | moved[c]
        nulls[field] = F.when(~stale, F.col(field))
    return out.withColumns(nulls).drop(*(f"_was_{c}" for c in inputs))


def derived_after(old: DataFrame, new: DataFrame, depends: dict[str, list[str]]) -> DataFrame:
    """new, a table after edits of old, with derived fields made null in rows where their inputs changed and they didn't.

    For edits that aren't row by row (J9, procedures): a derived field that differs was written, and stays.
    """
    o, n = old.select("id", *(F.col(c).alias(f"_was_{c}") for c in _columns(old))), new
    both = n.join(o.withColumn("_there", F.lit(True)), "id", "left")
    moved = lambda c: ~F.col(f"_was_{c}").eqNullSafe(F.col(c))
    stale: dict[str, Column] = {}

    def is_stale(field: str, on: tuple = ()) -> Column:
        if field not in stale:
            any_moved = F.lit(False)
            for need in depends[field]:
                any_moved = any_moved | moved(need)
                if need in depends and need not in on:
                    any_moved = any_moved | is_stale(need, (*on, field))
            test = F.coalesce("_there", F.lit(False)) & ~moved(field) & any_moved
            if on:
                return test
            stale[field] = test
        return stale[field]

    nulls = {f: F.when(~is_stale(f), F.col(f)) for f in depends}
    return both.withColumns(nulls).select(*new.columns)


# --- the feed


def change_log(edits: DataFrame) -> DataFrame:
    """(version, id, kind, before, after): what each edit of (batch, seq, id, op, written, …) did to its row, in the order of seq.

    Ops as in ``history.edited``, on a table that begins empty. Batches get versions from 1 without gaps, those that change nothing
    too (a row without an id); edits that change nothing are no change. A row's state before an edit is carried along its id, so
    the edits of one id may be most of the table.
    """
    cols = _columns(edits, "batch", "seq", "op", "written")
    whole = F.col("op") != "put"
    numbered = running(edits.groupBy("batch").agg(F.min("seq").alias("_first")), [], ["_first"], F.lit(1), "version")
    known = latest(edits, ["id"], ["seq"], {"_alive": F.when(whole, F.col("op") != "remove")}).withColumn("_alive", F.coalesce("_alive", F.lit(False)))
    real = known.filter(whole | F.col("_alive"))  # a put without its row does nothing
    write = lambda c: F.when(whole | F.coalesce(F.array_contains("written", c), F.lit(False)), F.struct(F.when(F.col("op") != "remove", F.col(c)).alias("v")))
    state = latest(real, ["id"], ["seq"], {f"_b_{c}": write(c) for c in cols})
    before = F.when(F.col("_alive"), F.struct("id", *(F.col(f"_b_{c}.v").alias(c) for c in cols)))
    after = F.when(F.col("op") != "remove", F.struct("id", *(F.when(write(c).isNotNull(), F.col(c)).otherwise(F.col(f"_b_{c}.v")).alias(c) for c in cols)))
    did = state.select("batch", "seq", "id", before.alias("before"), after.alias("after"))
    one = did.groupBy("batch", "id").agg(F.min_by(F.struct("before"), "seq").alias("x"), F.max_by(F.struct("after"), "seq").alias("y"))
    moved = one.select("batch", "id", "x.before", "y.after").filter(~F.col("before").eqNullSafe(F.col("after")))
    out = numbered.join(moved, "batch", "left")
    return out.select("version", "id", F.when(F.col("id").isNotNull(), changes.kind()).alias("kind"), "before", "after")


def state_at(feed: DataFrame, version: int, base: DataFrame | None = None, since: int = 0) -> DataFrame:
    """The table at a version: base, the table at ``since`` (nothing at 0), under the changes after it."""
    part = feed.filter((F.col("version") > since) & (F.col("version") <= version) & F.col("id").isNotNull())
    net = changes.compose(part.select(F.col("version").alias("seq"), "id", "before", "after"))
    if base is None:
        return net.filter("after IS NOT NULL").select("after.*")
    return changes.apply(base, net)


def counts(feed: DataFrame) -> DataFrame:
    """(version, added, removed, updated): the keys that each version touched."""
    n = lambda k: F.count_if(F.col("kind").eqNullSafe(k)).alias(k)
    return feed.groupBy("version").agg(n("added"), n("removed"), n("updated"))


class Feed:
    """A feed kept as a table of one folder a version. One writer appends; readers take what came after the version they know."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        """schema is that of ``changes.between``: id, before and after."""
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _read(self) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        return self.spark.read.schema(f"{fields}, version long").parquet(self.path)

    def version(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return 0
        names = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("version=")]
        done = [p for p in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max((int(p.getName().split("=")[1]) for p in done), default=0)

    def append(self, change: DataFrame) -> int:
        """Write a change as the next version and return that; one that was broken off before is written over. Also if it is empty."""
        version = self.version() + 1
        change.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/version={version}")
        return version

    def since(self, version: int, upto: int | None = None) -> DataFrame:
        """The changes of the versions after one; partition pruning reads no others."""
        last = self.version() if upto is None else upto
        if last <= version:
            return self.spark.createDataFrame([], self.schema).withColumn("version", F.lit(0).cast("long"))
        return self._read().filter((F.col("version") > version) & (F.col("version") <= last))

    def table(self, version: int | None = None, base: DataFrame | None = None, since: int = 0) -> DataFrame:
        last = self.version() if version is None else version
        return state_at(self.since(since, last), last, base, since)
