"""Change tables: (id, before, after) structs, null where a side has no row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import running, small


def _rows(df: DataFrame, name: str) -> DataFrame:
    return df.select("id", F.struct(*df.columns).alias(name))


def between(old: DataFrame, new: DataFrame) -> DataFrame:
    """What turns old into new."""
    both = _rows(old, "before").join(_rows(new.select(*old.columns), "after"), "id", "full_outer")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def kind():
    return F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("updated")


def apply(table: DataFrame, change: DataFrame) -> DataFrame:
    kept = table.join(change.select("id"), "id", "left_anti").select(*table.columns)
    return kept.unionByName(change.filter("after IS NOT NULL").select("after.*"))


def inverse(change: DataFrame) -> DataFrame:
    return change.select("id", F.col("after").alias("before"), F.col("before").alias("after"))


def compose(steps: DataFrame) -> DataFrame:
    """steps (seq, id, before, after) as one change: the first before, the last after; what comes back is no change."""
    out = steps.groupBy("id").agg(F.min_by("before", "seq").alias("before"), F.max_by("after", "seq").alias("after"))
    return out.filter(~F.col("before").eqNullSafe(F.col("after")))


def stale(table: DataFrame, change: DataFrame) -> DataFrame:
    """Ids whose row is no longer what the change stands on."""
    now = _rows(table, "now")
    return change.join(now, "id", "left").filter(~F.col("before").eqNullSafe(F.col("now"))).select("id")


def checkout(log: DataFrame, chain: DataFrame) -> DataFrame:
    """Rows after the commits of a chain (commit_id, depth; 0 the oldest) over a log (commit_id, op, id, …): the last op of each id; op 0 removes."""
    cols = [c for c in log.columns if c not in ("commit_id", "op")]
    last = log.join(small(chain), "commit_id").groupBy("id").agg(F.max_by(F.struct("op", *cols), "depth").alias("r"))
    return last.filter("r.op <> 0").select(*(f"r.{c}" for c in cols))


def layer(ops: DataFrame) -> DataFrame:
    """(id, removed, value) of pending ops (id, seq, op, value): set and remove forget what came before, later puts fill in."""
    reset = F.max(F.when(F.col("op") != "put", F.col("seq"))).over(W.partitionBy("id"))
    live = ops.withColumn("reset", F.coalesce(reset, F.lit(-1))).filter("seq >= reset")
    return live.groupBy("id").agg(F.max_by("op", "seq").eqNullSafe("remove").alias("removed"), F.max_by(F.col("value"), F.when(F.col("value").isNotNull(), F.col("seq"))).alias("value"))


def three_way(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """(key, plan) of tables (key, hash): what a synchronisation does with each key."""
    return _planned(base, local, remote).select("key", "plan")


def _planned(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """(key, b, l, r, plan): the hashes of the three sides beside what is to be done."""
    b, lo, r = (d.select("key", F.col("hash").alias(n)) for d, n in ((base, "b"), (local, "l"), (remote, "r")))
    j = b.join(lo, "key", "full_outer").join(r, "key", "full_outer")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    plan = (
        F.when(same("l", "r"), "none")
        .when(same("b", "l"), F.when(F.col("r").isNull(), "remove_local").when(F.col("l").isNull(), "add_local").otherwise("update_local"))
        .when(same("b", "r"), F.when(F.col("l").isNull(), "remove_remote").when(F.col("r").isNull(), "add_remote").otherwise("update_remote"))
        .otherwise("conflict")
    )
    return j.select("key", "b", "l", "r", plan.alias("plan"))


def synchronised(base: DataFrame, local: DataFrame, remote: DataFrame, first: str = "merge", pull_only: bool = False, sides: DataFrame | None = None) -> DataFrame:
    """(key, plan, hash) of tables (key, hash): what a synchronisation does with each key, and the hash its base has afterwards.

    Conflicts go to the side that ``sides`` (key, side: local or remote) names, on a link that only pulls always to the remote one;
    others stay conflicts. A first synchronisation, one with an empty base, merges both tables, or mirrors one: what only the other
    holds is removed there (``first``: merge, remote, local). A link that only pulls leaves local edits and removals be (``held``)
    and local additions alone (``none``). Keys in conflict or held keep their base; a null hash is a key without one.
    An empty remote table under a base that isn't is an error, not a removal of everything.
    """
    if first not in ("merge", "remote", "local"):
        raise ValueError(f"unknown first synchronisation: {first}")
    if pull_only and first == "local":
        raise ValueError("a link that only pulls can't mirror the local table")
    initial = base.isEmpty()
    if not initial and remote.isEmpty():
        raise ValueError("the remote table came back empty; nothing was synchronised")
    rows = _planned(base, local, remote)
    if sides is not None:
        rows = rows.join(sides.select("key", "side"), "key", "left")
    side = F.lit("remote") if pull_only else F.col("side") if sides is not None else F.lit(None).cast("string")
    wins = lambda to, mine, theirs: F.when(F.col(mine).isNull(), f"remove_{to}").when(F.col(theirs).isNotNull(), f"update_{to}").otherwise(f"add_{to}")
    settled = F.when(side == "local", wins("remote", "l", "r")).when(side == "remote", wins("local", "r", "l")).otherwise("conflict")
    plan = F.when(F.col("plan") == "conflict", settled).otherwise(F.col("plan"))
    if initial and first == "remote":
        plan = F.when(plan == "add_remote", "remove_local").otherwise(plan)
    if initial and first == "local":
        plan = F.when(plan == "add_local", "remove_remote").otherwise(plan)
    if pull_only:
        plan = F.when(plan == "add_remote", "none").when(plan.isin("update_remote", "remove_remote"), "held").otherwise(plan)
    rows = rows.select("key", "b", "l", "r", plan.alias("plan"))
    after = F.when(F.col("plan").isin("conflict", "held"), F.col("b")).when(F.col("plan").isin("remove_local", "remove_remote"), None)
    after = after.when(F.col("plan").isin("add_local", "update_local"), F.col("r")).otherwise(F.col("l"))
    return rows.select("key", "plan", after.alias("hash"))


def numbered(df: DataFrame, content: str, order: str) -> DataFrame:
    """Rows with the key content#n, n counting equal contents in order."""
    rows = running(df, [content], [order], F.lit(1), "_n")
    return rows.withColumn("key", F.concat_ws("#", F.col(content).cast("string"), F.col("_n").cast("string"))).drop("_n")
