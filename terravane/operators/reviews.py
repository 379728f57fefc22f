"""Review sessions: for each source a worklist in a fixed order, and a cursor that walks it.

A worklist row is (source, run, place, id, reviewed). ``run`` numbers what was appended, ``place`` the rows of one run, so appending
and pruning renumber nothing: the order is (run, place), with gaps. A cursor row is (source, run, place, id, done). Every function
works on all sources at once and cuts the lineage of the cursors, so a walk of many steps doesn't redo earlier ones; a source with most of the rows is dealt by ranges (``shared.running``) and aggregated before a shuffle.
Ids are told once a source; a null source or id is no work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, running, small


def _at() -> Column:
    return F.struct("run", "place", "id")


def _numbered(matches: DataFrame, order: list[str]) -> DataFrame:
    """(source, place, id) in the order of the given columns, ties by id; of repeated ids the first stands."""
    rows = matches.filter("source IS NOT NULL AND id IS NOT NULL")
    keys = F.struct(*(F.col(c) for c in order), F.col("id").alias("_id"))
    first = rows.groupBy("source", "id").agg(F.min(keys).alias("_order"))
    return running(first, ["source"], ["_order"], F.lit(1), "place").select("source", "place", "id")


def _cursors(first: DataFrame) -> DataFrame:
    return first.select("source", "at.run", "at.place", "at.id", F.lit(False).alias("done"))


def begin(matches: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(worklist, cursors) over matches (source, id, …); a source without matches has no session."""
    work = _numbered(matches, order).select("source", F.lit(0).alias("run"), "place", "id", F.lit(False).alias("reviewed"))
    work = checkpointed(work)
    return work, checkpointed(_cursors(work.groupBy("source").agg(F.min(_at()).alias("at"))))


def unseen(work: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches of sources with a session that its worklist lacks."""
    known = work.select("source").distinct()
    return matches.join(work.select("source", "id"), ["source", "id"], "left_anti").join(known, "source", "left_semi")


def append(work: DataFrame, matches: DataFrame, order: list[str]) -> DataFrame:
    """work with its unseen matches as one more run at the end of each list; rows of earlier runs stay as they are."""
    runs = work.groupBy("source").agg((F.max("run") + 1).alias("run"))
    new = _numbered(unseen(work, matches), order).join(small(runs), "source")
    return work.unionByName(new.select("source", "run", "place", "id", F.lit(False).alias("reviewed")))


def _with_cursor(work: DataFrame, cursors: DataFrame) -> DataFrame:
    at = cursors.select("source", F.struct("run", "place", "id").alias("at"))
    return work.join(small(at), "source")


def prune(work: DataFrame, cursors: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without the ids that aren't live (id). A cursor whose row went takes the row at its old position in what is left, the last
    one if that is shorter; a list with nothing left ends its session."""
    left = checkpointed(work.join(live.select("id").distinct(), "id", "left_semi").select(*work.columns))
    stay = cursors.join(left.select("source", "id"), ["source", "id"], "left_semi").select(*cursors.columns)
    lost = cursors.join(left.select("source", "id"), ["source", "id"], "left_anti").select(*cursors.columns)
    was = _with_cursor(work, lost).groupBy("source").agg(F.count(F.when(_at() < F.col("at"), 1)).alias("before"))
    lists = left.join(small(lost.select("source")), "source", "left_semi")
    total = lists.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    wanted = was.join(total, "source").select("source", F.least(F.col("before") + 1, "total").alias("nth"), F.lit(True).alias("there"))
    placed = running(lists.select("source", "run", "place", "id"), ["source"], ["run", "place", "id"], F.lit(1), "nth")
    back = placed.join(small(wanted), ["source", "nth"]).select("source", "run", "place", "id")
    done = lost.select("source", "done")
    return left, checkpointed(stay.unionByName(back.join(done, "source").select(*cursors.columns)))


def advance(work: DataFrame, cursors: DataFrame, when: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Each cursor's row is reviewed and the cursor goes one on; at the end of the list it stays and is done. ``when`` chooses cursors."""
    chosen = cursors if when is None else cursors.filter(when)
    marks = chosen.select("source", "id", F.lit(True).alias("_mark"))
    marked = work.join(small(marks), ["source", "id"], "left").select("source", "run", "place", "id", (F.col("reviewed") | F.coalesce("_mark", F.lit(False))).alias("reviewed"))
    following = _with_cursor(work, chosen).filter(_at() > F.col("at")).groupBy("source").agg(F.min(_at()).alias("to"))
    moved = chosen.join(following, "source", "left")
    to = lambda c: F.coalesce(F.col(f"to.{c}"), F.col(c)).alias(c)
    new = moved.select("source", to("run"), to("place"), to("id"), (F.col("done") | F.col("to").isNull()).alias("done"))
    rest = cursors.join(chosen.select("source"), "source", "left_anti").select(*cursors.columns)
    return marked, checkpointed(new if when is None else new.unionByName(rest))


def retreat(work: DataFrame, cursors: DataFrame) -> DataFrame:
    """Cursors one back, those at the start as they are; nothing is marked."""
    earlier = _with_cursor(work, cursors).filter(_at() < F.col("at")).groupBy("source").agg(F.max(_at()).alias("to"))
    to = lambda c: F.coalesce(F.col(f"to.{c}"), F.col(c)).alias(c)
    return checkpointed(cursors.join(earlier, "source", "left").select("source", to("run"), to("place"), to("id"), "done"))


def resumed(work: DataFrame, cursors: DataFrame, live: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(worklist, cursors, new matches): sessions without what is gone, and what their sources match now that they lack."""
    left, now = prune(work, cursors, live)
    return left, now, unseen(left, matches).select("source", "id").distinct()


def ids(work: DataFrame, reviewed: bool) -> DataFrame:
    """(source, run, place, id) that are reviewed, or still to review."""
    return work.filter(F.col("reviewed") == reviewed).drop("reviewed")


def reviewed_ids(work: DataFrame) -> DataFrame:
    """Ids that some session has reviewed, once each."""
    return work.filter("reviewed").select("id").distinct()
