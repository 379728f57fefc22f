"""Procedures: functions that fill fields of rows, in the order of what they need of each other.

Results are written into the table (``applied``, ``run``), handed back beside it (``collected``), or made page by page into a folder
(``paged``), where those of finished pages can be read while later ones run and a run that was broken off goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spatial
from .shared import running


@dataclass(frozen=True)
class Provider:
    """What a procedure writes (name -> type) and needs, and its function from a batch of the needed columns to the written ones.

    ``once_by`` names a key whose rows share one call; rows without the key stand alone. Without ``writes`` there is nothing to skip.
    ``batch`` is the most rows of a call. ``around`` (metres, fields) asks the table for each row's neighbours: a column ``neighbours``
    of structs (id, metres, fields …), nearest first, the row itself among them, comes by a join before any call.
    """

    name: str
    writes: dict[str, str]
    needs: tuple[str, ...]
    run: Callable[[pd.DataFrame], pd.DataFrame]
    once_by: str | None = None
    force: bool = False
    batch: int = 10_000
    around: tuple[float, tuple[str, ...]] | None = None

    def __post_init__(self):
        if self.around and self.once_by:
            raise ValueError("rows that share a call have no neighbours in common")

    @property
    def given(self) -> tuple[str, ...]:
        """The columns of a call."""
        return (*self.needs, "neighbours") if self.around else self.needs


@dataclass(frozen=True)
class Registry:
    providers: dict[str, Provider] = field(default_factory=dict)

    def order(self, names: list[str]) -> list[Provider]:
        """Producers of needed fields first; those of a cycle keep the order they are given in."""
        chosen, out = [self.providers[n] for n in names], []
        while chosen:
            made = {w for p in chosen for w in p.writes}
            ready = [p for p in chosen if not any(need in made and need not in p.writes for need in p.needs)]
            out += ready or chosen
            chosen = [p for p in chosen if p not in out]
        return out


def _call(provider: Provider, keys: list[str]):
    def run(batches):
        for arrived in batches:
            for start in range(0, len(arrived), provider.batch):
                rows = arrived.iloc[start : start + provider.batch]
                done = provider.run(rows[list(provider.given)].reset_index(drop=True))
                yield pd.concat([rows[keys].reset_index(drop=True), done[list(provider.writes)].reset_index(drop=True)], axis=1)

    return run


def _marked(df: DataFrame, provider: Provider) -> DataFrame:
    """df with null columns for fields it lacks and ``status``."""
    for name, kind in provider.writes.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    missing, held = F.lit(False), F.lit(bool(provider.writes) and not provider.force)
    for n in provider.needs:
        missing = missing | F.col(n).isNull()
    for w in provider.writes:
        held = held & F.col(w).isNotNull()
    return df.withColumn("status", F.when(held, "skipped").when(missing, "failed").otherwise("done"))


def _calls(df: DataFrame, todo: DataFrame, provider: Provider) -> DataFrame:
    """(id, what a call is given) of the rows to do."""
    calls = todo.select("id", *provider.needs)
    if provider.around:
        metres, fields = provider.around
        near = spatial.neighbours(df, metres, list(fields))
        calls = calls.join(near, "id", "left")
    return calls


def _made(calls: DataFrame, provider: Provider) -> DataFrame:
    """(id, fields) that the function gives."""
    schema = T.StructType([calls.schema["id"], *(T.StructField(w, T._parse_datatype_string(k)) for w, k in provider.writes.items())])
    return calls.mapInPandas(_call(provider, ["id"]), schema)


def _results(df: DataFrame, todo: DataFrame, provider: Provider) -> DataFrame:
    """(id, fields) of the rows to do; one row stands for all of its key, those without a key for themselves."""
    if not provider.once_by:
        return _made(_calls(df, todo, provider), provider)
    alone = todo.filter(F.col(provider.once_by).isNull())
    first = todo.filter(F.col(provider.once_by).isNotNull()).groupBy(provider.once_by).agg(F.min_by(F.struct("id", *provider.needs), "id").alias("r"))
    calls = first.select("r.id", *(F.col(f"r.{n}").alias(n) for n in provider.needs)).unionByName(alone.select("id", *provider.needs))
    made = _made(calls, provider)
    by = first.select(F.col(provider.once_by).alias("_shared"), F.col("r.id").alias("id"))
    fan = made.join(by, "id").drop("id")
    some = todo.select("id", F.col(provider.once_by).alias("_shared")).join(fan, "_shared").drop("_shared")
    return some.unionByName(made.join(alone.select("id"), "id", "left_semi"))


def applied(df: DataFrame, provider: Provider) -> DataFrame:
    """df with the provider's fields and ``status``: done, skipped (all of them held already, unless forced) or failed (a needed field is missing)."""
    rows = _marked(df, provider)
    made = _results(df, rows.filter("status = 'done'"), provider).select("id", *(F.col(w).alias(f"new_{w}") for w in provider.writes))
    out = rows.join(made, "id", "left")
    value = lambda w: F.when(F.col("status") == "done", F.col(f"new_{w}")).otherwise(F.col(w))
    return out.select(*(value(c).alias(c) if c in provider.writes else F.col(c) for c in rows.columns if c != "status"), "status")


def collected(df: DataFrame, provider: Provider) -> DataFrame:
    """(id, fields, input_hash) of the rows to do, the table left as it is; ``landed`` writes them later where the inputs are still the same."""
    todo = _marked(df, provider).filter("status = 'done'")
    return _results(df, todo, provider).join(todo.select("id", F.xxhash64(*provider.needs).alias("input_hash")), "id")


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """A table written before, None if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


_DONE = T.StructType([T.StructField("page", T.LongType())])


def paged(df: DataFrame, provider: Provider, folder: str, page_rows: int = 1_000_000, most: int | None = None) -> int:
    """Make results page by page into a shared folder and give the number of pages left, at most ``most`` pages a call.

    The rows to do are numbered by id once and kept with what a call is given, so a run that goes on sees the inputs it began with.
    A page is a job of about ``page_rows`` rows; its results are in a folder of their own, and it is told finished after they are
    written, so a page that was broken off is made anew. ``partial`` reads what is finished at any time. ``once_by`` is not for pages.
    """
    if provider.once_by:
        raise ValueError("rows that share a call may lie in several pages")
    spark = df.sparkSession
    todo = _marked(df, provider).filter("status = 'done'")
    calls = _calls(df, todo, provider).withColumn("input_hash", F.xxhash64(*provider.needs))
    plan_schema = T.StructType([*calls.schema.fields, T.StructField("page", T.LongType())])
    finished = _stored(spark, f"{folder}/done", _DONE)
    if finished is None:  # written last, so the plan is whole
        numbered = running(calls, [], ["id"], F.lit(1), "_n")
        pages = numbered.withColumn("page", F.floor((F.col("_n") - 1) / page_rows)).drop("_n")
        pages.write.mode("overwrite").partitionBy("page").parquet(f"{folder}/plan")
        spark.createDataFrame([], _DONE).write.mode("overwrite").parquet(f"{folder}/done")
        finished = _stored(spark, f"{folder}/done", _DONE)
    plan = spark.read.schema(plan_schema).parquet(f"{folder}/plan")
    open_pages = [r.page for r in plan.select("page").distinct().join(finished, "page", "left_anti").orderBy("page").collect()]
    now = open_pages if most is None else open_pages[:most]
    for page in now:
        rows = plan.filter(F.col("page") == page)
        made = _made(rows.drop("page"), provider).join(rows.select("id", "input_hash"), "id")
        made.write.mode("overwrite").parquet(f"{folder}/results/page={page}")
        spark.createDataFrame([(page,)], _DONE).write.mode("append").parquet(f"{folder}/done")
    return len(open_pages) - len(now)


def partial(spark: SparkSession, provider: Provider, folder: str, id_type: str = "long") -> DataFrame:
    """(id, fields, input_hash, page) of the finished pages; empty before the first."""
    fields = ", ".join(f"`{w}` {k}" for w, k in provider.writes.items())
    schema = T._parse_datatype_string(f"id {id_type}, {fields}, input_hash long, page long")
    results, finished = _stored(spark, f"{folder}/results", schema), _stored(spark, f"{folder}/done", _DONE)
    if results is None or finished is None:
        return spark.createDataFrame([], schema)
    return results.join(finished, "page", "left_semi").select(*schema.names)


def run(df: DataFrame, registry: Registry, names: list[str]) -> DataFrame:
    """df after the named procedures, each with its own status column."""
    for provider in registry.order(names):
        df = applied(df, provider).withColumnRenamed("status", f"{provider.name}_status")
    return df


def landed(table: DataFrame, result: DataFrame, fields: list[str], inputs: list[str]) -> DataFrame:
    """table with a result (id, input_hash, fields …) where the inputs are still those it was made from."""
    same = F.xxhash64(*inputs)
    both = table.withColumn("hash_now", same).join(result.select("id", "input_hash", *(F.col(f).alias(f"new_{f}") for f in fields)), "id", "left")
    fresh = F.col("hash_now").eqNullSafe(F.col("input_hash"))
    return both.select(*(F.when(fresh, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns), fresh.alias("landed"))


# What a check of coverage may find.
FINDINGS = {"newer": 1, "off_default": 2, "default_stale": 4, "pano_id_broke": 8, "unofficial": 16, "goodcam_available": 32, "not_found": 64}


def findings(**found: Column) -> Column:
    """All findings of a row in one number."""
    out = F.lit(0)
    for name, holds in found.items():
        out = out.bitwiseOR(F.when(holds, FINDINGS[name]).otherwise(0))
    return out
