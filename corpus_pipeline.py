"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm.frames import materialize, named, text_key, text_of
from terravane.llm.neardup import clusters, maybe_broadcast
from terravane.llm.packing import pack
from terravane.llm.pii import redact
from terravane.llm.quality import fit, keep_good
from terravane.llm.suffixes import PASSAGE, remove_repeats
from terravane.llm.workers import give_back

_KEY, _ID = "terravane_text_key", "terravane_doc_id"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1; it learns from the labels of what comes in.

    All stages keep a null text null until packing (there it is empty), treat repeated rows alike, hand on other columns and keep an
    empty table empty. Here a null text is judged as an empty one.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    give_back()  # the driver had the sample; later stages need the room
    return keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least doc_id (rows without one come last), a single row of it.

    The group goes by its label, not by doc_id: unrelated texts of one doc_id all stay, near copies without ids leave one.
    """
    found = materialize(clusters(docs).select("doc_id", "nid", F.col("label").alias("g")), "clusters")
    best = found.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "nid")).alias("best"), F.count(F.lit(1)).alias("n"))
    # the rows to drop are fewer than those to keep
    dropped = found.join(best.filter("n > 1"), "g").filter(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("nid") == F.col("best.nid"))))
    dropped = dropped.select(F.col("doc_id").alias(_ID), F.col("nid").alias(_KEY)).distinct()
    again = found.groupBy("doc_id", "nid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias(_ID), F.col("nid").alias(_KEY))
    keyed = docs.withColumn(_KEY, text_key(text_of()))
    same = lambda other: (keyed[_KEY] == other[_KEY]) & keyed["doc_id"].cast("long").eqNullSafe(other[_ID])
    gone = materialize(dropped.unionByName(again).distinct(), "dropped")
    rest = keyed.join(maybe_broadcast(gone), same(gone), "left_anti")
    # rows that occur several times and stay: one of each
    kept = again.join(dropped, (again[_KEY] == dropped[_KEY]) & again[_ID].eqNullSafe(dropped[_ID]), "left_anti")
    kept = materialize(kept, "kept_once")
    row = F.struct(*(named(c) for c in docs.columns))
    once = keyed.join(maybe_broadcast(kept), same(kept), "left_semi").groupBy(_KEY).agg(F.min_by(row, F.to_json(row)).alias("row"))  # the same one in every run
    once = once.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
    return rest.drop(_KEY).unionByName(once)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of 400 bytes and of 50 words that repeat; texts that repeat whole (ids aside) are empty then, if as long."""
    return remove_repeats(docs, n_words=PASSAGE)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; repeated rows stay repeated rows."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens: one at least for each row, empty or null as its text may be."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", suffixes),
    ("PII", pii),
    ("best-fit packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
