"""Operator 5: best-fit packing planned on the histogram of piece lengths.

The plan never looks at documents. Pieces are counted by length (at most
``capacity`` counts), best-fit decreasing runs over those counts on the driver,
and gives for each length a few ranges of ranks with their sequences and
offsets. Pieces then take the slots of the plan by a join on their rank within
their length. Ranks are made in two levels (count by length and salt, then a row
number within both), so a length that many pieces share isn't one task's work.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import materialize, partitions, small_batches, text_of
from .wordbpe import WordCache
from .workers import lean

CAPACITY = 2048
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache.of(path)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for i, ids, ends in cache.of_rows(batch.column(1), end):
                a = 0
                for doc, b in zip(doc_ids[i:], ends.tolist()):
                    for k, s in enumerate(range(a, b, 4 * capacity)):
                        piece = ids[s : min(b, s + 4 * capacity)]
                        for column, v in zip(rows, (doc, k, (s - a) // 4, len(piece) // 4, zlib.crc32(piece))):
                            column.append(v)
                    a = b
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _PIECES.types)], schema=_PIECES)

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only beyond capacity. A null text is empty: one end id."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return src.mapInArrow(lean(_cut(path or tokenizer_path(), capacity, end_id), "wordbpe"), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, rank_from, rank_to, first_sequence, each, offset).

    The piece of rank r in [rank_from, rank_to) goes to sequence first_sequence + (r - rank_from) // each, at
    offset + ((r - rank_from) % each) * length. Sequences filled alike are one group; a step takes the group
    of least room that a length still fits, so steps follow the number of lengths, not of pieces.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, how many)
    rooms: list[int] = []
    rows, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first = capacity, sequences
                n = -(-left // (capacity // length))
                sequences += n
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, rank + full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            if full < n and left:  # fewer than `each` are left, for one more sequence
                rows.append((length, rank, rank + left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                put(room, first + full + 1, n - full - 1)
                left = 0
            elif full < n:
                put(room, first + full, n - full)
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most capacity tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece. Null and empty
    texts are one end id; repeated rows and null doc_ids are packed as any other; an empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    # Equal ids share a salt, but for null ones, which may be many: their places in the partitions deal them, stored once so that all steps see the same.
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", place), F.lit(max(8, 4 * partitions(spark))))
    salted = materialize(pieces(docs, capacity, path).withColumn("salt", salt), "pieces")
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    # one row per (length, salt): bounded by capacity times the salts, whatever the input
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)))
    histogram = {r["length"]: r["n"] for r in salted.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = plan(histogram, capacity)
    schema = "length long, rank_from long, rank_to long, first_sequence long, each long, offset long"
    slots_df = spark.createDataFrame(slots, schema)
    within = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    ranked = salted.withColumn("within", within).join(before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["length", "salt"])
    p, s = ranked.withColumn("rank", F.col("within") + F.col("before")).alias("p"), F.broadcast(slots_df).alias("s")  # a few rows per length, at most a few times capacity
    k = F.col("p.rank") - F.col("s.rank_from")
    return p.join(s, (F.col("p.length") == F.col("s.length")) & (F.col("p.rank") >= F.col("s.rank_from")) & (F.col("p.rank") < F.col("s.rank_to"))).select(
        "p.doc_id",
        "p.piece",
        "p.start",
        "p.length",
        "p.ids_crc32",
        (F.col("s.first_sequence") + F.floor(k / F.col("s.each"))).cast("long").alias("sequence_id"),
        (F.col("s.offset") + F.pmod(k, F.col("s.each")) * F.col("p.length")).cast("long").alias("offset"),
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
