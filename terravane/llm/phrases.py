"""Operator 12: phrase collocations from fixed-width binary keys.

One pass over the texts cuts them into words and keeps, for each chunk of a few MB, its distinct
words with counts and the texts as numbers into them. Counts by word give the dictionary: words
that occur often enough get an id, no phrase of others can. Each chunk then takes the ids of its
own words by a join on the chunk, breaks its texts at words without one, and packs ids of two and
three neighbours into keys of twelve bytes. Keys are dealt by ranges of ids, radix-sorted digit by
digit and counted as runs. No task ever sees the whole dictionary, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import running
from .bytesops import slices, text_buffers
from .frames import discard, materialize, small_batches, text_of
from .wordruns import lowered, numbered, runs
from .workers import lean

LEAST = 10
SHARE = 50
TOP = 2000
_CHUNK = 4 << 20  # bytes of text
_RANGE = 1 << 20  # word occurrences whose phrases share a range of keys
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SOLID = ~_BREAKS
_SOLID[[0x20, 0x09]] = False
_CHUNKS = "chunk long, number int, lang string, word string, n long, seq binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk a row a distinct (lang, word), and one with its texts as numbers of words, 0 where a piece ends."""
    part, count = TaskContext.get().partitionId(), 0
    names = [f.split()[0] for f in _CHUNKS.split(", ")]
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        lang, names_of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), langs.dictionary
        bytes_, offsets = text_buffers(batch.column(1))
        for i, j in slices(offsets, _CHUNK):
            raw = lowered(bytes_[offsets[i] : offsets[j]])
            start, end, row = runs(raw, offsets[i : j + 1] - offsets[i], _SOLID)
            if not len(start):
                continue
            word, words = numbered(raw, start, end, _SOLID)
            both, seq, n = np.unique(lang[i:j][row] * len(words) + word, return_inverse=True, return_counts=True)
            breaks = np.zeros(len(raw) + 1, np.int64)
            np.cumsum(_BREAKS[raw], out=breaks[1:])
            cut = (row[1:] != row[:-1]) | (breaks[start[1:]] != breaks[end[:-1]])
            at = np.arange(len(seq))
            at[1:] += np.cumsum(cut)
            flat = np.zeros(at[-1] + 1, "<i4")
            flat[at] = seq + 1
            chunk, count = (part << 32) + count, count + 1
            of, last = np.r_[both, 0], np.arange(len(both) + 1) == len(both)  # the last row holds the texts
            columns = [
                pa.array(np.full(len(of), chunk)),
                pa.array(np.r_[np.arange(1, len(of)), 0].astype(np.int32)),
                names_of.take(pa.array(of // len(words), mask=last)),
                words.take(pa.array(of % len(words), mask=last)).cast(pa.string()),
                pa.array(np.r_[n, 0]),
                pa.array([None] * len(both) + [flat.tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of fixed-width keys (n × digits of 16 bits, the most significant first), one stable pass a digit from the last."""
    order = np.arange(len(keys))
    for digit in range(keys.shape[1] - 1, -1, -1):
        order = order[np.argsort(keys[order, digit], kind="stable")]
    return order


def run_lengths(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (rows of three 32-bit ids), in order, with the sums of n."""
    if not len(ids):
        return ids, n
    order = radix_order(np.ascontiguousarray(ids.astype(">u4")).view(">u2").astype(np.uint16))
    ids, n = ids[order], n[order]
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(1)])
    return ids[first], np.add.reduceat(n, first)


def _grams(total: int):
    """Keys of a chunk with their counts, a blob for each range."""

    def run(words: pa.Table, texts: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for text in texts["seq"].to_pylist():
            seq = np.frombuffer(text, "<i4")
            size = int(seq.max(initial=0)) + 1
            ids, before, often = np.zeros(size, np.uint32), np.zeros(size), np.zeros(size)
            number = words["number"].to_numpy()
            ids[number], before[number], often[number] = words["id"].to_numpy(), words["before"].to_numpy(), words["f"].to_numpy()
            a = np.r_[seq, 0, 0]
            a[ids[a] == 0] = 0  # words that are too rare break pieces as well
            x, y, z = a[:-2], a[1:-1], a[2:]
            two = (x > 0) & (y > 0)
            three = two & (z > 0)
            keys = np.concatenate([np.stack([x[two], y[two], np.zeros(two.sum(), a.dtype)], 1), np.stack([x[three], y[three], z[three]], 1)])
            keys, n = run_lengths(keys.astype(np.uint32), np.ones(len(keys), np.int64))  # by the chunk's numbers: a range is the same for all of a key
            x, y, z = keys.T
            # a place for each key on the line of all occurrences: inside its first word's part by the second, inside that by the third
            place = before[x] + often[x] * ((before[y] + often[y] * (before[z] / total)) / total)
            range_ = (place / _RANGE).astype(np.int64)
            order = np.lexsort((n == 1, range_))  # in a range, keys that occur once come last and need no count
            range_, n, packed = range_[order], n[order], np.stack([ids[x], ids[y], ids[z]], 1).astype("<u4")[order]
            cuts = np.flatnonzero(np.diff(range_)) + 1
            for some, r, times in zip(np.split(packed, cuts), np.split(range_, cuts), np.split(n, cuts)):
                if len(r):
                    out.append((r[0], some.tobytes(), times[times > 1].astype("<i4").tobytes()))
        return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["range", "keys", "n"])

    return run


def _counted(least: int):
    def run(group: pa.Table) -> pa.Table:
        ids = [np.frombuffer(b, "<u4").reshape(-1, 3) for b in group["keys"].to_pylist()]
        n = [np.frombuffer(b, "<i4") for b in group["n"].to_pylist()]
        n = [np.concatenate([c, np.ones(len(k) - len(c), np.int64)]) for k, c in zip(ids, n)]
        ids, n = run_lengths(np.concatenate(ids), np.concatenate(n))
        keep = n >= least
        columns = [ids[keep, k].astype(np.int64) for k in range(3)] + [n[keep]]
        return pa.table([pa.array(c) for c in columns], names=["i1", "i2", "i3", "a"])

    return run


def _worst(a: str, l: str, r: str) -> str:
    """floor(1000000 a a / (l r)), in decimals of 38 digits: exact for counts below 10^15."""
    d = lambda c: f"cast({c} as decimal(15,0))"
    return f"((cast(1000000 as decimal(7,0)) * {d(a)} * {d(a)}) div ({d(l)} * {d(r)}))"


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two and three words.

    A phrase occurs a times (``least`` or more), its worst cut falls into parts that occur l and r times, and the score is
    floor(10^6 a² / (l r)). Phrases inside a longer candidate that occurs at least ``share`` percent as often are dropped. Null
    texts are empty, a null language is ``und``; repeated rows count each; texts without words, empty texts and an empty table
    give no rows; other columns are ignored. Exact for counts below 10^15 and below 2^32 different frequent words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    chunks = materialize(src.mapInArrow(lean(_cut), _CHUNKS), "chunks", "zstd")
    words = chunks.filter("seq is null")
    counts = materialize(words.groupBy("lang", "word").agg(F.sum("n").alias("f")), "counts", "zstd")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counts.filter(F.col("f") >= least)
    before = running(frequent.withColumn("one", F.lit(1)), [], ["lang", "word"], F.col("f"), "upto")
    ids = running(before, [], ["lang", "word"], F.col("one"), "id").select("lang", "word", "id", "f", (F.col("upto") - F.col("f")).alias("before"))
    ids = materialize(ids, "dictionary", "zstd")
    size = ids.agg(F.sum("f").alias("total"), F.count(F.lit(1)).alias("n")).first()
    if size["n"] >= 1 << 32:
        raise ValueError("more than 2^32 frequent words")
    own = words.join(ids, ["lang", "word"]).select("chunk", "number", "id", "f", "before")
    texts = chunks.filter("seq is not null").select(F.col("chunk").alias("place"), "seq")
    keys = own.groupBy("chunk").cogroup(texts.groupBy("place")).applyInArrow(_grams(size["total"] or 1), "range long, keys binary, n binary")
    grams = keys.groupBy("range").applyInArrow(_counted(least), "i1 long, i2 long, i3 long, a long")
    grams = materialize(grams, "grams", "zstd")

    word = lambda k: ids.select(F.col("id").alias(f"i{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else []))
    pairs, triples = grams.filter("i3 = 0").drop("i3"), grams.filter("i3 > 0")
    head = triples.groupBy("i1", "i2").agg(F.max("a").alias("more"))
    tail = triples.groupBy(F.col("i2").alias("i1"), F.col("i3").alias("i2")).agg(F.max("a").alias("more"))
    longer = head.unionByName(tail).groupBy("i1", "i2").agg(F.max("more").alias("more"))
    pairs = pairs.join(longer, ["i1", "i2"], "left").filter(F.col("more").isNull() | (F.col("more") * 100 < F.col("a") * share))
    two = pairs.join(word(1), "i1").join(word(2), "i2").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r")).withColumn("score", F.expr(_worst("a", "l", "r")))
    known = grams.filter("i3 = 0")
    first = known.select("i1", "i2", F.col("a").alias("f12"))
    second = known.select(F.col("i1").alias("i2"), F.col("i2").alias("i3"), F.col("a").alias("f23"))
    three = triples.join(first, ["i1", "i2"]).join(second, ["i2", "i3"]).join(word(1), "i1").join(word(2), "i2").join(word(3), "i3")
    three = three.withColumn("s1", F.expr(_worst("a", "f1", "f23"))).withColumn("s2", F.expr(_worst("a", "f12", "f3")))
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    both = two.unionByName(three).select("lang", "phrase", "a", "l", "r", "score", (-F.col("score")).alias("_s"), (-F.col("a")).alias("_a"))
    ranked = running(both, ["lang"], ["_s", "_a", "phrase"], F.lit(1), "rank").filter(F.col("rank") <= top)
    out = ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    out = materialize(out, "collocations")
    discard(chunks, counts, ids, grams)
    return out


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
