"""Operator 13: ranked lexical search over a block-max index.

Documents lie in blocks by their order. A block is a row with a forward index (for each document its
terms and their impacts) and, for each of its terms, how many documents hold it and the largest
impact. Impacts are the integer part of a score that doesn't depend on the query, so a query's bound
for a block is the sum of weights times the block's maxima.

A search takes queries in bounded batches. It reads only the maxima to find each query's best blocks
by bound; scoring those gives a threshold that at least k documents reach. Then every task goes through
its blocks, those of the largest bounds first, scores the ones whose bound isn't under the threshold of
a query, and raises the threshold by what it finds. A block is passed over only on that proof.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytesops import text_buffers
from .frames import batches_of, discard, materialize, small_batches, text_of
from .wordruns import lowered, numbered, runs
from .workers import lean

TOP = 50
_BYTES, _DOCS = 1 << 18, 128  # of a block, at most (or one document)
_ITEMS = 4096  # queries of a batch, about
_SEEDS = 8  # blocks that give a query its first threshold
_AT_ONCE = 256  # queries scored against a block together
_BLOCKS = 16  # of a row group or a batch for Python; a row is a block
_SOLID = np.ones(256, bool)
_SOLID[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number of the word) of each term of a text column, and the distinct words; only A-Z are lower-cased."""
    raw, offsets = text_buffers(column)
    raw = lowered(raw)
    start, end, row = runs(raw, offsets, _SOLID)
    number, words = numbered(raw, start, end, _SOLID)
    return row, number, words


_FORWARD = "block long, doc_ids array<bigint>, sizes binary, words array<binary>, docs binary, terms binary, tfs binary"


def _forward(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks: the documents with a term, how many each has, and (document, term, occurrences) by document."""
        part, count = TaskContext.get().partitionId(), 0
        blob = lambda a, kind="<i4": pa.array([a.astype(kind).tobytes()], pa.binary())
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            i, n = 0, batch.num_rows
            while i < n:
                j = max(i + 1, min(i + most, int(np.searchsorted(offsets, offsets[i] + _BYTES, "right")) - 1))
                row, number, words = terms_of(batch.column(1).slice(i, j - i))
                pair, tf = np.unique(row * max(1, len(words)) + number, return_counts=True)
                doc, term = pair // max(1, len(words)), pair % max(1, len(words))
                held, doc = np.unique(doc, return_inverse=True)
                if len(held):
                    sizes = np.bincount(row, minlength=j - i)[held]
                    ids = batch.column(0).slice(i, j - i).take(pa.array(held))
                    columns = [pa.array([(part << 32) + count]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), blob(sizes, "<i8"), pa.array([words.to_pylist()], pa.list_(pa.binary())), blob(doc), blob(term), blob(tf, "<i8")]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "sizes", "words", "docs", "terms", "tfs"])
                    count += 1
                i = j

    return run


def impacts(tf: np.ndarray, n: np.ndarray, count: int, total: int) -> np.ndarray:
    """The part of a term's score without its weight: (10^9 tf) div (1000 tf + 20 m), m = 50 + (50 n N) div L."""
    sizes, which = np.unique(n, return_inverse=True)
    m = np.array([50 + 50 * int(x) * count // total for x in sizes], np.int64)[which]  # Python's integers: no overflow
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def weights(df: np.ndarray, count: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * count + 2) / (2 * df + 1))).astype(np.int64)


_INDEX = "block long, doc_ids array<bigint>, words array<binary>, df binary, most binary, docs binary, terms binary, impacts binary"


def _finish(count: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df, most, got = [], [], []
            for b in batch.select(["sizes", "docs", "terms", "tfs"]).to_pylist():
                doc, term = np.frombuffer(b["docs"], "<i4"), np.frombuffer(b["terms"], "<i4")
                m = impacts(np.frombuffer(b["tfs"], "<i8"), np.frombuffer(b["sizes"], "<i8")[doc], count, total)
                top = np.zeros(int(term.max(initial=-1)) + 1, "<i4")
                np.maximum.at(top, term, m.astype("<i4"))
                df.append(np.bincount(term).astype("<i4").tobytes())
                most.append(top.tobytes())
                got.append(m.astype("<i4").tobytes())
            blobs = {"df": df, "most": most, "impacts": got}
            names = [f.split()[0] for f in _INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(blobs[c], pa.binary()) if c in blobs else batch[c] for c in names], names=names)

    return run


def build_index(docs: DataFrame, most: int = _DOCS) -> tuple[DataFrame, int, int]:
    """(index, N, L): blocks of documents that have terms, how many such documents there are and how many terms they have together."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    forward = materialize(src.mapInArrow(lean(_forward(most)), _FORWARD), "forward", "zstd", _BLOCKS)
    with batches_of(docs.sparkSession, _BLOCKS):
        sums = forward.select(F.size("doc_ids").alias("n"), "sizes").mapInArrow(_sums, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
        count, total = sums["n"] or 0, sums["l"] or 0
        index = materialize(forward.mapInArrow(lean(_finish(count, total)), _INDEX), "block_index", "zstd", _BLOCKS)
    discard(forward)
    return index, count, total


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        each = [int(np.frombuffer(s, "<i8").sum()) for s in b["sizes"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["n"].cast(pa.int64()), pa.array(each, pa.int64())], names=["n", "l"])


class Asked:
    """A batch of queries: their words, and which query has which, once each."""

    def __init__(self, texts: pa.Array):
        row, number, self.words = terms_of(texts)
        pair = np.unique(row * max(1, len(self.words)) + number)
        self.item, self.word = pair // max(1, len(self.words)), pair % max(1, len(self.words))
        self.size = len(texts)
        self.weight = np.zeros(len(self.words), np.int64)

    def seen(self, words: list[bytes]) -> np.ndarray:
        """For each word of a block its number here, or -1."""
        at = pc.index_in(pa.array(words, pa.binary()), value_set=self.words)
        return at.fill_null(-1).to_numpy().astype(np.int64)

    def bounds(self, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For each query the sum of weights times a block's maxima."""
        top = np.zeros(len(self.words), np.int64)
        top[at[at >= 0]] = most[at >= 0]
        out = np.zeros(self.size, np.int64)
        np.add.at(out, self.item, self.weight[self.word] * top[self.word])
        return out

    def scores(self, queries: np.ndarray, at: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
        """Scores of a block's documents (rows) for some queries (columns)."""
        place = np.full(self.size, -1)
        place[queries] = np.arange(len(queries))
        mine = place[self.item] >= 0
        here = np.zeros(len(self.words), bool)
        here[at[at >= 0]] = True
        mine &= here[self.word]
        used, column = np.unique(self.word[mine], return_inverse=True)
        whole = self.weight[used].sum() * 1_000_000 >= 1 << 53  # doubles hold every partial sum exactly below
        kind = np.int64 if whole else np.float64
        weight = np.zeros((len(used), len(queries)), kind)
        weight[column, place[self.item[mine]]] = self.weight[self.word[mine]]
        of = np.full(len(self.words) + 1, -1)
        of[used] = np.arange(len(used))
        c = of[at[term]]  # -1 finds the last one: no word
        table = np.zeros((docs, len(used)), kind)
        table[doc[c >= 0], c[c >= 0]] = impact[c >= 0]
        return (table @ weight).astype(np.int64)


def _df(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        df = np.zeros(len(asked.words), np.int64)
        for b in batches:
            for words, n in zip(b["words"].to_pylist(), b["df"].to_pylist()):
                at = asked.seen(words)
                df[at[at >= 0]] += np.frombuffer(n, "<i4")[at >= 0]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["word", "df"])

    return run


def _best_blocks(sent, seeds: int):
    """Each query's blocks of the largest bounds among those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best, block = np.zeros((0, asked.size), np.int64), np.zeros((0, asked.size), np.int64)
        for b in batches:
            got = [asked.bounds(asked.seen(words), np.frombuffer(most, "<i4")) for words, most in zip(b["words"].to_pylist(), b["most"].to_pylist())]
            best = np.vstack([best, *[g[None] for g in got]])
            block = np.vstack([block, np.repeat(b["block"].to_numpy()[:, None], asked.size, 1)])
            order = np.argsort(-best, axis=0, kind="stable")[:seeds]
            best, block = np.take_along_axis(best, order, 0), np.take_along_axis(block, order, 0)
        rank, item = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(block[rank, item]), pa.array(best[rank, item])], names=["item", "block", "bound"])

    return run


def _search(sent, k: int, skipped=None):
    """The k best documents of a task's blocks for each query, from the blocks whose bound doesn't rule them out.

    Sent are the queries, a score that the k best reach, and the queries of each block (None: all). skipped, an accumulator,
    counts (query, block) pairs passed over.
    """
    names = ["item", "doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, least, chosen = sent.value
        floor = least.copy()
        score, doc_id, none = np.zeros((asked.size, k), np.int64), np.zeros((asked.size, k), np.int64), np.ones((asked.size, k), bool)
        for batch in batches:
            rows = batch.to_pylist()
            told = []
            for b in rows:
                at, impact = asked.seen(b["words"]), np.frombuffer(b["impacts"], "<i4")
                bound = asked.bounds(at, np.frombuffer(b["most"], "<i4"))
                if chosen is not None:
                    only = np.zeros(asked.size, bool)
                    only[chosen[b["block"]]] = True
                    bound = np.where(only, bound, 0)
                told.append((int((bound - floor).max(initial=0)), at, impact, bound, b))
            for _, at, impact, bound, b in sorted(told, key=lambda t: -t[0]):  # those that may raise a threshold most come first
                queries = np.flatnonzero((bound >= floor) & (bound > 0))
                if skipped is not None:
                    skipped.add(int((bound > 0).sum()) - len(queries))
                doc, term = np.frombuffer(b["docs"], "<i4"), np.frombuffer(b["terms"], "<i4")
                ids = np.array([0 if d is None else d for d in b["doc_ids"]], np.int64)
                absent = np.array([d is None for d in b["doc_ids"]])
                for s in range(0, len(queries), _AT_ONCE):
                    some = queries[s : s + _AT_ONCE]
                    got = asked.scores(some, at, doc, term, impact, len(ids))
                    good = (got >= floor[some]) & (got > 0)
                    for c in np.flatnonzero(good.any(0)):
                        q, new = some[c], np.flatnonzero(good[:, c])
                        sc, di, ab = np.r_[score[q], got[new, c]], np.r_[doc_id[q], ids[new]], np.r_[none[q], absent[new]]
                        keep = np.lexsort((di, ab, -sc))[:k]
                        score[q], doc_id[q], none[q] = sc[keep], di[keep], ab[keep]
                        floor[q] = max(floor[q], score[q, -1])
        item, place = np.nonzero(score)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc_id[item, place], mask=none[item, place]), pa.array(score[item, place])], names=names)

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, skipped=None, block: int = _DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its k best documents of a score above 0, ties to the smaller doc_id.

    Null texts have no terms, documents without terms don't count, items without terms (or with none that occurs) give no rows.
    Repeated rows, of documents or items, are rows of their own; a null doc_id comes last among equals; an empty table gives no
    rows; other columns are ignored. A block has at most ``block`` documents. skipped is an accumulator for (item, block) pairs that bounds rule out.
    """
    spark = docs.sparkSession
    index, count, _ = build_index(docs, block)
    asked_rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"), F.monotonically_increasing_id().alias("row"))
    asked_rows = materialize(asked_rows, "items")
    passes = max(1, -(-asked_rows.count() // _ITEMS))
    schema = "item long, doc_id long, score long"
    out = spark.createDataFrame([], "row long, item_id long, doc_id long, score long")
    with batches_of(spark, _BLOCKS):
        for p in range(passes if count else 0):
            some = asked_rows.filter(F.pmod(F.xxhash64("row"), F.lit(passes)) == p).orderBy("row").toArrow().combine_chunks()  # about _ITEMS rows
            if not some.num_rows:
                continue
            asked = Asked(some["text"].combine_chunks() if isinstance(some["text"], pa.ChunkedArray) else some["text"])
            sent = spark.sparkContext.broadcast(asked)
            counts = index.select("words", "df").mapInArrow(lean(_df(sent)), "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
            df = np.zeros(len(asked.words), np.int64)
            for r in counts.collect():  # a row a word of the batch
                df[r["word"]] = r["df"]
            sent.destroy()
            asked.weight = weights(df, count)
            sent = spark.sparkContext.broadcast(asked)
            bounds = index.select("block", "words", "most").mapInArrow(lean(_best_blocks(sent, _SEEDS)), "item long, block long, bound long")
            best = bounds.withColumn("_rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "block"))).filter(F.col("_rank") <= _SEEDS)
            chosen: dict[int, list[int]] = {}
            for r in best.select("item", "block").collect():  # _SEEDS a query
                chosen.setdefault(r["block"], []).append(r["item"])
            sent.destroy()
            least = np.ones(asked.size, np.int64)
            if chosen:
                first = spark.sparkContext.broadcast((asked, least, chosen))
                these = F.broadcast(spark.createDataFrame([(b,) for b in chosen], "block long"))  # as many
                found = index.join(these, "block", "left_semi").mapInArrow(lean(_search(first, k)), schema)
                kth = found.withColumn("_rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score")))).filter(F.col("_rank") == k)
                for r in kth.select("item", "score").collect():  # one a query
                    least[r["item"]] = r["score"]
                first.destroy()
            last = spark.sparkContext.broadcast((asked, least, None))
            found = materialize(index.mapInArrow(lean(_search(last, k, skipped)), schema), "found")
            last.destroy()
            names = spark.createDataFrame(pa.table({"item": np.arange(some.num_rows), "row": some["row"], "item_id": some["item_id"]}))
            out = out.unionByName(found.join(F.broadcast(names), "item").select("row", "item_id", "doc_id", "score"))  # the batch's rows
    discard(index)
    place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
