"""Operator 6: exact top-k inner products over an impact-ordered index, score at a time.

Vectors are dealt into blocks. The index has one row a block: its postings in segments,
one for each quantised impact (the magnitude of a component without its low bits), in
descending order, inside a segment by dimension. A search adds segment after segment to
the scores of a batch of queries. What isn't added yet bounds every score by the product of
norms, and after each segment a query is done once that proof leaves it few possible
members; exactly those are rescored. The best k of a query, rescored after the first
segments, give the proof its threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import discard, materialize

TOP = 5
EVERY = 50
_BLOCK = 8192
_QUERIES = 8192
_BATCH = 256
_LOW_BITS = 2
_FEW = 16
_LONG = (1 << 63) - 1


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, row, x): the vectors that take part, as doubles; row numbers them.

    Null ids, null vectors and vectors with a null or non-finite component take no part.
    """
    x = F.col("embedding").cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, finite))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), x.alias("x"))


def _matrix(column) -> np.ndarray:
    """Rows of doubles, the shorter ones filled up with zeros."""
    rows = [np.asarray(r, np.float64) for r in column.to_pylist()]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def integers(x: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale · x), exactly: as int64 where products stay well inside a double, else as Python integers."""
    if not x.size or float(np.abs(x).max()) < 2.0**20:
        return np.floor(x * scale).astype(np.int64)
    # a double of 2**53 or more is whole, so scaling it later loses nothing
    one = lambda c: int(c) * scale if abs(c) >= 2.0**53 else math.floor(c * scale)
    return np.array([[one(c) for c in row] for row in x.tolist()], object).reshape(x.shape)


def _build(scale: int):
    def run(table: pa.Table) -> pa.Table:
        """The index row of one block: what a search needs of its vectors, and the segments (impact, dimension, vectors, signs)."""
        raw = _matrix(table["x"])
        x = integers(raw, scale)
        levels, places, codes = [], [], []
        if x.dtype != object:
            impact = np.abs(x) >> _LOW_BITS
            vec, dim = np.nonzero(impact)
            u = impact[vec, dim]
            order = np.lexsort((vec, dim, -u))
            u, code = u[order], vec[order] * 2 + (x[vec, dim] < 0)[order]
            group = u * max(1, x.shape[1]) + dim[order]
            cut = np.flatnonzero(np.diff(group)) + 1 if len(group) else np.zeros(0, np.int64)
            starts = np.concatenate([[0], cut]) if len(group) else cut
            levels, places, codes = u[starts], dim[order][starts], [c.astype("<i4").tobytes() for c in (np.split(code, cut) if len(group) else [])]
        segments = [{"impact": int(u), "dim": int(b), "postings": c} for u, b, c in zip(levels, places, codes)]
        kind = pa.list_(pa.struct([("impact", pa.int64()), ("dim", pa.int32()), ("postings", pa.binary())]))
        return pa.table(
            {
                "block": table["block"].slice(0, 1),
                "ids": pa.array([table["vec_id"].to_numpy().astype("<i8").tobytes()]),
                "row": pa.array([table["row"].to_numpy().astype("<i8").tobytes()]),
                "width": pa.array([raw.shape[1]], pa.int32()),
                "vectors": pa.array([raw.astype("<f8").tobytes()]),
                "segments": pa.array([segments], kind),
            }
        )

    return run


_INDEX = "block int, ids binary, row binary, width int, vectors binary, segments array<struct<impact:long,dim:int,postings:binary>>"


def build_index(vectors: DataFrame, rows: int, scale: int = 256) -> DataFrame:
    """The index: a row for each block of about 8192 vectors, spread by a hash of their row numbers."""
    n = max(1, -(-rows // _BLOCK))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
    return dealt.groupBy("block").applyInArrow(_build(scale), _INDEX)


def possible_members(x: np.ndarray, segments: list[tuple[int, int, np.ndarray]], queries: np.ndarray, k: int, stops: list[int] | None = None) -> list[np.ndarray]:
    """For each query (integers, like x) the positions of all vectors that may be among its k best, k at least where there are.

    stops, if given, takes the number of segments that each query needed.
    """
    n, d = x.shape
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, d)
    everyone = [np.arange(n)] * len(queries)
    if n <= _FEW * k or largest >= 2.0**52:  # doubles don't hold such scores exactly: no bound, all are rescored
        return everyone
    kind = np.float32 if largest < 2**24 else np.float64
    found: list = [None] * len(queries)
    left = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    square = left**2
    by_level: list[tuple[int, list[tuple[int, np.ndarray]]]] = []
    for u, dim, code in segments:
        if not by_level or by_level[-1][0] != u:
            by_level.append((u, []))
        by_level[-1][1].append((dim, code))
    norms = []  # of what isn't scored after each level
    rest = x.astype(np.int64)
    for u, lists in by_level:
        for dim, code in lists:
            vec, minus = code >> 1, code & 1
            old = rest[vec, dim]
            new = old - np.where(minus, -1, 1) * (u << _LOW_BITS)
            square[vec] += new.astype(np.float64) ** 2 - old.astype(np.float64) ** 2
            rest[vec, dim] = new
        norms.append(np.sqrt(np.maximum(square, 0)) * (1 + 1e-9) + 1e-6)
    half = next((k_ for k_, s in enumerate(norms) if s.sum() <= 0.7 * left.sum()), len(norms) - 1) if norms else -1
    for at in range(0, len(queries), _BATCH):
        live = np.arange(at, min(at + _BATCH, len(queries)))
        q = np.ascontiguousarray(queries[live].T.astype(kind))  # dimension × query
        length = np.sqrt((q.astype(np.float64) ** 2).sum(0)) * (1 + 1e-9)
        score = np.zeros((n, len(live)), kind)
        sure = None
        for level, (u, lists) in enumerate(by_level):
            for dim, code in lists:
                vec, minus = code >> 1, code & 1
                score[vec] += np.where(minus, -(u << _LOW_BITS), u << _LOW_BITS).astype(kind)[:, None] * q[dim][None, :]
            if level < half:
                continue
            if sure is None:  # the k best so far, rescored: at least so much has the k-th best of all
                best = np.argpartition(score, n - k, axis=0)[n - k :]
                exact = (x[best] * queries[live].T[None].transpose(0, 2, 1)).sum(2)
                sure = exact.min(0).astype(np.float64)
            possible = score + norms[level][:, None] * length[None, :] >= sure[None, :]
            done = possible.sum(0) <= _FEW * k
            if level == len(by_level) - 1:
                done[:] = True
            for c in np.flatnonzero(done):
                found[live[c]] = np.flatnonzero(possible[:, c])
                if stops is not None:
                    stops.append(level + 1)
            if done.all():
                break
            if done.any():
                go = ~done
                live, q, length, score, sure = live[go], np.ascontiguousarray(q[:, go]), length[go], np.ascontiguousarray(score[:, go]), sure[go]
    return [np.arange(n) if f is None else f for f in found]


def _exact(x: np.ndarray, near: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact scores, held inside the range of a long."""
    y = x[near]
    if y.dtype != object and q.dtype != object and float(np.abs(y).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, y.shape[1]) < 2.0**62:
        return y @ q
    total = [sum(a * b for a, b in zip(row, q.tolist())) for row in y.tolist()]
    return np.array([max(-_LONG - 1, min(_LONG, t)) for t in total], np.int64)


def _search(sent, k: int, scale: int):
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_rows, query_ids, given = sent.value
        for batch in batches:
            for block in batch.to_pylist():
                ids, row = np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["row"], "<i8")
                raw = np.frombuffer(block["vectors"], "<f8").reshape(len(ids), block["width"])
                d = max(raw.shape[1], given.shape[1])
                x, q = (integers(np.pad(m, ((0, 0), (0, d - m.shape[1]))), scale) for m in (raw, given))
                segments = [(s["impact"], s["dim"], np.frombuffer(s["postings"], "<i4")) for s in block["segments"]]
                near_of = possible_members(x, segments, q, k + 1) if x.dtype != object and q.dtype != object else [np.arange(len(x))] * len(q)
                out: list[list] = [[], [], [], []]
                for own, query, y, near in zip(query_rows.tolist(), query_ids.tolist(), q, near_of):
                    near = near[row[near] != own]
                    score = _exact(x, near, y)
                    best = np.lexsort((ids[near], -score.astype(object) if len(score) and score.min() == -_LONG - 1 else -score))[:k]
                    for c, v in zip(out, (own, query)):
                        c += [v] * len(best)
                    out[2] += ids[near][best].tolist()
                    out[3] += score[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    return run


def top_k(embeddings: DataFrame, k: int = TOP, every: int = EVERY, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, its k largest integer inner products with all other rows; ties to the smaller vec_id.

    Rows of one vec_id are rows of their own, as candidates and as queries. Vectors of different lengths count as if
    filled up with zeros. Scores beyond the range of a long are held at its ends. Queries are taken in blocks of
    about 8192, each against the whole index. An empty table gives no rows, a query with fewer than k others all of
    them; other columns are ignored.
    """
    spark = embeddings.sparkSession
    vectors = materialize(usable_vectors(embeddings), "vectors")
    index = materialize(build_index(vectors, vectors.count(), scale), "impact_index")
    asked = vectors.filter(F.col("vec_id") % every == 0)
    passes = max(1, -(-asked.count() // _QUERIES))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    parts = []
    for p in range(passes):
        some = asked.filter(F.pmod(F.xxhash64("row"), F.lit(passes)) == p).orderBy("row").toArrow()  # about 8192 rows
        if some.num_rows:
            sent = spark.sparkContext.broadcast((some["row"].to_numpy(), some["vec_id"].to_numpy(), _matrix(some["x"])))
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)  # a row is a block
            parts.append(materialize(index.mapInArrow(_search(sent, k, scale), "query long, query_id long, vec_id long, score long"), "block_best"))
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
            sent.destroy()
    discard(vectors, index)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = parts[0]
    for more in parts[1:]:
        best = best.unionByName(more)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))  # k rows of each block
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
