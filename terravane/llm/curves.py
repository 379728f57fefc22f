"""Operator 11: approximate nearest neighbours along shifted space-filling curves.

Every distinct vector is projected several times, each time by another rotation and shift, and
gets a key on the Hilbert curve through the projected space. Each curve is range-partitioned and
numbered by Spark, so a vector has a place on it, and places are cut into blocks. A query looks
at the blocks that a window about its place touches, on every curve; what the windows find is
scored on the original vectors and merged.

The window isn't a constant. A bounded sample of queries is searched exactly, and the window is
the least one in which the curves together hold the wanted share of their true neighbours; so
recall is measured on the table at hand, at any size.

Nearness is the inner product. Vectors get one more component, which brings all to the largest
norm, and a query none but the same norm: then the nearest by angle is the largest product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.shared import running
from .frames import discard, materialize
from .topk import usable_vectors

TOP = 20
EVERY = 20
CURVES = 16
_DIMS, _BITS = 8, 7  # of a key: 56 bits
_FITTED = 4096  # vectors that place the grid
CALIBRATED = 256  # queries that are searched exactly
WANTED = 0.95  # of their true neighbours lie inside the windows
_LEAST_BLOCK, _MOST_BLOCK = 256, 16384
_QUERIES = 4096  # of one block at a time


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (n × dims, below 2**bits) on the Hilbert curve; dims · bits is at most 63."""
    x = cells.astype(np.uint64).T.copy()
    dims, n = x.shape
    one = np.uint64(1)
    level = one << np.uint64(bits - 1)
    while level > one:  # undo the turns of the larger cubes
        low = level - one
        for i in range(dims):
            inside = (x[i] & level) != 0
            swap = np.where(inside, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[i] ^= swap
        level >>= one
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros(n, np.uint64)
    level = one << np.uint64(bits - 1)
    while level > one:
        flip ^= np.where((x[-1] & level) != 0, level - one, np.uint64(0))
        level >>= one
    x ^= flip
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def _pack(rows: list, width: int) -> list[bytes]:
    """Vectors as bytes, filled up with zeros: as floats where those hold them exactly, else as doubles."""
    out = []
    for r in rows:
        v = np.zeros(width)
        v[: len(r)] = r
        with np.errstate(over="ignore"):
            narrow = v.astype("<f4")
        out.append(narrow.tobytes() if (narrow == v).all() else v.astype("<f8").tobytes())
    return out


def _unpack(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    raw = column.to_pylist()
    out = np.empty((len(raw), width))
    narrow = np.fromiter((len(b) == 4 * width for b in raw), bool, len(raw))
    for kind, which in (("<f4", narrow), ("<f8", ~narrow)):
        if which.any():
            out[which] = np.frombuffer(b"".join(b for b, w in zip(raw, which) if w), kind).reshape(-1, width)
    return out


class Curves:
    """The rotations, the grid of each projection and the scale: bounded, and the same for every size of table."""

    def __init__(self, sample: np.ndarray, largest: float, curves: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.width, self.unit = sample.shape[1], largest or 1.0
        dims = min(_DIMS, self.width + 1)
        self.turn = [np.linalg.qr(rng.normal(size=(self.width + 1, dims)))[0] for _ in range(curves)]
        self.shift = rng.random((curves, dims)) / 2
        at = self.lifted(sample)
        self.middle = [(at @ t).mean(0) for t in self.turn]
        self.spread = [np.maximum((at @ t).std(0), 1e-9) for t in self.turn]

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        y = x / self.unit  # norms are at most 1
        norm = np.minimum(np.sqrt((y * y).sum(1)), 1.0)
        if query:
            return np.hstack([y / np.maximum(norm, 1e-300)[:, None], np.zeros((len(y), 1))])
        return np.hstack([y, np.sqrt(1 - norm * norm)[:, None]])

    def keys(self, x: np.ndarray, query: bool = False) -> list[np.ndarray]:
        at, out = self.lifted(x, query), []
        for turn, shift, middle, spread in zip(self.turn, self.shift, self.middle, self.spread):
            z = np.clip((at @ turn - middle) / (6 * spread) + 0.5, 0, 1 - 1e-9) / 2 + shift
            out.append(hilbert_keys((z * (1 << _BITS)).astype(np.int64), _BITS))
        return out


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with q: the same sum, in the same order, for a pair wherever it is taken; undefined ones are least."""
    with np.errstate(all="ignore"):
        s = (x * q).sum(-1)
    return np.where(np.isnan(s), -np.inf, s)


def best_of(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of q the positions of its k best rows of x and their scores, ties to the smaller ids."""
    with np.errstate(all="ignore"):
        rough = q @ x.T
        slack = 1e-12 * max(1, x.shape[1]) * np.abs(q).max(1, initial=0)[:, None] * np.abs(x).max(initial=0) * x.shape[1]
    rough = np.where(np.isfinite(rough), rough, np.inf)  # overflown: judged by their own sums
    out = []
    for row, y, free in zip(rough, q, np.nan_to_num(slack[:, 0], posinf=np.inf)):
        near = np.arange(len(x)) if len(x) <= k else np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - 2 * free)
        s = scores(x[near], y)
        order = np.lexsort((ids[near], -s))[:k]
        out.append((near[order], s[order]))
    return out


def _ordered(c: Column) -> Column:
    """Members of a class, as they may enter a result: at most k + 1, since all have one score and smaller ids go first."""
    return F.array_sort(F.collect_list(c))


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """(h, x, members): one row a distinct vector with its k + 1 smallest (vec_id, row); copies never meet in one task beyond that many a map task."""
    place = F.row_number().over(W.partitionBy("h", "x").orderBy("vec_id", "row"))
    few = vectors.withColumn("_place", place).filter(F.col("_place") <= k + 1)
    return few.groupBy("h", "x").agg(_ordered(F.struct("vec_id", "row")).alias("members"))


def _packed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = pa.array(_pack(b["x"].to_pylist(), width), pa.binary())
            yield pa.RecordBatch.from_arrays([b["cid"], b["least"], v], names=["cid", "least", "v"])

    return run


def _keyed(curves: Curves, query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = curves.keys(_unpack(b["v"], curves.width), query)
            n, cid = b.num_rows, b["cid"].to_numpy()
            columns = [np.repeat(np.arange(len(keys), dtype=np.int32), n), np.concatenate(keys), np.tile(cid, len(keys)), np.full(n * len(keys), int(query), np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["curve", "key", "cid", "asks"])

    return run


def _truth(sent: tuple[np.ndarray, np.ndarray], width: int, k: int):
    """The k best of each batch for the sampled queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q = sent
        for b in batches:
            x, cid, least = _unpack(b["v"], width), b["cid"].to_numpy(), b["least"].to_numpy()
            columns: list[list] = [[], [], [], []]
            for own, (near, s) in zip(asked, best_of(x, least, q, k) if len(x) else []):
                for c, v in zip(columns, (np.full(len(near), own), cid[near], least[near], s)):
                    c.append(v)
            kinds = (np.int64, np.int64, np.int64, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, t)) for c, t in zip(columns, kinds)], names=["asked", "cid", "least", "score"])

    return run


def _window(places: DataFrame, table: DataFrame, asks: DataFrame, width: int, k: int, wanted: float) -> int:
    """The least window that holds the wanted share of the sampled queries' true neighbours on some curve."""
    spark = places.sparkSession
    sample = asks.orderBy(F.xxhash64("cid"), "cid").limit(CALIBRATED).toArrow()
    sent = (sample["cid"].to_numpy(), _unpack(sample["v"], width))
    found = table.mapInArrow(_truth(sent, width, k), "asked long, cid long, least long, score double")
    rank = F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), "least"))
    true = found.withColumn("_rank", rank).filter(F.col("_rank") <= k).select("asked", "cid").toArrow()  # CALIBRATED · k rows at most
    pairs = F.broadcast(spark.createDataFrame(true.to_pandas(), "asked long, cid long"))
    theirs = places.filter("asks = 0").join(pairs, "cid").select("asked", "cid", "curve", "place")
    own = places.filter("asks = 1").join(F.broadcast(pairs.select(F.col("asked").alias("cid")).distinct()), "cid").select(F.col("cid").alias("asked"), "curve", F.col("place").alias("own"))
    gaps = theirs.join(own, ["asked", "curve"]).groupBy("asked", "cid").agg(F.min(F.abs(F.col("place") - F.col("own"))).alias("gap"))
    gap = np.sort(gaps.select("gap").toArrow()["gap"].to_numpy())
    return max(k, int(gap[min(len(gap) - 1, int(np.ceil(wanted * len(gap))) - 1)]) + 1)


def _windows(width: int, k: int):
    """The k best of a block for each query that looks at it."""

    def run(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy() == 1
        rows, queries = group.filter(pa.array(~asks)), group.filter(pa.array(asks))
        x, cid, least = _unpack(rows["v"], width), rows["cid"].to_numpy(), rows["least"].to_numpy()
        q, own = _unpack(queries["v"], width), queries["cid"].to_numpy()
        columns: list[list] = [[], [], [], []]
        for at in range(0, len(q), 256):
            for o, (near, s) in zip(own[at : at + 256], best_of(x, least, q[at : at + 256], k) if len(x) else []):
                for c, v in zip(columns, (np.full(len(near), o), cid[near], least[near], s)):
                    c.append(v)
        kinds = (np.int64, np.int64, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, t)) for c, t in zip(columns, kinds)], names=["asked", "cid", "least", "score"])

    return run


def nearest(embeddings: DataFrame, k: int = TOP, every: int = EVERY, curves: int = CURVES, wanted: float = WANTED) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, the k rows of largest inner product that its windows hold.

    Scores are exact in double precision, on the original vectors; ties go to the smaller vec_id. Null ids and vectors that are
    null, zero or hold a null or a component that isn't finite take no part; vectors of different lengths count as filled up with
    zeros. Rows of one vec_id are rows of their own, and a query's own row is no candidate, its copies are. Sums that overflow
    are infinite, undefined ones count as least. Tables of one block (256 distinct vectors or fewer) are searched whole; fewer
    than k others are all returned; an empty table gives no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    even = F.transform("x", lambda c: c + 0.0)  # one zero
    vectors = usable_vectors(embeddings).filter(F.exists("x", lambda c: c != 0)).withColumn("x", even).withColumn("h", F.xxhash64("x"))
    vectors = materialize(vectors, "vectors")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))
    most = vectors.agg(F.max(F.size("x")).alias("width"), F.max(norm).alias("norm"), F.max(F.aggregate("x", F.lit(0.0), lambda s, c: F.greatest(s, F.abs(c)))).alias("one")).first()
    if most["width"] is None:
        discard(vectors)
        return nothing
    width = most["width"]
    largest = most["norm"] if np.isfinite(most["norm"]) and most["norm"] > 0 else most["one"] * width**0.5
    classes = materialize(_classes(vectors, k).withColumn("cid", F.col("members")[0]["row"]), "classes")
    narrow = classes.select("cid", F.col("members")[0]["vec_id"].alias("least"), "x")
    table = materialize(narrow.mapInArrow(_packed(width), "cid long, least long, v binary"), "packed")
    asked = vectors.filter(F.col("vec_id") % every == 0).select("vec_id", "row", "h", "x")
    asking = asked.select("h", "x").distinct().join(classes, ["h", "x"]).select("cid")
    asks = materialize(asking.join(table, "cid").select("cid", "v"), "asks")
    if asks.isEmpty():
        discard(vectors, classes, table, asks)
        return nothing

    fitted = table.orderBy(F.xxhash64("cid"), "cid").limit(_FITTED).toArrow()
    grid = Curves(_unpack(fitted["v"], width), float(largest), curves)
    schema = "curve int, key long, cid long, asks int"
    keyed = table.select("cid", "v").mapInArrow(_keyed(grid, False), schema).unionByName(asks.mapInArrow(_keyed(grid, True), schema))
    # the place of a query is the number of vectors before it
    places = running(keyed, ["curve"], ["key", "asks", "cid"], F.lit(1) - F.col("asks"), "place")
    places = materialize(places.select("curve", "cid", "asks", "place"), "places")
    window = _window(places, table, asks, width, k + 1, wanted)
    size = min(max(window, _LEAST_BLOCK), _MOST_BLOCK)

    rows = places.filter("asks = 0").select("curve", "cid", F.floor((F.col("place") - 1) / size).cast("long").alias("block"))
    last = F.lit((table.count() - 1) // size).cast("long")
    low = F.greatest(F.floor((F.col("place") - window) / size), F.lit(0)).cast("long")
    high = F.least(F.floor((F.col("place") + window - 1) / size).cast("long"), last)
    looks = places.filter("asks = 1").select("curve", "cid", F.explode(F.sequence(F.least(low, last), high)).alias("block"))
    # queries may crowd at one place: such a block meets them in parts
    loads = looks.groupBy("curve", "block").agg(F.ceil(F.count(F.lit(1)) / _QUERIES).cast("int").alias("parts"))
    loads = materialize(loads, "loads")
    rows = rows.join(loads, ["curve", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    looks = looks.join(loads, ["curve", "block"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    full = rows.join(table, "cid").select("curve", "block", "part", "cid", "least", "v", F.lit(0).alias("asks"))
    full = full.unionByName(looks.join(asks, "cid").select("curve", "block", "part", "cid", F.lit(0).cast("long").alias("least"), "v", F.lit(1).alias("asks")))
    found = full.groupBy("curve", "block", "part").applyInArrow(_windows(width, k + 1), "asked long, cid long, least long, score double")

    # a query's copies are candidates wherever they stand: their class is one of its own
    me = asks.mapInArrow(_own_score(width), "asked long, cid long, score double").join(table.select("cid", "least"), "cid").select("asked", "cid", "least", "score")
    once = found.unionByName(me).repartition("asked").groupBy("asked", "cid").agg(F.max("least").alias("least"), F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), "least"))
    best = once.withColumn("_rank", rank).filter(F.col("_rank") <= k + 1).select("asked", "cid", "score")
    member = best.join(classes.select("cid", "members"), "cid").select("asked", "score", F.explode("members").alias("m"))
    order = F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), F.col("m.vec_id"), F.col("m.row")))
    lists = member.withColumn("_rank", order).filter(F.col("_rank") <= k + 1).groupBy("asked").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "m"))).alias("best"))
    lists = materialize(lists, "lists")
    rows = asked.join(classes.select("h", "x", "cid"), ["h", "x"]).select("vec_id", "row", F.col("cid").alias("asked")).join(lists, "asked")
    others = F.slice(F.filter("best", lambda b: b["m"]["row"] != F.col("row")), 1, k)
    out = rows.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.m.vec_id").alias("vec_id"), (-F.col("b.s") + 0.0).alias("score"))


def _own_score(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unpack(b["v"], width)
            yield pa.RecordBatch.from_arrays([b["cid"], b["cid"], pa.array(scores(x, x))], names=["asked", "cid", "score"])

    return run


def op11_hilbert_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
