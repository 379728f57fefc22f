"""Operator 1: quality classifier by Naive Bayes support vectors.

Indicators of hashed n-grams (bytes, words, word shapes) are scaled by the log-count
ratios of the two classes; a linear hinge-loss model on them is fitted by dual
coordinate descent. Class counts cover all labelled training rows; the linear model is
fitted on at most ``sample_per_class`` of them a class, drawn by a hash of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import U64, Spans, slices, text_buffers, words
from .frames import discard, materialize, named, small_batches, text_of
from .workers import lean

BITS = 17
SAMPLE_PER_CLASS = 2000
THRESHOLD = 0.7
_ODD = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3), U64(0x1D8E4E27C47D124F)]
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SIGN[[44, 46]] = False  # commas and full stops are plain prose


def _bucket(codes: np.ndarray, stream: int) -> np.ndarray:
    return (((codes + U64(stream)) * _ODD[stream]) >> U64(64 - BITS)).astype(np.int32)


def indicators(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each row of a slice, the distinct buckets of its n-grams."""
    c = raw.astype(U64)
    grams = [_bucket(c, 0)]
    for n in (2, 3, 4):
        c = (c[:-1] << U64(8)) | raw[n - 1 :] if len(c) > 1 else c[:0]
        grams.append(_bucket(c, n - 1))
    start, end, row = words(raw, offsets)
    h = Spans(raw).hash(start, end)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    tally = lambda mask: (lambda s: s[end] - s[start])(np.concatenate([[0], np.cumsum(mask[raw], dtype=np.int64)]))
    up, low, signs = tally(_UPPER), tally(_LOWER), tally(_SIGN)
    shape = (same + 2 * (low == 0) * (up > 0) + 4 * (tally(_DIGIT) > 0) + 8 * (signs > 0) + 16 * (signs > 1) + 32 * (end - start > 20)).astype(U64)
    pair = h[:-1] * U64(3) + h[1:] if len(h) else h
    wide = [(_bucket(h, 4), 1), (_bucket(pair, 5), 2), (_bucket(shape, 6), 1)]
    two = shape[:-1] * U64(64) + shape[1:] if len(shape) else shape
    wide.append((_bucket(two, 7), 2))
    wide.append((_bucket(two[:-1] * U64(64) + shape[2:] if len(shape) > 2 else shape[:0], 8), 3))
    first = np.searchsorted(row, np.arange(len(offsets)))
    stamp = np.zeros(1 << BITS, np.int32)
    for i in range(len(offsets) - 1):
        a, b = offsets[i], offsets[i + 1]
        if a == b:
            yield np.zeros(0, np.int32)
            continue
        wa, wb = first[i], first[i + 1]
        x = np.concatenate([g[a : max(a, b - n)] for n, g in enumerate(grams)] + [g[wa : max(wa, wb - n + 1)] for g, n in wide])
        order = np.arange(len(x), dtype=np.int32)
        stamp[x] = order  # whichever write is last stands for its bucket
        yield x[stamp[x] == order]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class counts by bucket (one set a partition), and the indicators of the rows drawn for the sample."""
    schema = pa.schema([("bucket", pa.int32()), ("good", pa.int64()), ("bad", pa.int64()), ("key", pa.int64()), ("label", pa.int32()), ("buckets", pa.list_(pa.int32()))])
    total = np.zeros((2, 1 << BITS), np.int64)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        raw, off = text_buffers(batch.column(0))
        label = batch.column(1).to_numpy(zero_copy_only=False)
        drawn = batch.column(2).to_numpy(zero_copy_only=False)
        key = batch.column(3).to_numpy(zero_copy_only=False)
        for i, j in slices(off):
            kept = []
            for r, x in enumerate(indicators(raw[off[i] : off[j]], off[i : j + 1] - off[i]), i):
                total[label[r]][x] += 1
                rows[label[r]] += 1
                if drawn[r]:
                    kept.append((None, None, None, int(key[r]), int(label[r]), x))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)
    some = np.flatnonzero(total.sum(0))
    n = len(some)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[1][some]), pa.array(total[0][some]), *(pa.nulls(n, t) for t in schema.types[3:])], schema=schema)


def scaled(buckets: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Indicators times their log-count ratios, by the root of their number."""
    return ratio[buckets] / max(1.0, len(buckets) ** 0.5)


def dual_coordinate_descent(xs: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, size: int, rounds: int = 40, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) that minimise |w|²/2 + Σ cost·max(0, 1 - y·w·x), x the scaled indicators of each row of xs and 1."""
    w = np.zeros(size + 1)
    alpha = np.zeros(len(y))
    norm = np.array([float((v := scaled(at, ratio)) @ v) + 1.0 for at in xs])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for k in rng.permutation(len(y)):
            at = xs[k]
            v = scaled(at, ratio)
            g = y[k] * (float(w[at] @ v) + w[-1]) - 1
            pg = min(g, 0.0) if alpha[k] == 0 else max(g, 0.0) if alpha[k] == cost[k] else g
            worst = max(worst, abs(pg))
            if pg:
                new = min(max(alpha[k] - g / norm[k], 0.0), cost[k])
                step, alpha[k] = (new - alpha[k]) * y[k], new
                w[at] += step * v
                w[-1] += step
        if worst < 1e-3:
            break
    return w


def _platt(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a·margin + b), weighted maximum likelihood with soft targets, by damped Newton steps."""
    n1, n0 = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        d, h = weight * (p - target), weight * p * (1 - p) + 1e-12
        grad = np.array([d @ margin, d.sum()])
        hess = np.array([[h @ margin**2, h @ margin], [h @ margin, h.sum()]]) + 1e-6 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(float(a), 1e-3), float(b)


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS, cost: float = 1.0, share: float = 0.25) -> dict:
    """The model: weights by bucket, bias, and the two numbers of the calibration.

    A doc_id with several labels takes their majority (a tie counts as 1); null labels and ids teach nothing; rows
    of one doc_id all take its label. Empty tables teach nothing either; other columns are ignored.
    With labels of one class or none, every score is the share of label 1, (n1 + 1) / (n + 2).
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("double").alias("q")).filter("doc_id IS NOT NULL AND q IS NOT NULL")
    known = known.groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("int").alias("label")).filter(~is_held_out())
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    flat = {"w": np.zeros(1 << BITS), "bias": 0.0, "a": 1.0, "b": float(np.log(prior / (1 - prior)))}
    if len(sizes) < 2:
        return flat
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    most = F.when(F.col("label") == 1, int(min(1, sample_per_class / sizes[1]) * (1 << 30))).otherwise(int(min(1, sample_per_class / sizes[0]) * (1 << 30)))
    known = known.withColumn("drawn", at < most)
    if sum(sizes.values()) <= 2_000_000:  # about 40 MB; beyond it Spark chooses, and shuffles both sides
        known = F.broadcast(known)
    rows = docs.select("doc_id", text_of().alias("text")).join(known, "doc_id").select("text", "label", "drawn", F.xxhash64("doc_id").alias("key"))
    table = materialize(rows.mapInArrow(lean(_counts), "bucket int, good long, bad long, key long, label int, buckets array<int>"), "counts")
    counted = table.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()  # at most 2**BITS rows
    good, bad = np.ones(1 << BITS), np.ones(1 << BITS)
    where = counted["bucket"].to_numpy()
    good[where] += counted["good"].to_numpy()
    bad[where] += counted["bad"].to_numpy()
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    sample = table.filter("label IS NOT NULL").select("key", "label", "buckets").toArrow().sort_by([("key", "ascending"), ("label", "ascending")])  # about 2 * sample_per_class rows
    discard(table)
    label = sample["label"].to_numpy()
    if len(set(label.tolist())) < 2:
        return flat
    xs = [np.sort(x.values.to_numpy()) for x in sample["buckets"]]
    del sample, counted
    weight = np.where(label == 1, sizes[1] / max(1, (label == 1).sum()), sizes[0] / max(1, (label == 0).sum()))
    weight = weight / weight.mean()
    y = np.where(label == 1, 1.0, -1.0)
    aside = np.arange(len(y)) % 5 == 4 if min((label == 1).sum(), (label == 0).sum()) >= 25 else np.zeros(len(y), bool)
    taught = np.flatnonzero(~aside)
    w = dual_coordinate_descent([xs[k] for k in taught], ratio, y[taught], cost * weight[taught], 1 << BITS)
    tested = np.flatnonzero(aside) if aside.any() else taught
    # the usual interpolation between the mean weight and the weights, which keeps rare buckets near Naive Bayes
    body = (1 - share) * np.abs(w[:-1]).mean() + share * w[:-1]
    margin = np.array([float(body[xs[k]] @ scaled(xs[k], ratio)) + share * w[-1] for k in tested])
    a, b = _platt(margin, label[tested], weight[tested])
    return {"w": body * ratio, "bias": share * float(w[-1]), "a": a, "b": b}


def _score(model):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            raw, off = text_buffers(batch.column(2))
            score = np.empty(batch.num_rows)
            for i, j in slices(off):
                for r, x in enumerate(indicators(raw[off[i] : off[j]], off[i : j + 1] - off[i]), i):
                    score[r] = m["w"][np.sort(x)].sum() / max(1.0, len(x) ** 0.5)
            score = 1 / (1 + np.exp(-np.clip(m["a"] * (score + m["bias"]) + m["b"], -35, 35)))
            score = np.round(score, 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], schema=schema)

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    A null text scores as an empty one; very long texts are one row of a slice; repeated rows repeat, equal texts
    score alike; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), text_of().alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights
    return src.mapInArrow(lean(_score(sent)), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, all columns (whatever their names), whose text the model predicts as 1; a null text is judged as an empty one and stays null, repeated rows share their fate."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    run = _score(sent)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = pa.nulls(batch.num_rows, pa.int64())
            out = next(run(iter([pa.RecordBatch.from_arrays([none, none, batch.column(1)], names=["a", "b", "c"])])))
            yield batch.filter(pa.array(out.column(3).to_numpy() == 1))

    packed = docs.select(F.struct(*(named(c) for c in docs.columns)).alias("row"), text_of().alias("text"))
    return packed.mapInArrow(lean(good), packed.schema).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op1_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels))
