"""Operator 3: near-duplicates by BagMinHash on multisets of five-word shingles.

A text is a bag: each shingle weighs as often as it occurs. The weight axis is cut at
1, 2, 4, 8, …; every (shingle, stratum) is a Poisson process of rate equal to the
stratum's length, whose points carry a slot and, by halving, a unit of weight; a point
counts if the text's weight reaches its unit. The least point of each slot is the
signature, and two signatures agree in a slot with probability equal to the weighted
Jaccard similarity. Points are drawn in rising order until they pass the largest slot.

Bands of the signature give candidates; links are verified on the whole bags. A group
of near copies is resolved in two rounds: each member is compared with the hub that it
shares most buckets with, and only buckets of several components go on. There, whole
signatures rule most pairs out; what they join is a group, and its texts are compared
block by block, pairs of one component excepted. No step emits the pairs of a group.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import U64, Spans, mix, slices, text_buffers, to_i64, words
from .frames import discard, materialize, small_batches, text_key, text_of
from .workers import lean

WORDS, THRESHOLD = 5, 0.8
SLOTS, BANDS, ROWS = 128, 24, 4
_RULED_OUT = 0.6  # of 128 slots; a pair at 0.8 has fewer with probability 1e-7, less than the bands miss
_BLOCK = 2048
_GOLD = U64(0x9E3779B97F4A7C15)


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of n words; a text of fewer words is one shingle."""
    start, end, row = words(raw, offsets)
    h = Spans(raw).hash(start, end)
    total = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(total)])
    codes = np.zeros(len(h), U64)
    for k in range(n):
        shifted = np.zeros(len(h), U64)
        shifted[: max(0, len(h) - k)] = h[k:]
        inside = np.arange(len(h)) + k < first[row + 1]
        codes = codes * U64(0x2545F4914F6CDD1D) + np.where(inside, shifted, U64(k + 1))
    keep = (np.arange(len(h)) + n <= first[row + 1]) | (np.arange(len(h)) == first[row]) & (total[row] < n)
    return mix(codes[keep]), row[keep]


def bags(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, weight, row) of the distinct shingles, sorted by row and hash."""
    h, row = shingles(raw, offsets)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), row[at]


def bag_min_hash(h: np.ndarray, weight: np.ndarray, row: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """n × slots least points; inf where a row has no element."""
    sig = np.full(n * slots, np.inf)
    strata = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    element = np.repeat(np.arange(len(h)), strata)
    stratum = np.arange(len(element)) - np.repeat(np.cumsum(strata) - strata, strata)
    low = np.where(stratum == 0, 0, 1 << np.maximum(stratum - 1, 0))
    length = np.where(stratum == 0, 1, low)
    seed = mix(h[element] + stratum.astype(U64) * U64(0xD1B54A32D192ED03))
    r, w = row[element], weight[element]
    x = np.zeros(len(element))
    drawn, highest = 0, np.full(n, np.inf)
    while len(x):
        points = 1 if drawn < 2 else 16
        steps = seed[:, None] + (np.arange(drawn + 1, drawn + 1 + points, dtype=U64) * _GOLD)[None, :]
        bits = mix(steps.ravel()).reshape(steps.shape)
        gaps = -np.log(((bits >> U64(24)).astype(np.float64) + 0.5) / 2.0**40) / length[:, None]
        at = x[:, None] + np.cumsum(gaps, axis=1)
        unit = low[:, None] + 1 + (mix(bits.ravel()).reshape(bits.shape) & (length - 1).astype(U64)[:, None]).astype(np.int64)
        counts = (unit <= w[:, None]) & (at <= highest[r][:, None])
        slot = r[:, None] * slots + (bits & U64(slots - 1)).astype(np.int64)
        np.minimum.at(sig, slot[counts], at[counts])
        drawn += points
        x = at[:, -1]
        touched = np.unique(r)
        highest[touched] = sig.reshape(n, slots)[touched].max(1)
        go = x <= highest[r]
        x, seed, r, w, low, length = x[go], seed[go], r[go], w[go], low[go], length[go]
    return sig.reshape(n, slots)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    power = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(ROWS)], U64)
    for batch in batches:
        raw, off = text_buffers(batch.column(2))
        for i, j in slices(off):
            h, w, row = bags(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            sig = bag_min_hash(h, w, row, j - i)
            full = np.isfinite(sig[:, 0])
            code = mix(sig.view(U64).ravel()).reshape(sig.shape)
            band = mix(((code[:, : BANDS * ROWS].reshape(j - i, BANDS, ROWS) * power).sum(2, dtype=U64) + np.arange(BANDS, dtype=U64)).ravel()).reshape(j - i, BANDS)
            short = (code & U64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([s.tobytes() if f else None for s, f in zip(short, full)], pa.binary()), pa.array([to_i64(b) if f else None for b, f in zip(band, full)], pa.list_(pa.int64()))],
                names=["doc_id", "nid", "sig", "bands"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, nid, sig, bands): nid stands for the text; sig and bands are null for a text without words."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text_of()).alias("nid"), F.lower(text_of()).alias("text"))
    return src.mapInArrow(lean(_signed), "doc_id long, nid binary, sig binary, bands array<long>")


class _Bags:
    """The bags of the last few texts: pairs come sorted by hub."""

    def __init__(self):
        self.held: OrderedDict[bytes, tuple] = OrderedDict()

    def get(self, nid: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
        if nid not in self.held:
            raw = np.frombuffer(text.encode(), np.uint8)
            h, w, _ = bags(raw, np.array([0, len(raw)]))
            self.held[nid] = h, w
            if len(self.held) > 64:
                self.held.popitem(last=False)
        return self.held[nid]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    union = int(a[1].sum() + b[1].sum()) - both
    return both / union if union else 0.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = _Bags()
    for batch in batches:
        a, b, ta, tb = batch.columns
        linked = [weighted_jaccard(kept.get(x.as_py(), t.as_py()), kept.get(y.as_py(), u.as_py())) >= THRESHOLD for x, y, t, u in zip(a, b, ta, tb)]
        yield pa.RecordBatch.from_arrays([a, b, pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked) of pairs of nids, on their whole bags."""
    ta = texts.select(F.col("nid").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("nid").alias("b"), F.col("text").alias("tb"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").sortWithinPartitions("b").mapInArrow(lean(_verify), "a binary, b binary, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of edges (a, b): label is the least node of the component. Min-label propagation with pointer jumping; each round is a table in the shared folder."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("all"))  # a node's lesser neighbours hang on the least of them: few edges are left
    star = least.select("a", F.col("m").alias("b")).union(least.select(F.explode("all").alias("a"), F.col("m").alias("b")).filter("a <> b")).distinct()
    star = materialize(star, "stars")
    both = materialize(star.union(star.select("b", "a")), "edges")
    now = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        step = now.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = materialize(step.join(jump, "label", "left").select("node", "was", F.least(F.col("label"), F.coalesce("root", "label")).alias("label")), "labels")
        changed = new.filter("was <> label").limit(1).count()
        discard(now)
        now = new
        if not changed:
            discard(both, star)
            return now.select("node", "label")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (nid, label) after the links; only the graph of the labels themselves is solved."""
    la = labels.select(F.col("nid").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("nid").alias("b"), F.col("label").alias("lb"))
    graph = links.join(la, "a").join(lb, "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    solved = components(graph)
    return materialize(labels.join(solved.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("nid", F.coalesce("root", "label").alias("label")), "node_labels")


class _Sets:
    """Union-find over the rows of a block, joined by label from the start."""

    def __init__(self, label: list):
        first: dict = {}
        self.up = [first.setdefault(x, k) for k, x in enumerate(label)]

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def links(self, name: list, before: list[int]) -> pa.Table:
        """(a, b): one row of each set there was before, to the least name of its set now."""
        least: dict = {}
        for k, x in enumerate(name):
            r = self.root(k)
            least[r] = min(x, least.get(r, x))
        rows = [(x, least[self.root(k)]) for k, x in enumerate(name) if before[k] == k and x != least[self.root(k)]]
        return pa.table([pa.array([x for x, _ in rows], pa.binary()), pa.array([y for _, y in rows], pa.binary())], names=["a", "b"])


def _near_rows(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Of one pair of blocks (i, j): each row of the first, and the rows of the second of other labels that its signature doesn't rule out."""
    names: dict = {}
    lab = np.array([names.setdefault(x, len(names)) for x in table["label"].to_pylist()])
    block, i, j = table["block"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, SLOTS)
    right, least = np.flatnonzero(block == j), int(np.ceil(_RULED_OUT * SLOTS))
    for p in np.flatnonzero(block == i):
        others = right[(lab[right] != lab[p]) & ((right > p) | (i != j))]
        if len(others):
            yield int(p), others[(sig[others] == sig[p]).sum(1) >= least]


def _alike(table: pa.Table) -> pa.Table:
    """Links (a, b) that join, within one pair of blocks of a bucket, all that signatures hold to be alike: fewer links than rows."""
    nid = table["nid"].to_pylist()
    sets = _Sets(nid)
    for p, near in _near_rows(table):
        for q in near.tolist():
            sets.join(p, q)
    return sets.links(nid, [*range(len(nid))])


def _linked(table: pa.Table) -> pa.Table:
    """Links (a, b) on whole bags that join, within one pair of blocks of a group, all that is linked: fewer links than rows. What signatures don't rule out is compared unless joined already."""
    nid, text, sets = table["nid"].to_pylist(), table["text"], _Sets(table["label"].to_pylist())
    before = [sets.root(k) for k in range(len(nid))]
    held: dict[int, tuple] = {}

    def bag(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in held:
            raw = np.frombuffer(text[k].as_py().encode(), np.uint8)
            held[k] = bags(raw, np.array([0, len(raw)]))[:2]
        return held[k]

    for p, near in _near_rows(table):
        for q in near.tolist():
            if sets.root(p) != sets.root(q) and weighted_jaccard(bag(p), bag(q)) >= THRESHOLD:
                sets.join(p, q)
    return sets.links(nid, before)


def _stars(members: DataFrame, labels: DataFrame) -> DataFrame:
    """One pair (a, b) for each node that shares a bucket with another component's hub: the hub it meets in most buckets."""
    rows = members.join(labels, "nid")
    hubs = rows.groupBy("bucket").agg(F.min(F.struct("label", "nid")).alias("hub"), F.max("label").alias("last")).filter("hub.label <> last")
    met = rows.join(hubs, "bucket").filter("label <> hub.label").groupBy(F.col("nid").alias("a"), F.col("hub.nid").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    met = met.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _in_blocks(rows: DataFrame, blocks, *columns: str) -> DataFrame:
    """Each row once for every pair of blocks (i, j) of its group that its own block is in."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("nid"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    return rows.select(*columns, "nid", "label", "sig", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _groups(members: DataFrame, labels: DataFrame, sigs: DataFrame) -> DataFrame:
    """(node, label): the groups within which nodes of different components may still be linked."""
    rows = members.select("bucket", "nid").join(labels, "nid")
    mixed = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket", "size")
    rows = rows.join(mixed, "bucket").join(sigs, "nid")
    cut = _in_blocks(rows, F.ceil(F.col("size") / F.lit(_BLOCK)), "bucket")
    return components(cut.groupBy("bucket", "i", "j").applyInArrow(_alike, "a binary, b binary"))


def _rest(groups: DataFrame, labels: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the components of a group, block by block; a block has about a thousand texts or 4 MB."""
    named = groups.select(F.col("node").alias("nid"), F.col("label").alias("group"))
    rows = named.join(labels, "nid").join(sigs, "nid").join(texts, "nid")
    size = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    rows = rows.join(size, "group")
    cut = _in_blocks(rows, F.greatest(F.ceil(F.col("n") / 1024), F.ceil(F.col("chars") / (4 << 20))), "group", "text")
    return cut.groupBy("group", "i", "j").applyInArrow(_linked, "a binary, b binary")


def maybe_broadcast(df: DataFrame, most: int = 500_000, inside: str | None = None) -> DataFrame:
    """df marked for broadcast if it has at most ``most`` rows of a few bytes (or members in the array column ``inside``); else Spark shuffles both sides."""
    size = F.count(F.lit(1)) if inside is None else F.coalesce(F.sum(F.size(inside) + 1), F.lit(0))
    return F.broadcast(df) if df.agg(size.alias("n")).first()["n"] <= most else df


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, nid, class_id, cluster_id, label of each row.

    class_id is the least doc_id of the rows of equal text; cluster_id the least doc_id of all texts that links
    of weighted Jaccard similarity 0.8 or more connect. label is the least nid of those texts: it stands for the
    group itself, where groups may share a doc_id or have none. Null texts are empty; texts without words link to none but
    their copies. Null ids are passed over for the least (null where no row of the group has one). Other columns
    are ignored; an empty table gives no rows.
    """
    signed = materialize(signatures(docs), "signatures")
    classes = signed.groupBy("nid").agg(F.min("doc_id").alias("class_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    rows = classes.filter("bands IS NOT NULL").select("nid", F.posexplode("bands").alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = materialize(rows.join(shared, "bucket", "left_semi"), "members")
    nodes = materialize(members.select("nid").distinct(), "nodes")
    sigs = materialize(classes.join(nodes, "nid", "left_semi").select("nid", "sig"), "node_signatures")
    source = docs.select(text_key(text_of()).alias("nid"), F.lower(text_of()).alias("text"))
    texts = materialize(source.join(maybe_broadcast(nodes), "nid", "left_semi").groupBy("nid").agg(F.first("text").alias("text")), "texts")
    labels = nodes.select("nid", F.col("nid").alias("label"))
    seen = materialize(_verified(_stars(members, labels), texts), "links").filter("linked")
    labels = _merged(labels, seen)
    more = materialize(_rest(_groups(members, labels, sigs), labels, sigs, texts), "links")
    if more.limit(1).count():
        labels = _merged(labels, more)
    discard(texts, members, sigs)
    named = labels.join(classes.select("nid", "class_id"), "nid")
    least = named.groupBy("label").agg(F.min("class_id").alias("cluster_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    linked = named.join(least, "label").select("nid", "cluster_id", "label")
    both = classes.select("nid", "class_id").join(linked, "nid", "left").select("nid", "class_id", F.coalesce("cluster_id", "class_id").alias("cluster_id"), F.coalesce("label", "nid").alias("label"))
    return signed.select("doc_id", "nid").join(both, "nid").select("doc_id", "nid", "class_id", "cluster_id", "label")


def op3_bag_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "cluster_id")
