"""Operator 7: repeated byte windows by a depth-limited, most-significant-digit radix sort of suffixes.

Suffixes count through ``DEPTH`` bytes only, and the equal groups of the last pass are
exactly the repeated windows. Each pass deals suffixes out by their next digit and drops
every group that can't hold a repeat. Digits are taken from the inside of a window to its
ends, so that neighbouring suffixes move together:

1. The first digit is the k-gram of least hash inside the window (its anchor). Neighbours
   share their anchor, so a run of them is one row; runs that are equal as a whole are
   settled at once. A run without its like whose anchor occurs elsewhere goes on.
2. Runs are cut at every sixteenth place of the anchor; the second digit is all that the
   windows of such a part share, 385 bytes.
3. The last digit is the 15 bytes that are left of each window; they are compared as they are.

The hash of an anchor only deals suffixes out, and never tells that bytes are equal: that is
said by BLAKE2b digests of 128 bits for whole runs and second digits, and by the bytes
themselves for the rest. A settled group leaves one weighted witness for the next pass, so a
hot group shrinks to its different members before it is dealt out again.

Repeated passages are found by their words in the same way (``passages``): runs of windows with one
anchor first, then the single windows of runs that differ as a whole.

Texts move once: the different texts are dealt by key into a bucketed table, and both steps
that need their bytes join it in place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import U64, Spans, slices, text_buffers, to_i64, words
from .frames import bucketed, discard, materialize, small_batches, text_key, text_of
from .workers import lean

DEPTH = 400
PASSAGE = 50  # words
_GRAM = 200
_CUT = 16
_SLICE = 1 << 18
_ROWS = 1 << 14
_TOP = U64(0xFFFFFFFF00000000)
_KEY = "terravane_text_key"
_RUNS = "key binary, copies long, pos long, lo int, hi int, outer long, inner binary"
_PASSAGES = "key binary, copies long, first long, last long, s long, e long, outer long, inner binary"
_WINDOWS = "key binary, copies long, digit binary, s long, e long"
_PARTS = "key binary, copies long, pos long, lo int, hi int, outer binary, head binary, tail binary"


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    m = len(v) - w + 1
    x = np.concatenate([v, np.full(-len(v) % w, ~U64(0))]).reshape(-1, w)
    head = np.minimum.accumulate(x, 1).ravel()
    tail = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[:m], head[w - 1 : w - 1 + m])


def runs(raw: np.ndarray, offsets: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, first start, last start, row, anchor hash) of each run of windows with one anchor.

    The anchor of a window is the leftmost of its grams whose hash is least in its upper half: a matter of the
    window's bytes alone.
    """
    if len(raw) < depth:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, U64),)
    h = Spans(raw).rolling(gram)
    anchor = (_sliding_min((h & _TOP) | np.arange(len(h), dtype=U64), depth - gram + 1) & ~_TOP).astype(np.int64)
    broken = np.zeros(len(raw) + 1, np.int32)  # starts whose window leaves its row
    np.add.at(broken, np.maximum(offsets[1:] - depth + 1, offsets[:-1]), 1)
    np.add.at(broken, offsets[1:], -1)
    whole = np.cumsum(broken)[: len(anchor)] == 0
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    at = anchor[first]
    # rows of exactly one window apart share no anchor: a gram never leaves the windows of its row
    row = np.searchsorted(offsets, first, "right") - 1
    return at, first, last, row, h[at]


def digests(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """BLAKE2b, 128 bits, of each byte range."""
    view, hashed = memoryview(np.ascontiguousarray(raw)), hashlib.blake2b
    return [hashed(view[s:e], digest_size=16).digest() for s, e in zip(start.tolist(), end.tolist())]


def _pieces(off: np.ndarray, depth: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row, first byte, last byte) of bounded pieces; a long text is cut so that each window lies in one piece."""
    for i, j in slices(off, _SLICE):
        if j - i > 1 or off[j] - off[i] <= 2 * _SLICE:
            yield i, j, int(off[i]), int(off[j])
        else:
            for a in range(int(off[i]), int(off[j]) - depth + 1, _SLICE):
                yield i, j, a, min(int(off[j]), a + _SLICE + depth - 1)


def _anchors(depth: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(2))
            for i, j, a, b in _pieces(off, depth):
                part = raw[a:b]
                o = np.clip(off[i : j + 1], a, b) - a
                at, first, last, row, outer = runs(part, o, depth, gram)
                inner = digests(part, first, last + depth)
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(at + a - off[row + i]), pa.array((at - last).astype(np.int32)), pa.array((at - first).astype(np.int32)), pa.array(to_i64(outer)), pa.array(inner, pa.binary())],
                    names=["key", "copies", "pos", "lo", "hi", "outer", "inner"],
                )

    return run


def _settle(rows: DataFrame, same: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(settled, open) of the rows of a pass, dealt by ``outer``; rows equal in ``same`` are equal runs.

    Equal runs repeat each other. ``open`` has one row for each different run of every ``outer`` group that holds
    several and one without its like; copies is then the number of runs it stands for.
    """
    groups = materialize(rows.groupBy("outer", *same).agg(F.sum("copies").alias("n")), name)
    mixed = groups.groupBy("outer").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1").select("outer", F.lit(1).alias("mixed"))
    told = groups.join(mixed, "outer", "left").filter("n > 1 OR mixed = 1")
    both = materialize(rows.join(told, ["outer", *same]), name + "_told")
    rest = [c for c in rows.columns if c not in ("outer", "copies", *same)]
    kept = both.filter("mixed = 1").groupBy("outer", *same).agg(F.min(F.struct(*rest)).alias("r"), F.first("n").alias("copies"))
    discard(groups)
    return both, kept.select("outer", *same, "r.*", "copies")


def _found(both: DataFrame, own: Column, depth: int) -> DataFrame:
    """(key, s, e) of runs that have their like, and had none before."""
    return both.filter((F.col("n") > 1) & own).select("key", (F.col("pos") - F.col("hi")).alias("s"), (F.col("pos") - F.col("lo") + depth).alias("e"))


def _cut_up(depth: int, cut: int):
    """Rows (key, text, todo) into the parts of their open runs: what the windows of a part share, and the bytes before and behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("copies", pa.int64()), ("pos", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("outer", pa.binary()), ("head", pa.binary()), ("tail", pa.binary())])
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            lists = batch.column(2)
            item = lists.flatten()
            each = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            pos, lo, hi, copies = (item.field(k).to_numpy() for k in ("pos", "lo", "hi", "copies"))
            data = memoryview(raw) if len(raw) else memoryview(b"")
            for i in range(0, len(each), _ROWS // 4):
                row, p, x, y, c = (v[i : i + _ROWS // 4] for v in (each, pos, lo, hi, copies))
                count = y // cut - x // cut + 1
                which = np.repeat(np.arange(len(p)), count)
                cell = x[which] // cut + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                u, v = cell * cut, cell * cut + cut - 1
                low, high = np.maximum(u, x[which]), np.minimum(v, y[which])
                base = off[row[which]] + p[which]
                shared = digests(raw, base - u, base - v + depth)
                outer = [d + k.to_bytes(2, "little") for d, k in zip(shared, cell.tolist())]
                head = [bytes(data[s:e]) for s, e in zip((base - high).tolist(), (base - u).tolist())]
                tail = [bytes(data[s:e]) for s, e in zip((base - v + depth).tolist(), (base - low + depth).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[which])), pa.array(c[which].astype(np.int64)), pa.array(p[which].astype(np.int64)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(outer, pa.binary()), pa.array(head, pa.binary()), pa.array(tail, pa.binary())],
                    schema=schema,
                )

    return run


def different_texts(docs: DataFrame) -> DataFrame:
    """(key, text, copies) of the different texts as UTF-8, dealt by key into a bucketed table."""
    text = text_of()
    rows = docs.select(text_key(text).alias("key"), text.cast("binary").alias("text"))
    return bucketed(rows.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "key", "texts")


def covered(texts: DataFrame, depth: int = DEPTH, gram: int | None = None) -> DataFrame:
    """(key, spans): for each different text, the sorted [start, end) byte ranges of windows of ``depth`` bytes that also start elsewhere."""
    gram, cut = gram or depth // 2, min(_CUT, depth)
    first = materialize(texts.select("key", "copies", "text").mapInArrow(lean(_anchors(depth, gram)), _RUNS), "anchors")
    both0, todo = _settle(first, ["inner"], "pass1")
    discard(first)
    spans = _found(both0, F.lit(True), depth)
    by_text = todo.groupBy("key").agg(F.collect_list(F.struct("pos", "lo", "hi", "copies")).alias("todo"))  # the runs of one text
    parts = materialize(texts.select("key", "text").join(by_text, "key").select("key", "text", "todo").mapInArrow(lean(_cut_up(depth, cut)), _PARTS), "parts")
    both1, todo = _settle(parts, ["lo", "hi", "head", "tail"], "pass2")
    discard(parts)
    spans = spans.unionByName(_found(both1, F.col("copies") == 1, depth))
    # each window of a part: the end of what stands before the shared bytes and the beginning of what stands behind them
    at = todo.withColumn("o", F.explode(F.sequence("lo", "hi"))).withColumn("t", F.col("o") - F.col("o") % cut)
    digit = F.concat(F.substring("head", F.col("hi") - F.col("o") + 1, F.col("o") - F.col("t")), F.substring("tail", F.lit(1), F.col("t") + (cut - 1) - F.col("o")))
    windows = materialize(at.select("key", "pos", "outer", "o", digit.alias("digit"), "copies"), "windows")
    twice = windows.groupBy("outer", "o", "digit").agg(F.sum("copies").alias("n")).filter("n > 1")
    last = windows.filter("copies = 1").join(twice, ["outer", "o", "digit"], "left_semi")
    spans = spans.unionByName(last.select("key", (F.col("pos") - F.col("o")).alias("s"), (F.col("pos") - F.col("o") + depth).alias("e")))
    ranges = materialize(spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans")), "covered")
    discard(both0, both1, windows)
    return ranges


def _spaced(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the words, each with a space behind it, where each begins): white space doesn't tell passages apart."""
    size = end - start
    place = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(place[-1], 32, np.uint8)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(place[:-1], size) + at] = raw[np.repeat(start, size) + at]
    return out, place


def _word_anchors(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(2))
            for i, j in slices(off, _SLICE):
                part = raw[off[i] : off[j]]
                start, end, of = words(part, off[i : j + 1] - off[i])
                if len(start) < n:
                    continue
                upto = np.searchsorted(of, np.arange(j - i + 1))
                _, first, last, row, outer = runs(Spans(part).hash(start, end), upto, n, max(1, n // 2))
                flat, place = _spaced(part, start, end)
                inner = digests(flat, place[first], place[last + n])
                take, base = pa.array(row + i), off[row + i] - off[i]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(first - upto[row]), pa.array(last - upto[row]), pa.array(start[first] - base), pa.array(end[last + n - 1] - base), pa.array(to_i64(outer)), pa.array(inner, pa.binary())],
                    names=["key", "copies", "first", "last", "s", "e", "outer", "inner"],
                )

    return run


def _word_windows(n: int):
    """Rows (key, text, todo) into the single windows of their open runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, todo in zip(batch.column(0), batch.column(1), batch.column(2)):
                raw = np.frombuffer(text.as_py(), np.uint8)
                start, end, _ = words(raw, np.array([0, len(raw)]))
                flat, place = _spaced(raw, start, end)
                first, last, copies = (todo.values.field(c).to_numpy() for c in ("first", "last", "copies"))
                count = last - first + 1
                w = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                each = np.repeat(copies, count)
                for k in range(0, len(w), _ROWS):
                    x = w[k : k + _ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()] * len(x), pa.binary()), pa.array(each[k : k + _ROWS]), pa.array(digests(flat, place[x], place[x + n]), pa.binary()), pa.array(start[x]), pa.array(end[x + n - 1])],
                        names=["key", "copies", "digit", "s", "e"],
                    )

    return run


def passages(texts: DataFrame, n: int = PASSAGE) -> DataFrame:
    """(key, spans): for each different text, the sorted [start, end) byte ranges of windows of ``n`` words that also start elsewhere.

    Words are runs without ASCII white space; what stands between them doesn't count.
    """
    first = materialize(texts.select("key", "copies", "text").mapInArrow(lean(_word_anchors(n)), _PASSAGES), "word_anchors")
    both, todo = _settle(first, ["inner"], "word_pass")
    discard(first)
    spans = both.filter("n > 1").select("key", "s", "e")
    by_text = todo.groupBy("key").agg(F.collect_list(F.struct("first", "last", "copies")).alias("todo"))  # the runs of one text
    windows = materialize(texts.select("key", "text").join(by_text, "key").select("key", "text", "todo").mapInArrow(lean(_word_windows(n)), _WINDOWS), "word_windows")
    twice = windows.groupBy("digit").agg(F.sum("copies").alias("n")).filter("n > 1")
    spans = spans.unionByName(windows.filter("copies = 1").join(twice, "digit", "left_semi").select("key", "s", "e"))
    ranges = materialize(spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans")), "passages")
    discard(both, windows)
    return ranges


def merged(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of ranges [s, e) sorted by s."""
    if not len(s):
        return []
    reach = np.maximum.accumulate(e)
    new = np.append(True, s[1:] > reach[:-1])
    return list(zip(s[new].tolist(), reach[np.append(new[1:], True)].tolist()))


def _kept(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in gone)]
    return b"".join([data[a:b] for a, b in zip(ends, [*(s for s, _ in gone), len(data)])])


def _each(batch: pa.RecordBatch, column: str = "spans") -> Iterator[tuple[bytes, bytes, list[tuple[int, int]]]]:
    """(key, text, merged ranges) of each row (key, text, spans)."""
    lists = batch.column(column)
    item, size = lists.flatten(), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    s, e, upto = item.field("s").to_numpy(), item.field("e").to_numpy(), np.concatenate([[0], np.cumsum(size)])
    for k in range(batch.num_rows):
        yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), merged(s[upto[k] : upto[k + 1]], e[upto[k] : upto[k + 1]])


def _size(ranges: list[tuple[int, int]]) -> int:
    return sum(e - s for s, e in ranges)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    for batch in batches:
        rows = [(key, len(data), _size(gone), len(gone), hashlib.sha256(_kept(data, gone)).hexdigest(), len(told), _size(told)) for (key, data, gone), (_, _, told) in zip(_each(batch), _each(batch, "passages"))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"])


def removal(docs: DataFrame, depth: int = DEPTH, n_words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes of each row, on the UTF-8 bytes of its whole text.

    Every byte covered by a ``depth``-byte string that also starts anywhere else goes, in all its occurrences.
    With ``n_words``, n_passages and passage_bytes follow: the maximal runs, and their bytes, that windows of so many
    words cover that also start elsewhere, however short in bytes. They are told of and stay in the kept bytes.

    Null texts are empty; repeated rows repeat each other, so all of a text of depth bytes or more goes; very long
    texts are read in pieces of 256 KiB; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    texts = different_texts(docs)
    marked = texts.select("key", "text").join(covered(texts, depth), "key", "left")
    if n_words:
        marked = marked.join(passages(texts, n_words).withColumnRenamed("spans", "passages"), "key", "left")
    else:
        marked = marked.withColumn("passages", F.slice("spans", 1, 0))
    told = marked.select("key", "text", "spans", "passages").mapInArrow(lean(_report), "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long")
    told = materialize(told, "removals")
    discard(texts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text_of()).alias("key"))
    more = ["n_passages", "passage_bytes"] if n_words else []
    return rows.join(told, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("kept_bytes"), *more)


def whole_characters(data: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges without the characters that they cover in part."""
    out = []
    for s, e in gone:
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        if e > s:
            out.append((s, e))
    return out


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(key, _kept(data, whole_characters(data, gone)).decode()) for key, data, gone in _each(batch)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.binary(), pa.string()])], names=["key", "cleaned"])


def remove_repeats(docs: DataFrame, depth: int = DEPTH, n_words: int | None = None) -> DataFrame:
    """docs with the repeated windows taken out of text (whole characters only) and n_chars, if there, counted anew.

    With ``n_words``, repeated passages of so many words or more go as well, however short in bytes.

    Rows without a repeat stay as they are, null texts too; repeated rows repeat each other; other columns, also
    nested ones or those with dots in their names, are handed on; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    texts = different_texts(docs)
    gone = covered(texts, depth)
    if n_words:
        gone = gone.unionByName(passages(texts, n_words)).groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    changed = texts.select("key", "text").join(gone, "key").select("key", "text", "spans").mapInArrow(lean(_cleaned), "key binary, cleaned string")
    changed = materialize(changed.select(F.col("key").alias(_KEY), F.col("cleaned").alias(_KEY + "_text")), "cleaned")
    discard(texts)
    old, new = F.col("text"), F.col(_KEY + "_text")
    out = docs.withColumn(_KEY, text_key(text_of())).join(changed, _KEY, "left").withColumn("text", F.when(new.isNull(), old.cast("string")).otherwise(new).cast(docs.schema["text"].dataType))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(new.isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.drop(_KEY, _KEY + "_text")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_words=PASSAGE)
