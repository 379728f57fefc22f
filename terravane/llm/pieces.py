"""Operator 9: SentencePiece encoding and decoding by a max-plus parallel scan.

A sequence of pieces is the encoding of its text exactly if each neighbouring pair is
(the pair's own text encodes to that pair), so an encoding is the one path of weight 0,
all others weighing minus infinity. A giant text is cut into chunks. Each chunk yields,
on its own, the max-plus matrix from the pieces that may reach over its start to those
that may reach over its end; the matrices of a text are combined associatively, which
fixes each chunk's boundary pieces, and each chunk is then traced back on its own.
Chunks are cut at fixed places, mostly inside a word, where a boundary has several states.
Inside a chunk the path is found word by word, since no piece reaches over the start of a
word; a text of one chunk is the same lattice without a boundary. The tokenizer's library
only reads the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import discard, materialize, small_batches, text_key, text_of

CHUNK = 1 << 15
_SPACE = "▁"
_NONE = -np.inf
_WORD = re.compile("▁+[^▁]*|[^▁]+")
State = tuple[int, int]  # (start, end) of the piece that reaches over a boundary, from the boundary on; (0, 0) for a word start


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_models: dict[str, Pieces] = {}


def _packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}i", *ids)


class _Known(dict):
    """The ids of words, as bytes; of two generations the older one goes when the younger is full, so frequent words stay.

    A word falls into parts between neighbours that stand together in no piece: no path joins them, and each part has a path of its own.
    """

    def __init__(self, model: Pieces):
        self.model, self.older = model, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            joined = self.model.joined
            at = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joined]
            if at:
                ids = b"".join([self[word[i:j]] for i, j in zip([0, *at], [*at, len(word)])])
            else:
                ids = _packed(self.model.ids(self.model.path(word)))
        if len(word) <= 64:
            if len(self) >= self.model.most:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Pieces:
    """The vocabulary of a BPE model, and its merges of short texts."""

    def __init__(self, path: str, most: int = 250_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte = {}
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        for i, p in enumerate(self.piece):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_unused(i):
                self.score[p], self.id[p] = sp.get_score(i), i
        byte = {i: b for b, i in self.byte.items()}
        self.raw = [bytes([byte[i]]) if i in byte else p.encode() for i, p in enumerate(self.piece)]
        self.longest = max(map(len, self.id))
        self.joined = {q[i : i + 2] for q in self.id for i in range(len(q) - 1)}
        lengths: dict[str, set[int]] = {}
        for q in self.id:
            for first in {q[:2], q[:3]} if len(q) > 1 else ():
                lengths.setdefault(first, {1}).add(len(q))
        for first in lengths:
            if len(first) == 3:
                lengths[first] |= {2} & {len(q) for q in (first[:2],) if q in self.id}
        # of the pieces with these three characters first (two: at the end of a word, or before characters that no piece has there), longest first
        self.sizes = {first: tuple(sorted(n if len(first) == 3 else {k for k in n if k < 3}, reverse=True)) for first, n in lengths.items()}
        self.trails: dict[str, tuple] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.most = most
        self.known = _Known(self)

    @staticmethod
    def of(path: str) -> Pieces:
        if path not in _models:
            _models[path] = Pieces(path)
        return _models[path]

    def merge(self, text: str) -> list[str]:
        """The merges of a short text: best score first, then leftmost."""
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            s = self.score.get(parts[i] + parts[j])
            if s is not None:
                heapq.heappush(heap, (-s, i, j, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if parts[i] != a or parts[j] != b or after[i] != j:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def coded(self, text: str) -> bytes:
        """The ids of whole words as little-endian 32-bit integers, each word by its path of weight 0; short words are remembered."""
        return b"".join(map(self.known.__getitem__, _WORD.findall(text)))

    def words(self, text: str) -> list[int]:
        return np.frombuffer(self.coded(text), "<i4").tolist()

    def path(self, word: str) -> list[str]:
        """The pieces of the one path of weight 0 through the lattice of a word, depth first, longest piece first.

        A beginning of the word has one encoding, so a place is entered by one piece only, and never twice.
        """
        n, ids, pairs, fits, sizes = len(word), self.id, self.pairs, self.fits, self.sizes
        one = (1,)
        first = sizes.get(word[:3]) or sizes.get(word[:2], one)
        pieces, tries, dead = [""], [iter(first)], set()
        pos, u = 0, ""
        after = pairs.get(u, pairs)
        while pos < n:
            for size in tries[-1]:
                end = pos + size
                if end > n or end in dead:
                    continue
                v = word[pos:end]
                if size > 1 and v not in ids:
                    continue
                known = after.get(v)
                if known is True or known is not False and fits(u, v):
                    pos, u = end, v
                    pieces.append(v)
                    tries.append(iter(sizes.get(word[pos : pos + 3]) or sizes.get(word[pos : pos + 2], one)))
                    break
            else:
                dead.add(pos)
                tries.pop()
                pos -= len(pieces.pop())
                u = pieces[-1]
            after = pairs.get(u, pairs)
        return pieces[1:]

    def trail(self, piece: str) -> tuple[list[float], list[str], list[str]]:
        """The scores of a piece's own merges in their order, and its first and last part before each and at the end."""
        known = self.trails.get(piece)
        if known is None:
            parts, scores, first, last = [*piece], [], [piece[0]], [piece[-1]]
            while len(parts) > 1:
                best, i = max((self.score.get(parts[i] + parts[i + 1], _NONE), -i) for i in range(len(parts) - 1))
                if best == _NONE:
                    break
                parts[-i : 2 - i] = [parts[-i] + parts[1 - i]]
                scores.append(best)
                first.append(parts[0])
                last.append(parts[-1])
            known = self.trails[piece] = (scores if len(parts) == 1 else None), first, last
        return known

    def fits(self, a: str, b: str) -> bool:
        """Whether pieces a and b may follow one another: weight 0 rather than minus infinity."""
        after = self.pairs.get(a)
        known = after.get(b) if after is not None else None
        if known is None:
            if self.n_pairs >= self.most:
                self.pairs.clear()
                self.n_pairs = 0
            known = self.pairs.setdefault(a, {})[b] = self._fit(a, b)
            self.n_pairs += 1
        return known

    def _fit(self, a: str, b: str) -> bool:
        """Merging a and b, no pair across them is ever the best."""
        left, right = self.trail(a) if a else None, self.trail(b)
        if right[0] is None or left is not None and left[0] is None:
            return False
        if left is None:
            return True
        (da, _, edge), (db, begin, _), score = left, right, self.score.get
        i, j, n, m = 0, 0, len(da), len(db)
        across = score(edge[0] + begin[0], _NONE)
        while i < n or j < m:
            x, y = da[i] if i < n else _NONE, db[j] if j < m else _NONE
            if x >= y:  # of equal scores the leftmost pair is merged first
                if across > x:
                    return False
                i += 1
                if edge[i] is not edge[i - 1]:
                    across = score(edge[i] + begin[j], _NONE)
            else:
                if across >= y:
                    return False
                j += 1
                if begin[j] is not begin[j - 1]:
                    across = score(edge[i] + begin[j], _NONE)
        return across == _NONE

    def ids(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            i = self.id.get(p)
            if i is None:
                out += [self.byte[b] for b in p.encode()]
            else:
                out.append(i)
        return out


def cuts(text: str, chunk: int = CHUNK) -> list[int]:
    """Starts of the chunks: the multiples of chunk."""
    return list(range(0, max(1, len(text)), chunk))


def entries(model: Pieces, around: str, at: int) -> list[State]:
    """The pieces of text that end at or reach over a boundary at ``at``; (0, 0) alone where a word starts."""
    if at == 0 or at >= len(around) or around[at] == _SPACE and around[at - 1] != _SPACE:
        return [(0, 0)]
    out = []
    for i in range(max(0, at - model.longest), at):
        for j in range(at, min(len(around), i + model.longest) + 1):
            p = around[i:j]
            if (j - i == 1 or p in model.id) and model.merge(p) == [p]:
                out.append((i - at, j - at))
    return out


def paths(model: Pieces, text: str, start: int, end: int) -> tuple[list[State], list[State], dict[tuple[int, str], tuple[int, list[tuple[int, str]]]]]:
    """Of a chunk of text (which holds ``longest`` characters more on both sides where it can): entry states, exit states, and
    the nodes (end, piece) -> (entries that reach it as a bit set, the nodes before it)."""
    enter, leave = entries(model, text, start), entries(model, text, end)
    nodes: dict[tuple[int, str], tuple[int, list]] = {}
    at: dict[int, list[str]] = {}
    for k, (i, j) in enumerate(enter):
        key = (start + j, text[start + i : start + j])
        if key not in nodes:
            at.setdefault(key[0], []).append(key[1])
        nodes[key] = (nodes.get(key, (0, []))[0] | 1 << k, [])
    exits = {(end + j, text[end + i : end + j]) for i, j in leave}
    pos = start
    while pos < end:
        for u in at.get(pos, ()):
            reach = nodes[pos, u][0]
            for n in range(1, min(model.longest, len(text) - pos) + 1):
                v = text[pos : pos + n]
                if n > 1 and v not in model.id:
                    continue
                if pos + n > end and (pos + n, v) not in exits:
                    continue
                if not model.fits(u, v):
                    continue
                key = (pos + n, v)
                old = nodes.get(key)
                if old is None:
                    at.setdefault(pos + n, []).append(v)
                    nodes[key] = (reach, [(pos, u)])
                else:
                    nodes[key] = (old[0] | reach, [*old[1], (pos, u)])
        pos += 1
    return enter, leave, nodes


def transfer(model: Pieces, text: str, start: int, end: int) -> tuple[list[State], list[State], np.ndarray]:
    """The max-plus matrix of a chunk."""
    enter, leave = entries(model, text, start), entries(model, text, end)
    if enter == leave == [(0, 0)]:
        return enter, leave, np.zeros((1, 1))
    head, tail = _open_ends(text, start, end, enter, leave)
    if head < tail:  # words lie between: what enters doesn't bear on what leaves
        _, _, first = paths(model, text[: head + 1] if head < len(text) else text, start, head)
        _, _, last = paths(model, text, tail, end)
        ok_in = _reached(first, head, "", len(enter), text)
        ok_out = [bool(last.get((end + j, text[end + i : end + j]), (0,))[0]) or (i, j) == (0, 0) for i, j in leave]
        return enter, leave, np.where(np.outer(ok_in, ok_out), 0.0, _NONE)
    _, _, nodes = paths(model, text, start, end)
    m = np.full((len(enter), len(leave)), _NONE)
    for c, (i, j) in enumerate(leave):
        if (i, j) == (0, 0):
            m[_reached(nodes, end, "", len(enter), text), c] = 0.0
            continue
        bits = nodes.get((end + j, text[end + i : end + j]), (0, []))[0]
        for r in range(len(enter)):
            if bits >> r & 1:
                m[r, c] = 0.0
    return enter, leave, m


def _open_ends(text: str, start: int, end: int, enter: list[State], leave: list[State]) -> tuple[int, int]:
    """Where the first word that starts in the chunk does, and the last."""
    starts = lambda k: text[k] == _SPACE and (k == 0 or text[k - 1] != _SPACE)
    head = start
    if enter != [(0, 0)]:
        head = next((k for k in range(start, end) if starts(k)), end)
    tail = end
    if leave != [(0, 0)]:
        tail = next((k for k in range(end - 1, head - 1, -1) if starts(k)), start if enter == [(0, 0)] else head)
    return head, tail


def _reached(nodes: dict, at: int, _: str, n: int, text: str) -> np.ndarray:
    bits = 0
    for (pos, _piece), (b, _before) in nodes.items():
        if pos == at:
            bits |= b
    return np.array([bool(bits >> k & 1) for k in range(n)])


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def boundary_states(mats: list[np.ndarray]) -> list[int]:
    """The state at each boundary of the one path of weight 0, from products of all matrices up to it and all from it."""
    n = len(mats)

    def scan(ms: list[np.ndarray]) -> list[np.ndarray]:  # inclusive prefixes in a balanced tree
        if len(ms) == 1:
            return ms
        halves = scan([combine(ms[k], ms[k + 1]) if k + 1 < len(ms) else ms[k] for k in range(0, len(ms), 2)])
        return [ms[0]] + [halves[k // 2] if k % 2 else combine(halves[k // 2 - 1], ms[k]) for k in range(1, len(ms))]

    before = scan(mats)
    after = [m.T for m in scan([m.T for m in reversed(mats)])][::-1]
    out = [0]
    for k in range(1, n):
        out.append(int(np.argmax(before[k - 1][0] + after[k][:, 0])))
    return [*out, 0]


def trace(model: Pieces, text: str, start: int, end: int, enter: State, leave: State) -> list[int]:
    """The ids of the pieces that begin in [start + enter's end, end), the leaving one among them."""
    out: list[str] = []
    first = start + enter[1]
    states = entries(model, text, start)
    head, tail = _open_ends(text, start, end, states, entries(model, text, end))

    def back(a: int, b: int, key: tuple[int, str] | None, bit: int, stop: tuple[int, str]) -> list[str]:
        _, _, nodes = paths(model, text, a, b)
        if key is None:
            key = next(k for k, v in nodes.items() if k[0] == b and v[0] >> bit & 1)
        parts = []
        while key != stop:
            parts.append(key[1])
            key = next(p for p in nodes[key][1] if nodes[p][0] >> bit & 1)
        return parts[::-1]

    bit = states.index(enter)
    stop = (first, text[start + enter[0] : first])
    if leave != (0, 0):
        goal = (end + leave[1], text[end + leave[0] : end + leave[1]])
    else:
        goal = None
    if head >= tail and goal is not None:  # one word runs through
        return model.ids(back(start, end, goal, bit, stop))
    if enter != (0, 0):
        out += back(start, head, None, bit, stop)
    ids = model.ids(out) + model.words(text[head if enter != (0, 0) else start : tail])
    if goal is not None:
        ids += model.ids(back(tail, end, goal, 0, (tail, "")))
    return ids


def escaped(text: str) -> str:
    return _SPACE + text.replace(" ", _SPACE) if text else ""


def encode(model: Pieces, text: str, chunk: int = CHUNK) -> list[int]:
    """Ids of a whole text, chunk by chunk in this process."""
    s = escaped(text)
    if len(s) <= chunk:
        return model.words(s)
    bounds = [*cuts(s, chunk), len(s)]
    mats, states = [], []
    for a, b in zip(bounds, bounds[1:]):
        lo, hi = max(0, a - 2 * model.longest), min(len(s), b + 2 * model.longest)
        enter, leave, m = transfer(model, s[lo:hi], a - lo, b - lo)
        mats.append(m)
        states.append((enter, leave))
    at = boundary_states(mats)
    out = []
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        lo, hi = max(0, a - 2 * model.longest), min(len(s), b + 2 * model.longest)
        out += trace(model, s[lo:hi], a - lo, b - lo, states[k][0][at[k]], states[k][1][at[k + 1]])
    return out


def decode(model: Pieces, ids: list[int]) -> str:
    """The text of ids: bytes are joined to characters, the sign of a space becomes one, and the first one goes."""
    return b"".join([model.raw[i] for i in ids]).decode("utf-8", "replace").replace(_SPACE, " ")[1:]


def _cut(path: str, chunk: int):
    """Giant texts into rows (key, chunk, text with margins, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path)
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                s = escaped(text.as_py())
                bounds = [*cuts(s, chunk), len(s)]
                for i in range(0, len(bounds) - 1, 64):
                    rows = []
                    for k, (a, b) in enumerate(zip(bounds[i : i + 64], bounds[i + 1 : i + 65]), i):
                        lo, hi = max(0, a - 2 * model.longest), min(len(s), b + 2 * model.longest)
                        rows.append((key.as_py(), k, s[lo:hi], a - lo, b - lo))
                    types = [pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["key", "chunk", "part", "a", "b"])

    return run


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path)
        for batch in batches:
            mats, shapes = [], []
            for part, a, b in zip(batch["part"], batch["a"], batch["b"]):
                m = transfer(model, part.as_py(), a.as_py(), b.as_py())[2]
                mats.append((m == 0).astype(np.uint8).tobytes())
                shapes.append(m.shape[0])
            yield pa.RecordBatch.from_arrays([batch["key"], batch["chunk"], pa.array(mats, pa.binary()), pa.array(shapes, pa.int32())], names=["key", "chunk", "matrix", "rows"])

    return run


def _settle(table: pa.Table) -> pa.Table:
    """The boundary states of one text, from the small matrices of its chunks."""
    table = table.sort_by([("chunk", "ascending")])
    mats = [np.where(np.frombuffer(m, np.uint8).reshape(r, -1), 0.0, _NONE) for m, r in zip(table["matrix"].to_pylist(), table["rows"].to_pylist())]
    at = boundary_states(mats)
    return pa.table([table["key"], table["chunk"], pa.array(at[:-1], pa.int32()), pa.array(at[1:], pa.int32())], names=["key", "chunk", "enter", "leave"])


def _traced(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path)
        for batch in batches:
            ids = []
            for part, a, b, i, j in zip(batch["part"].to_pylist(), batch["a"].to_pylist(), batch["b"].to_pylist(), batch["enter"].to_pylist(), batch["leave"].to_pylist()):
                ids.append(np.asarray(trace(model, part, a, b, entries(model, part, a)[i], entries(model, part, b)[j]), "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch["key"], batch["chunk"], pa.array(ids, pa.binary())], names=["key", "chunk", "ids"])

    return run


_OUT = pa.schema([("key", pa.binary()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])
_KEYED = "key binary, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def _told(model: Pieces, text: str, coded: bytes) -> tuple:
    ids = np.frombuffer(coded, "<i4").tolist()
    back = decode(model, ids)
    return len(ids), zlib.crc32(coded), hashlib.sha256(back.encode()).hexdigest(), back == text.replace(_SPACE, " ")


def _report(path: str, schema: pa.Schema):
    """Rows (key or doc_id, text), or (key, text, the ids of its chunks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path)
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                rows.append(_told(model, text, model.coded(escaped(text)) if batch.num_columns == 2 else b"".join(batch.column(2)[k].as_py())))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), schema.types[1:]))], schema=schema)

    return run


def encode_table(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip of each whole text.

    ids_crc32 is of the ids as little-endian 32-bit integers. Texts of ``chunk`` characters or more are scanned in
    chunks on all executors, each different text once. Null and empty texts have no ids; repeated rows repeat; other
    columns are ignored; an empty table gives no rows.
    """
    path = path or model_path()
    small_batches(docs.sparkSession, 500)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    giant = src.filter(F.length("text") >= chunk).withColumn("key", text_key(F.col("text")))
    texts = materialize(giant.groupBy("key").agg(F.first("text").alias("text")), "giants")
    parts = materialize(texts.mapInArrow(_cut(path, chunk), "key binary, chunk int, part string, a long, b long"), "chunks")
    mats = parts.mapInArrow(_matrices(path), "key binary, chunk int, matrix binary, rows int")
    states = mats.groupBy("key").applyInArrow(_settle, "key binary, chunk int, enter int, leave int")
    traced = parts.join(states, ["key", "chunk"]).select("key", "chunk", "part", "a", "b", "enter", "leave").mapInArrow(_traced(path), "key binary, chunk int, ids binary")
    whole = traced.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"]).alias("ids"))  # of one text
    told = materialize(texts.join(whole, "key").select("key", "text", "ids").mapInArrow(_report(path, _OUT), _KEYED), "giants_told")
    long = giant.select("doc_id", "key").join(told, "key").drop("key")
    by_row = pa.schema([("doc_id", pa.int64()), *list(_OUT)[1:]])
    short = src.filter(F.length("text") < chunk).select("doc_id", "text").mapInArrow(_report(path, by_row), _KEYED.replace("key binary", "doc_id long"))
    discard(texts, parts)
    return short.unionByName(long)


def op9_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
