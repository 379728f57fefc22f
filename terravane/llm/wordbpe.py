"""Byte-pair merges of many words at once, and a bounded cache of the chunks of texts.

For the word-end BPE tokenizer whose file is given: it folds case, drops white space and
splits at it and between letters and other signs before any merge.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .bytesops import slices, text_buffers
from .wordruns import lowered, runs

_SOLID = np.ones(256, bool)  # all but white space
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_LETTER = np.zeros(256, bool)  # the bytes of a-z and, in UTF-8, of U+00C0 to U+00FF without the two signs there
_LETTER[[*range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = True
_LETTER[[0x97, 0xB7]] = False
_SIGN = np.zeros(256, bool)
_SIGN[[*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_SLICE = 1 << 22
_STEM, _TAIL = 60, 8  # bytes of a word, and of the signs behind it
_NONE = np.int64(1 << 40)


def _byte_signs() -> list[str]:
    """The printable sign that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Merges:
    """All words of a call go through their merges together: each round merges each word's first pair of least rank."""

    def __init__(self, model: dict):
        vocab, signs = model["vocab"], _byte_signs()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + model["end_of_word_suffix"]] for s in signs], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a << 20 | b
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.rank[at] << 20 | at, _NONE << 20)

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit bytes."""
        raw = _folded(np.frombuffer(b"".join(words), np.uint8))
        size = np.array([len(w) for w in words])
        sym, word = self.inner[raw], np.repeat(np.arange(len(words)), size)
        final = np.cumsum(size) - 1
        sym[final] = self.last[raw[final]]
        out: list[bytes] = [b""] * len(words)
        rank = np.full(len(sym), _NONE << 20)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._ranks(sym[inside], sym[inside + 1])
        while len(sym):
            new = np.ones(len(word), bool)
            new[1:] = word[1:] != word[:-1]
            start = np.flatnonzero(new)
            index = np.cumsum(new) - 1
            best = np.minimum.reduceat(rank, start)
            done = best >= _NONE << 20
            if done.any():
                gone = done[index]
                raw_ids = sym[gone].astype("<u4").tobytes()
                count = np.diff(np.append(start, len(sym)))[done]
                ends = np.cumsum(count) * 4
                for w, a, b in zip(word[start[done]].tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
                    out[w] = raw_ids[a:b]
                stay = ~gone
                sym, word, rank, index = sym[stay], word[stay], rank[stay], index[stay]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best[index])
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
            sym[hit] = self.made[rank[hit] & ((1 << 20) - 1)]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            hit -= np.arange(len(hit))
            rank[hit] = _NONE << 20
            right = hit[hit + 1 < len(sym)]
            right = right[word[right] == word[right + 1]]
            rank[right] = self._ranks(sym[right], sym[right + 1])
            left = hit[hit > 0] - 1
            left = left[word[left] == word[left + 1]]
            rank[left] = self._ranks(sym[left], sym[left + 1])
        return out


def _folded(raw: np.ndarray) -> np.ndarray:
    """U+00C0 to U+00DE in lower case; A-Z are already."""
    raw = raw.copy()
    raw[1:][(raw[:-1] == 0xC3) & (raw[1:] <= 0x9E) & (raw[1:] >= 0x80)] += 0x20
    return raw


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where each chunk begins and the last ends, the chunks before each row and in all) of texts.

    The bytes are those without white space, A-Z lower-cased. Chunks lie between white space; signs behind a
    word of plain letters are a chunk of their own.
    """
    start, end, row = runs(raw, offsets, _SOLID)
    place = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=place[1:])
    solid = lowered(raw[_SOLID[raw]])
    edge = np.zeros(len(solid) + 1, bool)
    edge[place] = True
    letter, sign = _LETTER[solid], _SIGN[solid]
    inner = ~edge[1:-1]
    odd = ~(letter | sign)
    odd[1:] |= letter[1:] & sign[:-1] & inner
    cut = np.flatnonzero(sign[1:] & letter[:-1] & inner) + 1
    of = np.searchsorted(place, cut, "right") - 1
    before = np.zeros(len(solid) + 1, np.int32)
    np.cumsum(odd, out=before[1:])
    plain = (before[place[of]] == before[place[of + 1]]) & (cut - place[of] <= _STEM) & (place[of + 1] - cut <= _TAIL)
    edge[cut[plain]] = True
    begin = np.flatnonzero(edge)
    upto = np.searchsorted(begin, place[np.searchsorted(row, np.arange(len(offsets)))])
    return solid, begin, upto


_caches: dict[str, WordCache] = {}


class WordCache:
    """Ids of texts as little-endian 32-bit bytes; the ids of a text are those of its chunks in order."""

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        self.tok, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.tok.encode_special_tokens = True
        with open(path) as f:  # the vocabulary file of the installed package, not an input
            self.merges = Merges(json.load(f)["model"])
    @staticmethod
    def of(path: str) -> WordCache:
        """The cache of this process: Spark uses a Python worker for many tasks."""
        if path not in _caches:
            _caches[path] = WordCache(path)
        return _caches[path]

    def _encode(self, chunk: bytes) -> bytes:
        return np.asarray(self.tok.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Plain words go through the merges, the rest through the library."""
        raw = np.frombuffer(b"".join(new), np.uint8)
        size = np.array([len(c) for c in new])
        plain = np.logical_and.reduceat(_LETTER[raw], np.cumsum(size) - size) & (size <= _STEM)
        for i in range(0, len(new), 20_000):
            some = [c for c, p in zip(new[i : i + 20_000], plain[i : i + 20_000].tolist()) if p]
            if some:
                self.known.update(zip(some, self.merges(some)))
        for k in np.flatnonzero(~plain).tolist():
            self.known[new[k]] = self._encode(new[k])

    def _ids(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.known.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        if not new:
            return found
        if len(self.known) + len(new) > self.most:
            self.known = {c: v for c, v in self.known.items() if len(c) <= 8}  # short chunks are the frequent ones
            if len(self.known) + len(new) > self.most:
                self.known = {}
        self._learn(new)
        known = self.known
        return [known[w] if ids is None else ids for w, ids in zip(words, found)]

    def of_rows(self, texts: pa.Array, end: bytes = b"") -> Iterator[tuple[int, memoryview, np.ndarray]]:
        """(first row, the ids of some rows one after the other, each row's end there in bytes); end closes each row."""
        texts.validate(full=True)  # UTF-8
        raw, off = text_buffers(texts)
        for i, j in slices(off, _SLICE):
            solid, begin, upto = chunks(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            told = pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin), pa.py_buffer(solid)]).dictionary_encode()
            data, at = text_buffers(told.dictionary)
            data, at = data.tobytes(), at.tolist()
            ids = pa.array([*self._ids([data[a:b] for a, b in zip(at, at[1:])]), end], pa.large_binary())
            which = np.insert(told.indices.to_numpy(), upto[1:], len(ids) - 1)
            flat = ids.take(pa.array(which))
            _, places, joined = flat.buffers()
            ends = np.frombuffer(places, np.int64)[upto[1:] + np.arange(1, j - i + 1)]
            yield i, memoryview(joined or b""), ends

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out = []
        for _, ids, ends in self.of_rows(pa.array(texts, pa.string())):
            out += [bytes(ids[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return out
