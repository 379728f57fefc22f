"""Searching, listing and small table questions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECONDARY = 0.7


def fold(text: str) -> str:
    """A text as searches see it: compatibility forms taken apart, marks taken off, lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M")).lower()


def _alphabets() -> tuple[dict[str, str], dict[str, str]]:
    """Letters of Latin, Greek, Cyrillic, kana and full-width forms that fold to one other character, and to several."""
    ranges = ((0xA0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0x2000, 0x2070), (0x3040, 0x3100), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))
    told = {chr(c): fold(chr(c)) for lo, hi in ranges for c in range(lo, hi)}
    return {c: f for c, f in told.items() if len(f) == 1 and f != c}, {c: f for c, f in told.items() if len(f) > 1 and c.isalpha()}


_ONE, _SEVERAL = _alphabets()


def folded(c: Column) -> Column:
    """``fold`` as a column, for the alphabets of ``_alphabets`` and any combining marks; built-in functions only."""
    c = F.translate(F.regexp_replace(c, r"\p{M}+", ""), "".join(_ONE), "".join(_ONE.values()))
    for letter, letters in _SEVERAL.items():
        c = F.replace(c, F.lit(letter), F.lit(letters))
    return F.lower(c)


def token_score(hay: Column, token: str) -> Column:
    """1 for the whole text, 0.9 at its beginning, 0.8 at the first find if it begins a word, 0.5 inside one; else 0.3 of the share of its letters in the span they lie in, 0 if they don't in order."""
    at = F.instr(hay, token)
    before = F.substring(hay, at - 1, F.lit(1))
    # the letters in order, each at its first place behind the last
    loose = re.escape(token[0]) + "".join(f"[^{re.escape(c)}]*{re.escape(c)}" for c in token[1:])
    span = F.length(F.regexp_extract(hay, loose, 0))
    fuzzy = F.when(span > 0, F.lit(0.3 * len(token)) / span).otherwise(0.0)
    word = F.when(before.rlike(r"[\p{L}\p{N}]"), 0.5).otherwise(0.8)
    return F.when(at == 1, F.when(F.length(hay) == len(token), 1.0).otherwise(0.9)).when(at > 1, word).otherwise(fuzzy)


def search(df: DataFrame, query: str, texts: list[str], order: str) -> DataFrame:
    """df with ``score``, best first, ties in source order: every token must be in one of the texts, later texts count less; an empty query finds all. Query and texts are folded alike."""
    tokens = fold(query).split()
    if not tokens:
        return df.withColumn("score", F.lit(1.0)).orderBy(order)
    each = [folded(F.coalesce(F.col(t), F.lit(""))) for t in texts]
    best = []
    for token in tokens:
        scores = [token_score(h, token) * (1.0 if k == 0 else SECONDARY) for k, h in enumerate(each)]
        best.append(F.greatest(*scores) if len(scores) > 1 else scores[0])
    total, all_hit = F.lit(0.0), F.lit(True)
    for b in best:
        total, all_hit = total + b, all_hit & (b > 0)
    return df.withColumn("score", total / len(tokens)).filter(all_hit).orderBy(F.desc("score"), order)


def snippet(text: Column, query: str) -> Column:
    """The text around the earliest term of a query: 50 characters before, 90 from it on; its head if there is none."""
    tokens = query.lower().split()
    lower, far = F.lower(text), F.lit(1 << 30)
    found = F.least(*(F.when(F.instr(lower, t) > 0, F.instr(lower, t)).otherwise(far) for t in tokens), far)
    pos, n = found - 1, F.length(text)
    start, end = F.greatest(pos - 50, F.lit(0)), F.least(pos + 90, n)
    cut = F.trim(F.substring(text, start + 1, end - start))
    part = F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(end < n, "…").otherwise(""))
    head = F.concat(F.trim(F.substring(text, 1, 120)), F.when(n > 120, "…").otherwise(""))
    return F.when(found == far, head).otherwise(part)


def visits(log: DataFrame, country: str | None = None, map_id: int | None = None, address: str | None = None, since: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """Rows of a visit log that meet all conditions given; an address is any part of it, whatever the case."""
    out = log
    if country is not None:
        out = out.filter(F.col("country") == country)
    if map_id is not None:
        out = out.filter(F.col("map_id") == map_id)
    if address is not None:
        out = out.filter(F.contains(F.lower("address"), F.lit(address.lower())))
    if since is not None:
        out = out.filter(F.col("seen_at") >= since)
    if ids is not None:
        out = out.filter(F.col("location_id").isin(ids))
    return out


def tags_in_order(tags: DataFrame, by: str) -> DataFrame:
    """Tags (name, amount, order) by name, by amount (most first) or by the order given by hand, then by name."""
    keys = {"name": [F.asc("name")], "amount": [F.desc("amount"), F.asc("name")], "manual": [F.asc_nulls_last("order"), F.asc("name")]}
    return tags.orderBy(*keys[by])


def rebased(path: Column, source: str, target: str) -> Column:
    """A folder path under source as one under target; others stay."""
    inside = (path == source) | F.startswith(path, F.lit(source + "/"))
    return F.when(inside, F.concat(F.lit(target), F.substring(path, len(source) + 1, 1 << 30))).otherwise(path)


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the first in order."""
    return df.groupBy(key).agg(F.min_by(F.struct(*(c for c in df.columns if c != key)), order).alias("r")).select(key, "r.*")
