"""Operator 10: personal data by weak supervision, in DataFrame functions only.

Base spans follow fixed rules. Further spans (credentials, numbers that look like phones
or identity numbers) come from wide candidates on which labelers vote: shapes (regular
expressions), word lists (gazetteer) and what stands around (context). Expectation
maximisation on the counts of vote patterns estimates how reliable each labeler is; its
posteriors, as soft labels, train a naive Bayes classifier of span features, which
decides. The driver sees only counts by pattern (3 to the number of labelers at most)
and by feature value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import materialize, named, text_of

# The base rules; quantifiers that can't give anything back are possessive, so long runs need no stack. A match that fails
# from the first character of a run fails from the others too, so it is tried there (or behind the last match) only.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{12,}+",  # a whole run, however long
    "local_phone": r"\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[.-][0-9]{4}",
    "identity": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
KINDS = [*BASE, *WIDE]
# Fixed word lists.
SECRET_WORDS = ["password", "passwd", "pwd", "token", "secret", "key", "apikey", "api_key", "auth", "bearer", "credential", "access_key", "private_key"]
NUMBER_WORDS = ["phone", "tel", "telephone", "call", "mobile", "fax", "cell", "ssn", "social", "security", "id", "passport", "number"]
_NEED = {"email": "@", "phone": "+"}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n + F.lit(1) - i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, twice(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(bare(p)) == 0, True).when(F.length(bare(p)) <= 3, bare(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _gate(kind: str, text: Column, numeric: Column) -> Column:
    if kind in _NEED:
        return F.contains(text, F.lit(_NEED[kind]))
    return numeric


def _split(df: DataFrame, text: str, gates: dict[str, Column]) -> DataFrame:
    """df with hits_* and gaps_* of each kind: its matches, and the text between them. Columns of their own, so that no lambda evaluates a pattern again."""
    none = F.array().cast("array<string>")
    out = df
    for k, gate in gates.items():
        pattern = (BASE | WIDE)[k]
        out = out.withColumns({f"hits_{k}": F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), f"gaps_{k}": F.when(gate, F.split(text, pattern, -1)).otherwise(none)})
    return out


def matches(kind: str) -> Column:
    """Array of (gap, before, match, after) of a kind's matches: gap is the length of the text since the last one."""
    gaps = F.col(f"gaps_{kind}")
    one = lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.right(F.get(gaps, i), F.lit(40)).alias("before"), m.alias("match"), F.left(F.get(gaps, i + 1), F.lit(8)).alias("after"))
    return F.transform(f"hits_{kind}", one)


def _word_before(before: Column) -> Column:
    return F.lower(F.regexp_extract(before, r"([A-Za-z_]+)[^A-Za-z0-9]*$", 1))


def votes(kind: Column, before: Column, m: Column, after: Column) -> list[Column]:
    """1 for personal data, -1 against, 0 abstaining; one column a labeler."""
    digits = F.length(_digits(m))
    letters = F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    word = _word_before(before)
    secret = kind == "secret"
    mixed = (digits >= 3) & (letters >= 3)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    return [
        vote(secret & mixed & (F.length(m) >= 16), secret & ((digits == 0) | (letters == 0))),  # shape: long and mixed
        vote(secret & m.rlike("^[0-9a-fA-F]{16,}$") & mixed, secret & m.rlike("^[A-Za-z]+$")),  # shape: hexadecimal
        vote(F.when(secret, word.isin(SECRET_WORDS)).otherwise(word.isin(NUMBER_WORDS)), F.lit(False)),  # gazetteer
        vote(secret & before.rlike(r"[=:]\s*[\"']?$"), secret & ~before.rlike(r"[=:]\s*[\"']?$")),  # context: assigned
        vote(before.rlike(r"[\"']$") & after.rlike(r"^[\"']"), before.rlike("[A-Za-z0-9/@.]$") | after.rlike("^[A-Za-z0-9/@]")),  # context: quoted, or part of a longer run
        vote(~secret & before.rlike(r"(^|[\s(:;,])$") & after.rlike(r"^([\s).,;]|$)"), ~secret & before.rlike(r"[0-9+().-]\s?$")),  # context: stands alone
    ]


N_VOTES = 6


def features(kind: Column, before: Column, m: Column, after: Column) -> list[Column]:
    """Small integers that describe a span."""
    n = F.length(m)
    digits = F.length(_digits(m))
    upper = F.length(F.regexp_replace(m, "[^A-Z]", ""))
    last, first = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    sort = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[A-Za-z]"), 2).when(c.rlike("[0-9]"), 3).when(c.isin("'", '"'), 4).when(c.isin("=", ":"), 5).otherwise(6)
    word = _word_before(before)
    return [
        F.when(kind == "secret", 0).when(kind == "local_phone", 1).otherwise(2),
        F.least(F.floor(n / 4), F.lit(15)).cast("int"),
        F.floor(digits * 8 / n).cast("int"),
        F.floor(upper * 4 / n).cast("int"),
        sort(last),
        sort(first),
        F.when(word.isin(SECRET_WORDS), 1).when(word.isin(NUMBER_WORDS), 2).otherwise(0),
        m.rlike("[_+/-]").cast("int"),
    ]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern by expectation maximisation (labelers independent given the class)."""
    if not patterns:
        return {}
    post = {p: min(0.95, max(0.05, 0.5 + 0.15 * sum(p))) for p, _ in patterns}
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        good = sum(n * post[p] for p, n in patterns)
        prior = min(1 - 1e-4, max(1e-4, good / total))
        table = []
        for k in range(len(patterns[0][0])):
            rates = {}
            for c in (1, 0):
                share = lambda p: post[p] if c else 1 - post[p]  # noqa: B023, E731
                counts = {v: 0.5 + sum(n * share(p) for p, n in patterns if p[k] == v) for v in (-1, 0, 1)}
                whole = sum(counts.values())
                rates[c] = {v: x / whole for v, x in counts.items()}
            table.append(rates)
        for p in post:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[k][1][v] / table[k][0][v]) for k, v in enumerate(p))
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def _code(values: list[Column], base: int, shift: int = 0) -> Column:
    out = F.lit(0)
    for v in values:
        out = out * base + (v + shift)
    return out.cast("int")


def train(candidates: DataFrame) -> dict[int, float]:
    """Log-odds by 100 * feature + value (-1: the prior) of the span classifier, from candidates (kind, before, match, after)."""
    kind, before, m, after = (F.col(c) for c in ("kind", "before", "match", "after"))
    named = candidates.select(_code(votes(kind, before, m, after), 3, 1).alias("pattern"), *(f.alias(f"f{k}") for k, f in enumerate(features(kind, before, m, after))))
    named = materialize(named, "votes")
    counted = [(r["pattern"], r["n"]) for r in named.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()]
    unpack = lambda code: tuple(code // 3 ** (N_VOTES - 1 - k) % 3 - 1 for k in range(N_VOTES))
    post = estimate(sorted((unpack(c), n) for c, n in counted))
    if not post:
        return {-1: -30.0}
    soft = F.element_at(F.create_map(*(F.lit(x) for c, _ in counted for x in (c, float(post[unpack(c)])))), F.col("pattern"))
    n = len([c for c in named.columns if c != "pattern"])
    values = named.withColumn("p", soft).select("p", F.explode(F.array(*(F.col(f"f{k}") + 100 * k for k in range(n)))).alias("value"))
    sums = {r["value"]: (r["good"], r["n"] - r["good"]) for r in values.groupBy("value").agg(F.sum("p").alias("good"), F.count(F.lit(1)).alias("n")).collect()}
    good, bad = (sum(v[c] for k, v in sums.items() if k < 100) for c in (0, 1))
    weights = {-1: math.log((good + 1) / (bad + 1))}
    for k, (g, b) in sums.items():
        weights[k] = math.log((g + 0.5) / (good + 1)) - math.log((b + 0.5) / (bad + 1))
    return weights


def accepts(weights: dict[int, float], kind: Column, before: Column, m: Column, after: Column) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))))
    total = F.lit(weights[-1])
    for k, f in enumerate(features(kind, before, m, after)):
        total = total + F.coalesce(F.try_element_at(table, (f + 100 * k).cast("int")), F.lit(0.0))
    return total > 0


_TEXT, _REST = "terravane_text", "terravane_rest"


def found(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, one array of matches a kind) of each row, as a table; uid numbers the rows."""
    text = text_of()
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    src = src.withColumn("numeric", F.col("text").rlike("[0-9]"))
    src = _split(src, "text", {k: _gate(k, F.col("text"), F.col("numeric")) for k in KINDS})
    return materialize(src.select(F.monotonically_increasing_id().alias("uid"), "doc_id", *(matches(k).alias(k) for k in KINDS)), "matches")


def _candidates(table: DataFrame) -> DataFrame:
    """(uid, doc_id, kind, at, start, end, before, match, after): the matches of every kind with their places."""
    some = table.filter(F.greatest(*(F.size(k) for k in KINDS)) > 0)

    def of(kind: str) -> Column:
        return F.transform(kind, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x["gap"].alias("gap"), x["before"].alias("before"), x["match"].alias("match"), x["after"].alias("after")))

    each = F.concat(*map(of, KINDS))
    rows = some.select("uid", F.explode(each).alias("m")).select("uid", "m.*").withColumn("size", F.length("match"))
    upto = W.partitionBy("uid", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)  # the matches of one document
    rows = rows.withColumn("end", (F.sum("gap").over(upto) + F.sum("size").over(upto)).cast("long"))
    return rows.withColumn("start", F.col("end") - F.col("size")).drop("gap", "size")


def _is_base() -> Column:
    out = F.lit(False)
    for k in BASE:
        out = F.when(F.col("kind") == k, passes(k, F.col("match"))).otherwise(out)
    return out


def _wide_only(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("kind").isin(*WIDE))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row, from its whole text.

    Counts and base_sha256 are of the base spans; spans has those the classifier adds as well, unless a base span of
    the same document overlaps them. Null texts are empty and have none; repeated rows repeat; other columns are
    ignored; an empty table gives no rows.
    """
    table = found(docs)
    rows = materialize(_candidates(table), "candidates")
    weights = train(_wide_only(rows))
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    judged = rows.withColumn("base", _is_base()).withColumn("more", F.when(F.col("kind").isin(*WIDE), accepts(weights, F.col("kind"), F.col("before"), F.col("match"), F.col("after"))).otherwise(False))
    judged = judged.filter(F.col("base") | F.col("more"))
    name = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    by = judged.withColumn("k", order).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "k", name.alias("name"), "end", "base"))).alias("s"))
    base = F.filter("s", lambda x: x["base"])
    added = F.filter("s", lambda x: ~x["base"] & ~F.exists(F.col("bases"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    by = by.withColumn("bases", base).withColumn("all", F.sort_array(F.concat("bases", added)))
    by = by.select("uid", F.transform("bases", lambda x: x["name"]).alias("b"), F.transform("all", lambda x: x["name"]).alias("a"))
    out = table.select("uid", "doc_id").join(by, "uid", "left")
    count = lambda k: F.coalesce(F.size(F.filter("b", lambda x: F.startswith(x, F.lit(k + ":")))), F.lit(0)).cast("long").alias(f"n_{k}")
    empty = F.array().cast("array<string>")
    joined = lambda c: F.array_join(F.coalesce(c, empty), ",")
    return out.select("doc_id", *(F.when(F.col("b").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(f"n_{k}") for k in BASE), F.sha2(joined(F.col("b")).cast("binary"), 256).alias("base_sha256"), joined(F.col("a")).alias("spans"))


def _redacted(kind: str, judge) -> Column:
    gaps = F.col(f"gaps_{kind}")
    put = lambda m, i: F.concat(F.when(judge(F.right(F.get(gaps, i), F.lit(40)), m, F.left(F.get(gaps, i + 1), F.lit(8))), F.lit(f"[{kind.upper()}]")).otherwise(m), F.get(gaps, i + 1))
    return F.when(F.size(f"hits_{kind}") > 0, F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(f"hits_{kind}", put), ""))).otherwise(F.col(_TEXT))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets, kind after kind, and n_chars, if there, counted anew.

    Kinds are judged one after the other, each on the text that the earlier ones leave, so that overlapping spans go
    once; that is where it differs from ``spans``. A null text stays null, an empty one empty; very long texts are
    whole; repeated rows repeat; other columns, whatever their names, are handed on; an empty table stays empty.
    """
    weights = train(_wide_only(_candidates(found(docs))))
    columns = [c for c in docs.columns if c != "text"]
    out = docs.select(F.struct(*(named(c) for c in columns)).alias(_REST) if columns else F.lit(0).alias(_REST), F.col("text").cast("string").alias(_TEXT))
    for kind in KINDS:
        text = F.col(_TEXT)
        out = _split(out, _TEXT, {kind: F.coalesce(_gate(kind, text, text.rlike("[0-9]")), F.lit(False))})
        judge = (lambda b, m, a, k=kind: passes(k, m)) if kind in BASE else (lambda b, m, a, k=kind: accepts(weights, F.lit(k), b, m, a))
        out = out.select(_REST, _redacted(kind, judge).alias(_TEXT))
    out = out.select(*(F.col(_REST).getField(c).alias(c) for c in columns), F.col(_TEXT).alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(named(c) for c in docs.columns))


def op10_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
