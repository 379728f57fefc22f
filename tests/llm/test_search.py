"""Operators 11 to 13 against brute force, and on odd tables."""

import collections
import re

import duckdb
import numpy as np
import pytest

from terravane.llm import blockmax, curves, phrases, queries, wordruns

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, row long, x int, cid int, block int, place int"
DOCS = "doc_id long, text string, lang string, chunk long, number int, n long, block int, words int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6) for i, v in rows], VECTORS)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, 3, 4, 5) for i, t, lang in rows], DOCS)


# 11 --------------------------------------------------------------------------------------------


def brute_nearest(rows, k, every):
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    width = max(len(v) for _, v in use)
    x = np.array([np.pad(v, (0, width - len(v))) for _, v in use])
    out = []
    for at, (i, _) in enumerate(use):
        if i % every == 0:
            s = (x * x[at]).sum(1)
            best = sorted((-s[j], use[j][0]) for j in range(len(use)) if j != at)[:k]
            out += [(i, r + 1, j, -v) for r, (v, j) in enumerate(best)]
    return sorted(out)


def test_hilbert_keys_visit_neighbours():
    """Cells that follow each other on the curve are neighbours in space, and every cell has its own place."""
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = curves.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_nearest_of_a_small_table_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=6).round(2).tolist()) for i in range(150)]
    rows += [(20, rows[20][1]), (7, rows[20][1]), (400, [1.0, 0.0]), (401, None), (402, [0.0, -0.0]), (403, [float("nan")]), (404, [float("inf"), 1.0]), (405, [None, 1.0]), (None, [1.0])]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)]  # many copies, all of one score
    got = sorted(tuple(r) for r in curves.nearest(vectors(spark, rows), 5, 20).collect())
    want = brute_nearest(rows, 5, 20)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-14)


def test_nearest_of_few_none_and_giant(spark):
    assert curves.nearest(vectors(spark, [])).count() == 0
    assert curves.nearest(vectors(spark, [(1, [1.0]), (2, [2.0])])).count() == 0  # no query
    assert curves.nearest(vectors(spark, [(20, [1.0])])).count() == 0  # no other row
    assert [tuple(r) for r in curves.nearest(vectors(spark, [(20, [1.0]), (3, [2.0])])).collect()] == [(20, 1, 3, 2.0)]
    huge = curves.nearest(vectors(spark, [(0, [1e308, 1e308]), (1, [1e308, 1e308]), (2, [1e308, -1e308]), (3, [-1e308, 0.0])])).collect()
    assert [(r.vec_id, r.score) for r in huge if r.query_id == 0] == [(1, np.inf), (2, -np.inf), (3, -np.inf)]


@pytest.mark.parametrize("norms", [False, True])
def test_recall_of_windows(spark, norms):
    """Clustered vectors, with norms of their own or none: windows hold what brute force finds."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 24))[rng.integers(0, 30, 4000)] + 0.4 * rng.normal(size=(4000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms:
        x *= rng.uniform(0.5, 2, (4000, 1))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = {(r.query_id, r.vec_id) for r in curves.nearest(vectors(spark, rows)).collect()}
    want = {r[:1] + r[2:3] for r in brute_nearest(rows, 20, 20)}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_recall_on_the_given_vectors(spark):
    got = curves.op11_hilbert_windows(spark, "/root/testdata/sf0.1").toPandas()
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    want = brute_nearest([(r.vec_id, r.embedding) for r in table], 20, 20)
    both = set(zip(got.query_id, got.vec_id)) & {(r[0], r[2]) for r in want}
    assert len(got) == len(want) and len(both) >= 0.9 * len(want)


# 12 --------------------------------------------------------------------------------------------


def brute_phrases(rows, least=10, share=50, top=2000):
    f, n, out = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    inside = {(lang, sub) for (lang, p), a in found.items() if len(p) == 3 for sub in (p[:2], p[1:]) if 100 * a >= share * f[lang, sub]}
    for (lang, p), a in found.items():
        if (lang, p) not in inside:
            score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, r in out.items() for i, (s, a, p, left, right) in enumerate(sorted(r)[:top]))


def test_phrases_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    some = ["New", "york", "CITY", "é", "É", "日本", "a\x00b", "x" * 70, "in", "the", " ", "\x1c", "it's"]
    text = lambda n: "".join(rng.choice(some) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "!?"]) for _ in range(n))
    rows = [(i, text(rng.integers(1, 60)), rng.choice(["en", "de", None, "und"])) for i in range(150)]
    rows = [(i, t, None if lang is None else str(lang)) for i, t, lang in rows] + [(1, None, "en"), (2, "", "fr"), (None, "new york city " * 3000, "en"), (3, ".,;  \t", "x")] + [(9, "same words here", "en")] * 40
    got = sorted(tuple(r) for r in phrases.collocations(docs(spark, rows)).collect())
    assert got == brute_phrases(rows) and len(got) > 10
    few = sorted(tuple(r) for r in phrases.collocations(docs(spark, rows), 3, 80, 7).collect())
    assert few == brute_phrases(rows, 3, 80, 7)


def test_phrases_over_several_chunks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_RANGE", 500)
    rows = [(i, "to be or not to be " * (i % 7) + "that is the question " * (i % 5), "en") for i in range(300)]
    got = sorted(tuple(r) for r in phrases.collocations(docs(spark, rows).repartition(7)).collect())
    assert got == brute_phrases(rows)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(docs(spark, [])).count() == 0
    assert phrases.collocations(docs(spark, [(1, None, None), (2, "", "en"), (3, "one two", "en")])).count() == 0


def test_scores_of_phrases_pass_64_bits(spark):
    of = lambda a, left, right: spark.range(1).selectExpr(phrases._worst(f"{a}L", f"{left}L", f"{right}L") + " AS s").first().s
    a = 123_456_789_012_345
    for left, right in ((a, a + 7), (a * 3, a * 5), (a, a)):
        assert of(a, left, right) == 1000000 * a * a // (left * right)


def test_radix_order_and_runs():
    rng = np.random.default_rng(2)
    ids = rng.choice(np.array([0, 1, 65535, 65536, 1 << 31, (1 << 32) - 1], np.uint32), (500, 3))
    keys, n = phrases.run_lengths(ids, np.ones(500, np.int64))
    assert dict(zip(map(tuple, keys.tolist()), n.tolist())) == collections.Counter(map(tuple, ids.tolist()))
    assert [tuple(k) for k in keys.tolist()] == sorted(set(map(tuple, ids.tolist())))


# 13 --------------------------------------------------------------------------------------------

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_rank(texts, items, k):
    terms = lambda t: _TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, collections.Counter(terms(t))) for i, t, _ in texts if terms(t)]
    count, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * count) // total
            s = sum(int(np.floor(1000 * np.log((2 * count + 2) / (2 * df[t] + 1)))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            scored += [(-s, i is None, i or 0, i)] if s else []
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return out


def ordered(rows):
    return sorted(rows, key=str)


def test_rank_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    some = np.array(["River", "stone", "é", "É", "x1", "日本", "walks", "slowly", "a\x00b", "the"])
    text = lambda n: "".join(w + s for w, s in zip(rng.choice(some, n, p=np.arange(1, 11) / 55), rng.choice([" ", "-", ".", "\n"], n)))
    rows = [(int(i), text(rng.integers(0, 40)), "en") for i in range(200)] + [(None, "river stone", None), (3, None, "en"), (4, "", "en"), (5, "river " * 5000, "en")] + [(77, "stone walks", "en")] * 9
    items = [(0, "river stone stone"), (1, None), (2, "nothing known"), (3, "É x1 日本"), (None, "the"), (4, "walks"), (4, "walks"), (5, text(60))]
    table = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], "item_id long, text string, row int, word int, item int")
    got = [tuple(r) for r in blockmax.rank(docs(spark, rows), table, 7, block=5).collect()]
    assert ordered(got) == ordered(brute_rank(rows, items, 7))


def test_bounds_rule_blocks_out(spark):
    """Blocks of one topic each: those of other topics are passed over, and the result is whole."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{t}x{rng.integers(0, 30)}" for _ in range(20)) + " common" * (i % 2), "en") for i, t in enumerate(np.repeat(np.arange(20), 128))]
    items = [(t, f"common w{t}x1 w{t}x2 w{t}x3") for t in range(20)]
    skipped = spark.sparkContext.accumulator(0)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in blockmax.rank(docs(spark, rows).coalesce(1), table, 10, skipped).collect()]
    assert ordered(got) == ordered(brute_rank(rows, items, 10))
    assert skipped.value > 20 * 19 * 0.8


def test_rank_in_several_batches_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(blockmax, "_ITEMS", 3)
    rows = [(i, f"w{i % 7} w{i % 3}", "en") for i in range(50)]
    items = [(i, f"w{i}") for i in range(8)]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert ordered(tuple(r) for r in blockmax.rank(docs(spark, rows), table, 4).collect()) == ordered(brute_rank(rows, items, 4))
    assert blockmax.rank(docs(spark, []), table).count() == 0
    assert blockmax.rank(docs(spark, [(1, None, None), (2, "..", None)]), table).count() == 0
    assert blockmax.rank(docs(spark, rows), table.limit(0)).count() == 0


def test_index_is_built_and_read_by_few_blocks(spark, monkeypatch):
    """Blocks are wide rows: however many a task has, a batch and a row group hold few."""
    import pyarrow.parquet as pq

    sizes = spark.sparkContext.accumulator(0)
    whole = blockmax._finish

    def watched(count, total):
        run = whole(count, total)

        def counted(batches):
            def each():
                for b in batches:
                    sizes.add(int(b.num_rows > 16))
                    yield b

            yield from run(each())

        return counted

    monkeypatch.setattr(blockmax, "_finish", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    index, count, total = blockmax.build_index(docs(spark, [(i, f"river w{i}", "en") for i in range(100)]).coalesce(1), 1)
    assert (count, total, index.count(), sizes.value) == (100, 200, 100, 0)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    assert max(m.row_group(g).num_rows for m in groups for g in range(m.num_row_groups)) <= 16
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == min(1000, int(before))


def test_large_weights_stay_whole():
    """Sums beyond what doubles hold are taken in integers."""
    import pyarrow as pa

    asked = blockmax.Asked(pa.array(["a b"]))
    asked.weight = np.array([1 << 40, (1 << 40) + 1])
    at = asked.seen([b"a", b"b"])
    got = asked.scores(np.array([0]), at, np.array([0, 0]), np.array([0, 1]), np.array([999_999, 999_999]), 1)
    assert got.tolist() == [[999_999 * ((1 << 41) + 1)]]


def test_runs_do_not_cross_rows():
    raw = np.frombuffer(b"abc de  f", np.uint8)
    solid = np.ones(256, bool)
    solid[32] = False
    start, end, row = wordruns.runs(raw, np.array([0, 2, 2, 5, 9]), solid)
    assert [(raw[a:b].tobytes(), r) for a, b, r in zip(start, end, row)] == [(b"ab", 0), (b"c", 2), (b"d", 2), (b"e", 3), (b"f", 3)]


@pytest.mark.parametrize("name", ["op12_phrase_collocations", "op13_block_max"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cursor = con.execute(queries.oracle_sql()[name])
    assert df.columns == [c[0] for c in cursor.description]
    assert sorted(tuple(r) for r in df.collect()) == sorted(cursor.fetchall())
