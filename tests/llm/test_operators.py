"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns of clashing names."""

import bisect
import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from terravane.llm import htmltext, mpeg, neardup, packing, pieces, pii, quality, suffixes, topk, warc, wordbpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, nid long, bucket string, outer int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "k", 1, "b", 2) for i, t in rows], DOCS)


ODD = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (None, "no id here at all, none"), (4, "é" * 3000 + " x" * 5000), (5, " \n\t "), (6, "A\x00b \x01 ✓")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


# 1 ---------------------------------------------------------------------------------------------


def test_quality_separates_and_is_whole(spark, odd, none):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "river", "stone", "walks", "slowly"]) for _ in range(30))
    bad = lambda: " ".join(rng.choice(["WIN!!", "$$$", "click###"]) for _ in range(30))
    rows = [(i, good() if i % 3 else bad()) for i in range(240)]
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(240)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs(spark, rows), labels)
    out = {r.doc_id: r for r in quality.score(docs(spark, rows), model).collect()}
    assert all(out[i].predicted == int(bool(i % 3)) for i in range(240))
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240))
    scored = quality.score(odd, model).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert quality.score(none, model).count() == 0
    assert quality.keep_good(odd, model).columns == odd.columns
    assert quality.fit(none, labels)["w"].any() == False  # noqa: E712  no text to learn from


def test_dual_coordinate_descent_minimises_the_hinge_loss():
    rng = np.random.default_rng(4)
    size = 40
    xs = [np.sort(rng.choice(size, rng.integers(3, 9), replace=False)).astype(np.int32) for _ in range(80)]
    ratio, cost = rng.normal(size=size), rng.uniform(0.2, 2, 80)
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    x = np.zeros((80, size + 1))
    for k, at in enumerate(xs):
        x[k, at] = quality.scaled(at, ratio)
    x[:, -1] = 1
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w = quality.dual_coordinate_descent(xs, ratio, y, cost, size, rounds=3000)
    plain, best = np.zeros(size + 1), np.inf  # subgradient steps
    for t in range(1, 40_001):
        plain -= (plain - (cost * y * (y * (x @ plain) < 1)) @ x) / t
        best = min(best, loss(plain))
    assert loss(w) <= best * 1.0005


def test_quality_of_ties_and_repeated_labels(spark):
    rows = [(i, "river stone" if i % 2 else "WIN!!") for i in range(60)]
    labels = [(i, i % 2, 0) for i in range(60)] + [(1, 0, 0), (0, 1, 0)]  # two ids with a tie
    model = quality.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r for r in quality.score(docs(spark, rows + rows[:3]), model).collect()}
    assert out[3].score > out[2].score and out[2].score == out[4].score


# 2 ---------------------------------------------------------------------------------------------


def test_html(spark):
    page = "<html><head><title>t</title><script>x<p>y</script></head><body><nav><a>m</a></nav><header>H</header><article><h1>A &amp; B</h1><p>one\n  two<br>three<p>four <b>five</b><div class='comments'><p>no</p></div></article><aside>s</aside><footer>f"
    assert [b[1] for b in htmltext.parse(page)[0] if not b[2]] == ["A & B", "one two three", "four five"]
    assert htmltext.parse("")[0] == [] and htmltext.parse("<<p>a<p")[0]
    rows = [(1, "http://h/1", page), (1, "http://h/1", page), (2, None, None), (None, "x", "<p>plain"), (3, "http://h/2", "<p " + "a='" * 5000)]
    out = htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS path", "2 AS host", "3 AS low"))
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in out.collect())
    assert got[1, "A & B\none two three\nfour five", 29] == 2 and got[2, "", 0] == 1 and got[None, "plain", 5] == 1 and sum(got.values()) == 5
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_removes_what_a_site_repeats(spark):
    rows = [(i, f"http://site/{i}", f"<body><div class=x{0}><p>Same words everywhere</p></div><div class=body1><p>Text number {i} of its own</p></div>") for i in range(8)]
    out = htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.text for r in out.collect()} == {f"Text number {i} of its own" for i in range(8)}


def test_html_reads_whole_class_lists_and_elements():
    kept = lambda page: [b[1] for b in htmltext.parse(page)[0] if not b[2]]
    long = " ".join(f"bg-colour-{k}" for k in range(30))
    assert kept(f"<div class='{long} sidebar text-sm'>gone</div><p>stays</p>") == ["stays"]
    for tag in ("span", "x-box", "a"):
        inner = f"<{tag}>{'word ' * 1000}</{tag}> rest <div><p>block</p></div>"
        assert kept(f"<p>before <{tag} class='{long} related'>{inner}</{tag}> behind</p><p>next</p>") == ["before behind", "next"]
    assert kept("<div><p>one <span class=share>two</p><p>three</p></div><p>four <span>five</span>") == ["one", "three", "four five"]
    assert kept("<p>one <span class=share>never closed<p>two") == ["one never closed", "two"]


def test_html_tells_deep_branches_apart():
    deep = "".join(f"<div class='level{k} {'u' * 90}'>" for k in range(8))
    page = f"<section class=alpha>{deep}a{'</div>' * 8}</section><section class=beta>{deep}b{'</div>' * 8}</section>"
    blocks, nodes = htmltext.parse(page)
    assert [b[1] for b in blocks] == ["a", "b"] and len({b[0] for b in blocks}) == 2 and len({n[0] for n in nodes}) == 18


def test_html_looks_give_way_to_what_is_there(spark):
    text = lambda *pages: [r.text for r in htmltext.main_text(spark.createDataFrame([(i, f"http://alone{i}/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")).orderBy("page_id").collect()]
    comments = "<article><p>main</p><div class=comments><article><p>comment</p></article></div></article>"
    advert = "<p>a <span class='ad'>" + "buy " * 600 + "</span> b</p>"
    got = text("<div class='post-more'><p>real story</p></div>", "<div class='login-news'><article><p>body</p></article></div><p>stray</p>", "<form><h1>t</h1><p>all in one form</p></form>", "<nav>m</nav>" + comments + "<footer>f</footer>", "<nav>only a menu</nav>", advert)
    assert got == ["real story", "body", "t\nall in one form", "main", "", "a b"]


def test_html_tree_decides_on_doubtful_names_in_articles(spark):
    odd = "<article><p>start</p><div class='social-history'><p>real story</p></div><div class='share-prices'><p>b</p></div></article>"
    page = lambda i: f"<article><p>Story {i}</p><div class='social-history'><p>Strikes of {i}</p></div><div class='share'><p>Tell your friends</p></div><div class='widget'><a href=/{i}>Topic {i}</a></div></article>"
    rows = [(i, f"http://site/{i}", page(i)) for i in range(8)] + [(100, "http://odd/1", odd)]
    out = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Story {i}\nStrikes of {i}" for i in range(8)) and out[100] == "start\nreal story\nb"


def test_html_tree_decides_inside_articles_too(spark):
    page = lambda i: f"<article><h1>Title {i}</h1><p>Story {i}</p><div class=box><p>Follow us everywhere</p></div></article><div class=more><p>Always here</p></div>"
    rows = [(i, f"http://site/{i}", page(i)) for i in range(20)] + [(100, "http://other/1", page(100))]
    out = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Title {i}\nStory {i}" for i in range(20))
    assert out[100] == "Title 100\nStory 100\nFollow us everywhere"  # one page tells nothing


def test_style_tree_matches_brute_force(spark):
    rng = random.Random(8)
    pages = [f"<div class=a><p>{rng.choice('xyz')}</p><p>{rng.choice('uv')} <a href=q>link</a></p>{'<ul><li>k</ul>' * rng.randrange(2)}</div>" for _ in range(30)]
    rows = [(i, "http://s/", p) for i, p in enumerate(pages)]
    src = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("page_id", "url", "'s' AS host", "xxhash64(html) AS digest", "html")
    got = {r.path: (r.pages, r.importance) for r in htmltext.style_tree(src.mapInArrow(htmltext._parsed, htmltext._PARSED)).collect()}
    nodes = [n for p in set(pages) for n in set(htmltext.parse(p)[1])]

    def entropy(values):
        c, m = collections.Counter(values), len(values)
        return -sum(n / m * math.log(n / m) for n in c.values()) / math.log(m) if m > 1 else 1.0

    for path in {n[0] for n in nodes}:
        mine = [n for n in nodes if n[0] == path]
        shown, told, depth = entropy([n[2] for n in mine]), entropy([n[3] for n in mine]), min(n[1] for n in mine)
        seen = shown if max(n[3] for n in mine) < 0 else (1 - 0.9**depth) * max(shown, told) + 0.9**depth * told
        assert got[path][0] == len(mine) and abs(got[path][1] - (seen * len(mine) + 1.5) / (len(mine) + 1.5)) < 1e-9
    assert len(got) == len({n[0] for n in nodes})


# 3 ---------------------------------------------------------------------------------------------


def brute_clusters(rows):
    bag = lambda t: neardup.bags(np.frombuffer((t or "").lower().encode(), np.uint8), np.array([0, len((t or "").lower().encode())]))[:2]
    bags = [bag(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or len(bags[i][0]) and neardup.weighted_jaccard(bags[i], bags[j]) >= 0.8:
                up[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for k, r in enumerate(rows):
        groups[root(k)].append(r[0])
    return sorted(min((x for x in g if x is not None), default=-1) for g in groups.values() for _ in g)


def test_near_duplicates_match_brute_force(spark, none):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows = list(ODD)
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([4, 40, 120]))]
        for copy in range(6):
            t = list(text)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((100 + base * 10 + copy, " ".join(t)))
    rows += [(900, "again " * 50), (901, "again " * 49)]
    out = neardup.clusters(docs(spark, rows)).collect()
    assert sorted(-1 if r.cluster_id is None else r.cluster_id for r in out) == brute_clusters(rows)
    assert neardup.clusters(none).count() == 0


def test_near_duplicate_recall(spark):
    """Of all pairs at 0.8 or more in a corpus of near copies, the share whose texts share a cluster."""
    rng = random.Random(11)
    rows = []
    for base in range(60):
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 200))]
        for copy in range(5):
            t = list(text)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = "changed"
            rows.append((base * 10 + copy, " ".join(t)))
    found = {r.doc_id: r.cluster_id for r in neardup.clusters(docs(spark, rows)).collect()}
    bag = {i: neardup.bags(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[:2] for i, t in rows}
    pairs = [(a, b) for k, (a, _) in enumerate(rows) for b, _ in rows[:k] if neardup.weighted_jaccard(bag[a], bag[b]) >= 0.8]
    assert len(pairs) > 100 and sum(found[a] == found[b] for a, b in pairs) / len(pairs) == 1.0


def test_bag_min_hash_is_unbiased():
    rng = np.random.default_rng(5)
    h = rng.integers(1, 1 << 60, 60).astype(np.uint64)
    wa, wb = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    row = np.zeros(60, np.int64)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    a, b = neardup.bag_min_hash(h, wa, row, 1, 4096), neardup.bag_min_hash(h, wb, row, 1, 4096)
    assert abs((a == b).mean() - want) < 0.03


# 4 ---------------------------------------------------------------------------------------------


def test_mpeg_round_trip_and_damage(spark, odd, none):
    rng = random.Random(2)
    for n in (0, 1, 63, 64, 937, 938, 5000):
        data = mpeg.padded(rng.randbytes(n))
        stream = mpeg.encode(data)
        info = mpeg.parse(stream)
        assert mpeg.decode(stream) == data and info["crc_bad"] == 0 and info["samples"] == 1152 * info["frames"] and info["table"]["bytes"] == len(stream) - info["table"]["at"] - 128
        assert all(mpeg.header(stream[o : o + 4]) for o in info["offsets"])
    broken = bytearray(stream)
    broken[info["offsets"][2] + 8] ^= 1  # in checked side information
    assert mpeg.parse(bytes(broken))["crc_bad"] == 1
    cut = stream[: info["offsets"][1]] + b"junk!" * 9 + stream[info["offsets"][1] :]
    again = mpeg.parse(cut)
    assert again["frames"] == info["frames"] and again["skipped"] == 45 and again["resyncs"] == 1
    with pytest.raises(ValueError):
        mpeg.decode(cut)
    out = mpeg.media_features(mpeg.encode_media(odd)).collect()
    assert collections.Counter(r.payload_sha256 for r in out) == collections.Counter(hashlib.sha256(mpeg.padded((t or "").encode())).hexdigest() for _, t in ODD)
    assert mpeg.media_features(mpeg.encode_media(none)).count() == 0


def test_mpeg_reads_stored_media(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    out = mpeg.op4_mpeg_audio(spark, str(tmp_path))
    files = out.inputFiles()
    assert files and all("/media/" in f for f in files)  # not the documents
    stored = spark.read.parquet(*files)
    assert collections.Counter(mpeg.decode(bytes(r.media)) for r in stored.collect()) == collections.Counter(mpeg.padded((t or "").encode()) for _, t in ODD)
    assert collections.Counter(r.media_sha256 for r in out.collect()) == collections.Counter(hashlib.sha256(r.media).hexdigest() for r in stored.collect())


# 5 ---------------------------------------------------------------------------------------------


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    out = packing.pack(odd, capacity=64).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    want = collections.Counter()
    for i, t in ODD:
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 64):
            want[i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    assert packing.pack(none).count() == 0


def test_packing_deals_equal_rows_without_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "same words here")] * 400 + [(k, f"other {k}") for k in range(50)], "doc_id long, text string").repartition(4)
    stored, keep = [], packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, name: stored.append(keep(df, name)) or stored[-1])
    out = packing.pack(docs, capacity=64).collect()
    assert stored[0].filter("doc_id IS NULL").select("salt").distinct().count() >= 8
    places = collections.defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    assert len(out) == 450
    for p in places.values():
        ends = [0]
        for offset, length in sorted(p):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 64


def test_plan_is_best_fit():
    rng = random.Random(3)
    for _ in range(20):
        histogram = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(30)}
        load, used = collections.Counter(), collections.Counter()
        for length, a, b, first, each, _ in packing.plan(histogram, 100):
            used[length] += b - a
            for k in range(b - a):
                load[first + k // each] += length
        assert used == collections.Counter(histogram) and max(load.values()) <= 100
        rooms: list[int] = []  # the same, piece by piece
        for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
            at = bisect.bisect_left(rooms, length)
            room = rooms.pop(at) if at < len(rooms) else 100
            bisect.insort(rooms, room - length)
        assert len(load) == len(rooms)


def test_word_ids_equal_the_tokenizer():
    cache = wordbpe.WordCache(packing.tokenizer_path(), most=50)
    texts = ["Été, ÉCOLE. naïve… foo!, bar., İx ß ẞ ÿ Ÿ áb 12,3 it's don't,", "", "\x01 \x01a , . .. ,,", "×÷ ×a ÆØ", "x" * 300, "a b c \x1c d", "***a!! ###", "x́ é"]
    for t, got in zip(texts, cache.many(texts)):
        assert np.frombuffer(got, "<u4").tolist() == cache.tok.encode(t, add_special_tokens=False).ids


def test_words_are_learnt_once_whatever_signs_stand_behind_them():
    cache = wordbpe.WordCache(packing.tokenizer_path())
    cache.many(["stone, Stone. (stone) STONE!! river\nriver? river"])
    assert set(cache.known) == {b"stone", b"river", b",", b".", b"(stone)", b"!!", b"?"}
    signs = ["a", "B", "é", "É", "×", "÷", "'s", "'", ",", "!", " ", "  ", "\n", "\x0b", "\x1c", "\u00a0", "3", "漢", "\u0301", "İ", "ß", "<|endoftext|>", "_", "'ll", "Þ", "\u0338", "<"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [w * n + s for w, n in (("a", 60), ("a", 61), ("é", 30), ("é", 31)) for s in ("!" * 8, "!" * 9, "")]
    for t, got in zip(texts, cache.many(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == cache.tok.encode(t, add_special_tokens=False).ids
    end = np.asarray([0], "<u4").tobytes()
    rows = [(i + k, bytes(ids[a:b])) for i, ids, ends in cache.of_rows(pa.array(["", "river", " ", ""]), end) for k, (a, b) in enumerate(zip([0, *ends], ends))]
    assert rows == [(0, end), (1, cache.known[b"river"] + end), (2, end), (3, end)]


# 6 ---------------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8))
    x[100:140] = x[50]  # ties
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(300)] + [(1000, None, 0), (1050, [1.0, None], 0), (1100, [float("nan")] * 8, 0), (None, [1.0] * 8, 0)]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int")).collect()
    v = np.floor(256 * x).astype(np.int64)
    want = []
    for q in range(0, 300, 50):
        s = v @ v[q]
        ids = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:5]
        want += [(q, k + 1, int(i), int(s[i])) for k, i in enumerate(ids)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")).count() == 1


def test_top_k_takes_every_row_and_any_finite_component(spark):
    rows = [(1, [1.0, 2.0]), (50, [3.0, 4.0]), (2, [2e12, 1.0]), (100, [1000.0, 1.0]), (100, [7.0, 1.0]), (3, [4e9, 1.0]), (4, [1e300, 0.0]), (5, [1.0, 2.0, 3.0])]
    got = collections.Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    whole = [(i, [int(math.floor(c * 256)) if abs(c) < 2**53 else int(c) * 256 for c in [*v, 0.0][:3]]) for i, v in rows]
    want = collections.Counter()
    for k, (q, x) in enumerate(whole):
        if q % 50 == 0:
            scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x, y)))), i) for j, (i, y) in enumerate(whole) if j != k]
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5]))
    assert got == want


def test_top_k_search_stops_on_proof():
    rng = np.random.default_rng(3)
    centre = rng.integers(-9, 9, (40, 32)) * 40
    x = np.concatenate([centre + rng.integers(-3, 4, centre.shape) for _ in range(25)])
    impact = np.abs(x) >> 2
    vec, dim = np.nonzero(impact)
    by = collections.defaultdict(list)
    for v, d in zip(vec, dim):
        by[-int(impact[v, d]), int(d)].append(2 * v + (x[v, d] < 0))
    segments = [(-u, d, np.array(c)) for (u, d), c in sorted(by.items())]
    stops: list[int] = []
    near = topk.possible_members(x, segments, x[:50], 6, stops)
    score = x @ x[:50].T
    for q, p in enumerate(near):
        assert set(np.flatnonzero(score[:, q] >= np.sort(score[:, q])[-6])) <= set(p.tolist()) and len(p) < len(x)
    assert len(stops) == 50 and min(stops) < len({u for u, *_ in segments})  # some need fewer than all


# 7 ---------------------------------------------------------------------------------------------


def brute_removal(rows, depth):
    seen = collections.Counter()
    data = [(t or "").encode() for _, t in rows]
    for b in data:
        seen.update(b[i : i + depth] for i in range(len(b) - depth + 1))
    out = collections.Counter()
    for (i, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for k in range(len(b) - depth + 1):
            if seen[b[k : k + depth]] > 1:
                gone[k : k + depth] = b"\1" * depth
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()] += 1
    return out


def test_suffixes_match_brute_force(spark, odd, none):
    rng = random.Random(3)
    shared = ["".join(rng.choice("abé ") for _ in range(90)) for _ in range(6)]
    rows = []
    for i in range(120):
        text = "".join(rng.choice("abcdefgé ") for _ in range(rng.randint(0, 120)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, 40)
            text += rng.choice(shared)[at : at + rng.randint(10, 80)] + rng.choice("xyz")
        rows.append((i, text))
    rows += [(None, "a" * 200), (300, "ab" * 100), (301, None), (302, ""), (303, rows[0][1]), (303, rows[0][1])]
    out = collections.Counter(tuple(r)[:5] for r in suffixes.removal(docs(spark, rows), 32).collect())
    assert out == brute_removal(rows, 32)
    assert suffixes.removal(none).count() == 0
    cleaned = suffixes.remove_repeats(docs(spark, rows), 32)
    assert cleaned.columns == odd.columns and cleaned.count() == len(rows)
    assert all(r.text is None or r.n_chars == len(r.text) for r in cleaned.collect())


def test_suffixes_tell_colliding_hashes_apart(spark):
    """Two texts whose windows have one polynomial hash modulo 2**64 for any odd base, and one anchor."""
    p = np.array([1], np.int64)
    for e in (1, 2, 4, 8, 16, 32, 32, 32, 32, 16, 16, 8):
        p = np.pad(p, (e, 0)) - np.pad(p, (0, e))
    rng = np.random.default_rng(0)
    for _ in range(1228):
        tail = rng.integers(97, 123, 200)
    a, b = (bytes([*(48 + np.maximum(s * p, 0)).tolist(), *tail.tolist()]).decode() for s in (1, -1))
    assert len(a) == 400 and a != b
    assert all(r.n_removed == 0 for r in suffixes.removal(docs(spark, [(1, a), (2, b)])).collect())
    assert [r.n_removed for r in suffixes.removal(docs(spark, [(1, a), (2, "x" + a)])).collect()] == [400, 400]


def test_suffixes_read_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    raw = "".join(rng.choice("abc") for _ in range(3000))
    text = raw + raw[700:1500] + "z"
    rows = [(1, text), (2, "q" + raw[2900:] + "r")]
    pieces_ = list(suffixes._pieces(np.array([0, 10, 10 + 3 * suffixes._SLICE]), 400))
    assert pieces_[0][:2] == (0, 1) and all(b - a <= suffixes._SLICE + 399 for *_, a, b in pieces_) and pieces_[-1][3] == 10 + 3 * suffixes._SLICE
    assert {x for *_, a, b in pieces_[1:] for x in (a, b - 399)} >= {10, 10 + suffixes._SLICE}
    assert collections.Counter(tuple(r)[:5] for r in suffixes.removal(docs(spark, rows), 64).collect()) == brute_removal(rows, 64)


def brute_passages(rows, n):
    """The bytes of each text outside of windows of n words that stand twice anywhere."""
    found = [list(re.finditer(rb"[^\t-\r ]+", (t or "").encode())) for t in rows]
    seen = collections.Counter(tuple(m.group() for m in ms[i : i + n]) for ms in found for i in range(len(ms) - n + 1))
    out = []
    for t, ms in zip(rows, found):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(ms) - n + 1):
            if seen[tuple(m.group() for m in ms[i : i + n])] > 1:
                gone[ms[i].start() : ms[i + n - 1].end()] = b"\1" * (ms[i + n - 1].end() - ms[i].start())
        out.append(bytes(c for c, g in zip(b, gone) if not g).decode())
    return out


def test_passages_of_words_match_brute_force(spark, monkeypatch):
    """Repeated passages go by their words, however few bytes they have and whatever white space is between them."""
    monkeypatch.setattr(suffixes, "_ROWS", 16)
    rng = random.Random(5)
    words = lambda k: " ".join(rng.choice(["a", "é", "of", "river", "stone", "日本"]) for _ in range(k))
    shared = [words(rng.randint(6, 30)) for _ in range(6)]
    rows = [rng.choice(["", "\n", " \t"]).join([words(rng.randint(0, 15)) + " ", rng.choice(shared), " " + words(rng.randint(0, 15))]) for _ in range(60)]
    rows += [shared[0].replace(" ", "\n  "), shared[0], None, "", " ", words(3), "x " * 40, words(200), rows[3], rows[3]]
    for n, depth in ((8, 4000), (2, 4000)):
        out = suffixes.remove_repeats(docs(spark, list(enumerate(rows))), depth, n).collect()
        assert [r.text or "" for r in sorted(out, key=lambda r: r.doc_id)] == brute_passages(rows, n)


def test_suffixes_tell_of_short_passages(spark, tmp_path):
    """54 words of under 400 bytes that repeat aren't removed, but told of, as are all repeated passages."""
    passage = " ".join(f"w{k}zz" for k in range(54))
    own = lambda a: " ".join(f"{a}{k}" for k in range(70))
    rows = [(1, f"{own('p')} {passage} {own('q')}"), (2, f"{own('r')} {passage}\n{own('s')} {passage}"), (3, own("t") + " " + passage[:240]), (4, None), (5, own("u")), (6, own("u"))]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in suffixes.op7_suffix_dedup(spark, str(tmp_path)).collect()}
    n = len(passage)
    assert {i: (r.n_passages, r.passage_bytes) for i, r in out.items()} == {1: (1, n), 2: (2, 2 * n), 3: (0, 0), 4: (0, 0), 5: (1, len(own("u"))), 6: (1, len(own("u")))}
    assert collections.Counter(tuple(r)[:5] for r in out.values()) == brute_removal(rows, 400)
    words = lambda k: " ".join(rng.choice(["a", "é", "of", "river", "日本"]) for _ in range(k))
    rng = random.Random(8)
    texts = [words(rng.randint(0, 40)) for _ in range(40)]
    texts = [*texts, None, *(f"{words(9)} {t[3:40]}\n{words(5)}" for t in texts[:9])]
    told = sorted(suffixes.removal(docs(spark, list(enumerate(texts))), 30, 7).collect(), key=lambda r: r.doc_id)
    assert [r.n_bytes - r.passage_bytes for r in told] == [len(t.encode()) for t in brute_passages(texts, 7)]
    assert collections.Counter(tuple(r)[:5] for r in told) == brute_removal(list(enumerate(texts)), 30)


def test_pipeline_gives_back_what_the_fit_took(spark, tmp_path, monkeypatch):
    import corpus_pipeline as c

    order: list[str] = []
    monkeypatch.setattr(c, "fit", lambda *a: order.append("fit") or "model")
    monkeypatch.setattr(c, "give_back", lambda: order.append("back"))
    monkeypatch.setattr(c, "keep_good", lambda docs, model: order.append(model) or docs)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert c.quality(spark, docs(spark, [(1, "a")]), str(tmp_path)).count() == 1 and order == ["fit", "back", "model"]


def test_pipeline_removes_short_passages(spark, tmp_path):
    """54 words of 300 bytes are under the 400 bytes of a window, and a repeated passage all the same."""
    import corpus_pipeline as c

    passage = " ".join(f"w{k}zz" for k in range(54))
    own = lambda a: " ".join(f"{a}{k}" for k in range(70))
    rows = [(1, f"{own('p')} {passage} {own('q')}"), (2, f"{own('r')} {passage} {own('s')}"), (3, own("t") + " " + passage[:240])]
    assert len(passage) < 330
    out = {r.doc_id: r.text for r in c.suffixes(spark, docs(spark, rows), str(tmp_path)).collect()}
    assert out == {1: f"{own('p')}  {own('q')}", 2: f"{own('r')}  {own('s')}", 3: rows[2][1]}


# 8 ---------------------------------------------------------------------------------------------


def test_warc(spark):
    long = "<p>" + "payload " * 40
    rows = [(5, "http://a/\n b%", long), (3, "http://b", long), (9, None, long), (None, "http://c", long), (7, "u", "short"), (8, "u", "short"), (10, "u", None), (3, "http://b", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first", "3 AS content")
    archives = warc.write_archives(pages, segment_bytes=200)
    assert archives.count() >= 1
    out = warc.read_archives(archives).collect()
    digest = hashlib.sha256(long.encode()).hexdigest()
    got = collections.Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    assert got[3, "http://b", len(long), digest, "response", None] == 2
    for i, u in ((5, "http://a/\n b%"), (9, None), (None, "http://c")):
        assert got[i, u, len(long), digest, "revisit", 3] == 1
    assert sum(r.record_type == "response" for r in out) == 5 and all(r.verified for r in out)
    assert {r.payload.decode() for r in out if r.payload is not None} == {long, "short", ""}
    with pytest.raises(ValueError):
        list(warc.members(archives.first().content[:-3]))
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


# 9 ---------------------------------------------------------------------------------------------


def test_pieces_equal_the_library():
    import sentencepiece

    model, library = pieces.Pieces.of(pieces.model_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(1)
    signs = ["abcdefgthein", "   ", "éü漢字😀", "\n\t", "AB12==--", "▁"]
    for chunk in (7, 20, 50):
        texts = ["".join(rng.choice(rng.choice(signs)) for _ in range(rng.randint(0, 150))) for _ in range(60)]
        texts += ["".join(rng.choice("abcdeinthr") for _ in range(300)) for _ in range(10)] + ["a" * 300 + "==" * 90 + "-" * 77]
        for t in texts:
            ids = pieces.encode(model, t, chunk)
            assert ids == library.encode(t) == model.words(pieces.escaped(t))
            assert pieces.decode(model, ids) == t.replace("▁", " ")


def test_frequent_words_stay_known():
    """The memory of words is bounded, and a word that keeps coming is taken through its lattice once; parts no piece joins are shared."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    model, asked = pieces.Pieces(pieces.model_path(), most=8), collections.Counter()
    path = model.path
    model.path = lambda w: asked.update([w]) or path(w)
    text = " ".join(f"river {a}{b}{c}" for a in "qxz" for b in "aeiou" for c in "kvw")
    assert model.words(pieces.escaped(text)) == library.encode(text)
    assert asked["▁river"] == 1 and len(model.known) <= 8 and len(model.known.older) <= 8
    assert model.words("▁river\n▁river\n\n") == library.encode("river\n river\n\n") and asked["▁river"] == 1
    assert all(w[i : i + 2] in model.joined for w in asked for i in range(len(w) - 1))


def test_pieces_table(spark, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rows = [*ODD, (50, "a" * 900 + " b" * 700 + "x==" * 300), (50, "a" * 900 + " b" * 700 + "x==" * 300)]
    out = pieces.encode_table(docs(spark, rows), chunk=500).collect()
    want = collections.Counter((i, zlib.crc32(np.asarray(library.encode(t or ""), "<u4").tobytes())) for i, t in rows)
    assert want == collections.Counter((r.doc_id, r.ids_crc32) for r in out) and all(r.round_trip for r in out)
    assert pieces.encode_table(none).count() == 0


def test_boundaries_inside_words_have_several_states():
    model = pieces.Pieces.of(pieces.model_path())
    s = pieces.escaped("the internationalisation of unbelievable characterisations " * 20)
    states = [len(pieces.entries(model, s, at)) for at in pieces.cuts(s, 97)[1:]]
    assert max(states) > 2 and sum(n > 1 for n in states) > len(states) // 2


# 10 --------------------------------------------------------------------------------------------


def brute_pii(text):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, (kind, p) in enumerate(rules.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(d) <= 19 and luhn) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_pii_base_spans_and_additions(spark, none):
    secret = [(100 + i, f"so token = \"{hashlib.sha1(bytes([i])).hexdigest()}\" and {'plainwordswithnothing'} {'x' * 20}") for i in range(30)]
    rows = [*ODD, *secret, (200, "😀 a@b.c_d@e.f.g +1 (728) 555-9388 1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.1 4111 1111-1111 1111 " + "7" * 3000), (201, "é" * 10 + "x@y.z" + "1" * 12), (201, "é" * 10 + "x@y.z" + "1" * 12)]
    out = pii.spans(docs(spark, rows)).collect()
    want = collections.Counter((i, hashlib.sha256(",".join(brute_pii(t)).encode()).hexdigest()) for i, t in rows)
    assert want == collections.Counter((r.doc_id, r.base_sha256) for r in out)
    texts = dict(rows)
    for r in out:
        names = r.spans.split(",") if r.spans else []
        assert set(brute_pii(texts[r.doc_id])) <= set(names)
        assert (r.n_email, r.n_card) == tuple(sum(x.startswith(k) for x in brute_pii(texts[r.doc_id])) for k in ("email", "card"))
        if 100 <= r.doc_id < 130 if r.doc_id is not None else False:
            assert any(x.startswith("secret:") for x in names)
    assert pii.spans(none).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(docs(spark, rows)).collect()}
    assert "[EMAIL]" in clean[201] and "@" not in clean[201] and clean[2] is None and "[SECRET]" in clean[100] and "plainwordswithnothing" in clean[100]


def test_pii_takes_a_long_secret_as_one_span(spark):
    rng = random.Random(6)
    part = {n: "".join(rng.choice("abcdefABC") + rng.choice("0123456789") for _ in range(n // 2)) for n in range(264, 1100, 2)}  # no card number inside
    size = {i: 264 if i % 2 else 300 + i * 40 for i in range(20)}
    rows = [(i, f'so token = "{part[n]}" and plain words') for i, n in size.items()] + [(99, "x" * 200_000 + " 1")]
    out = {r.doc_id: r.spans for r in pii.spans(docs(spark, rows)).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs(spark, rows)).collect()}
    for i, n in size.items():
        assert [x for x in out[i].split(",") if x.startswith("secret:")] == [f"secret:12:{12 + n}"]
        assert clean[i] == 'so token = "[SECRET]" and plain words'
    assert out[99] == "" and clean[99] == rows[-1][1]


def test_pii_is_linear_in_long_runs(spark):
    rows = [(1, "a" * 300_000 + " x@y.z"), (2, "1" * 300_000 + " 1.2.3.4"), (3, "a@b.c" + "%d@e.f" * 3)]
    began = time.monotonic()
    out = {r.doc_id: r for r in pii.spans(docs(spark, rows)).collect()}
    assert out[1].n_email == 1 and out[2].n_ip == 1 and out[3].n_email == 4 and time.monotonic() - began < 90
    assert out[3].base_sha256 == hashlib.sha256(",".join(brute_pii(rows[2][1])).encode()).hexdigest()


# pipeline --------------------------------------------------------------------------------------


def test_pipeline_run(spark, tmp_path):
    """The stages one after the other on a small corpus of odd rows and column names, against their operators one by one."""
    import corpus_pipeline as c

    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "river", "stone", "walks", "slowly", "green", "hills"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["WIN!!", "$$$", "click###"]) for _ in range(30))
    rows = [(i, good() if i % 4 else bad()) for i in range(200)]
    rows += [(300, rows[1][1]), (301, None), (None, rows[2][1]), (5, rows[5][1]), (302, good() + " mail a.b@c.example.org")]
    names = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, hits_email string, key binary"
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "h", b"k") for i, t in rows], names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs_ = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs_.columns
    for _, stage in c.STAGES[:-1]:
        docs_ = stage(spark, docs_, str(tmp_path))
        assert docs_.columns == columns
    kept = {r.doc_id: r.text for r in docs_.collect()}
    assert all(i % 4 for i in kept if i is not None and i < 200) and 300 not in kept and 302 in kept and "[EMAIL]" in kept[302]
    want = collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.pack(docs_).collect())
    assert collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in c.run(spark, str(tmp_path)).collect()) == want
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert c.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c

    passage = "a passage that repeats in two documents and is long enough to go " * 8
    rows = [(i, " ".join(f"word{(i * 37 + k * k) % 997}" for k in range(60))) for i in range(40)]
    rows += [(50, rows[0][1]), (51, rows[0][1]), (60, "x " + passage + "tail one"), (61, "other text before " + passage + "tail two"), (None, "no id"), (70, None), (71, "mail me at a.b@c.example.org now please")]
    docs_ = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = c.near_duplicates(spark, docs_, str(tmp_path))
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 50 not in ids and 51 not in ids and 61 not in ids and len(ids) == len(rows) - 3 and kept.columns == docs_.columns
    cut = {r.doc_id: r.text for r in c.suffixes(spark, docs_, str(tmp_path)).collect()}
    assert cut[60] == "xone" and cut[1] == rows[1][1]  # the space before and "tail " after are shared as well
    assert "[EMAIL]" in {r.doc_id: r.text for r in c.pii(spark, docs_, str(tmp_path)).collect()}[71]
    packed = c.packing(spark, docs_, str(tmp_path))
    assert packed.count() == len(rows)
    twice = c.near_duplicates(spark, docs_.union(docs_), str(tmp_path))
    assert sorted(map(str, (r.doc_id for r in twice.collect()))) == sorted(map(str, ids))


def test_near_duplicates_go_by_group_not_by_id(spark, tmp_path):
    import corpus_pipeline as c

    text = lambda base, end: " ".join(f"{base}{k}" for k in range(60)) + f" {end}"
    rows = [(1, text("river", "a")), (1, text("stone", "a")), (2, text("stone", "b")), (1, text("cloud", "a"))]  # one id on three unrelated texts
    rows += [(None, text("grass", e)) for e in "abc"] + [(None, text("field", "a"))]  # near copies, none with an id
    rows += [(9, text("light", "a")), (None, text("light", "b")), (None, text("light", "b"))]
    docs_ = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    out = [(r.doc_id, r.text.split("0")[0]) for r in c.near_duplicates(spark, docs_, str(tmp_path)).collect()]
    assert sorted(out, key=str) == sorted([(1, "river"), (1, "stone"), (1, "cloud"), (None, "grass"), (None, "field"), (9, "light")], key=str)
