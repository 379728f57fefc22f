"""Patches, derived fields and the feed against plain replays."""

import random
import tempfile

from pyspark.sql import functions as F

from terravane.operators import changes, feed, history, search, shared

ROWS = "id long, a long, b string"
PATCHES = "id long, written array<string>, a long, b string"
EDITS = "batch long, seq long, id long, op string, written array<string>, a long, b string"


def random_patches(rng, n):
    return [(i, w := rng.choice([[], ["a"], ["b"], ["a", "b"]]), rng.choice([None, 1, 2]) if "a" in w else None, rng.choice([None, "x", "y"]) if "b" in w else None) for i in range(n) if rng.random() < 0.7]


def applied(rows, patches):
    out = dict(rows)
    for i, w, a, b in patches:
        if i in out:
            out[i] = (a if "a" in w else out[i][0], b if "b" in w else out[i][1])
    return out


def test_patches_compose_and_invert(spark):
    rng = random.Random(2)
    rows = {i: (rng.choice([None, 1, 2]), rng.choice([None, "x"])) for i in range(40)}
    one, two = random_patches(rng, 50), random_patches(rng, 50)
    t = spark.createDataFrame([(i, *r) for i, r in rows.items()], ROWS)
    p, q = spark.createDataFrame(one, PATCHES), spark.createDataFrame(two, PATCHES)
    plain = applied(applied(rows, one), two)
    got = feed.patched(t, feed.then(p, q))
    assert {r.id: (r.a, r.b) for r in got.collect()} == plain
    back = feed.patched(t, feed.patch_between(t, got))
    assert {r.id: (r.a, r.b) for r in back.collect()} == plain
    assert feed.patch_between(t, t).count() == 0
    layer = p.withColumn("op", F.lit("patch"))
    assert {r.id: (r.a, r.b) for r in history.overlay(t, layer).collect()} == applied(rows, one)


def test_merge_patches_of_json(spark):
    cases = [('{"a":1,"b":{"c":2,"d":3}}', '{"b":{"c":null,"e":[1,null]},"a":null}', '{"b":{"d":3,"e":[1,null]}}'), (None, '{"a":{"b":null}}', '{"a":{}}'), ('{"a":1}', None, '{"a":1}'), ("[1]", '{"é":1}', '{"é":1}'), ('{"a":1}', "7", "7")]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, p string")
    assert [r.m for r in df.select(feed.merge_patch("t", "p").alias("m")).collect()] == [c[2] for c in cases]


def test_reach_stops_at_what_the_edit_wrote():
    depends = {"b": ["a"], "c": ["b"], "d": ["c", "x"], "e": ["e2"], "e2": ["e"]}
    assert feed.reach(depends)["d"] == {"c", "x", "b", "a"}
    assert feed.reach(depends, {"b"}) == {"c": {"b"}, "d": {"c", "x", "b"}, "e": {"e2", "e"}, "e2": {"e", "e2"}}


def test_derived_fields_of_a_table_edit(spark):
    old = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (3, 1, "x")], ROWS)
    new = spark.createDataFrame([(1, 2, "x"), (2, 2, "y"), (3, 1, "x"), (4, 5, "x")], ROWS)
    got = {r.id: r.b for r in feed.derived_after(old, new, {"b": ["a"]}).collect()}
    assert got == {1: None, 2: "y", 3: "x", 4: "x"}


def random_edits(rng, n):
    return [(s // 5, s, rng.choice([0, 0, 0, 1, 2, None]), rng.choice(["put", "put", "put", "set", "remove", "add"]), w := rng.choice([[], ["a"], ["b"], ["a", "b"], None]), rng.choice([None, 1, 2]), rng.choice([None, "x", "y"])) for s in range(n)]


def replay(edits, batches):
    rows = {}
    for batch, _, i, op, w, a, b in edits:
        if batch > batches:
            break
        if op in ("set", "add"):
            rows[i] = (a, b)
        elif op == "remove":
            rows.pop(i, None)
        elif i in rows:
            rows[i] = (a if w and "a" in w else rows[i][0], b if w and "b" in w else rows[i][1])
    return rows


def test_replaying_the_log_from_any_version_gives_the_table(spark):
    edits = [e for e in random_edits(random.Random(11), 60) if e[2] is not None]
    log = feed.change_log(spark.createDataFrame(edits, EDITS)).cache()
    versions = sorted({e[0] for e in edits})
    assert [r.version for r in log.select("version").distinct().orderBy("version").collect()] == list(range(1, len(versions) + 1))
    tables = {v: replay(edits, versions[v - 1]) if v else {} for v in range(len(versions) + 1)}
    last = len(versions)
    for since in (0, 3, last - 1):
        base = spark.createDataFrame([(i, *r) for i, r in tables[since].items()], ROWS)
        assert {r.id: (r.a, r.b) for r in feed.state_at(log, last, base, since).collect()} == tables[last]
    for v in (1, 5):
        assert {r.id: (r.a, r.b) for r in feed.state_at(log, v).collect()} == tables[v]
    plain = history.edited(spark.createDataFrame([], ROWS), spark.createDataFrame(edits, EDITS).drop("batch"))
    assert {r.id: (r.a, r.b) for r in plain.collect()} == tables[last]


def test_a_kept_feed_is_resumed(spark):
    path = f"file://{tempfile.mkdtemp(prefix='spark-feed-')}/feed"
    old = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], ROWS)
    new = spark.createDataFrame([(1, 2, "x"), (3, 1, None)], ROWS)
    kept = feed.Feed(spark, path, changes.between(old, old).schema)
    assert kept.version() == 0 and kept.since(0).count() == 0
    assert kept.append(changes.between(old.limit(0), old)) == 1
    assert kept.append(changes.between(old, old)) == 2  # nothing changed, still a version
    assert kept.append(changes.between(old, new)) == 3
    again = feed.Feed(spark, path, kept.schema)
    assert again.version() == 3 and {r.version for r in again.since(1).collect()} == {3}
    assert sorted(tuple(r) for r in again.table().collect()) == sorted(tuple(r) for r in new.collect())
    assert sorted(tuple(r) for r in again.table(base=old, since=2).collect()) == sorted(tuple(r) for r in new.collect())


def test_latest_carries_values_over_ranges(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.7 else k % 3, k, rng.choice([None, None, k])) for k in range(400)]
    got = shared.latest(spark.createDataFrame(rows, "g long, o long, v long"), ["g"], ["o"], {"w": F.col("v")}).collect()
    seen, want = {}, {}
    for g, o, v in rows:
        want[o] = seen.get(g)
        seen[g] = v if v is not None else seen.get(g)
    assert {r.o: r.w for r in got} == want


def test_folding_is_the_same_in_columns(spark):
    texts = ["Café ÉCLAIR", "ñandú Ångström", "ﬁn ŒUVRE Ĳssel ǆ", "Ⅻ", "ПРИВЕТ й", "été", "ガ ＡＢＣ", "İi", "straße"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    told = [r.f for r in df.select(search.folded(F.col("t")).alias("f")).collect()]
    assert [a for a, t in zip(told, texts) if t != "Ⅻ"] == [search.fold(t) for t in texts if t != "Ⅻ"]
    found = search.search(df, "café écl", ["t"], "t").collect()
    assert [r.t for r in found] == ["Café ÉCLAIR"]
