"""The postings index, the vector store, running sums and joins of spans against plain loops."""

import random
import uuid
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import intervals, ordered, postings, retrieval, vectors
from sparkloom.plans.storage import shared_folder

CHUNK = "id long, path string, text string"


def folder(spark):
    return f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    some = ["token", "tokens", "TOKENizer", "my_token9", "9token", "with", "the", "thing", "things", "a2", "x", "42", "42abc", "été", "İstanbul", "pa-th", "_id"]
    rows = [(i * 7 % 6001 if i % 5 else i * 7 % 6001, f"src/{i % 9}/token.py" if i % 3 else None, " ".join(rng.choice(some) for _ in range(rng.randrange(40)))) for i in range(1500)]
    rows += [(7000, "p", None), (7001, None, None), (7002, "p", ""), (7003, "long", "token " * 5000)]
    return spark.createDataFrame(rows, CHUNK)


@pytest.fixture(scope="module")
def index(spark, texts):
    path = folder(spark)
    postings.build(texts.unionByName(spark.createDataFrame([(None, "p", "token")], CHUNK)), path)
    return postings.Index(spark, path)


QUERIES = ["token with the thing", "tokenizer 42", "nothing here", "a2 x", "", "my_token9 9token _id stanbul", "the", "token"]


@pytest.mark.parametrize("query", QUERIES)
def test_search_gives_the_rows_of_a_scan(texts, index, query):
    rows = lambda df: [tuple(r) for r in df.orderBy(F.desc("score"), "id").collect()]
    for n in (5, 60):
        assert rows(index.search(query, n)) == rows(retrieval.lexical_search(texts, query, n))
    assert rows(index.search_per_path(query, 20, 2)) == rows(retrieval.lexical_search(texts, query, 20, per_path=2))
    assert rows(index.scores(query)) == rows(retrieval.lexical_search(texts, query, 10**6))


def test_search_stops_early_and_reads_no_texts(index):
    found = index.search("token", 3)
    assert 0 < index.blocks_read < index.blocks_known
    assert "text" not in found.columns and "text" not in index.postings.columns


def test_many_words_are_joined(texts, index, monkeypatch):
    monkeypatch.setattr(postings, "LISTED", 1)
    assert index.search("token with", 9).collect() == retrieval.lexical_search(texts, "token with", 9).collect()


def test_index_of_nothing(spark):
    path = folder(spark)
    postings.build(spark.createDataFrame([], CHUNK), path)
    assert postings.Index(spark, path).search("token").count() == 0


VEC = "id long, embedding array<float>, label int"


def vecs(n, seed=1, dim=8):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, 1), 1) or 0.1 for _ in range(dim)], rng.choice([1, 2, None])) for i in range(n)]


def plain_nearest(rows, queries, k, scoped):
    unit = lambda v: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    out = set()
    for q, v, g in queries:
        if scoped and g is None:
            continue
        s = sorted((-int(np.floor(unit(np.float32(v)) @ unit(np.float32(x)) * 10000 + 0.5)), i) for i, x, h in rows if not scoped or h == g)
        out |= {(q, i, -c / 10000, p + 1) for p, (c, i) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("scoped", [False, True])
@pytest.mark.parametrize("wave", [32 << 20, 600])
def test_nearest(spark, monkeypatch, scoped, wave):
    monkeypatch.setattr(vectors, "WAVE_BYTES", wave)
    rows = vecs(400) + [(1000 + i, vecs(400)[3][1], 1) for i in range(30)]  # ties
    queries = rows[::40] + [(5000, [1.0] * 8, 9)]
    df, q = spark.createDataFrame(rows, VEC).repartition(5), spark.createDataFrame(queries, VEC)
    got = vectors.nearest(df, q, 7, "label" if scoped else None)
    assert {tuple(r) for r in got.collect()} == plain_nearest(rows, queries, 7, scoped)


def test_nearest_of_few_and_none(spark):
    rows = spark.createDataFrame(vecs(3), VEC)
    assert vectors.nearest(rows, rows, 5).count() == 9
    assert vectors.nearest(rows.limit(0), rows, 5).count() == 0 and vectors.nearest(rows, rows.limit(0), 5).count() == 0


def test_store_writes_only_what_changed(spark):
    store = vectors.VectorStore(spark, folder(spark), 8)
    rows = vecs(50)
    bad = [(60, None, 1), (61, [1.0] * 7, 1), (62, [float("nan")] * 8, 1), (63, [0.0] * 8, 1), (None, [1.0] * 8, 1), (64, [None] + [1.0] * 7, 1), (3, [2.0] * 8, 1)]
    make = lambda r: spark.createDataFrame(r, VEC)
    assert store.build(make(rows + bad)) == {"version": 1, "written": 50, "live": 50, "removed": 0, "rejected": 7}
    assert sorted(r["reason"] for r in store.rejects().collect()) == ["dimension", "missing", "no id", "not finite", "not finite", "repeated id", "zero"]
    clean = store.read().collect()
    again = store.build(store.read())
    assert again == {"version": 2, "written": 0, "live": 50, "removed": 0, "rejected": 0}
    files = len(store.versions._names(f"{store.versions.path}/data"))
    assert store.build(store.read()) == again and len(store.versions._names(f"{store.versions.path}/data")) == files
    changed = [(r["id"], [9.0] * 8 if r["id"] == 5 else r["embedding"], r["label"]) for r in clean if r["id"] != 7] + [(99, [1.0] * 8, 2)]
    assert store.build(make(changed)) == {"version": 3, "written": 2, "live": 50, "removed": 1, "rejected": 0}
    got = {r["id"]: r["embedding"] for r in store.read().collect()}
    assert set(got) == {i for i, *_ in changed} and got[5] == [9.0] * 8
    store.versions.sweep()
    assert {r["id"] for r in store.read().collect()} == set(got)


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50), i, rng.choice([None, 1, 5, -2])) for i in range(2000)]
    got = ordered.running(spark.createDataFrame(rows, "a int, b int, v int").repartition(7), [F.col("a"), F.col("b").desc()], F.col("v"), "before").collect()
    want, at = {}, 0
    for a, b, v in sorted(rows, key=lambda r: (r[0], -r[1])):
        want[a, b] = at
        at += v or 0
    assert {(r["a"], r["b"]): r["before"] for r in got} == want
    assert ordered.ranked(spark.createDataFrame([], "a int"), [F.col("a")], "at").count() == 0


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_sliding_distinct(spark, groups):
    rng = random.Random(4)
    rows = [(i, rng.choice("xy") if i % 9 else None, rng.choice([1, 1, 1, 2, 3, 4, None]), rng.randrange(300) if i % 50 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, g string, k int, t int")
    got = {r["i"]: r["distinct"] for r in ordered.sliding_distinct(df, "k", "t", 20, groups).collect()}
    for i, g, k, t in rows:
        if k is None or t is None:
            assert got[i] is None
        else:
            assert got[i] == len({x for _, h, x, u in rows if x is not None and u is not None and t - 20 < u <= t and (not groups or h == g)}), i


def test_sketches_are_near(spark):
    rows = [(t, random.Random(t).randrange(20_000)) for t in range(30_000)]
    df = spark.createDataFrame(rows, "t long, k long")
    exact = defaultdict(set)
    for t, k in rows:
        for c in range(-(-t // 1000), -(-t // 1000) + 10):
            exact[c * 1000].add(k)
    got = {r["upto"]: r["distinct"] for r in ordered.sliding_sketch(df, "k", "t", 10_000, 1000).collect()}
    assert set(got) == set(exact) and max(abs(got[c] - len(s)) / len(s) for c, s in exact.items()) < 0.06


@pytest.mark.parametrize("by", [[], ["u"]])
def test_spans(spark, by):
    rng = random.Random(5)
    span = lambda: (lambda s, n: (s, s + n))(rng.randrange(-300, 3000), rng.choice([0, 1, 1, 2, 3, 7, 64, 65, 900, 4000]))
    one = [(i, rng.randrange(4), *span()) for i in range(250)] + [(900, None, 5, 9), (901, 1, None, 9), (902, 1, 9, 5)]
    two = [(i, rng.randrange(4), *span()) for i in range(250)] + [(900, None, 5, 9), (901, 1, 9, None)]
    a = spark.createDataFrame(one, "i int, u int, s long, e long")
    b = spark.createDataFrame(two, "j int, u int, x long, y long") if by else spark.createDataFrame(two, "j int, w int, x long, y long")
    out = intervals.overlapping(a, b, ("s", "e", "x", "y"), by)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = [(r["i"], r["j"]) for r in out.collect()]
    ok = lambda p, q: None not in (*p[2:], *q[2:]) and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and q[2] < p[3]
    want = {(p[0], q[0]) for p in one for q in two if ok(p, q) and (not by or p[1] == q[1] is not None)}
    assert len(got) == len(set(got)) and set(got) == want


def test_spans_of_nothing_and_clashing_names(spark):
    a = spark.createDataFrame([(1, 0, 5)], "i int, s long, e long")
    b = spark.createDataFrame([], "j int, x long, y long")
    assert intervals.overlapping(a, b, ("s", "e", "x", "y")).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        intervals.overlapping(a, a, ("s", "e", "s", "e"))


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_open_spans(spark, groups):
    rng = random.Random(9)
    rows = [(i, rng.choice(["x", "y", None]), rng.randrange(50), None if i % 40 == 7 else rng.randrange(60)) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, g string, s long, e long")
    got = {r["i"]: r["n"] for r in ordered.open_spans(df, "s", "e", "n", groups).collect()}
    whole = [r for r in rows if r[3] is not None and r[2] < r[3]]
    want = {i: sum(a <= s < b and (not groups or h == g) for _, h, a, b in whole) if (i, g, s, e) in whole else None for i, g, s, e in rows}
    assert got == want


def test_files_shown(spark):
    import base64

    from sparkloom.operators.store import files_shown

    text = lambda rows: spark.createDataFrame(rows, "path string, text string")
    asked = spark.createDataFrame([(x,) for x in "abcdef"], "path string")
    remote = spark.createDataFrame([("c", base64.b64encode("ßßß".encode()).decode()), ("a", "eA=="), ("f", "!!")], "path string, base64 string")
    got = {r["path"]: tuple(r)[1:] for r in files_shown(asked, text([("a", "one"), ("d", "")]), text([("a", "two"), ("b", "ééé")]), remote, 5).collect()}
    assert got == {"a": ("stored", "one", False), "b": ("checkout", "éé", True), "c": ("remote", "ßß", True), "d": ("stored", "", False), "e": ("none", "", True), "f": ("none", "", True)}
