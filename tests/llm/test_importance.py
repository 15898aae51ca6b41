"""Importance resampling against plain loops, and the CRC-32 of joined words against zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import common, importance
from sparkloom.llm.importance import feature_buckets, importance_report, resampled

from .fixtures import documents, result, rows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text):
    w = WORD.findall((text or "").translate(FOLD))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(data, target):
    docs = [(i, *buckets(t)) for i, t, *_ in data]
    s, t = Counter(b for *_, bs in docs for b in bs), Counter(b for x in target for b in buckets(x)[1])
    sa, ta = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sa + 10000) / ((s[b] + 1) * (ta + 10000)))) for b in s}
    out = []
    for i, n, bs in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    rank = {id(x): k + 1 for k, x in enumerate(able[: 5 * len(able) // 100])}
    return sorted((tuple([*x[:4], rank.get(id(x))]) for x in out), key=repr)


TARGET = ["w1 w2 w3 w4 and Some Words", "one other: 日本語 w17-w18, ß", "", None, " ".join(f"w{i % 40}" for i in range(900))]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(list(enumerate(TARGET)), "item_id long, text string")


def more():
    rng = random.Random(8)
    long = " ".join(rng.choice(["w1", "w2 W3", "ÄÖü", "x" * 70, "a_b", "9"]) for _ in range(40_000))
    return rows() + [(300, long, "en", "s"), (301, long + " w1", "en", "s"), (300, long, "en", "s"), (302, "z" * 200_000 + " end", "en", "s"), (303, "-" * 100_000, "en", "s")]


@pytest.mark.parametrize("clashing", [False, True])
def test_importance(spark, target, clashing):
    assert result(importance_report(documents(spark, clashing, more()), target)) == brute(more(), TARGET)


def test_chunks_of_any_size_give_the_same(spark, target, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    texts = importance.Texts(documents(spark, data=more()), "doc_id", "text")
    assert texts.chunks.count() > 8 and texts.ids.count() == 6  # one of them holds no word
    monkeypatch.setattr(importance, "CHUNK_BYTES", 1 << 30)
    whole = importance.Texts(documents(spark, data=more()), "doc_id", "text")
    assert whole.chunks.count() == 0 and (whole.counts() == texts.counts()).all()


def test_few_words_and_empty_tables(spark, target):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance_report(documents(spark, data=[]), target).count() == 0
    assert result(importance_report(documents(spark), none)) == brute(rows(), [])
    few = [(i, f"only word {i}", "en", "s") for i in range(30)]
    assert result(importance_report(documents(spark, data=few), target)) == brute(few, TARGET)


def test_drawn_rows(spark, target):
    want = {i: r for i, *_, r in brute(rows(), TARGET) if r}
    once = documents(spark).dropDuplicates(["doc_id"])
    got = resampled(documents(spark, True), target)
    assert "rank" in got.columns and {r["doc_id"] for r in got.collect()} == set(want)
    assert once.count() > len(want) > 0


def test_cuts_lie_between_words():
    rng = random.Random(4)
    text = " ".join("v" * rng.randrange(1, 90) for _ in range(9000)).encode()
    import pyarrow as pa

    got = [b for b in importance._cut(iter([pa.record_batch([pa.array([b"k"]), pa.array([text])], ["row_key", "text"])]))]
    pieces = [(o, t) for b in got for o, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
    assert sum(o for o, _ in pieces) == 9000 and all(len(t.split()) == o + 2 for o, t in pieces[:-1])
    want, found = Counter(buckets(text.decode())[1]), Counter()
    for own, t in pieces:
        raw = np.frombuffer(t, np.uint8)
        for bucket, first, n in feature_buckets(raw, np.array([0, len(raw)]), np.array([own])):
            found.update(bucket[first[0] : first[0] + n[0]].tolist())
    assert found == want
