"""Vector codes against Lloyd's rounds by plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest

from sparkloom.llm import common, vector_codes
from sparkloom.llm.vector_codes import code_report, fitted_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(n=300, dim=32, seed=1):
    """Random vectors, a third of them one vector, with copies among the first entries, ties and bad ones."""
    rng = random.Random(seed)
    hot = [rng.gauss(0, 0.2) for _ in range(dim)]
    vec = lambda: [rng.choice([0.0, 0.125, -0.25]) if rng.random() < 0.4 else rng.gauss(0, 0.2) for _ in range(dim)]
    out = [(i, hot if i % 3 == 0 else vec(), rng.choice([0, 1, 2, None])) for i in range(n)]
    bad = [(-5, None, 1), (-4, [float("nan")] * dim, 1), (-3, [math.inf] + [0.0] * (dim - 1), 1), (-2, [None] + [0.0] * (dim - 1), 2)]
    return [*bad, *out, (7, vec(), 1), (None, vec(), None), (10**12, [9.0] * dim, 3)]


def brute(data):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], g) for i, v, g in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    d = -(-max(len(v) for _, v, _ in kept) // 16)
    parts = np.array([v + [0] * (16 * d - len(v)) for _, v, _ in kept], np.int64).reshape(-1, 16, d)
    books = parts[:64].transpose(1, 0, 2).copy()
    for step in range(3):
        far = ((parts[:, :, None] - books[None]) ** 2).sum(3)
        code = far.argmin(2)
        if step < 2:
            for p in range(16):
                for k in range(books.shape[1]):
                    mine = parts[code[:, p] == k, p]
                    if len(mine):
                        books[p, k] = mine.sum(0) // len(mine)
    error = far.min(2).sum(1)
    by = {}
    for (_, _, g), e in zip(kept, error, strict=True):
        by[g] = by.get(g, 0) + int(e)
    sha = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k in c), int(e), by[g], sha) for (i, _, g), c, e in zip(kept, code, error, strict=True)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def unique(data):
    """Rows without a repeated id, whose place among the first entries would hang on their content."""
    return list({r[0]: r for r in data}.values())


@pytest.mark.parametrize("n,dim", [(300, 32), (40, 16), (200, 128), (1, 16)])
def test_codes(spark, n, dim):
    data = unique(rows(n, dim))
    assert found(code_report(spark.createDataFrame(data, SCHEMA).repartition(5))) == brute(data)


def test_repeated_rows_and_clashing_names(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    data = unique(rows()) + rows()[-3:] + [rows()[200]] * 3
    df = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("?") for c in ("code", "error", "of", "ints", "upper", "n")})
    got = found(code_report(df))
    assert len(got) == len(data) - 4 and got == brute(data)


def test_odd_lengths_and_empty_tables(spark):
    data = [(i, [0.01 * i] * (1 + i % 20), 0) for i in range(50)] + [(60, [], 1), (61, [float(1 << 20)], 1)]
    assert found(code_report(spark.createDataFrame(data, SCHEMA))) == brute(data[:-1])  # 2 ** 20 is too large
    assert code_report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert code_report(spark.createDataFrame([(1, None, 2)], SCHEMA)).count() == 0


def test_bounds_hold_and_save_work(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-60, 60, (400, 4)), np.repeat(rng.integers(-60, 60, (1, 4)), 200, 0)])
    book = np.concatenate([x[:30], x[:2]])  # with equal entries
    code, upper, lower = vector_codes.nearest(x, book)
    compared = []
    exact = vector_codes._squares
    monkeypatch.setattr(vector_codes, "_squares", lambda a, b: compared.append(len(a)) or exact(a, b))
    for step in range(5):
        new = np.stack([x[code == k].sum(0) // max(1, (code == k).sum()) if (code == k).any() else book[k] for k in range(len(book))])
        moved, book = np.sqrt(((new - book) ** 2).sum(1)), new
        compared.clear()
        code, upper, lower = vector_codes.reassign(x, book, moved, code, upper, lower)
        far = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (code == far.argmin(1)).all()
        root = np.sqrt(far)
        assert (upper >= root[np.arange(len(x)), code]).all() and (lower <= root).all()
        assert sum(compared) - len(book) ** 2 < 0.7 * far.size
    assert sum(compared) - len(book) ** 2 < 0.3 * far.size


def test_rounds_read_what_the_one_before_wrote(spark):
    data = unique(rows())
    out, books = fitted_codes(spark.createDataFrame(data, SCHEMA), rounds=4, entries=16)
    assert books.shape == (16, 16, 2) and out.count() == len(data) - 4
    assert max(max(r["code"]) for r in out.collect()) < 16
