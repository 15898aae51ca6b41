"""The pipeline against a brute-force version of its stages."""

import random
import re
from collections import Counter

import corpus_pipeline

from .fixtures import documents, words
from .test_operators import TEXTS, WORD, classes, confirmed, labelled, targets

PATTERNS = (("card", r"[0-9](?:[\x20-]?[0-9])+"), ("ip", r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"), ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"))


def corpus(rng):
    items = [(i, " ".join(rng.choice(TEXTS["en"].split()) + str(rng.randrange(10)) for _ in range(25))) for i in range(3)]
    data = labelled(5, 90)
    for i in range(0, 30, 3):
        data.append((200 + i, f"{data[i][1]} mail me a.b@c{i}.org or call +1 (743) 555-{1000 + i}, card 4111 1111 1111 1111, host 10.0.0.{i} today", "en", "en.example.en"))
    for i in range(12):  # copies, near copies
        w = data[40][1].split() * 6
        w[0] = f"start{i % 4}"
        data.append((300 + i, " ".join(w), data[40][2], data[40][3]))
    data += [(400 + i, f"{data[50 + i][1]} {items[i][1]} {data[60 + i][1]}", "en", "en.example.en") for i in range(3)]
    data += [(500, None, "en", "x"), (501, " \n ", None, None), (502, "123 456", "en", "x"), (503, "the word that was for on are", None, None)]
    return data, items


def test_pipeline(spark, tmp_path):
    data, items = corpus(random.Random(8))
    docs = documents(spark, data=data)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert got.columns == [*docs.columns, "repeats"]
    rows = {r.doc_id: r for r in got.collect()}

    left = [x for x in data if x[1] and re.search(r"[^\W\d_]", x[1])]
    root, least, _ = classes(left)
    left = [x for x, r in zip(left, root) if x[0] == least[r]]
    left = [x for x in left if not any(t in x[1] for _, t in items)]
    sizes, texts = Counter(), {}
    for i, t, _, s in left:
        for kind, p in PATTERNS:
            t = re.sub(p, lambda m, kind=kind: f"<{kind.upper()}>" if confirmed(kind, m[0]) else m[0], t)
        texts[i] = t
        sizes[s] += len(WORD.findall(t))
    assert set(rows) <= set(texts)
    taken = Counter()
    for i, r in rows.items():
        assert r.text == texts[i] and r.n_chars == len(r.text) and r.repeats in (1, 2)
        taken[r.source] += r.repeats * len(WORD.findall(r.text))
    for s, want in targets(sizes).items():
        assert abs(taken[s] - want) <= max(0.05 * want, max(len(WORD.findall(texts[i])) for i, _, _, x in left if x == s) / 2)


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark"):
        (documents(spark, True, []) if name == "documents" else spark.createDataFrame([], "item_id long, text string")).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
    docs = documents(spark, True, labelled(3, 20) + [(None, None, None, None)] * 2 + [(1, " ".join(words(random.Random(1), 9)), None, None)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        (tmp_path / name).mkdir()
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/{name}/benchmark.parquet")
        assert stage(spark, docs, f"file://{tmp_path}/{name}").columns == docs.columns
