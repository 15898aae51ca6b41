"""Line dedup against plain loops; its runs as an index that batches are added to."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common
from sparkloom.llm.line_dedup import LineRuns, line_hashes, line_report, without_common_lines

from .fixtures import documents, result, rows

BLANKS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINE = "The Same Line Stands Here"


def lined():
    """The common odd rows, cut into lines, and lines that differ in case, blanks, length or letters past ASCII."""
    out = [(i, t if t is None else t.replace(" w1", "\nw1"), a, b) for i, t, a, b in rows()]
    out += [(200 + i, f"  {LINE}\t\n\nown line of document {i}\n{LINE.upper()}\r", "en", "s") for i in range(4)]
    out += [(210 + i, "nineteen characters\nÄÖÜ twenty characters" + "\n" * i, "de", "s") for i in range(4)]
    out += [(220, f"{LINE}\n{LINE}", None, None), (221, "äöü twenty characters ", "de", None), (222, "\n\n", "en", "s")]
    out += [(230 + i, "in two documents only, and twice\n" * 2, "en", "s") for i in range(2)]
    return out + [(None, LINE, "en", "s"), (None, f"x\n{LINE}\ny", "en", "s"), out[-1], (2**40, "\n".join(f"line number {k} of a long text" for k in range(3000)) + "\n" + LINE, "en", "s")]


def brute(data):
    key = lambda x: x.strip(BLANKS).translate(FOLD)
    held = defaultdict(set)
    for i, t, *_ in data:
        for x in (t or "").split("\n"):
            held[key(x)].add(-1 if i is None else i)
    out = []
    for i, t, *_ in data:
        ls = (t or "").split("\n")
        gone = [len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != (-1 if i is None else i) for x in ls]
        kept = "\n".join(x for x, g in zip(ls, gone, strict=True) if not g)
        out.append((i, len(ls), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 7])
def test_lines(spark, batches):
    assert result(line_report(documents(spark, data=lined()), batches=batches)) == brute(lined())


def test_clashing_names_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert result(line_report(documents(spark, True, lined()), batches=2)) == brute(lined())


def test_odd_tables(spark):
    assert line_report(documents(spark, data=[])).count() == 0
    nothing = [(None, None, None, None)] * 4
    assert result(line_report(documents(spark, data=nothing))) == brute(nothing)
    same = [(i, LINE, "en", "s") for i in range(30)]
    assert result(line_report(documents(spark, data=same))) == brute(same)


def test_texts(spark):
    got = without_common_lines(documents(spark, True, lined())).select("doc_id", "text", "key")
    texts = {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in got.collect()}
    assert texts == {(i, h) for i, _, _, h in brute(lined())}
    assert got.where("text is null").count() == 2


def _held(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string")
    return df.select("doc_id", F.explode(F.array_distinct(F.array_compact(line_hashes(F.col("text"))))).alias("hash"))


def test_runs_are_compacted_and_reopened(spark):
    path = common.work_dir(spark, "runs")
    runs = LineRuns(spark, path, buckets=4, fanout=3)
    for i in range(7):
        runs.add(_held(spark, [(10 * i + k, f"{LINE}\nline of batch {i // 2} and more words") for k in range(2)]))
    assert sorted(runs.runs) == [(0, 2), (3, 5), (6, 6)]
    # known from three documents on, but each batch holds a greater id, so it is an entry of each
    again = LineRuns(spark, path)
    assert sorted(again.runs) == sorted(runs.runs) and again.buckets == 4
    assert sorted(r["last"] for r in again.decided().collect()) == [11, 31, 51, 61]
    assert sorted(r["last"] for r in again.decided(2).collect()) == [11, 31, 51, 61, 61]
    for i in (7, 8):
        again.add(_held(spark, [(10 * i, LINE)]))
    assert sorted(again.runs) == [(0, 8)]
    # a batch of smaller ids tells nothing new of a decided line
    again.add(_held(spark, [(1, LINE), (2, "an entirely new line of words")]))
    assert again.runs[9, 9].count() == 1
    new = again.unseen(_held(spark, [(99, f"{LINE}\na line that no batch has held")]))
    assert new.count() == 1


def test_left_over_folders_do_not_count(spark):
    path = common.work_dir(spark, "runs")
    runs = LineRuns(spark, path, buckets=2, fanout=2)
    runs.add(_held(spark, [(i, LINE) for i in range(3)]))
    runs.add(_held(spark, [(i, LINE) for i in range(3, 6)]))
    assert sorted(runs.runs) == [(0, 1)]
    entries = runs.runs[0, 1]
    runs._written(entries, 0, 0)  # as if a job had died before it deleted what it merged
    assert sorted(LineRuns(spark, path).runs) == [(0, 1)]
    entries.write.parquet(f"{path}/run-2-2-2")
    runs._fs.delete(runs._path(f"{path}/run-2-2-2/_SUCCESS"), False)  # as if it had died while writing
    again = LineRuns(spark, path)
    assert sorted(again.runs) == [(0, 1)]
    again.add(_held(spark, [(9, LINE)]))
    assert again.decided().first()["last"] == 9


def test_runs_are_joined_in_place(spark):
    runs = LineRuns(spark, common.work_dir(spark, "runs"), buckets=4, fanout=9)
    for i in range(3):
        runs.add(_held(spark, [(i, f"{LINE}\nline {i} that has some more words")]))
    new = runs.unseen(_held(spark, [(9, f"{LINE}\nline 9 that has some more words")]))
    assert new.count() == 1
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 3  # the batch alone is dealt out
    assert runs._merged(sorted(runs.runs)).count() == 4
