"""Run control, filters and texts on the boundaries that the driver's tables do not reach."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import control, extract, quality, reports, retrieval


def test_ready_guard(spark):
    runs = spark.createDataFrame([(1, "complete"), (2, "running")], "id long, status string")
    assert control.ready(runs, 1).first().id == 1
    for i in (2, 3):
        with pytest.raises(control.NotReady):
            control.ready(runs, i)


def test_leases_and_sweep_at_their_limits(spark):
    leases = spark.createDataFrame([(1, "a", 100.0), (1, "b", 40.0), (2, "a", 41.0)], "run_id long, session_id string, last_seen double")
    assert control.released(leases, 1, "a", 100.0, 60.0).first().orphaned and not control.released(leases, 2, "b", 100.0, 60.0).first().orphaned
    sessions = spark.createDataFrame([("x", 100.0, 99.0), ("y", 101.0, 99.0), ("z", 101.0, 1.0)], "id string, expires_at double, last_seen double")
    got = {tuple(r) for r in control.swept(spark.range(1, 4), leases, sessions, 100.0, 60.0, 50.0).collect()}
    assert got == {("lease", "1/b"), ("session", "x"), ("session", "z"), ("run", "3")}


def test_sessions_slide_by_written_touches(spark):
    rows = [("a", float(t)) for t in (0, 50, 70, 165, 170)] + [(None, 5.0), (None, 6.0), ("b", 1.0)]
    got = sorted((tuple(r) for r in control.sliding_sessions(spark.createDataFrame(rows, "session_id string, epoch double"), 100.0).collect()), key=repr)
    # 50 is not written, 70 is, so 165 is within 100 of it
    assert got == [("a", 1, 0.0, 165.0, 5), ("b", 1, 1.0, 1.0, 1), (None, 1, 5.0, 5.0, 2)]


def test_names(spark):
    df = spark.createDataFrame([("A/b-c.D", "ABCDEF1"), ("a/b/c", "abc"), (" x/y ", "g" * 8), (None, None)], "n string, s string")
    got = [tuple(r) for r in df.select(control.repo_key(F.col("n")), control.clean_commit(F.col("s"))).collect()]
    assert got == [("a/b-c.d", "abcdef1"), (None, None), ("x/y", None), (None, None)]


def test_filters_and_marks(spark):
    df = spark.createDataFrame([("Ab", ["x/One.py"]), (None, None)], "title string, files array<string>")
    assert reports.holding(df, " ", "title").count() == 2 and reports.holding(df, "one", "title", "files").count() == 1
    text = df.select(reports.highlighted(F.lit("a.b A.B axb"), "a.b q")).first()[0]
    assert text == "<mark>a.b</mark> <mark>A.B</mark> axb"


def test_mentions_and_duplicates(spark):
    chunks = spark.createDataFrame([(1, "p", "say one two three four five six seven, ok"), (2, "p", "xone two three"), (3, "p", "def f(a):\n  return a+1"), (4, "q", "def  f( a ):\n\n return a + 1"), (5, "q", None)], "id long, path string, text string")
    needles = spark.createDataFrame([(1, "one two three"), (2, "two three four five six seven"), (3, "one two"), (4, "e two three f")], "needle_id long, needle string")
    assert {tuple(r) for r in retrieval.mentions(chunks, needles).collect()} == {(1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (4, 1)}
    assert [(r.members, r.first, r.paths) for r in quality.duplicate_groups(chunks, 2).collect()] == [(2, 3, 2)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "path string, text string, size long")
    assert extract.django_routes(none).count() == extract.migrations(none).count() == 0
    assert reports.counted(none, "path").count() == 0 and [r.note for r in reports.layer_notes(spark.createDataFrame([], "layer string")).collect()] == ["layers by name only"]
