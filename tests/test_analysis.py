"""A whole analysis of the small tree."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import store
from sparkloom.plans.analysis import Analysis

from .test_code import TREE


@pytest.fixture(scope="module")
def analysis(spark):
    return Analysis(spark.createDataFrame([(p, t, len(t), "ignored folder" if p.startswith("node_modules") else None) for p, t in TREE.items() if t], "path string, text string, size long, reason string"))


def test_reports(analysis):
    assert {(r.source, r.target) for r in analysis.edges.collect()} >= {("app/main.py", "app/api/users.py"), ("app/api/users.py", "app/services/user.py"), ("tests/test_user.py", "app/services/user.py")}
    api = analysis.apis().collect()
    assert [(r.method, r.path, r.handler, r.auth) for r in api] == [("GET", "/v1/users/{id}", "read", True)]
    model = analysis.database().collect()
    assert [(r.model, r.table, r.related, r.resolved, r.queries) for r in model] == [("User", "people", "Team", False, 1)]
    o = analysis.overview().first()
    assert (o.routes, o.models, o.errors, o.skipped, o.test_files) == (1, 1, 1, 1, 1)
    assert {r.package for r in analysis.packages().collect()} == {"fastapi", "express"}
    assert analysis.cycles().count() == 0
    kinds = {(r.kind, r.path) for r in analysis.issues().collect()}
    assert ("missing_tests", "app/services/user.py") in kinds or ("missing_tests", "app/api/users.py") in kinds
    assert 0 <= analysis.health().first().score <= 100
    assert {r.path for r in analysis.search("load_user").collect()} >= {"app/services/user.py", "tests/test_user.py"}
    assert [r.caller for r in analysis.references("fetch").collect()] == ["load_user"]


def test_impact(analysis):
    got = analysis.impact("services/user.py")
    assert {(r.path, r.distance) for r in got["dependents"].collect()} >= {("app/api/users.py", 1), ("tests/test_user.py", 1), ("app/main.py", 2)}
    assert [(r.path, r.reason) for r in got["tests"].collect()] == [("tests/test_user.py", "imports the file")]
    assert [r.endpoint for r in got["endpoints"].collect()] == ["GET /v1/users/{id}"]


def test_far_dependents_are_whole(spark, monkeypatch):
    from sparkloom.plans import report_queries as q

    near, far = range(10, 1510), range(5000, 5005)  # 1,500 files one step from the root 1, the tests two steps
    e = spark.createDataFrame([(i, 1) for i in near] + [(i, 10) for i in far], "source long, target long")
    root = spark.createDataFrame([(1,)], "id long")
    monkeypatch.setattr(q, "_root", lambda s, d: root)
    monkeypatch.setattr(q, "edges", lambda s, d: e)
    monkeypatch.setattr(q, "nodes", lambda s, d: spark.createDataFrame([(i, 5) for i in far], "id long, loc int"))
    monkeypatch.setattr(q, "table", lambda s, d, name: spark.createDataFrame([(f"e{i}", i) for i in far], "s_name string, s_suppkey long"))
    assert {r.id for r in q.related_tests(spark, "").collect()} == set(far)
    assert {r.id for r in q.affected_endpoints(spark, "").collect()} == set(far)


def test_exports(analysis):
    assert "| GET | /v1/users/{id} | app/api/users.py |" in analysis.docs().first().markdown
    whole = json.loads(analysis.bundle().first().bundle)
    assert whole["apis"][0]["path"] == "/v1/users/{id}" and {"files", "edges", "apis"} == set(whole)


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = lambda run, n: spark.createDataFrame([(run, i) for i in range(n)], "analysis_id string, k int")
    store.replace_run(rows("a", 3).union(rows("b", 2)), path)
    store.replace_run(rows("a", 1), path)
    assert sorted(map(tuple, spark.read.parquet(path).groupBy("analysis_id").count().collect())) == [("a", 1), ("b", 2)]
    store.delete_run(spark, [path], "b")
    assert spark.read.parquet(path).select("analysis_id").distinct().count() == 1
    s = spark.createDataFrame([("SELECT * FROM a JOIN b.c ON 1", "select", ["a", "b.c"]), ("insert into T values (1)", "insert", ["t"]), ("create table x", "ddl", []), ("???", "raw", [])], "q string, k string, t array<string>")
    assert s.where((store.sql_kind(F.col("q")) != F.col("k")) | (store.sql_tables(F.col("q")) != F.col("t"))).count() == 0
    old = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, at int, v string")
    assert sorted(map(tuple, store.latest(old, ["k"], "at").collect())) == [(1, 2, "b"), (2, 1, "c")]
    assert sorted(map(tuple, store.first_of_key(old, ["k"], ["at"]).collect())) == [(1, 1, "a"), (2, 1, "c")]
