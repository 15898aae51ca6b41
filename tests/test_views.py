"""Views of an analysis on nulls, ties and tables without rows."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import reports, views


@pytest.fixture(scope="module")
def net(spark):
    nodes = spark.createDataFrame([(i, f"f{i}", x, 10 * i) for i, x in enumerate(["ui", "ui", "util", "service", None])], "id long, path string, layer string, loc long")
    edges = spark.createDataFrame([(0, 1, "import", 1), (0, 2, "import", 2), (0, 3, "call", 5), (1, 3, "call", 5), (3, 2, "import", 9)], "source long, target long, kind string, weight long")
    return nodes, edges


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_cards(spark, net):
    symbols = spark.createDataFrame([("f0",), ("f0",), ("f3",), ("gone",)], "path string")
    got = {r["layer"]: r for r in views.layer_cards(*net, symbols, 1).collect()}
    assert set(got) == {"ui", "util", "service", None}
    assert tuple(got["ui"])[1:] == (2, 10, 2, 1, 4, 12, "call,import", "f0")
    assert tuple(got["util"])[1:] == (1, 20, 0, 2, 0, 0, "", "f2")
    none = spark.createDataFrame([], net[1].schema)
    assert views.layer_cards(net[0], none, symbols.limit(0)).count() == 4


def test_capped_view(net):
    n, e = views.capped_view(*net, most_nodes=3, most_edges=2)
    plain = lambda e: rows(e.select("source", "target", "kind", "weight"))
    assert rows(n.select("id")) == [(0,), (1,), (3,)] and plain(e) == [(0, 3, "call", 5), (1, 3, "call", 5)]
    n, e = views.capped_view(*net, layer="ui", kind="import")
    assert rows(n.select("id")) == [(0,), (1,)] and plain(e) == [(0, 1, "import", 1)]


def test_services(spark):
    routes = spark.createDataFrame([("api.py", "read", 1), ("api.py", "none", 2), (None, None, None)], "file_path string, handler string, line int")
    calls = spark.createDataFrame([("api.py", "read", 3, "run", "util.py"), ("api.py", "read", 4, "load", "svc.py"), ("api.py", "read", 2, "Thing", "svc0.py"), ("api.py", "read", 5, "more", "svc2.py"), ("api.py", "none", 9, "x", "api.py"), ("api.py", "none", 9, "y", None)], "path string, parent string, line int, name string, callee string")
    files = spark.createDataFrame([("util.py", "util"), ("svc.py", "service"), ("svc0.py", "service"), ("svc2.py", "service"), ("api.py", "route")], "path string, layer string")
    got = {r["handler"]: r["service"] for r in views.services_of(routes, calls, files).collect()}
    assert got == {"read": "svc.py", "none": None, None: None}


def test_prompts(spark):
    turns = spark.createDataFrame([(1, t, "user", "x" * t) for t in range(1, 9)] + [(2, 1, "user", None)], "conv_id long, turn int, role string, text string")
    found = spark.createDataFrame([(1, "b", 1, "12345", 0.5), (1, "a", 1, "abcde", 0.5), (1, "c", 1, "last one", 0.1), (1, "d", 1, "", 0.9), (1, "e", 1, None, 0.9), (3, "z", 1, "no turns", 0.9)], "conv_id long, path string, start_line int, text string, score double")
    got = {r["conv_id"]: r for r in views.prompts(turns, found, 8, keep=2, turn_chars=7).collect()}
    assert tuple(got[1]) == (1, 2, 2, 8, "user: xxxxxxx\nuser: xxxxxxx\n\n[1] a:1\nabcde\n\n[2] b:1\n123")
    assert tuple(got[2]) == (2, 1, 0, 0, "user: ") and set(got) == {1, 2}


def test_excerpts_with_ties_keep_their_own_texts(spark):
    same = [("p", 1, 2, "one", 0.5), ("p", 1, 2, "two", 0.5), ("a", 9, 9, "best", 0.9), ("z", 1, 1, "cut off", 0.1)]
    df = spark.createDataFrame(same, "path string, start_line int, end_line int, text string, score double")
    assert reports.prompt_excerpts(df, 3).first()[0] == "[1] a:9-9\nbest\n\n[2] p:1-2\none\n\n[3] p:1-2\ntwo"
    assert [r["n"] for r in reports.citations(df).orderBy("n").collect()] == [1, 2, 3, 4]
    assert reports.citations(df, 2).count() == 2 and reports.citations(df.limit(0)).count() == 0


def test_facets_of_endpoints(spark):
    df = spark.createDataFrame([("GET/POST", None, True, False, True), ("GET", "Flask", None, True, False)], "method string, framework string, auth boolean, is_test boolean, is_example boolean")
    got = {(r["facet"], r["value"]): r["n"] for r in views.endpoint_facets(df).collect()}
    assert got == {("method", "GET"): 2, ("method", "POST"): 1, ("framework", "unknown"): 1, ("framework", "Flask"): 1, ("total", "endpoints"): 2, ("total", "authenticated"): 1, ("total", "from_examples"): 1, ("total", "from_tests"): 1}


def test_a_prompt_holds_all_its_excerpts(spark):
    df = spark.range(3000).selectExpr("'p' AS path", "cast(id AS int) AS start_line", "cast(id AS int) AS end_line", "concat('t', id) AS text", "1.0D AS score")
    told = reports.prompt_excerpts(df).first()[0].split("\n\n")
    assert told == [f"[{i + 1}] p:{i}-{i}\nt{i}" for i in range(3000)]
