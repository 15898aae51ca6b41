"""Extraction and resolution on a small tree; graph operators against plain searches."""

import random
import tarfile
from collections import defaultdict

import pytest

from sparkloom.functions import paths, text
from sparkloom.operators import endpoints, extract, graph, resolve, retrieval, workflow
from sparkloom.sources import corpus

TREE = {
    "app/main.py": "from fastapi import FastAPI\nfrom app.api import users\n\napp = FastAPI()\napp.include_router(users.router, prefix='/v1')\n",
    "app/__init__.py": "",
    "app/api/__init__.py": "x = 1\n",
    "app/api/users.py": (
        "from fastapi import APIRouter, Depends\nfrom ..services.user import load_user\nfrom app.models import User\n\nrouter = APIRouter(prefix='/users')\n\n\n"
        "@router.get('/{id}')\nasync def read(id: int, me=Depends(get_current_user)):\n    if id and me:\n        return load_user(id)\n    return [x for x in range(3) if x]\n"
    ),
    "app/services/__init__.py": "y = 2\n",
    "app/services/user.py": "from app.models import User\n\n\ndef load_user(id):\n    return fetch(id)\n\n\ndef fetch(id):\n    return session.query(User)\n",
    "app/models.py": "class User(Base):\n    __tablename__ = 'people'\n    id = Column(Integer)\n    team = relationship('Team')\n\n\nLIMIT = 3\n",
    "tests/test_user.py": "from app.services.user import load_user\n\n\ndef test_load_user():\n    load_user(1)\n",
    "bad.py": "def broken(:\n",
    "web/app/(shop)/items/[id]/page.tsx": "import { a } from '@/lib/api'\nimport x from '../../helper'\nexport const Page = async () => a\n",
    "web/app/(shop)/helper.ts": "export function helper() {}\n",
    "web/src/lib/api.ts": "const express = require('express')\napp.get('/items', list)\n",
    "web/tsconfig.json": '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"],}, },\n}',
    "requirements.txt": "# all\nfastapi==0.1\nuvicorn[standard]>=2 ; python_version > '3'\n-r other.txt\nplain\n",
    "pyproject.toml": "[project]\ndependencies = ['httpx>=0.2', 'rich']\n[tool.poetry.dependencies]\npython = '^3'\nattrs = '^1'\n",
    "package.json": '{"name": "w", "dependencies": {"react": "^18"}, "devDependencies": {"vite": "5"}}',
    "go.mod": "module example.com/m\n\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n",
    "node_modules/x/index.js": "ignored\n",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for p, t in TREE.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    (root / "logo.png").write_bytes(b"\x89PNG\x00\x01")
    (root / "data.dat").write_bytes(bytes(range(256)) * 8)
    with tarfile.open(root.parent / "tree.tar.gz", "w:gz") as tar:
        tar.add(root / "app", "app")
    return corpus.read_tree(spark, str(root)).cache()


@pytest.fixture(scope="module")
def records(files):
    return extract.python_records(files).cache()


def test_tree(files):
    got = {r.path: r.reason for r in files.collect()}
    assert got["node_modules/x/index.js"] == "ignored folder" and got["logo.png"] == "binary suffix" and got["data.dat"] == "binary content"
    assert got["app/__init__.py"] == "empty" and got["app/main.py"] is None
    assert files.where("path = 'app/main.py'").first().text == TREE["app/main.py"]


def test_tarball(spark, files, tmp_path_factory):
    path = str(tmp_path_factory.getbasetemp() / "tree.tar.gz")
    got = next(p for p in tmp_path_factory.getbasetemp().rglob("tree.tar.gz"))
    rows = {r.path: (r.text, r.reason) for r in corpus.read_tarballs(spark, str(got)).collect()}
    assert rows["app/models.py"] == (TREE["app/models.py"], None) and rows["app/__init__.py"] == (None, "empty"), path
    few = {r.path: r.reason for r in corpus.read_tarballs(spark, str(got), max_entries=3).collect()}
    assert list(few.values()).count("over count") == 1 and len(few) <= 4
    tight = corpus.read_tarballs(spark, str(got), max_total=120).collect()
    assert len(tight) == len(rows) and sum(r.size for r in tight if r.reason is None) <= 120 and any(r.reason == "over budget" for r in tight)


def test_tree_beyond_its_limits(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.py").write_text("x = 1\n" * (i + 1))
    (tmp_path / "none.py").write_text("")
    rows = {r.path: (r.reason, r.text is not None) for r in corpus.read_tree(spark, str(tmp_path), max_files=3).collect()}
    assert rows == {f"{i}.py": (None, True) for i in range(3)} | {f"{i}.py": ("over count", False) for i in range(3, 6)} | {"none.py": ("empty", False)}
    rows = {r.path: r.reason for r in corpus.read_tree(spark, str(tmp_path), max_total=6 + 12 + 17).collect()}
    assert rows == {"0.py": None, "1.py": None, **{f"{i}.py": "over budget" for i in range(2, 6)}, "none.py": "empty"}


def test_short_needles_are_found(spark):
    from sparkloom.operators.retrieval import mentions

    texts = [(1, "say foo bar, xhellox and more"), (2, "hello"), (3, None), (4, ""), (5, "foo  bar"), (6, "one two three four five six seven eight"), (7, "é日本語é")]
    needles = [(1, "foo bar"), (2, "hello"), (3, ""), (4, None), (5, "two three four five six seven e"), (6, "hello"), (7, "日本"), (8, " "), (9, "x"), (10, "two three four five six seven x")]
    got = mentions(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(needles, "needle_id long, needle string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((n, i) for n, x in needles if x for i, t in texts if t and x in t)

def test_python_records(records):
    by = defaultdict(list)
    for r in records.collect():
        by[r.path, r.record].append(r)
    read = next(r for r in by["app/api/users.py", "symbol"] if r.name == "read")
    assert read.complexity == 1 + 3 and read.names == ["id", "me"] and read.exported  # if, and, comprehension
    route = by["app/api/users.py", "route"][0]
    assert (route.kind, route.name, route.parent, route.auth, route.target) == ("GET", "/{id}", "read", True, "router")
    assert by["app/api/users.py", "router"][0].target == "/users"
    assert by["app/main.py", "mount"][0].target == "/v1"
    model = by["app/models.py", "model"][0]
    assert (model.target, model.names, model.detail) == ("people", ["id", "team"], "Team")
    query = by["app/services/user.py", "query"][0]
    assert (query.kind, query.name) == ("select", "User")
    assert [r.name for r in by["bad.py", "error"]] == ["SyntaxError"] and len(by["bad.py", "symbol"]) == 0


def test_other_languages(files):
    got = {(r.path, r.record, r.name) for r in extract.pattern_records(files).collect()}
    assert ("web/src/lib/api.ts", "route", "/items") in got and ("web/src/lib/api.ts", "import", "express") in got
    assert ("web/app/(shop)/items/[id]/page.tsx", "symbol", "Page") in got


def test_manifests(files):
    got = {(r.manifest, r.name, r.version) for r in corpus.dependencies(files).collect()}
    assert got == {
        ("requirements.txt", "fastapi", "==0.1"), ("requirements.txt", "uvicorn", ">=2"), ("requirements.txt", "plain", None), ("pyproject.toml", "httpx", ">=0.2"), ("pyproject.toml", "rich", None),
        ("pyproject.toml", "attrs", "^1"), ("package.json", "react", "^18"), ("package.json", "vite", "5"), ("go.mod", "github.com/a/b", "v1.2.3"),
    }


def test_imports_and_calls(spark, files, records):
    imports = resolve.resolved_imports(records.where("record = 'import'"), files).cache()
    got = {(r.path, r.name): r.resolved for r in imports.collect()}
    assert got["app/api/users.py", "services.user"] == "app/services/user.py"
    assert got["app/main.py", "app.api"] == "app/api/users.py" and got["app/api/users.py", "app.models"] == "app/models.py"
    assert got["app/main.py", "fastapi"] is None
    edges = {(r.source, r.target) for r in resolve.import_edges(imports).collect()}
    assert ("tests/test_user.py", "app/services/user.py") in edges
    calls = resolve.resolved_calls(records.where("record = 'call'"), records.where("record = 'symbol'"), imports).cache()
    callee = {(r.path, r.target): r.callee for r in calls.collect()}
    assert callee["app/api/users.py", "load_user"] == "app/services/user.py" and callee["app/services/user.py", "fetch"] == "app/services/user.py"
    steps = resolve.workflows(records.where("record = 'route'"), calls, files.select("path", paths.layer(files.path).alias("layer"))).collect()
    assert [(r.step, r.file, r.name, r.layer) for r in sorted(steps, key=lambda r: r.step)][:3] == [(1, "app/api/users.py", "read", "route"), (2, "app/services/user.py", "load_user", "service"), (3, "app/services/user.py", "fetch", "service")]
    js = resolve.resolved_js(extract.pattern_records(files).where("record = 'import'"), files, corpus.aliases(files))
    found = {r.name: r.resolved for r in js.collect()}
    assert found["@/lib/api"] == "web/src/lib/api.ts" and found["../../helper"] == "web/app/(shop)/helper.ts" and found["express"] is None


def test_resolve_target(spark):
    f = spark.createDataFrame([("a/b/users.py",), ("c/users.py",), ("x/only_here.py",)], "path string")
    one = lambda q: [tuple(r) for r in resolve.resolve_target(f, q).collect()]
    assert one("c/users.py") == [("c/users.py", 1)] and one("b/users.py") == [("a/b/users.py", 2)] and one("ONLY") == [("x/only_here.py", 4)] and one("py") == []


def test_paths(spark):
    cases = {
        "src/api/routes/users.py": "route", "app/main.py": "entrypoint", "app/crud.py": "repository", "docs/a.md": "docs", "tests/api/x.py": "test", "x/y.test.ts": "test", "pkg/thing.py": "other",
        "lib/ui/button.tsx": "ui", "index.js": "entrypoint", "core/auth/x.py": "middleware", "services/api/store.py": "repository",
    }
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    assert {r.path: r.l for r in df.select("path", paths.layer(df.path).alias("l")).collect()} == cases
    repo = spark.createDataFrame([("owner/name",), ("https://host.com/owner/name.git",), ("git@host.com:owner/name.git",), ("https://host.com/owner/name/tree/dev/x",), ("nothing",)], "a string")
    assert [r[0] for r in repo.select(paths.repo_of(repo.a)).collect()] == ["owner/name"] * 4 + [None]
    route = spark.createDataFrame([("web/app/(shop)/items/[id]/page.tsx",), ("pages/index.tsx",), ("pages/a/[...rest].ts",), ("lib/x.ts",)], "p string")
    assert [r[0] for r in route.select(paths.app_route(route.p)).collect()] == ["/items/:id", "/", "/a/*rest", None]


def test_router_prefixes(spark):
    routers = spark.createDataFrame([("app", ""), ("v1", "/v1"), ("users", "/users/"), ("a", "a"), ("b", "b"), ("lone", "/x")], "router string, own string")
    mounts = spark.createDataFrame([("v1", "app", "/api"), ("users", "v1", ""), ("users", "app", "/u"), ("a", "b", ""), ("b", "a", "")], "child string, parent string, prefix string")
    got = dict(map(tuple, endpoints.router_prefixes(routers, mounts).collect()))
    assert got["users"] == "/api/v1/users" and got["v1"] == "/api/v1" and got["app"] == "" and got["lone"] == "/x"
    assert got["a"] == "/b/a" and got["b"] == "/a/b"


def test_lexical_score(spark):
    df = spark.createDataFrame([("token token token token token token token",), ("The the",), ("nothing",), ("",)], "t string")
    s = [r[0] for r in df.select(text.lexical_score("the Token", df.t)).collect()]
    assert s == [pytest.approx(0.5 + 0.25), 0.5, 0.0, 0.0]
    assert df.select(text.lexical_score("!", df.t)).first()[0] == 0.0


def components(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in out[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    r = {a: reach(a) for a in {x for e in edges for x in e}}
    return {a: min(b for b in r[a] if a in r[b]) for a in r if any(b != a and a in r[b] for b in r[a])}


@pytest.mark.parametrize("limit", [0, 10**6])
def test_strong_components(spark, limit):
    rng = random.Random(1)
    pairs = list({(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(55)) if a != b}) + [(100, 101), (101, 100), (102, 103)]
    df = spark.createDataFrame([(a, b, "import", 1) for a, b in pairs], "source long, target long, kind string, weight long")
    assert dict(map(tuple, graph.strong_components(df, limit).collect())) == components(pairs)
    assert graph.strong_components(df.limit(0), limit).count() == 0


def test_missing_tests(spark):
    s = spark.createDataFrame([("a.py", "loadUser", 5), ("a.py", "save_all", 9), ("b.py", "orphan", 7)], "path string, name string, loc int")
    t = spark.createDataFrame([("user",), ("saveall",)], "name string")
    assert [r.name for r in resolve.missing_tests(s, t).collect()] == ["orphan"]


def walked(start, calls, layer, base):
    """A plain breadth-first trace: names of the steps behind a handler, and whether it was cut."""
    todo, seen, steps, d = [(start, 1)], {start}, [], 0
    while todo:
        (at, d), todo = todo[0], todo[1:]
        if d > workflow.MAX_DEPTH or base + len(steps) >= workflow.MAX_STEPS:
            return steps, True
        for to in calls.get(at, ()):
            if to not in seen:
                if len(seen) >= workflow.MAX_VISITED:
                    return steps, True
                seen.add(to)
                if layer[to[0]] != "test":
                    steps.append(to)
                    todo.append((to, d + 1))
    return steps, False


@pytest.mark.parametrize("fan", [1, 3, 30])
def test_traces_against_a_plain_search(spark, fan):
    rng = random.Random(fan)
    names = [(f"f{i % 9}.py", f"s{i}") for i in range(120)]
    layer = {f"f{i}.py": "test" if i in (2, 7) else "service" for i in range(9)}
    calls = {a: [names[rng.randrange(120)] for _ in range(rng.randrange(1, fan + 1))] for a in names}
    rows = [(a[0], f"K.{a[1]}", b[1], f"x.{b[1]}", k, b[0]) for a, bs in calls.items() for k, b in enumerate(bs)]
    routes = [("GET", f"/{i}", *names[i], i, "Flask" if i % 2 else None, i % 3 == 0) for i in range(25)] + [("PUT", "/lost", "f0.py", "nowhere", 1, None, None)]
    steps, reports = workflow.traced(
        spark.createDataFrame(routes, "method string, path string, file_path string, handler string, line int, framework string, auth boolean"),
        spark.createDataFrame(rows, "path string, parent string, name string, target string, line int, callee string"),
        spark.createDataFrame([(*n, 1) for n in names], "path string, name string, line int"),
        spark.createDataFrame([], "path string, parent string, line int, orm string, table string"),
        spark.createDataFrame(list(layer.items()), "path string, layer string"),
    )
    got = defaultdict(list)
    for r in sorted(steps.collect(), key=lambda r: (r.workflow, r.step)):
        got[r.workflow.split()[1]].append((r.file, r.label))
    cut = {r.trigger.split()[1]: (r.truncated, r.confidence, r.n_steps) for r in reports.collect()}
    assert len(cut) == 26 and cut["/lost"] == (True, 0.35, 1)
    for _, path, file, name, _, framework, auth in routes[:-1]:
        want, short = walked((file, name), calls, layer, 2 + auth)
        assert [x for x in got[path][2 + auth :]] == want
        sure = 0.4 + min(0.5, 0.08 * (2 + auth + len(want))) + (0.05 if framework else 0) - (0.08 if short else 0)
        assert cut[path][0] == short and cut[path][1] == pytest.approx(min(0.95, sure), abs=0.006)


def test_categories(spark):
    df = spark.createDataFrame([("POST /login",), ("GET /cart checkout",), ("x",), (None,), ("search query upload",)], "t string")
    assert [r[0] for r in df.select(workflow.category(df.t)).collect()] == ["auth", "payment", "general", "general", "search"]


def test_chunks_of_symbols(spark):
    f = spark.createDataFrame([("a.py", "def f():\r\n    return 1\n" + "x = 2\n" * 900, "python"), ("b.py", None, "python"), ("c.py", "", "python")], "path string, text string, language string")
    s = spark.createDataFrame([("a.py", "f", "function", None, 1, 2, "Gives one."), ("a.py", "K", "class", "O", 3, 902, None), ("a.py", "n", "constant", None, 1, 1, None), ("b.py", "g", "function", None, 1, 2, None)], "path string, name string, kind string, parent string, line int, end_line int, doc string")
    got = {r.symbol: r for r in retrieval.code_chunks(f, s).collect()}
    assert got["f"].text == "file: a.py\nlanguage: python\nsymbol: function f\npurpose: Gives one.\ncode:\ndef f():\n    return 1" and got["f"].tokens == len(got["f"].text) // 4
    assert " in class O\n" in got["K"].text and got["K"].text.endswith("\n… (truncated)") and set(got) == {"f", "K"}
    assert retrieval.code_chunks(f, s.limit(0)).collect()[0].kind == "file" and retrieval.code_chunks(f.limit(0), s).count() == 0


def test_small_files_are_dealt_to_tasks_by_number(spark, monkeypatch):
    monkeypatch.setattr(extract, "PARSED", 10)
    files = spark.range(0, 100, 1, 1).selectExpr("concat('m', id, '.py') AS path", "'x = 1' AS text")
    assert extract.python_records(files).rdd.getNumPartitions() >= 10


def test_imports_that_read_alike_are_resolved_once(spark, monkeypatch):
    tried = []
    keep = resolve.staged
    monkeypatch.setattr(resolve, "staged", lambda df, label: tried.append((label, keep(df, label))) or tried[-1][1])
    paths = ["a/__init__.py", "a/m.py", "b/m.py", "b/x.py", "b/y.py", "m.py"]
    files = spark.createDataFrame([(x,) for x in paths], "path string")
    rows = [("b/x.py", "m", 0, ["f"], 1), ("b/y.py", "m", 0, ["f"], 9), ("b/x.py", "", 1, ["y"], 2), ("b/x.py", "a", 0, ["m", "q"], 3), ("b/x.py", "a", 0, ["q"], 4), ("b/x.py", "json", 0, ["json"], 5), ("a/m.py", "b.x", 0, ["*"], 1)]
    imports = spark.createDataFrame(rows, "path string, name string, level int, names array<string>, line int")
    got = {(r["path"], r["line"]): r["resolved"] for r in resolve.resolved_imports(imports, files).collect()}
    assert got == {("b/x.py", 1): "m.py", ("b/y.py", 9): "m.py", ("b/x.py", 2): "b/y.py", ("b/x.py", 3): "a/m.py", ("b/x.py", 4): "a/__init__.py", ("b/x.py", 5): None, ("a/m.py", 1): "b/x.py"}
    assert dict(tried)["resolved"].count() == 5


def test_routes_that_have_all_steps_are_walked_no_further(spark, monkeypatch):
    levels = []
    keep = resolve.staged
    monkeypatch.setattr(resolve, "staged", lambda df, label: levels.append((label, keep(df, label))) or levels[-1][1])
    calls = [("f", f"g{i}", f"g{j}", "f") for i in range(200) for j in (2 * i + 1, 2 * i + 2)]
    calls = spark.createDataFrame(calls, "path string, parent string, name string, callee string")
    routes = spark.createDataFrame([("GET", "/a", "f", "g0"), ("GET", "/b", "f", "g399")], "kind string, name string, path string, parent string")
    layers = spark.createDataFrame([("f", "service")], "path string, layer string")
    got = {(r["route"], r["step"]): (r["distance"], r["name"], r["layer"]) for r in resolve.workflows(routes, calls, layers).collect()}
    tree = [(0, "g0")] + [(d, n) for d in (1, 2, 3) for n in sorted(f"g{i}" for i in range(2**d - 1, 2 ** (d + 1) - 1))]
    assert got == {("GET /a", k + 1): (*x, "service") for k, x in enumerate(tree[:14])} | {("GET /b", 1): (0, "g399", "service")}
    assert max(df.groupBy("route").count().agg({"count": "max"}).first()[0] for label, df in levels if label == "trace" and not df.isEmpty()) == 14
