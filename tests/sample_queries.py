"""What the code operators give on two small source trees, and the rows that they must give.

The rows were read through against the trees; the queries on the driver's tables are in plans/code_queries.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import paths
from sparkloom.operators import extract, reports, workflow
from sparkloom.plans.analysis import Analysis
from sparkloom.sources import corpus

from . import sample


def _analysis(spark: SparkSession) -> Analysis:
    return Analysis(sample.files(spark))


def _joined(c: str):
    return F.array_join(c, ",").alias(c)


def code_records(spark: SparkSession, d: str) -> DataFrame:
    """What the module walk finds: symbols, routers, mounts, routes, models, queries, errors."""
    r = _analysis(spark).records.where("record not in ('import', 'call')")
    return r.select("path", "record", "name", "kind", "parent", "target", "line", "complexity", _joined("names"), "auth", "detail")


def code_other_records(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark).other_records.select("path", "record", "kind", "name", "detail", "fidelity")


def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark).symbols.select("path", "name", "kind", "line", "loc", "complexity", "exported")


def code_imports(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark).imports.select("path", "name", _joined("names"), "level", "resolved", "external")


def code_calls(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark).calls.select("path", "parent", "target", "line", "callee")


def code_edges(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark).edges


def code_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Files kept in the graph with their roles."""
    return _analysis(spark).nodes.select("path", "layer", "loc", "language", "is_test", "is_example")


def code_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes behind the whole prefix of their router."""
    return _analysis(spark).apis().select("method", "path", "file_path", "line", "framework", "handler", "auth")


def code_models(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark).database()


def code_workflows(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark).workflows()


def code_cycles(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark).cycles()


def code_packages(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark).packages()


def code_manifests(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark).manifests()


def code_aliases(spark: SparkSession, d: str) -> DataFrame:
    return corpus.aliases(sample.files(spark).select("path", "text", paths.language(F.col("path")).alias("language")))


def code_references(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark).references("load_user")


def code_architecture(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark).architecture()


def code_issues(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark).issues()


def code_impact(spark: SparkSession, d: str) -> DataFrame:
    """Dependents, tests and endpoints of one file."""
    x = _analysis(spark).impact("services/user.py")
    rows = [x["dependents"].select(F.lit("dependent").alias("kind"), "path", F.col("distance").cast("string").alias("detail")), x["tests"].select(F.lit("test"), "path", "reason"), x["endpoints"].select(F.lit("endpoint"), "path", "endpoint")]
    return rows[0].union(rows[1]).union(rows[2])


def code_django(spark: SparkSession, d: str) -> DataFrame:
    return extract.django_routes(sample.files(spark))


def code_migrations(spark: SparkSession, d: str) -> DataFrame:
    return extract.migrations(sample.files(spark))


def code_migration_only(spark: SparkSession, d: str) -> DataFrame:
    """Tables that migrations create and no model has."""
    return reports.migration_only(extract.migrations(sample.files(spark)), _analysis(spark).database().select("table").distinct())


def _more(spark: SparkSession) -> Analysis:
    return Analysis(sample.files(spark, sample.MORE))


def code_modules(spark: SparkSession, d: str) -> DataFrame:
    """Imports of Go, Java, Ruby, PHP, Rust and C."""
    return _more(spark).imports.where("level is null").select("path", "name", "resolved")


def code_traces(spark: SparkSession, d: str) -> DataFrame:
    return _more(spark).traces[0]


def code_trace_reports(spark: SparkSession, d: str) -> DataFrame:
    r = workflow.listed(_more(spark).traces[1])
    return r.select("trigger", "category", "scope", "n_steps", "confidence", "truncated", "description", _joined("files"))


def code_symbol_trace(spark: SparkSession, d: str) -> DataFrame:
    return _more(spark).trace_symbol("services/accounts.py", "find")[0]


def code_entering(spark: SparkSession, d: str) -> DataFrame:
    return workflow.entering(_more(spark).traces[0], "repositories/people.py", "row_of")


def code_background(spark: SparkSession, d: str) -> DataFrame:
    return _more(spark).background().select("path", "trigger", _joined("tasks"))


def code_hints(spark: SparkSession, d: str) -> DataFrame:
    return _more(spark).hints()


def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = _more(spark).chunks()
    return c.select("path", "symbol", "kind", "start_line", "end_line", "tokens", F.sha1(F.col("text").cast("binary")).alias("sha1"))


def code_query_sites(spark: SparkSession, d: str) -> DataFrame:
    r = _more(spark).records.where("record = 'query'")
    return r.select("path", "parent", "line", "kind", "name", F.col("target").alias("orm"), "detail")


def code_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _more(spark).records.where("record = 'symbol'").select("path", "name", "signature", "doc", "decorated")


def code_script_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of the second tree's script file."""
    return _more(spark).other_records.where("record = 'symbol' and path = 'web/store.ts'").select("kind", "name")


QUERIES = {
    f.__name__: f
    for f in (
        code_records, code_other_records, code_symbols, code_imports, code_calls, code_edges, code_nodes, code_routes, code_models, code_workflows, code_cycles, code_packages, code_manifests, code_aliases,
        code_references, code_architecture, code_issues, code_impact, code_django, code_migrations, code_migration_only,
        code_modules, code_traces, code_trace_reports, code_symbol_trace, code_entering, code_background, code_hints, code_chunks, code_query_sites, code_signatures, code_script_symbols,
    )
}


def _rows(columns: str, types: str, rows: str) -> str:
    """The rows as a typed table."""
    names = columns.split()
    cast = ", ".join(f'CAST("{n}" AS {t}) AS "{n}"' for n, t in zip(names, types.split(), strict=True))
    heads = ", ".join(f'"{n}"' for n in names)
    return f"SELECT {cast} FROM (VALUES {rows}) AS t({heads})"


ORACLES = {
    "code_records": _rows(
        "path record name kind parent target line complexity names auth detail",
        "VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR INT INT VARCHAR BOOLEAN VARCHAR",
        """('alembic/versions/1_start.py', 'symbol', 'upgrade', 'function', NULL, NULL, 1, 1, '', NULL, NULL),
('app/api/users.py', 'route', '', 'POST', 'create', 'router', 16, NULL, '', NULL, 'FastAPI'),
('app/api/users.py', 'route', '/{id}', 'GET', 'read', 'router', 9, NULL, '', true, 'FastAPI'),
('app/api/users.py', 'router', 'router', NULL, NULL, '/users', 5, NULL, '', NULL, NULL),
('app/api/users.py', 'symbol', 'create', 'function', NULL, NULL, 16, 1, 'name', NULL, NULL),
('app/api/users.py', 'symbol', 'read', 'function', NULL, NULL, 9, 4, 'id,me', NULL, NULL),
('app/main.py', 'mount', 'users.router', NULL, 'app', '/v1', 5, NULL, '', NULL, NULL),
('app/main.py', 'router', 'app', NULL, NULL, '', 4, NULL, '', NULL, NULL),
('app/models.py', 'model', 'Team', NULL, NULL, 'teams', 7, NULL, 'id,users', NULL, 'people'),
('app/models.py', 'model', 'User', NULL, NULL, 'people', 1, NULL, 'id,team', NULL, 'Team'),
('app/models.py', 'symbol', 'LIMIT', 'constant', NULL, NULL, 13, 1, '', NULL, NULL),
('app/models.py', 'symbol', 'Team', 'class', NULL, NULL, 7, 1, '', NULL, 'Base'),
('app/models.py', 'symbol', 'User', 'class', NULL, NULL, 1, 1, '', NULL, 'Base'),
('app/services/user.py', 'query', 'User', 'select', 'fetch', 'SQLAlchemy', 9, NULL, '', NULL, NULL),
('app/services/user.py', 'symbol', 'fetch', 'function', NULL, NULL, 8, 1, 'id', NULL, NULL),
('app/services/user.py', 'symbol', 'load_user', 'function', NULL, NULL, 4, 1, 'id', NULL, NULL),
('app/util/left.py', 'symbol', 'a', 'function', NULL, NULL, 4, 1, '', NULL, NULL),
('app/util/right.py', 'symbol', 'b', 'function', NULL, NULL, 4, 3, '', NULL, NULL),
('bad.py', 'error', 'SyntaxError', NULL, NULL, NULL, 1, NULL, '', NULL, NULL),
('tests/test_user.py', 'symbol', 'test_load_user', 'function', NULL, NULL, 4, 1, '', NULL, NULL)""",
    ),
    "code_other_records": _rows(
        "path record kind name detail fidelity",
        "VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR",
        """('svc/Shop.java', 'import', 'import', 'java.util.List', NULL, 'approx'),
('svc/Shop.java', 'route', 'spring', '/shop', 'GET', 'approx'),
('svc/Shop.java', 'symbol', 'class', 'Shop', NULL, 'approx'),
('svc/main.go', 'route', 'gin', '/ping', 'GET', 'approx'),
('svc/main.go', 'symbol', 'function', 'Serve', NULL, 'approx'),
('web/app/(shop)/helper.ts', 'symbol', 'function', 'helper', NULL, 'approx'),
('web/app/(shop)/items/[id]/page.tsx', 'import', 'import', '../../helper', NULL, 'approx'),
('web/app/(shop)/items/[id]/page.tsx', 'import', 'import', '@/lib/api', NULL, 'approx'),
('web/app/(shop)/items/[id]/page.tsx', 'symbol', 'function', 'Page', NULL, 'approx'),
('web/src/cats.controller.ts', 'model', 'typeorm', 'Cat', NULL, 'approx'),
('web/src/cats.controller.ts', 'mount', 'express', 'adminRouter', '/admin', 'approx'),
('web/src/cats.controller.ts', 'mount', 'nest', 'Cats', 'cats', 'approx'),
('web/src/cats.controller.ts', 'query', 'prisma', 'cat', 'findMany', 'approx'),
('web/src/cats.controller.ts', 'route', 'nest', '', 'POST', 'approx'),
('web/src/cats.controller.ts', 'route', 'nest', ':id', 'GET', 'approx'),
('web/src/cats.controller.ts', 'symbol', 'class', 'Cat', NULL, 'approx'),
('web/src/cats.controller.ts', 'symbol', 'class', 'Cats', NULL, 'approx'),
('web/src/lib/api.ts', 'import', 'require', 'express', NULL, 'approx'),
('web/src/lib/api.ts', 'route', 'express', '/items', 'GET', 'approx'),
('web/src/cats.controller.ts', 'symbol', 'method', 'add', NULL, 'approx'),
('web/src/cats.controller.ts', 'symbol', 'method', 'one', NULL, 'approx')""",
    ),
    "code_symbols": _rows(
        "path name kind line loc complexity exported",
        "VARCHAR VARCHAR VARCHAR INT INT INT BOOLEAN",
        """('alembic/versions/1_start.py', 'upgrade', 'function', 1, 4, 1, true),
('app/api/users.py', 'create', 'function', 16, 2, 1, true),
('app/api/users.py', 'read', 'function', 9, 4, 4, true),
('app/models.py', 'LIMIT', 'constant', 13, 1, 1, true),
('app/models.py', 'Team', 'class', 7, 4, 1, false),
('app/models.py', 'User', 'class', 1, 4, 1, false),
('app/services/user.py', 'fetch', 'function', 8, 2, 1, true),
('app/services/user.py', 'load_user', 'function', 4, 2, 1, true),
('app/util/left.py', 'a', 'function', 4, 2, 1, true),
('app/util/right.py', 'b', 'function', 4, 5, 3, true),
('svc/Shop.java', 'Shop', 'class', NULL, NULL, NULL, NULL),
('svc/main.go', 'Serve', 'function', NULL, NULL, NULL, NULL),
('tests/test_user.py', 'test_load_user', 'function', 4, 2, 1, true),
('web/app/(shop)/helper.ts', 'helper', 'function', NULL, NULL, NULL, NULL),
('web/app/(shop)/items/[id]/page.tsx', 'Page', 'function', NULL, NULL, NULL, NULL),
('web/src/cats.controller.ts', 'Cat', 'class', NULL, NULL, NULL, NULL),
('web/src/cats.controller.ts', 'Cats', 'class', NULL, NULL, NULL, NULL),
('web/src/cats.controller.ts', 'add', 'method', NULL, NULL, NULL, NULL),
('web/src/cats.controller.ts', 'one', 'method', NULL, NULL, NULL, NULL)""",
    ),
    "code_imports": _rows(
        "path name names level resolved external",
        "VARCHAR VARCHAR VARCHAR INT VARCHAR BOOLEAN",
        """('app/api/users.py', 'app.models', 'User', 0, 'app/models.py', false),
('app/api/users.py', 'fastapi', 'APIRouter,Depends', 0, NULL, true),
('app/api/users.py', 'services.user', 'load_user', 2, 'app/services/user.py', false),
('app/main.py', 'app.api', 'users', 0, 'app/api/users.py', false),
('app/main.py', 'fastapi', 'FastAPI', 0, NULL, true),
('app/services/user.py', 'app.models', 'User', 0, 'app/models.py', false),
('app/util/left.py', 'app.util.right', 'b', 0, 'app/util/right.py', false),
('app/util/right.py', 'left', 'a', 1, 'app/util/left.py', false),
('shop/urls.py', 'django.urls', 'include,path', 0, NULL, true),
('svc/Shop.java', 'java.util.List', NULL, NULL, NULL, true),
('tests/test_user.py', 'app.services.user', 'load_user', 0, 'app/services/user.py', false),
('web/app/(shop)/items/[id]/page.tsx', '../../helper', NULL, NULL, 'web/app/(shop)/helper.ts', false),
('web/app/(shop)/items/[id]/page.tsx', '@/lib/api', NULL, NULL, 'web/src/lib/api.ts', false),
('web/src/lib/api.ts', 'express', NULL, NULL, NULL, true)""",
    ),
    "code_calls": _rows(
        "path parent target line callee",
        "VARCHAR VARCHAR VARCHAR INT VARCHAR",
        """('alembic/versions/1_start.py', 'upgrade', 'op.add_column', 4, NULL),
('alembic/versions/1_start.py', 'upgrade', 'op.create_table', 2, NULL),
('alembic/versions/1_start.py', 'upgrade', 'op.create_table', 3, NULL),
('app/api/users.py', NULL, 'APIRouter', 5, NULL),
('app/api/users.py', 'create', 'load_user', 17, 'app/services/user.py'),
('app/api/users.py', 'create', 'router.post', 15, NULL),
('app/api/users.py', 'read', 'Depends', 9, NULL),
('app/api/users.py', 'read', 'load_user', 11, 'app/services/user.py'),
('app/api/users.py', 'read', 'range', 12, NULL),
('app/api/users.py', 'read', 'router.get', 8, NULL),
('app/main.py', NULL, 'FastAPI', 4, NULL),
('app/main.py', NULL, 'app.include_router', 5, NULL),
('app/models.py', 'Team', 'Column', 9, NULL),
('app/models.py', 'Team', 'relationship', 10, NULL),
('app/models.py', 'User', 'Column', 3, NULL),
('app/models.py', 'User', 'relationship', 4, NULL),
('app/services/user.py', 'fetch', 'session.query', 9, NULL),
('app/services/user.py', 'load_user', 'fetch', 5, 'app/services/user.py'),
('app/util/left.py', 'a', 'b', 5, 'app/util/right.py'),
('app/util/right.py', 'b', 'a', 5, 'app/util/left.py'),
('shop/urls.py', NULL, 'include', 6, NULL),
('shop/urls.py', NULL, 'path', 4, NULL),
('shop/urls.py', NULL, 'path', 6, NULL),
('shop/urls.py', NULL, 're_path', 5, NULL),
('tests/test_user.py', 'test_load_user', 'load_user', 5, 'app/services/user.py')""",
    ),
    "code_edges": _rows(
        "source target kind weight",
        "VARCHAR VARCHAR VARCHAR BIGINT",
        """('app/api/users.py', 'app/models.py', 'import', 1),
('app/api/users.py', 'app/services/user.py', 'call', 2),
('app/api/users.py', 'app/services/user.py', 'import', 1),
('app/main.py', 'app/api/users.py', 'import', 1),
('app/services/user.py', 'app/models.py', 'import', 1),
('app/util/left.py', 'app/util/right.py', 'call', 1),
('app/util/left.py', 'app/util/right.py', 'import', 1),
('app/util/right.py', 'app/util/left.py', 'call', 1),
('app/util/right.py', 'app/util/left.py', 'import', 1),
('tests/test_user.py', 'app/services/user.py', 'call', 1),
('tests/test_user.py', 'app/services/user.py', 'import', 1),
('web/app/(shop)/items/[id]/page.tsx', 'web/app/(shop)/helper.ts', 'import', 1),
('web/app/(shop)/items/[id]/page.tsx', 'web/src/lib/api.ts', 'import', 1)""",
    ),
    "code_nodes": _rows(
        "path layer loc language is_test is_example",
        "VARCHAR VARCHAR BIGINT VARCHAR BOOLEAN BOOLEAN",
        """('alembic/versions/1_start.py', 'other', 4, 'python', false, false),
('app/api/__init__.py', 'route', 1, 'python', false, false),
('app/api/users.py', 'route', 17, 'python', false, false),
('app/main.py', 'entrypoint', 5, 'python', false, false),
('app/models.py', 'repository', 13, 'python', false, false),
('app/services/__init__.py', 'service', 1, 'python', false, false),
('app/services/user.py', 'service', 9, 'python', false, false),
('app/util/left.py', 'util', 5, 'python', false, false),
('app/util/right.py', 'util', 8, 'python', false, false),
('bad.py', 'other', 1, 'python', false, false),
('shop/urls.py', 'route', 7, 'python', false, false),
('svc/Shop.java', 'other', 7, 'java', false, false),
('svc/main.go', 'entrypoint', 5, 'go', false, false),
('tests/test_user.py', 'test', 5, 'python', true, false),
('web/app/(shop)/helper.ts', 'util', 2, 'typescript', false, false),
('web/app/(shop)/items/[id]/page.tsx', 'route', 3, 'typescript', false, false),
('web/src/cats.controller.ts', 'other', 10, 'typescript', false, false),
('web/src/lib/api.ts', 'route', 2, 'typescript', false, false)""",
    ),
    "code_routes": _rows(
        "method path file_path line framework handler auth",
        "VARCHAR VARCHAR VARCHAR INT VARCHAR VARCHAR BOOLEAN",
        """('GET', '/v1/users/{id}', 'app/api/users.py', 9, 'FastAPI', 'read', true),
('POST', '/v1/users', 'app/api/users.py', 16, 'FastAPI', 'create', NULL)""",
    ),
    "code_models": _rows(
        "model table related target resolved queries",
        "VARCHAR VARCHAR VARCHAR VARCHAR BOOLEAN BIGINT",
        """('Team', 'teams', 'people', 'User', true, 0),
('User', 'people', 'Team', 'Team', true, 1)""",
    ),
    "code_workflows": _rows(
        "route step distance file name layer",
        "VARCHAR INT INT VARCHAR VARCHAR VARCHAR",
        """('GET /{id}', 1, 0, 'app/api/users.py', 'read', 'route'),
('GET /{id}', 2, 1, 'app/services/user.py', 'load_user', 'service'),
('GET /{id}', 3, 2, 'app/services/user.py', 'fetch', 'service'),
('POST ', 1, 0, 'app/api/users.py', 'create', 'route'),
('POST ', 2, 1, 'app/services/user.py', 'load_user', 'service'),
('POST ', 3, 2, 'app/services/user.py', 'fetch', 'service')""",
    ),
    "code_cycles": _rows(
        "id component",
        "VARCHAR VARCHAR",
        """('app/util/left.py', 'app/util/left.py'),
('app/util/right.py', 'app/util/left.py')""",
    ),
    "code_packages": _rows(
        "package imports",
        "VARCHAR BIGINT",
        """('django', 1),
('express', 1),
('fastapi', 2),
('java', 1)""",
    ),
    "code_manifests": _rows(
        "manifest ecosystem name version",
        "VARCHAR VARCHAR VARCHAR VARCHAR",
        """('go.mod', 'go', 'github.com/a/b', 'v1.2.3'),
('package.json', 'npm', 'react', '^18'),
('package.json', 'npm', 'vite', '5'),
('pyproject.toml', 'pypi', 'attrs', '^1'),
('pyproject.toml', 'pypi', 'httpx', '>=0.2'),
('pyproject.toml', 'pypi', 'rich', NULL),
('requirements.txt', 'pypi', 'fastapi', '==0.1'),
('requirements.txt', 'pypi', 'plain', NULL),
('requirements.txt', 'pypi', 'uvicorn', '>=2')""",
    ),
    "code_aliases": _rows(
        "base alias target",
        "VARCHAR VARCHAR VARCHAR",
        """('web', '@', 'src')""",
    ),
    "code_references": _rows(
        "path caller line",
        "VARCHAR VARCHAR INT",
        """('app/api/users.py', 'create', 17),
('app/api/users.py', 'read', 11),
('tests/test_user.py', 'test_load_user', 5)""",
    ),
    "code_architecture": _rows(
        "source_layer target_layer weight edges kinds",
        "VARCHAR VARCHAR BIGINT BIGINT VARCHAR",
        """('entrypoint', 'route', 1, 1, 'import'),
('route', 'repository', 1, 1, 'import'),
('route', 'service', 3, 2, 'call,import'),
('route', 'util', 1, 1, 'import'),
('service', 'repository', 1, 1, 'import'),
('test', 'service', 2, 2, 'call,import')""",
    ),
    "code_issues": _rows(
        "kind severity path detail",
        "VARCHAR VARCHAR VARCHAR VARCHAR",
        """('circular_dependency', 'medium', 'app/util/left.py', '2'),
('isolated_module', 'info', 'app/api/__init__.py', 'app/api/__init__.py'),
('isolated_module', 'info', 'app/services/__init__.py', 'app/services/__init__.py'),
('isolated_module', 'info', 'bad.py', 'bad.py'),
('isolated_module', 'info', 'shop/urls.py', 'shop/urls.py'),
('isolated_module', 'info', 'svc/Shop.java', 'svc/Shop.java'),
('isolated_module', 'info', 'web/src/cats.controller.ts', 'web/src/cats.controller.ts'),
('missing_tests', 'low', 'app/api/users.py', 'create'),
('missing_tests', 'low', 'app/api/users.py', 'read'),
('missing_tests', 'low', 'app/services/user.py', 'fetch'),
('missing_tests', 'low', 'app/util/left.py', 'a'),
('missing_tests', 'low', 'app/util/right.py', 'b'),
('possible_secret', 'high', 'app/util/right.py', 'db_password:8'),
('tech_debt', 'info', 'web/app/(shop)/helper.ts', '1')""",
    ),
    "code_impact": _rows(
        "kind path detail",
        "VARCHAR VARCHAR VARCHAR",
        """('dependent', 'app/api/users.py', '1'),
('dependent', 'app/main.py', '2'),
('dependent', 'tests/test_user.py', '1'),
('endpoint', 'app/api/users.py', 'GET /v1/users/{id}'),
('endpoint', 'app/api/users.py', 'POST /v1/users'),
('test', 'tests/test_user.py', 'imports the file')""",
    ),
    "code_django": _rows(
        "path method local handler included",
        "VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR",
        """('shop/urls.py', 'ANY', '/api/', NULL, 'shop.api.urls'),
('shop/urls.py', 'ANY', '/items/<int:pk>/', 'views.item', NULL),
('shop/urls.py', 'ANY', '/old/', 'views.old', NULL)""",
    ),
    "code_migrations": _rows(
        "path table operations",
        "VARCHAR VARCHAR BIGINT",
        """('alembic/versions/1_start.py', 'audit', 3),
('alembic/versions/1_start.py', 'people', 3),
('db/migrate/2.sql', 'log', 2)""",
    ),
    "code_migration_only": _rows(
        "table path",
        "VARCHAR VARCHAR",
        """('audit', 'alembic/versions/1_start.py'),
('log', 'db/migrate/2.sql')""",
    ),
    "code_modules": _rows(
        "path name resolved",
        "VARCHAR VARCHAR VARCHAR",
        r"""('c/main.c', '../inc/a.h', 'inc/a.h'),
('c/main.c', 'b.h', 'z/b.h'),
('c/main.c', 'stdio.h', NULL),
('cmd/main.go', 'example.com/m/internal/store', 'internal/store/a.go'),
('cmd/main.go', 'github.com/gin-gonic/gin', NULL),
('j/App.java', 'com.shop.Cart', 'j/com/shop/Cart.java'),
('j/App.java', 'org.springframework.boot.Run', NULL),
('php/index.php', 'App\Models\Item', 'old/Item.php'),
('php/index.php', 'Illuminate\Http\Request', NULL),
('php/index.php', 'Model\Price', 'app/Model/Price.php'),
('rb/app.rb', 'app/auth', 'rb/app/auth.rb'),
('rb/app.rb', 'json', NULL),
('rb/app.rb', 'lib/x', 'rb/lib/x.rb'),
('src/lib.rs', 'crate::net::http', 'src/net/http.rs'),
('src/lib.rs', 'serde::Serialize', NULL),
('web/store.ts', 'react', NULL)""",
    ),
    "code_traces": _rows(
        "workflow step kind label file line",
        "VARCHAR INT VARCHAR VARCHAR VARCHAR INT",
        """('GET /ping api/login.py ping', 1, 'api', 'GET /ping', 'api/login.py', 19),
('GET /ping api/login.py ping', 2, 'controller', 'ping', 'api/login.py', 19),
('POST /login api/login.py login', 1, 'api', 'POST /login', 'api/login.py', 8),
('POST /login api/login.py login', 10, 'database', 'Django ORM · Person', 'repositories/people.py', 2),
('POST /login api/login.py login', 2, 'middleware', 'Authentication / authorisation check', 'api/login.py', 8),
('POST /login api/login.py login', 3, 'controller', 'login', 'api/login.py', 8),
('POST /login api/login.py login', 4, 'service', 'find', 'services/accounts.py', 4),
('POST /login api/login.py login', 5, 'service', 'remember', 'services/accounts.py', 9),
('POST /login api/login.py login', 6, 'controller', 'helper', 'api/login.py', 14),
('POST /login api/login.py login', 7, 'repository', 'row_of', 'repositories/people.py', 1),
('POST /login api/login.py login', 8, 'database', 'SQLAlchemy', 'services/accounts.py', 11),
('POST /login api/login.py login', 9, 'database', 'raw SQL', 'services/accounts.py', 11)""",
    ),
    "code_trace_reports": _rows(
        "trigger category scope n_steps confidence truncated description files",
        "VARCHAR VARCHAR VARCHAR BIGINT DOUBLE BOOLEAN VARCHAR VARCHAR",
        """('GET /ping', 'crud', 'application', 2, 0.61, false, 'GET /ping handled in api/login.py', 'api/login.py'),
('POST /login', 'auth', 'application', 10, 0.95, false, 'POST /login → login → find → remember → helper', 'api/login.py,repositories/people.py,services/accounts.py')""",
    ),
    "code_symbol_trace": _rows(
        "workflow step kind label file line",
        "VARCHAR INT VARCHAR VARCHAR VARCHAR INT",
        """('CALL find services/accounts.py find', 1, 'api', 'CALL find', 'services/accounts.py', 4),
('CALL find services/accounts.py find', 2, 'service', 'find', 'services/accounts.py', 4),
('CALL find services/accounts.py find', 3, 'repository', 'row_of', 'repositories/people.py', 1),
('CALL find services/accounts.py find', 4, 'database', 'SQLAlchemy', 'services/accounts.py', 11),
('CALL find services/accounts.py find', 5, 'database', 'raw SQL', 'services/accounts.py', 11),
('CALL find services/accounts.py find', 6, 'database', 'Django ORM · Person', 'repositories/people.py', 2)""",
    ),
    "code_entering": _rows(
        "workflow",
        "VARCHAR",
        """('POST /login api/login.py login')""",
    ),
    "code_background": _rows(
        "path trigger tasks",
        "VARCHAR VARCHAR VARCHAR",
        """('jobs/mail.py', 'background:mail.py', 'send,task_clean')""",
    ),
    "code_hints": _rows(
        "path framework",
        "VARCHAR VARCHAR",
        """('api/login.py', 'FastAPI'),
('cmd/main.go', 'Gin'),
('j/App.java', 'Spring Boot'),
('jobs/mail.py', 'Celery'),
('php/index.php', 'Laravel'),
('src/lib.rs', 'Serde'),
('web/store.ts', 'React')""",
    ),
    "code_chunks": _rows(
        "path symbol kind start_line end_line tokens sha1",
        "VARCHAR VARCHAR VARCHAR INT INT BIGINT VARCHAR",
        """('api/login.py', 'helper', 'symbol', 14, 15, 24, 'fecf51880b0b6d8916da3aae3d13e4f971b4e604'),
('api/login.py', 'login', 'symbol', 8, 11, 43, '08b71ae800b12a16e90649507b52f157e2e54e7a'),
('api/login.py', 'ping', 'symbol', 19, 20, 23, '05b46af44ac2d7b18b8acb2731853285c9c24f02'),
('c/main.c', NULL, 'file', 1, 7, 22, '21ccbf75e7e1b09a2ae4b9076bac6f8029b49dc9'),
('cmd/main.go', NULL, 'file', 1, 6, 21, 'cdd9cdf211756805cab96e6bd22b2e3cbb356ec8'),
('j/App.java', NULL, 'file', 1, 4, 18, '6912edc70ef1831a54acb1a5f21fc40c270e98ba'),
('jobs/mail.py', 'other', 'symbol', 13, 14, 22, '6e406b51a72d8ac5a89ec4fddf913ba2922f1bd5'),
('jobs/mail.py', 'send', 'symbol', 5, 6, 22, '14f8f12a973644f0e6ce725472bf0b9f3a1e0214'),
('jobs/mail.py', 'task_clean', 'symbol', 9, 10, 25, '46e1df8d47821e0fdbc7eef68f1ac28e1e7f7171'),
('php/index.php', NULL, 'file', 1, 4, 18, '514b6abf5b6ce2da77f6ab5e38de983a81bdb523'),
('repositories/people.py', 'row_of', 'symbol', 1, 2, 36, '3caf9ded681c8d498aeb60cd2b35777c8d145a77'),
('repositories/people.py', NULL, 'file', 1, 2, 17, 'ac579f345389253157cf2f7c36e553fe6664ff03'),
('services/accounts.py', 'find', 'symbol', 4, 6, 41, '7cb95a2c91b6181fa5417260c87a5f7d84a4d075'),
('services/accounts.py', 'remember', 'symbol', 9, 11, 40, '33a2a0fe4c7e3faa92093289039890ccb7030ec3'),
('services/accounts.py', NULL, 'file', 1, 11, 49, '3559e904aae160df377783f322af182a140df4b7')""",
    ),
    "code_query_sites": _rows(
        "path parent line kind name orm detail",
        "VARCHAR VARCHAR INT VARCHAR VARCHAR VARCHAR VARCHAR",
        """('repositories/people.py', 'row_of', 2, 'select', 'Person', 'Django ORM', NULL),
('services/accounts.py', 'remember', 10, 'insert', 'user', 'SQLAlchemy', NULL),
('services/accounts.py', 'remember', 11, 'raw', '', 'SQLAlchemy', 'UPDATE people SET seen = 1'),
('services/accounts.py', 'remember', 11, 'update', '', 'raw SQL', 'UPDATE people SET seen = 1')""",
    ),
    "code_signatures": _rows(
        "path name signature doc decorated",
        "VARCHAR VARCHAR VARCHAR VARCHAR BOOLEAN",
        """('api/login.py', 'helper', 'def helper(user)', NULL, false),
('api/login.py', 'login', 'def login(name, me)', NULL, true),
('api/login.py', 'ping', 'def ping()', NULL, true),
('jobs/mail.py', 'other', 'def other()', NULL, false),
('jobs/mail.py', 'send', 'def send(to)', NULL, true),
('jobs/mail.py', 'task_clean', 'def task_clean()', NULL, false),
('repositories/people.py', 'row_of', 'def row_of(name) -> dict', NULL, false),
('services/accounts.py', 'find', 'def find(name)', 'A person by name.', false),
('services/accounts.py', 'remember', 'def remember(user)', NULL, false)""",
    ),
    "code_script_symbols": _rows(
        "kind name",
        "VARCHAR VARCHAR",
        """('class', 'Cart'),
('constant', 'LIMITS'),
('method', 'total'),
('state', 'Theme')""",
    ),
}
