"""Extraction, resolution and reports over a code base that is written from the driver's tables, with the SQL that checks them.

SQL cannot parse source code; it computes the same facts from the tables that the code base was written from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import extract, reports, workflow
from sparkloom.plans.analysis import Analysis
from sparkloom.sources import corpus, written

_made: dict[tuple[str, str], Analysis] = {}


def _analysis(spark: SparkSession, d: str) -> Analysis:
    """The analysis of the code base of d, made once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _made:
        _made[key] = Analysis(written.files(spark, d))
    return _made[key]


def _joined(c: str):
    return F.array_join(c, ",").alias(c)


def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d).symbols.select("path", "name", "kind", "line", "loc", "complexity", "exported")


def code_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d).records.where("record = 'symbol'").select("path", "name", "signature", "doc", "decorated", _joined("names"))


def code_other_records(spark: SparkSession, d: str) -> DataFrame:
    """What patterns find in scripts, Java and C."""
    return _analysis(spark, d).other_records.select("path", "record", "kind", "name", "detail", "fidelity")


def code_imports(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d).imports.select("path", "name", _joined("names"), "level", "resolved", "external")


def code_calls(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d).calls.select("path", "parent", "target", "line", "callee")


def code_edges(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d).edges


def code_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Files kept in the graph with their roles."""
    return _analysis(spark, d).nodes.select("path", "layer", "loc", "language", "is_test", "is_example")


def code_architecture(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d).architecture()


def code_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes behind the whole prefix of their router."""
    return _analysis(spark, d).apis().select("method", "path", "file_path", "line", "framework", "handler", "auth")


def code_models(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d).database()


def code_query_sites(spark: SparkSession, d: str) -> DataFrame:
    r = _analysis(spark, d).records.where("record = 'query'")
    return r.select("path", "parent", "line", "kind", "name", F.col("target").alias("orm"), "detail")


def code_workflows(spark: SparkSession, d: str) -> DataFrame:
    """Each route's handler and what it calls in turn."""
    return _analysis(spark, d).workflows()


def code_traces(spark: SparkSession, d: str) -> DataFrame:
    """Steps of the first sixty routes; tests hold them against a plain search."""
    return _analysis(spark, d).traces[0]


def code_trace_reports(spark: SparkSession, d: str) -> DataFrame:
    r = workflow.listed(_analysis(spark, d).traces[1])
    return r.select("trigger", "category", "scope", "n_steps", "confidence", "truncated", "description", _joined("files"))


def code_background(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d).background().select("path", "trigger", _joined("tasks"))


def code_references(spark: SparkSession, d: str) -> DataFrame:
    """Who calls the function of part 20, which many parts do."""
    return _analysis(spark, d).references("run_20")


def code_packages(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d).packages()


def code_hints(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d).hints()


def code_manifests(spark: SparkSession, d: str) -> DataFrame:
    return corpus.dependencies(_analysis(spark, d).files)


def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of symbols: where they lie, and their code without its head."""
    c = _analysis(spark, d).chunks().where("kind = 'symbol'")
    return c.select("path", "symbol", "start_line", "end_line", F.sha1(F.substring_index("text", "\ncode:\n", -1).cast("binary")).alias("code"))


def code_django(spark: SparkSession, d: str) -> DataFrame:
    return extract.django_routes(_analysis(spark, d).files)


def code_migrations(spark: SparkSession, d: str) -> DataFrame:
    return extract.migrations(_analysis(spark, d).files)


def code_migration_only(spark: SparkSession, d: str) -> DataFrame:
    """Tables that migrations create and no model has."""
    x = _analysis(spark, d)
    return reports.migration_only(extract.migrations(x.files), x.database().select("table").distinct())


def code_overview(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d).overview().select("files", "languages", "test_files", "modules", "routes", "models", "errors", "symbols", "skipped")


QUERIES = {
    f.__name__: f
    for f in (
        code_symbols, code_signatures, code_other_records, code_imports, code_calls, code_edges, code_nodes, code_architecture, code_routes, code_models, code_query_sites, code_workflows, code_traces,
        code_trace_reports, code_background, code_references, code_packages, code_hints, code_manifests, code_chunks, code_django, code_migrations, code_migration_only, code_overview,
    )
}

_W = f"WITH RECURSIVE {written.SQL}"
_SYMBOLS = """, syms AS (SELECT path, 'Part' || i AS name, 'class' AS kind, 4 + k AS line, 3 + r AS loc, 1 AS complexity, false AS exported, 'class Part' || i || '(Base)' AS signature, NULL::BOOLEAN AS decorated, '' AS names FROM m
  UNION ALL SELECT path, run, 'function', f, 4 + k, 2, true, 'def run_' || i || '(x)', false, 'x' FROM m
  UNION ALL SELECT path, handler, 'function', line, 2, 1, true, 'def read_' || i || CASE WHEN i % 3 = 0 THEN '(id, me)' ELSE '(id)' END, true, CASE WHEN i % 3 = 0 THEN 'id,me' ELSE 'id' END FROM read
  UNION ALL SELECT test, 'test_run_' || i, 'function', 4, 2, 1, true, 'def test_run_' || i || '()', false, '' FROM tests
  UNION ALL SELECT path, 'upgrade', 'function', 1, 2 + ops, 1, true, 'def upgrade()', false, '' FROM moves
  UNION ALL SELECT 'jobs/supplier_' || s || '.py', name || s, 'function', line, 2, 1, true, 'def ' || name || s || a, name = 'send_', CASE WHEN name = 'send_' THEN 'to' ELSE '' END
    FROM apis, (VALUES ('send_', 5, '(to)'), ('task_clean_', 9, '()'), ('other_', 13, '()')) AS t(name, line, a))"""
_OTHER = """, other AS (SELECT 'web/src/supplier_' || s || '.ts' AS path, record, kind, replace(replace(name, '#n', nation::VARCHAR), '#', s::VARCHAR) AS name, detail FROM apis,
    (VALUES ('import', 'import', './nation_#n', NULL), ('import', 'import', 'axios', NULL), ('symbol', 'function', 'load#', NULL), ('route', 'express', '/web/s#', 'GET')) AS t(record, kind, name, detail)
  UNION ALL SELECT 'web/src/nation_' || nation || '.ts', 'symbol', 'function', 'api' || nation, NULL FROM apps
  UNION ALL SELECT 'j/com/shop/S' || s || '.java', record, kind, replace(replace(name, '#t', ((s + 1) % ns)::VARCHAR), '#', s::VARCHAR), detail FROM apis, nsup,
    (VALUES ('import', 'import', 'java.util.List', NULL), ('import', 'import', 'com.shop.S#t', NULL), ('symbol', 'class', 'S#', NULL), ('route', 'spring', '/java/s#', 'GET')) AS t(record, kind, name, detail)
  UNION ALL SELECT 'c/s' || s || '.c', record, kind, replace(replace(name, '#t', ((s + 1) % ns)::VARCHAR), '#', s::VARCHAR), detail FROM apis, nsup,
    (VALUES ('import', 'include', 'inc/s#t.h', NULL), ('import', 'include', 'stdio.h', NULL), ('symbol', 'function', 'go_#', NULL)) AS t(record, kind, name, detail))"""
_IMPORTS = """, imports AS (SELECT path, 'json' AS name, 'json' AS names, 0 AS level, NULL AS resolved FROM m
  UNION ALL SELECT m.path, d.module, d.run, 0, d.path FROM deps JOIN m USING (i) JOIN m AS d ON d.i = deps.j
  UNION ALL SELECT path, 'fastapi', 'APIRouter,Depends', 0, NULL FROM apis UNION ALL SELECT path, module, run, 0, part FROM read
  UNION ALL SELECT path, 'fastapi', 'FastAPI', 0, NULL FROM apps UNION ALL SELECT path, 'api', 'supplier_' || s, 0, 'api/supplier_' || s || '.py' FROM mounts
  UNION ALL SELECT test, module, run, 0, path FROM tests UNION ALL SELECT 'jobs/supplier_' || s || '.py', 'celery', 'shared_task', 0, NULL FROM apis
  UNION ALL SELECT 'shop/nation_' || nation || '/urls.py', 'django.urls', 'include,path', 0, NULL FROM apps
  UNION ALL SELECT 'web/src/supplier_' || s || '.ts', './nation_' || nation, NULL, NULL, 'web/src/nation_' || nation || '.ts' FROM apis UNION ALL SELECT 'web/src/supplier_' || s || '.ts', 'axios', NULL, NULL, NULL FROM apis
  UNION ALL SELECT 'j/com/shop/S' || s || '.java', 'java.util.List', NULL, NULL, NULL FROM apis UNION ALL SELECT 'j/com/shop/S' || s || '.java', 'com.shop.S' || ((s + 1) % ns), NULL, NULL, 'j/com/shop/S' || ((s + 1) % ns) || '.java' FROM apis, nsup
  UNION ALL SELECT 'c/s' || s || '.c', 'stdio.h', NULL, NULL, NULL FROM apis UNION ALL SELECT 'c/s' || s || '.c', 'inc/s' || ((s + 1) % ns) || '.h', NULL, NULL, 'inc/s' || ((s + 1) % ns) || '.h' FROM apis, nsup)"""
_CALLS = """, calls AS (SELECT path, 'Part' || i AS parent, 'Column' AS target, 6 + k AS line, NULL AS callee FROM m UNION ALL SELECT path, 'Part' || i, 'relationship', 7 + k, NULL FROM m WHERE r = 1
  UNION ALL SELECT path, run, 'json.dumps', f + 2, NULL FROM m UNION ALL SELECT path, run, 'session.query', f + 3 + k, NULL FROM m
  UNION ALL SELECT m.path, m.run, d.run, m.f + 2 + place, d.path FROM deps JOIN m USING (i) JOIN m AS d ON d.i = deps.j
  UNION ALL SELECT path, NULL, 'APIRouter', 3 + c, NULL FROM apis UNION ALL SELECT path, handler, CASE WHEN i % 2 = 0 THEN 'router.get' ELSE 'router.post' END, line - 1, NULL FROM read
  UNION ALL SELECT path, handler, 'Depends', line, NULL FROM read WHERE i % 3 = 0 UNION ALL SELECT path, handler, run, line + 1, part FROM read
  UNION ALL SELECT path, NULL, 'FastAPI', 3 + c, NULL FROM apps UNION ALL SELECT path, NULL, 'app.include_router', 4 + c + q, NULL FROM mounts
  UNION ALL SELECT test, 'test_run_' || i, run, 5, path FROM tests
  UNION ALL SELECT path, 'upgrade', 'op.create_table', 1 + unnest(range(1, ops + 1)), NULL FROM moves
  UNION ALL SELECT 'shop/nation_' || nation || '/urls.py', NULL, 'path', 3 + unnest(range(1, c + 2)), NULL FROM apps UNION ALL SELECT 'shop/nation_' || nation || '/urls.py', NULL, 'include', 4 + c, NULL FROM apps)"""
_EDGES = f"""{_IMPORTS}{_CALLS}, edges AS (SELECT DISTINCT path AS source, resolved AS target, 'import' AS kind, 1::BIGINT AS weight FROM imports WHERE resolved <> path
  UNION ALL SELECT path, callee, 'call', count(DISTINCT coalesce(parent, '<module>') || ' -> ' || target) FROM calls WHERE callee <> path GROUP BY 1, 2)"""
_NODES = """, nodes AS (SELECT path, CASE folder WHEN 'services' THEN 'service' WHEN 'repositories' THEN 'repository' WHEN 'utils' THEN 'util' ELSE 'route' END AS layer, f + 3 + k AS loc, 'python' AS language, false AS is_test FROM m
  UNION ALL SELECT test, 'test', 5, 'python', true FROM tests UNION ALL SELECT path, 'other', 2 + ops, 'python', false FROM moves
  UNION ALL SELECT path, 'route', 3 + c + 5 * c, 'python', false FROM apis UNION ALL SELECT 'web/src/supplier_' || s || '.ts', 'other', 7, 'typescript', false FROM apis
  UNION ALL SELECT 'j/com/shop/S' || s || '.java', 'other', 7, 'java', false FROM apis UNION ALL SELECT 'c/s' || s || '.c', 'other', 6, 'c', false FROM apis UNION ALL SELECT 'inc/s' || s || '.h', 'other', 1, 'c', false FROM apis
  UNION ALL SELECT 'jobs/supplier_' || s || '.py', 'other', 14, 'python', false FROM apis
  UNION ALL SELECT path, 'route', 3 + 2 * c, 'python', false FROM apps UNION ALL SELECT 'shop/nation_' || nation || '/urls.py', 'route', 5 + c, 'python', false FROM apps UNION ALL SELECT 'web/src/nation_' || nation || '.ts', 'other', 1, 'typescript', false FROM apps)"""

ORACLES = {
    "code_symbols": f"""{_W}{_SYMBOLS}{_OTHER} SELECT path, name, kind, line::INT AS line, loc::INT AS loc, complexity::INT AS complexity, exported FROM syms
UNION ALL SELECT path, name, kind, NULL, NULL, NULL, NULL FROM other WHERE record = 'symbol'""",
    "code_signatures": f"{_W}{_SYMBOLS} SELECT path, name, signature, NULL::VARCHAR AS doc, decorated, names FROM syms",
    "code_other_records": f"{_W}{_OTHER} SELECT *, 'approx' AS fidelity FROM other",
    "code_imports": f"{_W}{_IMPORTS} SELECT *, resolved IS NULL AS external FROM imports",
    "code_calls": f"{_W}{_CALLS} SELECT path, parent, target, line::INT AS line, callee FROM calls",
    "code_edges": f"{_W}{_EDGES} SELECT * FROM edges",
    "code_nodes": f"{_W}{_NODES} SELECT path, layer, loc::BIGINT AS loc, language, is_test, false AS is_example FROM nodes",
    "code_architecture": f"""{_W}{_EDGES}{_NODES} SELECT a.layer AS source_layer, b.layer AS target_layer, sum(weight)::BIGINT AS weight, count(*) AS edges, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds
FROM edges JOIN nodes a ON a.path = source JOIN nodes b ON b.path = target WHERE a.layer <> b.layer GROUP BY 1, 2""",
    "code_routes": f"""{_W} SELECT CASE WHEN i % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/n' || nation || '/s' || s || '/p' || i AS path, path AS file_path, line::INT AS line, 'FastAPI' AS framework, handler,
  CASE WHEN i % 3 = 0 THEN true END AS auth FROM read""",
    "code_models": f"""{_W} SELECT 'Part' || i AS model, 'part_' || i AS "table", CASE WHEN r = 1 THEN 'Part' || first END AS related, CASE WHEN r = 1 THEN 'Part' || first END AS target, r = 1 AS resolved, 1::BIGINT AS queries FROM m""",
    "code_query_sites": f"{_W} SELECT path, run AS parent, (f + 3 + k)::INT AS line, 'select' AS kind, 'Part' || i AS name, 'SQLAlchemy' AS orm, NULL::VARCHAR AS detail FROM m",
    "code_workflows": f"""{_W}, calls AS (SELECT m.path AS file, m.run AS caller, d.path AS callee, d.run AS called FROM deps JOIN m USING (i) JOIN m AS d ON d.i = deps.j UNION SELECT path, handler, part, run FROM read),
walk AS (SELECT CASE WHEN i % 2 = 0 THEN 'GET /p' ELSE 'POST /p' END || i AS route, path AS file, handler AS name, 0 AS distance FROM read
  UNION SELECT w.route, c.callee, c.called, w.distance + 1 FROM walk w JOIN calls c ON c.file = w.file AND c.caller = w.name WHERE w.distance < 7),
least AS (SELECT route, file, name, min(distance) AS distance FROM walk GROUP BY ALL),
steps AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY distance, file, name) AS step FROM least){_NODES}
SELECT route, step::INT AS step, distance::INT AS distance, file, name, layer FROM steps JOIN nodes ON path = file WHERE step <= 14""",
    "code_background": f"""{_W} SELECT 'jobs/supplier_' || s || '.py' AS path, 'background:supplier_' || s || '.py' AS trigger, 'send_' || s || ',task_clean_' || s AS tasks FROM apis ORDER BY path LIMIT 6""",
    "code_references": f"{_W}{_CALLS} SELECT path, coalesce(parent, '<module>') AS caller, min(line)::INT AS line FROM calls WHERE target = 'run_20' GROUP BY 1, 2",
    "code_packages": f"""{_W}{_IMPORTS} SELECT regexp_extract(name, '^[^./]*') AS package, count(*) AS imports FROM imports WHERE resolved IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60""",
    "code_hints": f"""{_W} SELECT path, 'FastAPI' AS framework FROM apis UNION ALL SELECT path, 'FastAPI' FROM apps UNION ALL SELECT 'jobs/supplier_' || s || '.py', 'Celery' FROM apis
UNION ALL SELECT 'shop/nation_' || nation || '/urls.py', 'Django' FROM apps UNION ALL SELECT 'web/src/supplier_' || s || '.ts', 'Axios' FROM apis""",
    "code_manifests": """SELECT 'svc/r' || n_regionkey || '/requirements.txt' AS manifest, 'pypi' AS ecosystem, 'lib' || s_suppkey AS name, '==' || s_suppkey || '.0' AS version FROM supplier JOIN nation ON n_nationkey = s_nationkey
QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) <= 400""",
    "code_chunks": f"""{_W}{_SYMBOLS}, codes AS (SELECT path, 'Part' || i AS name, 'class Part' || i || '(Base):' || chr(10) || '    __tablename__ = ''part_' || i || '''' || chr(10) || '    id = Column(Integer)' || CASE WHEN r = 1 THEN chr(10) || '    near = relationship(''Part' || first || ''')' ELSE '' END AS code FROM m
  UNION ALL SELECT path, run, 'def run_' || i || '(x):' || chr(10) || '    if x:' || chr(10) || '        json.dumps(x)' || chr(10) || coalesce((SELECT string_agg('        run_' || j || '(x)' || chr(10), '' ORDER BY j) FROM deps WHERE deps.i = m.i), '') || '    return session.query(Part' || i || ')' FROM m
  UNION ALL SELECT path, handler, 'def read_' || i || CASE WHEN i % 3 = 0 THEN '(id, me=Depends(current_user)):' ELSE '(id):' END || chr(10) || '    return run_' || i || '(id)' FROM read
  UNION ALL SELECT test, 'test_run_' || i, 'def test_run_' || i || '():' || chr(10) || '    run_' || i || '(1)' FROM tests
  UNION ALL SELECT path, 'upgrade', 'def upgrade():' || chr(10) || coalesce((SELECT string_agg(CASE WHEN i % 2 = 0 THEN '    op.create_table(''part_' || i || ''')' || chr(10) ELSE '' END || CASE WHEN i % 50 = 0 THEN '    op.create_table(''audit_' || i || ''')' || chr(10) ELSE '' END, '' ORDER BY i) FROM m WHERE i // 50 = q), '') || '    return 1' FROM moves
  UNION ALL SELECT 'jobs/supplier_' || s || '.py', name || s, 'def ' || name || s || a || ':' || chr(10) || '    return ' || coalesce(v, s::VARCHAR) FROM apis, (VALUES ('send_', '(to)', 'to'), ('task_clean_', '()', NULL), ('other_', '()', '2')) AS t(name, a, v))
SELECT path, name AS symbol, line::INT AS start_line, (line + loc - 1)::INT AS end_line, sha1(code) AS code FROM syms JOIN codes USING (path, name)""",
    "code_django": f"""{_W} SELECT 'shop/nation_' || nation || '/urls.py' AS path, 'ANY' AS method, '/s' || s || '/' AS local, 'views.s' || s AS handler, NULL AS included FROM mounts
UNION ALL SELECT 'shop/nation_' || nation || '/urls.py', 'ANY', '/more/', NULL, 'shop.nation_' || ((nation + 1) % 25) || '.urls' FROM apps""",
    "code_migrations": f"{_W} SELECT moves.path, 'part_' || i AS \"table\", ops AS operations FROM moves JOIN m ON i // 50 = q WHERE i % 2 = 0 UNION ALL SELECT moves.path, 'audit_' || i, ops FROM moves JOIN m ON i // 50 = q WHERE i % 50 = 0",
    "code_migration_only": f"{_W} SELECT 'audit_' || i AS \"table\", moves.path FROM moves JOIN m ON i // 50 = q WHERE i % 50 = 0",
    "code_overview": f"""{_W}{_NODES}{_SYMBOLS}{_OTHER} SELECT (SELECT count(*) FROM nodes) + (SELECT count(DISTINCT n_regionkey) FROM supplier JOIN nation ON n_nationkey = s_nationkey) AS files, 5::BIGINT AS languages, (SELECT count(*) FROM tests) AS test_files,
  13 + (SELECT count(*) FROM nation) + (SELECT count(DISTINCT n_regionkey) FROM supplier JOIN nation ON n_nationkey = s_nationkey) AS modules,
  (SELECT count(*) FROM read) AS routes, (SELECT count(*) FROM m) AS models, 0::BIGINT AS errors, (SELECT count(*) FROM syms) + (SELECT count(*) FROM other WHERE record = 'symbol') AS symbols, 0::BIGINT AS skipped""",
}
