"""Queries behind the pages of an analysis, over the code base written from the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import endpoints, graph, impact, reports, resolve, store, views
from sparkloom.plans.code_queries import _EDGES, _NODES, _OTHER, _SYMBOLS, _W, _analysis
from sparkloom.plans.code_queries import ORACLES as _CODE
from sparkloom.plans.graph_queries import _BOTH, _DEGREE
from sparkloom.plans.storage import staged
from sparkloom.sources.proxy import edges, nodes, table


def view_layer_cards(spark: SparkSession, d: str) -> DataFrame:
    x = _analysis(spark, d)
    return views.layer_cards(x.nodes, x.edges, x.symbols)


def view_graph_facets(spark: SparkSession, d: str) -> DataFrame:
    x = _analysis(spark, d)
    return views.graph_facets(x.nodes, x.edges, "layer", "language")


def view_endpoint_facets(spark: SparkSession, d: str) -> DataFrame:
    return views.endpoint_facets(_analysis(spark, d).routes())


def view_capped_nodes(spark: SparkSession, d: str) -> DataFrame:
    return views.capped_view(nodes(spark, d), edges(spark, d))[0].select("id", "coupling")


def view_capped_edges(spark: SparkSession, d: str) -> DataFrame:
    """The heaviest import edges among the most coupled economy parts."""
    return views.capped_view(nodes(spark, d), edges(spark, d), 300, 100, "ECONOMY", "import")[1]


def view_boards(spark: SparkSession, d: str) -> DataFrame:
    """Leaderboards: coupling, length, complexity, symbols without tests, files on their own."""
    x = _analysis(spark, d)
    n = staged(x.dependencies().withColumn("name", F.lit("")), "coupled")
    code = n.where("not is_test")
    tested = x.records.join(x.files.where("is_test").select("path"), "path", "left_semi")
    names = tested.where("record = 'symbol'").select(F.regexp_replace("name", "^test_", "").alias("name")).union(tested.where("record = 'import'").select(F.explode("names")))
    exported = x.symbols.join(x.files.where("not is_test and layer not in ('other', 'config', 'test', 'docs')").select("path"), "path", "left_semi").where("exported and kind in ('function', 'method', 'class')").select("path", "name", "loc")
    alone = graph.orphans(code.where("layer not in ('config', 'entrypoint') and path not like 'alembic/%'"), x.edges)
    parts = [
        views.board(n, "coupling", F.col("coupling"), 15, 12),
        views.board(code, "length", F.col("loc"), 15, 100),
        views.board(x.symbols.where("kind = 'function'"), "complexity", F.col("complexity"), 12, 2),
        resolve.missing_tests(exported, names).select(F.lit("untested").alias("board"), "path", "name", F.col("loc").cast("long").alias("value")),
        alone.orderBy("path").limit(10).select(F.lit("alone").alias("board"), "path", F.lit("").alias("name"), F.lit(0).cast("long").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def view_services(spark: SparkSession, d: str) -> DataFrame:
    """The service behind each endpoint."""
    x = _analysis(spark, d)
    return views.services_of(x.apis().select("file_path", "handler", "line"), x.calls, x.files)


def view_affected_workflows(spark: SparkSession, d: str) -> DataFrame:
    """Workflows that pass the module of part 20 or what depends on it within two steps."""
    x = _analysis(spark, d)
    target = x.files.where("path = 'services/part_20.py'").select(F.col("path").alias("id"))
    cone = impact.dependents(x.edges.select("source", "target"), target, 2).select(F.col("id").alias("path")).union(target)
    return views.affected_workflows(x.workflows(), staged(cone, "cone"))


def view_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = _analysis(spark, d).records.where("record = 'symbol'").select("path", "name", "signature", "doc")
    return views.symbols_holding(s, "PART1").select("path", "name", "signature")


def view_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints by method and a needle that only their handlers hold."""
    return endpoints.filtered(_analysis(spark, d).apis(), "get", "FastAPI", "READ_1").select("method", "path", "handler")


def view_query_filter(spark: SparkSession, d: str) -> DataFrame:
    """Query sites of one kind, and models, that hold a needle."""
    x = _analysis(spark, d)
    sites = x.records.where("record = 'query' and kind = 'select'").select("path", "name", F.lit("").alias("table"))
    models = x.database().select(F.lit("").alias("path"), F.col("model").alias("name"), "table")
    return reports.holding(sites.unionByName(models), "Part_1", "path", "table")


def view_files(spark: SparkSession, d: str) -> DataFrame:
    """The file picker: the first thirty files of a layer whose path holds what was typed."""
    return reports.holding(_analysis(spark, d).files.where("layer = 'route'"), " Part_1", "path").orderBy("path").limit(30).select("path", "layer")


def view_files_shown(spark: SparkSession, d: str) -> DataFrame:
    """Each part's module from where it is kept: with the run, in the checkout, remote, or nowhere; cut to 260 bytes."""
    f = _analysis(spark, d).files.where("path rlike '/part_[0-9]+.py$' and not is_test").select("path", "text", F.regexp_extract("path", "([0-9]+).py$", 1).cast("long").alias("i"))
    remote = f.where("i % 3 < 2 or i % 5 = 0").select("path", F.base64(F.encode("text", "UTF-8")).alias("base64"))
    shown = store.files_shown(f, f.where("i % 5 = 0"), f.where("i % 3 = 0"), remote, 260)
    return shown.select("path", "origin", F.octet_length("content").cast("long").alias("bytes"), "truncated")


def view_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a run by language of their file, and all."""
    x = _analysis(spark, d)
    c = x.chunks().where("kind = 'symbol'").join(x.files.select("path", "language"), "path")
    return reports.counted(c, "language")


def view_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A prompt for each conversation, from the documents that fall to it."""
    turns = table(spark, d, "conversations")
    n = turns.agg((F.max("conv_id") + 1).alias("n")).first()["n"]
    found = table(spark, d, "documents").select((F.col("doc_id") % n).alias("conv_id"), F.col("source").alias("path"), F.col("doc_id").alias("start_line"), "text", (F.col("doc_id") % 7 / 8).alias("score"))
    p = views.prompts(turns, found, 1500)
    return p.select("conv_id", "turns", "excerpts", "chars", F.sha1(F.col("prompt").cast("binary")).alias("prompt"))


def view_overview(spark: SparkSession, d: str) -> DataFrame:
    """The counts of the overview, a row each."""
    x = _analysis(spark, d)
    count = lambda df, name, c=None: df.agg((F.count(F.lit(1)) if c is None else c).cast("long").alias("n")).select(F.lit(name).alias("name"), "n")
    r, s, e, i = x.records, x.symbols, x.edges, x.imports
    tell = lambda df, facet, **named: [count(df.where(c), n) for n, c in named.items()]
    parts = [
        count(x.files, "files"), count(x.files, "loc", F.sum("loc")), count(x.files, "languages", F.count_distinct("language")), count(x.files, "folders", F.count_distinct(F.regexp_replace("path", "/[^/]*$", ""))),
        *tell(x.files, "files", test_files="is_test", docs="layer = 'docs'"), count(s, "symbols"), *tell(s, "symbols", functions="kind = 'function'", classes="kind = 'class'", exported="exported"), count(s, "complexity", F.sum("complexity")),
        count(i, "imports"), *tell(i, "imports", external_imports="external", resolved_imports="resolved is not null"), count(x.calls, "calls"), *tell(x.calls, "calls", resolved_calls="callee is not null"),
        count(e, "edges"), *tell(e, "edges", import_edges="kind = 'import'", call_edges="kind = 'call'"), count(e, "weight", F.sum("weight")), *tell(r, "records", routes="record = 'route'", protected="record = 'route' and auth", routers="record = 'router'", mounts="record = 'mount'", models="record = 'model'", queries="record = 'query'", errors="record = 'error'"),
        count(x.skipped, "skipped"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        view_layer_cards, view_graph_facets, view_endpoint_facets, view_capped_nodes, view_capped_edges, view_boards, view_services, view_affected_workflows, view_symbols, view_endpoints, view_query_filter,
        view_files, view_files_shown, view_chunk_counts, view_prompts, view_overview,
    )
}

_DEGREES = """, deg AS (SELECT path, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT source AS path, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target, 1, 0 FROM edges) GROUP BY path),
coupled AS (SELECT n.*, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) + coalesce(fan_out, 0) AS coupling FROM nodes n LEFT JOIN deg USING (path))"""
_ALL = f"{_W}{_EDGES}{_NODES}{_SYMBOLS}{_OTHER}{_DEGREES}"
_EVERY = ", every AS (SELECT path FROM syms UNION ALL SELECT path FROM other WHERE record = 'symbol')"
_REGIONS = "(SELECT count(DISTINCT n_regionkey) FROM supplier JOIN nation ON n_nationkey = s_nationkey)"
_STEPS = _CODE["code_workflows"].split("\nSELECT route")[0]

ORACLES = {
    "view_layer_cards": f"""{_ALL}{_EVERY}, c AS (SELECT layer, count(*) AS files, sum(loc)::BIGINT AS loc, sum(fan_in)::BIGINT AS fan_in, sum(fan_out)::BIGINT AS fan_out FROM coupled GROUP BY layer),
s AS (SELECT layer, count(*) AS symbols FROM every JOIN nodes USING (path) GROUP BY layer),
w AS (SELECT a.layer, sum(weight)::BIGINT AS weight, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM edges JOIN nodes a ON a.path = source JOIN nodes b ON b.path = target WHERE a.layer <> b.layer GROUP BY 1),
p AS (SELECT layer, string_agg(path, ',' ORDER BY path) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY path) AS r FROM nodes) WHERE r <= 12 GROUP BY layer)
SELECT layer, files, loc, coalesce(symbols, 0) AS symbols, fan_in, fan_out, coalesce(weight, 0) AS weight, coalesce(kinds, '') AS kinds, samples FROM c LEFT JOIN s USING (layer) LEFT JOIN w USING (layer) LEFT JOIN p USING (layer)""",
    "view_graph_facets": f"""{_ALL} SELECT 'layer' AS facet, layer AS value, count(*) AS nodes, sum(loc)::BIGINT AS loc, count(*) FILTER (coupling >= 12) AS high_coupling FROM coupled GROUP BY layer
UNION ALL SELECT 'language', language, count(*), sum(loc)::BIGINT, count(*) FILTER (coupling >= 12) FROM coupled GROUP BY language""",
    "view_endpoint_facets": f"""{_W} SELECT 'method' AS facet, CASE WHEN i % 2 = 0 THEN 'GET' ELSE 'POST' END AS value, count(*) AS n FROM read GROUP BY 2 UNION ALL SELECT 'framework', 'FastAPI', count(*) FROM read
UNION ALL SELECT 'total', 'endpoints', count(*) FROM read UNION ALL SELECT 'total', 'authenticated', count(*) FROM read WHERE i % 3 = 0""",
    "view_capped_nodes": f"{_BOTH}{_DEGREE} SELECT id, coupling FROM coupled ORDER BY coupling DESC, path, id LIMIT 1600",
    "view_capped_edges": f"""{_BOTH}{_DEGREE}, keep AS (SELECT id FROM coupled WHERE layer = 'ECONOMY' ORDER BY coupling DESC, path, id LIMIT 300)
SELECT source, target, kind, weight FROM edges WHERE kind = 'import' AND source IN (FROM keep) AND target IN (FROM keep) ORDER BY weight DESC, source, target LIMIT 100""",
    "view_boards": f"""{_ALL} SELECT * FROM (SELECT 'coupling' AS board, path, '' AS name, coupling::BIGINT AS value FROM coupled ORDER BY coupling DESC, path LIMIT 15) WHERE value >= 12
UNION ALL SELECT * FROM (SELECT 'length', path, '', loc::BIGINT AS value FROM coupled WHERE NOT is_test ORDER BY loc DESC, path LIMIT 15) WHERE value >= 100
UNION ALL SELECT * FROM (SELECT 'complexity', path, name, complexity::BIGINT AS value FROM syms WHERE kind = 'function' ORDER BY complexity DESC, path, name LIMIT 12) WHERE value >= 2
UNION ALL SELECT * FROM (SELECT 'untested', s.path, s.name, s.loc::BIGINT FROM syms s JOIN nodes n ON n.path = s.path WHERE exported AND kind = 'function' AND NOT is_test AND layer NOT IN ('other', 'config', 'test', 'docs')
  AND s.name NOT IN (SELECT run FROM tests) ORDER BY s.loc DESC, s.path, s.name LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'alone', path, '', 0::BIGINT FROM coupled WHERE coupling = 0 AND NOT is_test AND path NOT LIKE 'alembic/%' ORDER BY path LIMIT 10)""",
    "view_services": f"""{_W} SELECT r.path AS file_path, handler, line::INT AS line, CASE WHEN i % 4 < 3 THEN part END AS service FROM read r""",
    "view_affected_workflows": f"""{_STEPS}, e AS (SELECT m.path AS source, d.path AS target FROM deps JOIN m USING (i) JOIN m AS d ON d.i = deps.j UNION SELECT path, part FROM read UNION SELECT path, 'api/supplier_' || s || '.py' FROM mounts UNION SELECT test, path FROM tests),
one AS (SELECT source AS path FROM e WHERE target = 'services/part_20.py'), cone AS (SELECT 'services/part_20.py' AS path UNION SELECT path FROM one UNION SELECT source FROM e WHERE target IN (SELECT path FROM one))
SELECT route, arg_min(file, (step, file)) AS file FROM (SELECT * FROM steps WHERE step <= 14) WHERE file IN (SELECT path FROM cone) GROUP BY route""",
    "view_symbols": f"{_W}{_SYMBOLS} SELECT path, name, signature FROM syms WHERE contains(lower(name), 'part1') OR contains(lower(signature), 'part1') ORDER BY length(name), name, path LIMIT 50",
    "view_endpoints": f"""{_W} SELECT 'GET' AS method, '/n' || nation || '/s' || s || '/p' || i AS path, handler FROM read WHERE i % 2 = 0 AND contains(handler, 'read_1')""",
    "view_query_filter": f"""{_W} SELECT path, 'Part' || i AS name, '' AS "table" FROM m WHERE contains(path, 'part_1') UNION ALL SELECT '', 'Part' || i, 'part_' || i FROM m WHERE contains('part_' || i, 'part_1')""",
    "view_files": f"{_W}{_NODES} SELECT path, layer FROM nodes WHERE layer = 'route' AND contains(path, 'part_1') ORDER BY path LIMIT 30",
    "view_files_shown": f"""{_W}, t AS (SELECT path, i, strlen(repeat(chr(34), 3) || 'Part ' || i || '.' || repeat(chr(34), 3) || chr(10) || 'import json' || chr(10) || coalesce((SELECT string_agg('from ' || x.module || ' import ' || x.run || chr(10), '') FROM deps JOIN m AS x ON x.i = j WHERE deps.i = m.i), '')
  || chr(10) || 'class Part' || i || '(Base):' || chr(10) || '    __tablename__ = ''part_' || i || '''' || chr(10) || '    id = Column(Integer)' || chr(10) || CASE WHEN r = 1 THEN '    near = relationship(''Part' || first || ''')' || chr(10) ELSE '' END
  || chr(10) || chr(10) || 'def run_' || i || '(x):' || chr(10) || '    if x:' || chr(10) || '        json.dumps(x)' || chr(10) || coalesce((SELECT string_agg('        run_' || j || '(x)' || chr(10), '') FROM deps WHERE deps.i = m.i), '') || '    return session.query(Part' || i || ')' || chr(10)) AS n,
  CASE WHEN i % 5 = 0 THEN 'stored' WHEN i % 3 = 0 THEN 'checkout' WHEN i % 3 < 2 THEN 'remote' ELSE 'none' END AS origin FROM m)
SELECT path, origin, CASE WHEN origin = 'none' THEN 0 ELSE least(n, 260) END::BIGINT AS bytes, origin = 'none' OR n > 260 AS truncated FROM t""",
    "view_chunk_counts": f"{_W}{_SYMBOLS} SELECT 'all' AS facet, NULL::VARCHAR AS value, count(*) AS n FROM syms UNION ALL SELECT 'language', 'python', count(*) FROM syms",
    "view_prompts": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
h AS (SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || left(coalesce(text, ''), 400), chr(10) ORDER BY turn) AS history FROM t WHERE back <= 6 GROUP BY conv_id),
x AS (SELECT doc_id % (SELECT max(conv_id) + 1 FROM conversations) AS conv_id, source AS path, doc_id AS start_line, text, doc_id % 7 / 8 AS score FROM documents WHERE length(text) > 0),
n AS (SELECT *, row_number() OVER w AS n, 1500 - coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY score DESC, path, start_line)),
f AS (SELECT conv_id, count(*) AS excerpts, sum(least(length(text), room))::BIGINT AS chars, string_agg('[' || n || '] ' || path || ':' || start_line || chr(10) || left(text, room::BIGINT), chr(10) || chr(10) ORDER BY n) AS found FROM n WHERE room > 0 GROUP BY conv_id)
SELECT conv_id, turns, coalesce(excerpts, 0) AS excerpts, coalesce(chars, 0) AS chars, sha1(concat_ws(chr(10) || chr(10), history, found)) AS prompt FROM h LEFT JOIN f USING (conv_id)""",
    "view_overview": f"""{_ALL}, k AS (SELECT * FROM (VALUES
  ('files', (SELECT count(*) FROM nodes) + {_REGIONS}), ('loc', (SELECT sum(loc) FROM nodes) + (SELECT count(*) FROM supplier)), ('languages', 5),
  ('folders', 13 + (SELECT count(*) FROM nation) + {_REGIONS}), ('test_files', (SELECT count(*) FROM tests)), ('docs', {_REGIONS}),
  ('symbols', (SELECT count(*) FROM syms) + (SELECT count(*) FROM other WHERE record = 'symbol')), ('functions', (SELECT count(*) FROM syms WHERE kind = 'function') + (SELECT count(*) FROM other WHERE record = 'symbol' AND kind = 'function')),
  ('classes', (SELECT count(*) FROM syms WHERE kind = 'class') + (SELECT count(*) FROM other WHERE record = 'symbol' AND kind = 'class')), ('exported', (SELECT count(*) FROM syms WHERE exported)), ('complexity', (SELECT sum(complexity) FROM syms)),
  ('imports', (SELECT count(*) FROM imports)), ('external_imports', (SELECT count(*) FROM imports WHERE resolved IS NULL)), ('resolved_imports', (SELECT count(*) FROM imports WHERE resolved IS NOT NULL)),
  ('calls', (SELECT count(*) FROM calls)), ('resolved_calls', (SELECT count(*) FROM calls WHERE callee IS NOT NULL)), ('edges', (SELECT count(*) FROM edges)), ('import_edges', (SELECT count(*) FROM edges WHERE kind = 'import')),
  ('call_edges', (SELECT count(*) FROM edges WHERE kind = 'call')), ('weight', (SELECT sum(weight) FROM edges)), ('routes', (SELECT count(*) FROM read)), ('protected', (SELECT count(*) FROM read WHERE i % 3 = 0)),
  ('routers', (SELECT count(*) FROM apis) + (SELECT count(*) FROM apps)), ('mounts', (SELECT count(*) FROM mounts)), ('models', (SELECT count(*) FROM m)), ('queries', (SELECT count(*) FROM m)), ('errors', 0), ('skipped', 0)) AS t(name, n))
SELECT name, n::BIGINT AS n FROM k""",
}
