"""Run control and report queries, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import control, impact, ordered, reports
from sparkloom.operators import graph as g
from sparkloom.plans.graph_queries import _BOTH, _DEGREE
from sparkloom.plans.report_queries import _CONE, _root
from sparkloom.plans.storage import staged
from sparkloom.sources.proxy import DECLARATIONS_SQL, NODES_SQL, chunks, declarations, edges, nodes, table

#: Seconds since the epoch of 2024-01-20.
_NOW = 1705708800.0


def _leases(spark: SparkSession, d: str) -> DataFrame:
    """Events as leases: a user's session of each type on runs of their number."""
    e = table(spark, d, "events").select((F.col("user_id") % 40).alias("run_id"), F.concat_ws("-", "user_id", "event_type").alias("session_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("epoch"))
    return e.where(F.col("epoch") <= _NOW).groupBy("run_id", "session_id").agg(F.max("epoch").alias("last_seen"))


_LEASES = f"""e AS (SELECT user_id % 40 AS run_id, user_id || '-' || event_type AS session_id, epoch_us(ts) / 1e6 AS epoch FROM events),
leases AS (SELECT run_id, session_id, max(epoch) AS last_seen FROM e WHERE epoch <= {_NOW} GROUP BY ALL)"""


def lease_release(spark: SparkSession, d: str) -> DataFrame:
    """Whether run 7 is orphaned once a session lets go, for a short and a long time to live."""
    x = _leases(spark, d)
    return control.released(x, 7, "7-click", _NOW, 3600.0).unionByName(control.released(x, 7, "7-click", _NOW, 864000.0))


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """Leases of a day, customers as sessions that expire by their balance, suppliers as runs."""
    sessions = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.lit(_NOW) + F.col("c_acctbal")).alias("expires_at"), (F.lit(_NOW) - F.col("c_custkey") * 60.0).alias("last_seen"))
    runs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return control.swept(runs, _leases(spark, d), sessions, _NOW, 86400.0, 36000.0)


def browser_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Users' visits: three days to live, touched every half day."""
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("epoch"))
    return control.sliding_sessions(e, 259200.0, 43200.0)


def run_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs on branches by priority; customers ask for one, every fifth by force."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("complete")
    runs = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repo_id"), F.left("o_orderpriority", F.lit(1)).alias("branch"), (F.col("o_custkey") % 3).alias("session_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id"), F.lit("1").alias("branch"), F.lit(1).cast("long").alias("session_id"), (F.col("c_custkey") % 5 == 0).alias("force"))
    return control.reusable(runs, wanted).select("repo_id", "run_id")


def ready_run(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("running").alias("status"))
    return control.ready(r, r.where("status = 'complete'").agg(F.min("id")).first()[0])


def default_branches(spark: SparkSession, d: str) -> DataFrame:
    """Nations as branches of their regions; France and Japan are called main."""
    name = F.when(F.col("n_nationkey") % 9 == 4, "main").when(F.col("n_nationkey") % 9 == 7, "master").otherwise(F.col("n_name"))
    return control.with_default(table(spark, d, "nation").select(F.col("n_regionkey").alias("repo_id"), F.col("n_nationkey").alias("place"), name.alias("name")))


def repo_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    name = F.concat(F.lit(" "), F.col("p_type"), F.lit("/"), F.col("p_brand"))
    plain = F.concat(F.col("p_type"), F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(" "))
    return p.select("p_partkey", control.repo_key(name).alias("bad"), control.repo_key(plain).alias("key"), control.clean_commit(F.upper(F.hex("p_partkey"))).alias("short"), control.clean_commit(F.upper(F.md5(F.col("p_partkey").cast("string")))).alias("sha"))


def scrubbed_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).select("id", "path", F.when(F.col("id") % 2 == 0, F.lit("load")).alias("symbol"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("__INDEX__ "), F.col("path"))).otherwise(F.col("text")).alias("text"))
    return control.scrubbed(c).select("id", "text")


def ages(spark: SparkSession, d: str) -> DataFrame:
    """Words for the age of each event as of the last one, and of each order."""
    e = table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return e.select("event_id", control.since(F.floor((F.lit(1706659200000000) - F.col("t")) / 1e6) * F.pmod("event_id", F.lit(50)) / 20).alias("age"))


def _issues(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("loc") >= 45, "high").when(F.col("loc") >= 30, "medium").otherwise("low")
    return nodes(spark, d).select("id", F.col("layer").alias("kind"), severity.alias("severity"), F.concat(F.lit("Found in "), F.col("language")).alias("title"), F.array("path").alias("files"))


_ISSUES = f"WITH {NODES_SQL}, issues AS (SELECT id, layer AS kind, CASE WHEN loc >= 45 THEN 'high' WHEN loc >= 30 THEN 'medium' ELSE 'low' END AS severity, 'Found in ' || language AS title, path FROM nodes)"


def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.counted(_issues(spark, d), "kind", "severity")


def issue_filter(spark: SparkSession, d: str) -> DataFrame:
    return reports.issues_shown(_issues(spark, d), "ECONOMY", "high", " RING ").select("id", "title")


def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Files with small sizes are tests; line items are symbols of a complexity by quantity."""
    n, e = nodes(spark, d), edges(spark, d)
    s = table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("complexity"))
    return reports.quality_metrics(n.withColumn("is_test", F.col("loc") <= 5), s, g.coupled(n, e))


def workflow_facets(spark: SparkSession, d: str) -> DataFrame:
    return reports.counted(declarations(spark, d).withColumn("category", F.element_at(F.split("path", "/"), 2)), "category")


def workflow_filter(spark: SparkSession, d: str) -> DataFrame:
    w = declarations(spark, d).select("line", F.col("method").alias("name"), F.col("path").alias("trigger"), F.array("file_path").alias("files"))
    return reports.holding(w, "EXAMPLE.com", "name", "trigger", "files").select("line", "trigger")


def query_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Line items as queries: kind by flag, table by supplier."""
    q = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("status"))
    return reports.counted(q, "kind", "status")


def database_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Brands as technologies, large parts their markers; suppliers use some of them."""
    p = table(spark, d, "part").where("p_size >= 48").select(F.col("p_brand").alias("name"), F.lit("store").alias("kind"), F.concat(F.lit("dependency "), F.col("p_name")).alias("evidence"), F.lit(reports.MARKER_WEIGHT).alias("weight"))
    o = table(spark, d, "supplier").where("s_acctbal < 5000").select(F.concat(F.lit("Brand#"), F.col("s_nationkey")).alias("name"), F.lower("s_name").alias("path"))
    return reports.database_confidence(p.where("name < 'Brand#2'"), o)


def migration_only(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("table"), F.concat(F.lit("m/"), F.col("l_orderkey")).alias("path"))
    return reports.migration_only(m, table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("table")))


def known_orms(spark: SparkSession, d: str) -> DataFrame:
    return reports.known_orms(table(spark, d, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", "unknown").otherwise(F.col("c_mktsegment")).alias("orm")))


def layer_notes(spark: SparkSession, d: str) -> DataFrame:
    """Types as layers."""
    names = {"ECONOMY": "ui", "SMALL": "route", "MEDIUM": "test", "LARGE": "util"}
    layer = F.coalesce(*[F.when(F.col("layer") == k, F.lit(v)) for k, v in names.items()], F.lit("other"))
    return reports.layer_notes(nodes(spark, d).select(layer.alias("layer")))


def handlers_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    """Line items as routes whose handler is their part, defined in the file of the supplier that is least far."""
    li = table(spark, d, "lineitem")
    routes = li.select(F.col("l_partkey").alias("handler"), F.col("l_suppkey").alias("path")).distinct()
    symbols = li.where("l_linenumber = 1").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("path"))
    return reports.handlers_elsewhere(routes, symbols)


def repo_by_name(spark: SparkSession, d: str) -> DataFrame:
    repos = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return reports.by_folded_name(repos, table(spark, d, "supplier").select(F.upper(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("name")))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("path", F.col("id").alias("start_line"), (F.col("id") + 9).alias("end_line"), F.concat(F.lit("text of "), F.col("language")).alias("text"), (1.0 / (1 + F.col("id") % 7)).alias("score"))


_SCORED = f"WITH {NODES_SQL}, s AS (SELECT path, id AS start_line, id + 9 AS end_line, 'text of ' || language AS text, 1.0::DOUBLE / (1 + id % 7) AS score FROM nodes), c AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, path, start_line) AS INT) AS n FROM s)"


def citations(spark: SparkSession, d: str) -> DataFrame:
    return reports.citations(_scored(spark, d))


def prompt_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return reports.prompt_excerpts(_scored(spark, d))


def highlighted(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("id", F.sha1(reports.highlighted(F.col("text"), "the a th.n Then").cast("binary")).alias("digest"))


def language_labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.lower("p_type").alias("language")).union(table(spark, d, "customer").select(F.lit("csharp"))).union(table(spark, d, "nation").select(F.lit("objective_c")))
    return p.distinct().select("language", reports.language_label(F.col("language")).alias("label"))


def selection_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and distinct files of a selection."""
    return chunks(spark, d).where(F.length("text") >= 40).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("path").alias("files"))


def frameworks_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The ordered read of frameworks: by confidence, then name, with the place of each."""
    f = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("framework")).agg(F.round(F.least(F.lit(0.99), F.count(F.lit(1)) * 0.15), 2).alias("confidence"))
    return ordered.ranked(f, [F.col("confidence").desc(), F.col("framework")], "at").select("framework", "confidence", (F.col("at") + 1).cast("int").alias("place"))


def impact_lines(spark: SparkSession, d: str) -> DataFrame:
    """Summary lines of the file of greatest fan-in."""
    root, e = _root(spark, d), staged(edges(spark, d), "edges")
    n = nodes(spark, d).withColumn("complexity", F.lit(1)).withColumn("parse_error", F.lit(None).cast("string"))
    cone = staged(impact.dependents(e, root, 2), "cone")
    tests, none = n.where("loc <= 4").select("id"), nodes(spark, d).limit(0).select("id")
    risks = impact.risks(n, e, g.strong_components(e).select("id"), none, tests, none.withColumn("models", F.lit(0)))
    return reports.impact_lines(n.join(root, "id", "left_semi"), cone, impact.related_tests(tests, e, cone, root), risks)


QUERIES = {
    f.__name__: f
    for f in (
        lease_release, sweep, browser_sessions, run_reuse, ready_run, default_branches, repo_keys, scrubbed_chunks, ages, issue_counts, issue_filter, quality_metrics, workflow_facets, workflow_filter, query_kinds,
        database_confidence, migration_only, known_orms, layer_notes, handlers_elsewhere, repo_by_name, citations, prompt_excerpts, highlighted, language_labels, selection_counts, frameworks_ordered, impact_lines,
    )
}


def _counted(cte: str, rows: str, *facets: str) -> str:
    return f"{cte} SELECT 'all' AS facet, NULL::VARCHAR AS value, count(*) AS n FROM {rows} HAVING count(*) > 0" + "".join(f" UNION ALL SELECT '{f}', CAST({f} AS VARCHAR), count(*) FROM {rows} GROUP BY {f}" for f in facets)


ORACLES = {
    "lease_release": f"""WITH {_LEASES}, t AS (SELECT unnest([3600.0, 864000.0]) AS ttl)
SELECT 7 AS run_id, NOT EXISTS (SELECT 1 FROM leases WHERE run_id = 7 AND session_id <> '7-click' AND last_seen > {_NOW} - ttl) AS orphaned FROM t""",
    "sweep": f"""WITH {_LEASES}, live AS (SELECT * FROM leases WHERE last_seen > {_NOW} - 86400)
SELECT 'lease' AS kind, run_id || '/' || session_id AS id FROM leases WHERE last_seen <= {_NOW} - 86400
UNION ALL SELECT 'session', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal <= 0 OR c_custkey * 60.0 > 36000
UNION ALL SELECT 'run', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey NOT IN (SELECT run_id FROM live)""",
    "browser_sessions": """WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, k, 1 AS visit, t AS opened, t AS touched FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, w.visit + (o.t >= touched + 259200)::INT, CASE WHEN o.t >= touched + 259200 THEN o.t ELSE opened END,
    CASE WHEN o.t >= touched + 259200 OR o.t - touched >= 43200 THEN o.t ELSE touched END FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT user_id AS session_id, visit, opened, max(touched) AS last_touch, count(*) AS requests FROM w GROUP BY user_id, visit, opened""",
    "run_reuse": """WITH r AS (SELECT o_custkey AS repo_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM orders
  WHERE o_orderstatus IN ('O', 'P') AND left(o_orderpriority, 1) = '1' AND o_custkey % 3 = 1 GROUP BY 1)
SELECT c_custkey AS repo_id, CASE WHEN c_custkey % 5 <> 0 THEN run_id END AS run_id FROM customer LEFT JOIN r ON repo_id = c_custkey""",
    "ready_run": "SELECT min(o_orderkey) AS id, 'complete' AS status FROM orders WHERE o_orderstatus = 'F'",
    "default_branches": """WITH b AS (SELECT n_regionkey AS repo_id, n_nationkey AS k, CASE n_nationkey % 9 WHEN 4 THEN 'main' WHEN 7 THEN 'master' ELSE n_name END AS name FROM nation)
SELECT repo_id, name, row_number() OVER (PARTITION BY repo_id ORDER BY name NOT IN ('main', 'master'), k) = 1 AS is_default FROM b""",
    "repo_keys": """SELECT p_partkey, NULL::VARCHAR AS bad, lower(p_type || '/' || replace(p_brand, '#', '-')) AS "key", CASE WHEN length(hex(p_partkey)) >= 7 THEN lower(hex(p_partkey)) END AS short, md5(CAST(p_partkey AS VARCHAR)) AS sha FROM part""",
    "scrubbed_chunks": "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '__INDEX__ ' || source ELSE '__INDEX__ ' || source || ' ' || CASE WHEN doc_id % 2 = 0 THEN 'load' ELSE '' END END AS text FROM documents",
    "ages": """WITH s AS (SELECT event_id, floor((1706659200000000 - epoch_us(ts)) / 1e6) * (event_id % 50) / 20 AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago'
  WHEN s < 2592000 THEN CAST(floor(s / 86400) AS BIGINT) || 'd ago' WHEN s < 31536000 THEN CAST(floor(s / 2592000) AS BIGINT) || 'mo ago' ELSE CAST(floor(s / 31536000) AS BIGINT) || 'y ago' END AS age FROM s""",
    "issue_counts": _counted(_ISSUES, "issues", "kind", "severity"),
    "issue_filter": f"{_ISSUES} SELECT id, title FROM issues WHERE kind = 'ECONOMY' AND severity = 'high' AND (contains(lower(title), 'ring') OR contains(lower(path), 'ring'))",
    "quality_metrics": f"""{_BOTH}{_DEGREE}, f AS (SELECT count(*) AS files, count(*) FILTER (WHERE loc <= 5) AS test_files, CAST(sum(loc) AS BIGINT) AS loc FROM nodes),
s AS (SELECT count(*) AS symbols, round(avg(CAST(trunc(l_quantity) AS INT)), 2) AS avg_complexity, max(CAST(trunc(l_quantity) AS INT)) AS max_complexity FROM lineitem),
c AS (SELECT round(avg(coupling), 2) AS avg_coupling, count(*) FILTER (WHERE coupling = 0) AS uncoupled FROM coupled)
SELECT *, files - test_files AS production_files, round(test_files / greatest(1, files), 3) AS test_file_ratio FROM f, s, c""",
    "workflow_facets": _counted(f"WITH {DECLARATIONS_SQL}, w AS (SELECT split_part(path, '/', 2) AS category FROM declarations)", "w", "category"),
    "workflow_filter": f"WITH {DECLARATIONS_SQL} SELECT line, path AS trigger FROM declarations WHERE contains(lower(method), 'example.com') OR contains(lower(path), 'example.com') OR contains(lower(file_path), 'example.com')",
    "query_kinds": _counted("WITH q AS (SELECT l_returnflag AS kind, l_linestatus AS status FROM lineitem)", "q", "kind", "status"),
    "database_confidence": """WITH m AS (SELECT p_brand AS name, round(least(1.0, sum(0.7::DOUBLE)), 2) AS start, list_slice(list_sort(list(DISTINCT 'dependency ' || p_name)), 1, 4) AS found FROM part WHERE p_size >= 48 AND p_brand < 'Brand#2' GROUP BY 1),
o AS (SELECT 'Brand#' || s_nationkey AS name, count(*) AS uses, list_slice(list_sort(list(DISTINCT lower(s_name))), 1, 4) AS paths FROM supplier WHERE s_acctbal < 5000 GROUP BY 1)
SELECT name, CASE WHEN start IS NULL THEN 'orm' ELSE 'store' END AS kind, CAST(CASE WHEN uses IS NULL THEN start ELSE least(0.95, round(coalesce(start, 0.6) + 0.25 * uses, 2)) END AS DOUBLE) AS confidence,
  array_to_string(list_slice(list_concat(coalesce(found, []), coalesce(paths, [])), 1, 4), ',') AS evidence FROM m FULL JOIN o USING (name)""",
    "migration_only": """SELECT l_suppkey AS "table", min('m/' || l_orderkey) AS path FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1""",
    "known_orms": "SELECT DISTINCT c_mktsegment AS orm FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "layer_notes": """WITH l AS (SELECT list(DISTINCT CASE p_type WHEN 'ECONOMY' THEN 'ui' WHEN 'SMALL' THEN 'route' WHEN 'MEDIUM' THEN 'test' WHEN 'LARGE' THEN 'util' ELSE 'other' END) AS x FROM part)
SELECT 'front end and API' AS note FROM l WHERE list_has_all(x, ['ui', 'route']) UNION ALL SELECT 'service layer' FROM l WHERE list_contains(x, 'service') UNION ALL SELECT 'data access layer' FROM l WHERE list_contains(x, 'repository')
UNION ALL SELECT 'layers by name only' FROM l WHERE NOT list_has_any(x, ['service', 'repository']) UNION ALL SELECT 'tests' FROM l WHERE list_contains(x, 'test')""",
    "handlers_elsewhere": """WITH r AS (SELECT DISTINCT l_partkey AS handler, l_suppkey AS path FROM lineitem), s AS (SELECT DISTINCT l_partkey AS handler, l_suppkey AS path FROM lineitem WHERE l_linenumber = 1)
SELECT handler, path, (SELECT min(s.path) FROM s WHERE s.handler = r.handler) AS defined_in FROM r WHERE (handler, path) NOT IN (SELECT (handler, path) FROM s)""",
    "repo_by_name": """SELECT upper(replace(s_name, 'Supplier', 'Customer')) AS name, (SELECT min(c_custkey) FROM customer WHERE lower(c_name) = lower(replace(s_name, 'Supplier', 'Customer'))) AS id FROM supplier""",
    "citations": f"{_SCORED} SELECT n, path, start_line, end_line, round(score, 3) AS score FROM c",
    "prompt_excerpts": f"""{_SCORED} SELECT string_agg('[' || n || '] ' || path || ':' || start_line || '-' || end_line || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS prompt FROM c""",
    "highlighted": r"SELECT doc_id AS id, sha1(regexp_replace(text, '(the|th\.n|Then)', '<mark>\1</mark>', 'gi')) AS digest FROM documents",
    "language_labels": """WITH p AS (SELECT lower(p_type) AS language FROM part UNION SELECT 'csharp' UNION SELECT 'objective_c')
SELECT language, CASE language WHEN 'csharp' THEN 'C#' WHEN 'objective_c' THEN 'Objective C' ELSE upper(left(language, 1)) || substr(language, 2) END AS label FROM p""",
    "selection_counts": "SELECT count(*) AS chunks, count(DISTINCT source) AS files FROM documents WHERE length(text) >= 40",
    "frameworks_ordered": """WITH f AS (SELECT s_nationkey AS framework, CAST(round(least(0.99, count(*) * 0.15), 2) AS DOUBLE) AS confidence FROM supplier GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY confidence DESC, framework) AS INT) AS place FROM f""",
    "impact_lines": f"""{_BOTH}{_DEGREE}{_CONE.format(n=2)}, scc_pairs AS (SELECT DISTINCT source, target FROM edges), reach AS (SELECT target AS b FROM scc_pairs WHERE source IN (SELECT id FROM root) UNION SELECT p.target FROM reach r JOIN scc_pairs p ON r.b = p.source),
t AS (SELECT id FROM nodes WHERE loc <= 4), t1 AS (SELECT target AS id FROM edges WHERE source IN (SELECT id FROM t)), t2 AS (SELECT id FROM t1 UNION SELECT target FROM edges WHERE source IN (SELECT id FROM t1)),
t3 AS (SELECT id FROM t2 UNION SELECT target FROM edges WHERE source IN (SELECT id FROM t2)), me AS (SELECT * FROM coupled WHERE id IN (SELECT id FROM root)),
rel AS (SELECT count(*) AS n FROM t WHERE id IN (SELECT id FROM cone) OR id IN (SELECT source FROM edges WHERE target IN (SELECT id FROM root))),
risks AS (SELECT 'risk [high]: high coupling' AS r FROM me WHERE coupling >= 12 UNION ALL SELECT 'risk [high]: part of a cycle' WHERE EXISTS (SELECT 1 FROM reach WHERE b IN (SELECT id FROM root))
  UNION ALL SELECT 'risk [medium]: many dependents' FROM me WHERE coupling < 12 AND fan_in >= 5 UNION ALL SELECT 'risk [medium]: no related tests' FROM me WHERE id NOT IN (SELECT id FROM t3))
SELECT 'target: ' || id || ' (layer ' || layer || ', ' || loc || ' loc)' || chr(10) || 'files that depend on it: ' || (SELECT count(*) FROM cone WHERE distance = 1) || chr(10) || 'transitive dependents: ' || (SELECT count(*) FROM cone)
  || chr(10) || 'related tests: ' || (SELECT n FROM rel) || coalesce(chr(10) || (SELECT string_agg(r, chr(10) ORDER BY r) FROM (SELECT r FROM risks ORDER BY r LIMIT 4)), '') AS lines FROM me""",
}
