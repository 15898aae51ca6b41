"""Impact, storage, export and lookup queries, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import graph as g
from sparkloom.operators import impact, resolve, retrieval, store
from sparkloom.plans.graph_queries import _BOTH, _DEGREE, _SCC
from sparkloom.plans.storage import staged
from sparkloom.sources import corpus
from sparkloom.sources.proxy import DECLARATIONS_SQL, NODES_SQL, chunks, declarations, edges, nodes, runs, table

_NOW = "2024-01-20 00:00:00"


def _root(spark: SparkSession, d: str) -> DataFrame:
    return staged(g.coupled(nodes(spark, d), edges(spark, d)).orderBy(F.desc("fan_in"), "path", "id").limit(1).select("id"), "root")


def impact_dependents(spark: SparkSession, d: str) -> DataFrame:
    return impact.cone(edges(spark, d), _root(spark, d)).select("id", "distance")


def affected_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as endpoints of the file with their key that are in the cone."""
    root = _root(spark, d)
    ends = table(spark, d, "supplier").select(F.col("s_name").alias("endpoint"), F.col("s_suppkey").alias("id"))
    return impact.affected(ends, impact.dependents(edges(spark, d), root, 3), root)


def related_tests(spark: SparkSession, d: str) -> DataFrame:
    """Files of the smallest sizes as tests."""
    root = _root(spark, d)
    tests = nodes(spark, d).where("loc <= 20").select("id")
    return impact.related_tests(tests, edges(spark, d), impact.dependents(edges(spark, d), root, 2), root)


def change_risks(spark: SparkSession, d: str) -> DataFrame:
    """Risks of each file: suppliers are endpoints, small files tests, negative balances models, and long files hard to parse."""
    e = staged(edges(spark, d), "edges")
    n = nodes(spark, d).withColumn("complexity", (F.col("loc") / 3).cast("int")).withColumn("parse_error", F.when(F.col("loc") == 50, "deep"))
    s = table(spark, d, "supplier")
    models = s.where("s_acctbal < 0").groupBy(F.col("s_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("models"))
    return impact.risks(n, e, g.strong_components(e).select("id"), s.select(F.col("s_suppkey").alias("id")), n.where("loc <= 4").select("id"), models, high=8, fans=4)


def reverse_callers(spark: SparkSession, d: str) -> DataFrame:
    """Callers of each file, the first forty by id."""
    w = Window.partitionBy("target").orderBy("source")
    c = edges(spark, d).where("kind = 'call'").select("target", "source").distinct()
    return c.withColumn("r", F.row_number().over(w)).where("r <= 40").select("target", "source")


def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose name holds the needle, case aside and without wildcards; shortest name first."""
    p = table(spark, d, "part").where(F.contains(F.lower("p_name"), F.lit("ring")) & F.contains(F.lower("p_type"), F.lit("o")))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).orderBy(F.length("p_name"), "p_name", "p_partkey").limit(50)


def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).where((F.col("id") == 17) & F.col("path").isNotNull()).select("id", "path", "layer").limit(1)


def target_path(spark: SparkSession, d: str) -> DataFrame:
    """The file meant by part of a path."""
    first = nodes(spark, d).orderBy("path", "id").first()["path"]
    return resolve.resolve_target(nodes(spark, d).select("path").distinct(), first.split("/", 1)[1])


def path_in_text(spark: SparkSession, d: str) -> DataFrame:
    """First chunk that holds each item's whole text, and how many do."""
    hit = retrieval.mentions(chunks(spark, d).select("id", "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle")))
    return hit.groupBy(F.col("needle_id").alias("item_id")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("chunks"))


def short_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Which chunks hold the first one, two and three words of each item, or a piece of its first word."""
    words = F.split("text", " ")
    parts = [F.slice(words, 1, n) for n in (1, 2, 3)]
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(F.array(*[F.array_join(p, " ") for p in parts], F.substring("text", 2, 4))).alias("kind", "needle"))
    hit = retrieval.mentions(chunks(spark, d).select("id", "text"), rows.select((F.col("item_id") * 4 + F.col("kind")).alias("needle_id"), "needle"))
    return hit.groupBy("needle_id").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("chunks"))


def scan_budget(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files by source, a tenth of them as many as may be scanned, and a fifth of all bytes."""
    size = F.octet_length("text").cast("long")
    docs = table(spark, d, "documents").select(F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt")).alias("path"), size.alias("size"))
    sums = docs.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).first()
    reason = F.when(F.col("size") == 0, "empty").when(F.col("size") > 20_000, "too large")
    return corpus.budgeted(docs.withColumn("reason", reason), sums["n"] * 3 // 10, sums["b"] // 5)


def marker_join(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of markers: brands by a fixed table."""
    marks = spark.createDataFrame([("Brand#11", "web", 0.75), ("Brand#22", "web", 0.7), ("Brand#33", "store", 0.6)], "p_brand string, framework string, weight double")
    m = table(spark, d, "part").select("p_brand").distinct().join(F.broadcast(marks), "p_brand")
    return m.groupBy("framework").agg(F.round(F.least(F.lit(0.99), F.sum("weight")), 2).alias("confidence"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("evidence"))


def file_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of each layer's files with their counts as one string."""
    k = nodes(spark, d).groupBy("layer", "language").agg(F.count(F.lit(1)).alias("n"))
    part = F.concat_ws(" ", F.col("n").cast("string"), "language")
    return k.groupBy("layer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("language", part.alias("s")))), lambda x: x["s"]), ", ").alias("summary"))


def file_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Greatest line number of each file's records, 1 without any."""
    m = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_linenumber").alias("m"))
    return nodes(spark, d).select("id").join(m, "id", "left").select("id", F.coalesce("m", F.lit(1)).alias("complexity"))


def issue_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 findings in order of emission: severity, then file."""
    rank = F.when(F.col("loc") >= 48, 0).when(F.col("loc") >= 45, 1).otherwise(2)
    return nodes(spark, d).where("loc >= 40").select("id", rank.alias("rank"), "loc").orderBy("rank", "id").limit(200)


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """Workflow seeds: signal paths first, then by path, one a path, the first sixty."""
    x = declarations(spark, d)
    first = F.when(F.col("path").contains("/de/"), 0).when(F.col("path").contains("/fr/"), 1).otherwise(2)
    return x.groupBy("path").agg(F.min(first).alias("rank")).orderBy("rank", "path").limit(60)


def default_file(spark: SparkSession, d: str) -> DataFrame:
    """The file shown first in each layer: largest, least deep, shortest path, path."""
    depth = F.size(F.split("path", "/"))
    key = F.struct((-F.col("loc")).alias("a"), depth.alias("b"), F.length("path").alias("c"), "path", "id")
    return nodes(spark, d).groupBy("layer").agg(F.min(key).alias("k")).select("layer", "k.id", "k.path")


def ownerless_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of repositories that no live lease owns: no event of their number in the last three days."""
    live = table(spark, d, "events").where(F.col("ts").cast("timestamp") >= F.to_timestamp(F.lit(_NOW)) - F.expr("INTERVAL 3 DAYS")).select(F.col("user_id").alias("repo_id"))
    return runs(spark, d).where("status = 'O'").join(live, "repo_id", "left_anti").select("id", "repo_id")


def index_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of each user's index: that of the last event, its type being the model."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")).alias("x"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).join(last, "user_id", "left")
    return c.select("user_id", store.index_status(F.to_timestamp(F.lit("2024-01-31 00:00:00")), F.col("x.ts"), F.col("x.event_type"), "click", 24).alias("status"))


def upsert(spark: SparkSession, d: str) -> DataFrame:
    """Customers with every third one's segment replaced."""
    old = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return store.upserted(old, old.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("NEW")), ["c_custkey"])


def orphaned_repos(spark: SparkSession, d: str) -> DataFrame:
    """Repositories left without runs when the finished ones are deleted."""
    return store.orphaned(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), runs(spark, d).where("status = 'P'"))


def endpoint_markdown(spark: SparkSession, d: str) -> DataFrame:
    x = declarations(spark, d).select("framework", "method", "path").distinct()
    return store.markdown_table(x, ["method", "path"], ["path", "method"], ["framework"])


def layer_artifact(spark: SparkSession, d: str) -> DataFrame:
    x = nodes(spark, d).where("loc >= 49").select("layer", "id", "loc")
    return store.artifact(x, "architecture", ["layer"])


def secret_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a credential, numbered from one."""
    rows = chunks(spark, d).select("id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    return rows.where(F.col("body").rlike(r"""(?i)\b(api[_-]?key|secret|password|passwd|token|private[_-]?key|access[_-]?key)\b\s*[:=]\s*['"][^'"]{6,}['"]""")).select("id", (F.col("line") + 1).alias("line"))


def stage_finish(spark: SparkSession, d: str) -> DataFrame:
    """Status of every stage at the end of a run: running becomes done, what never began is skipped."""
    stages = table(spark, d, "nation").select(F.col("n_name").alias("stage"), F.col("n_nationkey").alias("k"))
    seen = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    s = stages.join(seen, "k", "left")
    return s.select("stage", F.when(F.col("n").isNull(), "skipped").otherwise("done").alias("status"))


QUERIES = {
    f.__name__: f
    for f in (
        impact_dependents, affected_endpoints, related_tests, change_risks, reverse_callers, symbol_search, symbol_lookup, target_path, path_in_text, short_mentions, scan_budget, marker_join, file_summaries, file_complexity, issue_cap,
        seeds, default_file, ownerless_runs, index_status, upsert, orphaned_repos, endpoint_markdown, layer_artifact, secret_lines, stage_finish,
    )
}

_CONE = """, root AS (SELECT id FROM coupled ORDER BY fan_in DESC, path, id LIMIT 1),
walk AS (SELECT id, 0 AS d FROM root UNION SELECT e.source, w.d + 1 FROM walk w JOIN edges e ON e.target = w.id WHERE w.d < {n}),
cone AS (SELECT id, min(d) AS distance FROM walk GROUP BY id HAVING min(d) > 0)"""

ORACLES = {
    "impact_dependents": f"{_BOTH}{_DEGREE}{_CONE.format(n=2)} SELECT id, distance FROM cone ORDER BY distance, id LIMIT 40",
    "affected_endpoints": f"""{_BOTH}{_DEGREE}{_CONE.format(n=3)}, near AS (SELECT id FROM root UNION SELECT id FROM cone)
SELECT s_name AS endpoint, s_suppkey AS id FROM supplier WHERE s_suppkey IN (SELECT id FROM near) ORDER BY endpoint LIMIT 30""",
    "related_tests": f"""{_BOTH}{_DEGREE}{_CONE.format(n=2)}, t AS (SELECT id FROM nodes WHERE loc <= 20)
SELECT id, CASE WHEN id IN (SELECT source FROM edges WHERE target IN (SELECT id FROM root)) THEN 'imports the file' ELSE 'depends on it' END AS reason
FROM t WHERE id IN (SELECT id FROM cone) OR id IN (SELECT source FROM edges WHERE target IN (SELECT id FROM root))""",
    "change_risks": f"""{_BOTH}{_DEGREE}{_SCC}, e0 AS (SELECT id FROM nodes WHERE id IN (SELECT s_suppkey FROM supplier)), e1 AS (SELECT id FROM e0 UNION SELECT target FROM edges WHERE source IN (SELECT id FROM e0)),
e2 AS (SELECT id FROM e1 UNION SELECT target FROM edges WHERE source IN (SELECT id FROM e1)), t0 AS (SELECT id FROM nodes WHERE loc <= 4), t1 AS (SELECT target AS id FROM edges WHERE source IN (SELECT id FROM t0)),
t2 AS (SELECT id FROM t1 UNION SELECT target FROM edges WHERE source IN (SELECT id FROM t1)), t3 AS (SELECT id FROM t2 UNION SELECT target FROM edges WHERE source IN (SELECT id FROM t2))
SELECT id, 'high' AS level, 'high coupling' AS risk FROM coupled WHERE coupling >= 8 UNION ALL SELECT id, 'medium', 'many dependents' FROM coupled WHERE coupling < 8 AND fan_in >= 4
UNION ALL SELECT id, 'high', 'part of a cycle' FROM scc UNION ALL SELECT id, CASE WHEN id IN (SELECT id FROM e0) THEN 'high' ELSE 'medium' END, 'endpoints in its cone' FROM coupled WHERE id IN (SELECT id FROM e2)
UNION ALL SELECT id, 'high', 'defines models' FROM coupled WHERE id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
UNION ALL SELECT id, 'medium', 'high complexity' FROM coupled WHERE floor(loc / 3) >= 15 UNION ALL SELECT id, 'medium', 'no related tests' FROM coupled WHERE id NOT IN (SELECT id FROM t3)
UNION ALL SELECT id, 'low', 'did not parse' FROM coupled WHERE loc = 50""",
    "reverse_callers": f"""{_BOTH}, c AS (SELECT DISTINCT target, source FROM edges WHERE kind = 'call')
SELECT target, source FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY source) AS r FROM c) WHERE r <= 40""",
    "symbol_search": "SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_type), 'o') ORDER BY length(p_name), p_name, p_partkey LIMIT 50",
    "symbol_lookup": f"WITH {NODES_SQL} SELECT id, path, layer FROM nodes WHERE id = 17",
    "target_path": f"""WITH {NODES_SQL}, f AS (SELECT DISTINCT path FROM nodes), q AS (SELECT substr(path, instr(path, '/') + 1) AS q FROM f ORDER BY path LIMIT 1),
r AS (SELECT path, CASE WHEN path = q THEN 1 WHEN ends_with(path, '/' || q) THEN 2 WHEN split_part(path, '/', -1) = split_part(q, '/', -1) THEN 3 WHEN contains(lower(path), lower(q)) THEN 4 END AS rank FROM f, q)
SELECT min(path) AS path, rank FROM r WHERE rank IS NOT NULL GROUP BY rank HAVING rank < 4 OR count(*) = 1 ORDER BY rank LIMIT 1""",
    "path_in_text": "SELECT item_id, min(doc_id) AS first, count(*) AS chunks FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY item_id",
    "short_mentions": """WITH w AS (SELECT item_id, text, string_split(text, ' ') AS ws FROM benchmark),
n AS (SELECT item_id * 4 + k AS needle_id, CASE WHEN k < 3 THEN array_to_string(list_slice(ws, 1, k + 1), ' ') ELSE substr(text, 2, 4) END AS needle FROM w, range(4) r(k))
SELECT needle_id, min(doc_id) AS first, count(*) AS chunks FROM documents d JOIN n ON contains(d.text, n.needle) GROUP BY needle_id""",
    "scan_budget": """WITH f AS (SELECT coalesce(source, '') || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size FROM documents),
s AS (SELECT count(*) * 3 // 10 AS n, sum(size) // 5 AS b FROM f), e AS (SELECT *, CASE WHEN size = 0 THEN 'empty' WHEN size > 20000 THEN 'too large' END AS early FROM f),
k AS (SELECT path, size, row_number() OVER (ORDER BY path) - 1 AS place, sum(size) OVER (ORDER BY path) AS upto FROM e WHERE early IS NULL)
SELECT path, size, early AS reason FROM e WHERE early IS NOT NULL UNION ALL SELECT path, size, CASE WHEN place >= n THEN 'over count' WHEN upto > b THEN 'over budget' END FROM k, s""",
    "marker_join": """WITH m AS (SELECT * FROM (VALUES ('Brand#11', 'web', 0.75), ('Brand#22', 'web', 0.7), ('Brand#33', 'store', 0.6)) AS t(p_brand, framework, weight)),
x AS (SELECT DISTINCT p_brand FROM part) SELECT framework, CAST(round(least(0.99, sum(weight)), 2) AS DOUBLE) AS confidence, string_agg(p_brand, ',' ORDER BY p_brand) AS evidence FROM m JOIN x USING (p_brand) GROUP BY framework""",
    "file_summaries": f"""WITH {NODES_SQL}, k AS (SELECT layer, language, count(*) AS n FROM nodes GROUP BY ALL)
SELECT layer, string_agg(n || ' ' || language, ', ' ORDER BY language) AS summary FROM k GROUP BY layer""",
    "file_complexity": "SELECT p_partkey AS id, coalesce(max(l_linenumber), 1) AS complexity FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1",
    "issue_cap": f"WITH {NODES_SQL} SELECT id, CASE WHEN loc >= 48 THEN 0 WHEN loc >= 45 THEN 1 ELSE 2 END AS rank, loc FROM nodes WHERE loc >= 40 ORDER BY rank, id LIMIT 200",
    "seeds": f"WITH {DECLARATIONS_SQL} SELECT path, min(CASE WHEN contains(path, '/de/') THEN 0 WHEN contains(path, '/fr/') THEN 1 ELSE 2 END) AS rank FROM declarations GROUP BY path ORDER BY rank, path LIMIT 60",
    "default_file": f"""WITH {NODES_SQL} SELECT layer, id, path FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY loc DESC, len(string_split(path, '/')), length(path), path, id) AS r FROM nodes) WHERE r = 1""",
    "ownerless_runs": f"""SELECT o_orderkey AS id, o_custkey AS repo_id FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '{_NOW}' - INTERVAL 3 DAY)""",
    "index_status": """WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS m, max(ts) AS seen FROM events GROUP BY user_id)
SELECT c_custkey AS user_id, CASE WHEN seen IS NULL THEN 'missing' WHEN seen + INTERVAL 24 HOUR <= TIMESTAMP '2024-01-31 00:00:00' THEN 'expired' WHEN m <> 'click' THEN 'stale model' ELSE 'ready' END AS status
FROM customer LEFT JOIN l ON user_id = c_custkey""",
    "upsert": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "orphaned_repos": "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "endpoint_markdown": f"""WITH {DECLARATIONS_SQL}, x AS (SELECT DISTINCT framework, method, path FROM declarations)
SELECT framework, '| method | path |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || method || ' | ' || path || ' |', chr(10) ORDER BY path, method) AS markdown FROM x GROUP BY framework""",
    "layer_artifact": f"""WITH {NODES_SQL} SELECT layer, '[' || string_agg('{{"id":' || id || ',"loc":' || loc || '}}', ',' ORDER BY id) || ']' AS payload, 'architecture' AS kind FROM nodes WHERE loc >= 49 GROUP BY layer""",
    "secret_lines": r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT id, CAST(line AS INT) AS line FROM l WHERE regexp_matches(body, '(?i)\b(api[_-]?key|secret|password|passwd|token|private[_-]?key|access[_-]?key)\b\s*[:=]\s*[''"][^''"]{6,}[''"]')""",
    "stage_finish": """SELECT n_name AS stage, CASE WHEN count(s_suppkey) > 2 THEN 'done' ELSE 'skipped' END AS status FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""",
}
