"""Joins, aggregates, windows, sets and time-driven queries on records, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import paths as p
from sparkloom.operators import endpoints as ep
from sparkloom.operators import graph as g
from sparkloom.plans.graph_queries import _BOTH, _DEGREE
from sparkloom.sources.proxy import DECLARATIONS_SQL, NODES_SQL, declarations, edges, nodes, runs, table
from sparkloom.streaming import sessions as s

_NOW = "2024-01-20 00:00:00"


def endpoint_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return ep.deduplicated(declarations(spark, d))


def endpoint_stats(spark: SparkSession, d: str) -> DataFrame:
    return ep.stats(declarations(spark, d))


def endpoint_filter(spark: SparkSession, d: str) -> DataFrame:
    return ep.filtered(declarations(spark, d), "get", "com", "/fr/").select("method", "path", "file_path", "line")


def endpoint_facets(spark: SparkSession, d: str) -> DataFrame:
    return declarations(spark, d).groupBy("method", "framework").agg(F.count(F.lit(1)).alias("endpoints"))


def latest_run(spark: SparkSession, d: str) -> DataFrame:
    """The newest run of each repository; ties by id."""
    r = runs(spark, d)
    return r.groupBy("repo_id").agg(F.max(F.struct("created_at", "id", "status")).alias("x")).select("repo_id", F.col("x.id").alias("run_id"), F.col("x.status").alias("status"))


def recent_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).orderBy(F.desc("created_at"), "id").limit(100).select("id", "repo_id", "status")


def runs_with_repo(spark: SparkSession, d: str) -> DataFrame:
    """Open runs with their repository's name; a missing one stays null."""
    c = table(spark, d, "customer").where("c_mktsegment != 'BUILDING'").select(F.col("c_custkey").alias("repo_id"), F.col("c_name").alias("repo"))
    return runs(spark, d).where("status = 'O'").join(c, "repo_id", "left").select("id", "repo_id", "repo")


def runs_per_repo(spark: SparkSession, d: str) -> DataFrame:
    """Runs of every repository, none included."""
    n = runs(spark, d).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id")).join(n, "repo_id", "left").select("repo_id", F.coalesce("n", F.lit(0)).cast("long").alias("runs"))


def repos_without_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id"), "c_mktsegment").join(runs(spark, d).where("status = 'P'"), "repo_id", "left_anti")


def repos_with_live_run(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id")).join(runs(spark, d).where("status = 'P'"), "repo_id", "left_semi")


def relations(spark: SparkSession, d: str) -> DataFrame:
    """Model relations: to a region by key; keys moved out of range stay unresolved."""
    n = table(spark, d, "nation").select("n_name", F.when(F.col("n_nationkey") % 7 == 0, F.col("n_regionkey") + 100).otherwise(F.col("n_regionkey")).alias("k"))
    r = table(spark, d, "region")
    return n.join(r, F.col("k") == F.col("r_regionkey"), "left").select(F.col("n_name").alias("model"), F.col("r_name").alias("target"), F.col("r_name").isNotNull().alias("resolved"))


def delete_guard(spark: SparkSession, d: str) -> DataFrame:
    """Repositories with runs that are neither finished nor shared by a part buyer: all minus owned, plus shared."""
    r = runs(spark, d)
    every, owned, shared = r.select("repo_id"), r.where("status = 'F'").select("repo_id"), r.where("status = 'P'").select("repo_id")
    return every.subtract(owned).union(shared).distinct()


def argmin_service(spark: SparkSession, d: str) -> DataFrame:
    """For each order the supplier of the lowest flag rank, then line: the callee of the lowest layer."""
    li = table(spark, d, "lineitem")
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    g = li.groupBy("l_orderkey").agg(F.min(F.struct(rank.alias("r"), "l_linenumber", "l_suppkey")).alias("x"))
    return g.select("l_orderkey", F.col("x.l_suppkey").alias("service"), F.col("x.r").alias("rank"))


def first_match(spark: SparkSession, d: str) -> DataFrame:
    """Ordered candidates, first that exists wins: supplier keys tried against customers."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    tries = F.array(F.col("l_partkey") * 3, F.col("l_partkey"), F.col("l_suppkey"))
    c = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.posexplode(tries).alias("pos", "k"))
    hit = c.join(table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k", "left_semi")
    return hit.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.min_by("k", "pos").alias("resolved"), F.min("pos").alias("pos"))


def unique_definition(spark: SparkSession, d: str) -> DataFrame:
    """Names defined once: callers resolve to them only then."""
    n = table(spark, d, "part").withColumn("p_name", F.concat_ws(" ", "p_name", "p_brand", "p_size")).groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("id")).where("n = 1")
    return n.select(F.col("p_name").alias("name"), "id")


def rollup_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Symbol counts by kind and in all."""
    return table(spark, d, "part").rollup("p_type").agg(F.count(F.lit(1)).alias("symbols")).select(F.coalesce("p_type", F.lit("all")).alias("kind"), "symbols")


def framework_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Sum of marker weights a brand, .99 at most, with up to four kinds of evidence."""
    w = F.when(F.col("p_size") % 4 == 0, 0.75).when(F.col("p_size") % 4 == 1, 0.7).otherwise(0.0)
    e = table(spark, d, "part").where("p_size < 3 or p_size > 48").select("p_brand", "p_type", w.alias("w"))
    g = e.groupBy("p_brand").agg(F.round(F.sum("w"), 2).alias("score"), F.array_join(F.slice(F.array_sort(F.collect_set("p_type")), 1, 4), ",").alias("evidence"))
    return g.where("score > 0").select("p_brand", F.least(F.lit(0.99), F.round(F.least(F.lit(1.0), F.col("score")), 2)).alias("confidence"), "evidence")


def merged_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies by lower-case name: version of the first manifest, number of manifests."""
    o = table(spark, d, "part")
    return o.groupBy(F.lower("p_brand").alias("name")).agg(F.min_by("p_type", "p_partkey").alias("version"), F.countDistinct("p_type").alias("manifests"))


def overview(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return n.agg(
        F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"), F.countDistinct("language").alias("languages"), F.countDistinct(p.dirname(F.col("path"))).alias("modules"),
        F.count_if(F.col("loc") >= 40).alias("large"), F.max("loc").alias("max_loc"), F.round(F.avg("loc"), 2).alias("avg_loc"),
    )


def subtree_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files below every folder."""
    parts = F.split("path", "/")
    n = nodes(spark, d).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("folder"))
    return n.groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


def tree_order(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the root's first folder, folders first, then by lower-case name."""
    parts = F.split("path", "/")
    n = nodes(spark, d).select(F.element_at(parts, 1).alias("name"), (F.size(parts) > 1).alias("folder")).distinct()
    w = Window.partitionBy("folder").orderBy(F.lower("name"))
    return n.withColumn("position", F.row_number().over(w))


def lanes(spark: SparkSession, d: str) -> DataFrame:
    """Place of each file in its layer's lane, most coupled first."""
    w = Window.partitionBy("layer").orderBy(F.desc("coupling"), "path", "id")
    return g.coupled(nodes(spark, d), edges(spark, d)).select("layer", "id", F.row_number().over(w).alias("place"))


def primary_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one key, first wins: line items by order and line."""
    li = table(spark, d, "lineitem")
    g = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("x"))
    return g.select("l_orderkey", "l_linenumber", "x.l_partkey", "x.l_suppkey")


def category_top(spark: SparkSession, d: str) -> DataFrame:
    """The three most frequent event types; ties by name."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


def classified(spark: SparkSession, d: str) -> DataFrame:
    """Category of each page by the most signal words, first category on ties, else general."""
    low = F.lower("url")
    hits = {k: sum((F.contains(low, F.lit(w)).cast("int") for w in ws[1:]), F.contains(low, F.lit(ws[0])).cast("int")) for k, ws in _SIGNALS.items()}
    most = F.greatest(*hits.values())
    out = F.lit(None).cast("string")
    for k in reversed(hits):
        out = F.when(hits[k] == most, k).otherwise(out)
    return table(spark, d, "pages").select("page_id", F.when(most > 0, out).otherwise("general").alias("category"))


_SIGNALS = {"search": ("page=", "ref=", "thth"), "localised": ("/fr/", "/de/", "/es/"), "mobile": ("//m.", "thther"), "blog": ("blog", "tion")}


def progress(spark: SparkSession, d: str) -> DataFrame:
    """Running share of the day's work in each priority: weighted and monotone."""
    g = table(spark, d, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("o_orderpriority")
    run = F.sum("n").over(w.orderBy("day")) / F.sum("n").over(w)
    return g.select("o_orderpriority", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(run, 6).alias("progress"))


def quota_range(spark: SparkSession, d: str) -> DataFrame:
    return s.quota_usage(table(spark, d, "events"))


def lease_sessions(spark: SparkSession, d: str) -> DataFrame:
    x = s.leases(table(spark, d, "events"))
    return x.select("user_id", F.unix_seconds("start").alias("start"), F.unix_seconds("last_seen").alias("last_seen"), "events")


def live_leases(spark: SparkSession, d: str) -> DataFrame:
    return s.live_leases(table(spark, d, "events"), _NOW, 60 * 24 * 3).select("user_id", F.unix_seconds("last_seen").alias("last_seen"))


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """At most three accepted events in any twelve hours of a user; denied ones do not count."""
    return s.rate_limited(table(spark, d, "events"), 12 * 3600.0, 3)


def expired_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Events whose time to live of 24 hours is over at the given time, the boundary included."""
    e = table(spark, d, "events")
    return e.where(F.col("ts").cast("timestamp") + F.expr("INTERVAL 24 HOURS") <= F.to_timestamp(F.lit(_NOW))).groupBy("event_type").agg(F.count(F.lit(1)).alias("expired"))


def active_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Users and events of each day."""
    e = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return e.agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("events"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Sums of a JSON property by event type."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count(k).alias("n"))


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    """One JSON artifact a layer."""
    g = nodes(spark, d).groupBy("layer").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))
    return g.select("layer", F.to_json(F.struct("layer", "files", "loc")).alias("artifact"))


def path_layers(spark: SparkSession, d: str) -> DataFrame:
    """Layers, languages and roles of paths made from documents' sources."""
    folder = F.element_at(F.array(*[F.lit(x) for x in _FOLDERS]), (F.col("doc_id") % len(_FOLDERS) + 1).cast("int"))
    x = table(spark, d, "documents").select("doc_id", F.concat(folder, F.lit("/"), "source", F.lit("."), F.element_at(F.array(F.lit("py"), F.lit("md"), F.lit("ts")), (F.col("doc_id") % 3 + 1).cast("int"))).alias("path"))
    return x.select("doc_id", "path", p.layer(F.col("path")).alias("layer"), p.language(F.col("path")).alias("language"), p.is_test(F.col("path")).alias("test"), p.is_example(F.col("path")).alias("example"))


_FOLDERS = ("src/api/v1", "src/services/mail", "tests/unit", "app/models", "lib/ui/hooks", "examples/basic", "pkg")


def app_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes of page files named after pages."""
    path = F.concat(F.lit("web/app/(shop)/"), F.regexp_extract("url", r"/([a-z]{2})/", 1), F.lit("/[id]/page.tsx"))
    return table(spark, d, "pages").select("page_id", p.app_route(path).alias("route"))


def methods_split(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints by single method, where a declaration names several."""
    m = F.when(F.col("page_id") % 3 == 0, "GET/POST").otherwise("GET")
    return table(spark, d, "pages").select(F.explode(F.split(m, "/")).alias("method")).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        endpoint_dedupe, endpoint_stats, endpoint_filter, endpoint_facets, latest_run, recent_runs, runs_with_repo, runs_per_repo, repos_without_runs, repos_with_live_run, relations, delete_guard,
        argmin_service, first_match, unique_definition, rollup_kinds, framework_confidence, merged_dependencies, overview, subtree_counts, tree_order, lanes, primary_keys, category_top, classified,
        progress, quota_range, lease_sessions, live_leases, rate_limit, expired_chunks, active_distinct, json_props, artifacts, path_layers, app_routes, methods_split,
    )
}

_RUNS = "WITH runs AS (SELECT o_orderkey AS id, o_custkey AS repo_id, o_orderstatus AS status, o_orderdate AS created_at FROM orders)"
_RANK = "struct_pack(a := CAST(is_test AS INT), b := CAST(is_example AS INT), c := CASE WHEN coalesce(framework, '') = '' THEN 1 ELSE 0 END, d := length(file_path), file_path := file_path, line := coalesce(line, 0))"
_DEDUPED = f"""WITH {DECLARATIONS_SQL}, g AS (SELECT method, path, min({_RANK}) AS best, count(DISTINCT (file_path, line)) AS declarations FROM declarations GROUP BY ALL),
e AS (SELECT method, path, best.file_path AS file_path, best.line AS line, declarations FROM g)"""


def _signal(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(url), '{w}') AS INT)" for w in words) + ")"


ORACLES = {
    "rate_limit": """WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT event_id, user_id, k, true AS accepted, [t] AS log FROM o WHERE k = 1
  UNION ALL SELECT o.event_id, o.user_id, o.k, len(list_filter(log, lambda x: x > o.t - 43200)) < 3,
    CASE WHEN len(list_filter(log, lambda x: x > o.t - 43200)) < 3 THEN list_append(list_filter(log, lambda x: x > o.t - 43200), o.t) ELSE list_filter(log, lambda x: x > o.t - 43200) END
  FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1) SELECT event_id, user_id, accepted FROM w""",
    "endpoint_dedupe": f"{_DEDUPED} SELECT * FROM e",
    "endpoint_stats": f"""{_DEDUPED} SELECT * FROM (SELECT count(*) AS declared, count(*) FILTER (is_example) AS from_examples, count(*) FILTER (is_test) AS from_tests, count(DISTINCT path) AS unique_paths FROM declarations),
  (SELECT count(*) AS endpoints, count(*) FILTER (declarations > 1) AS multi_declared FROM e)""",
    "endpoint_filter": f"WITH {DECLARATIONS_SQL} SELECT method, path, file_path, line FROM declarations WHERE method = 'GET' AND framework = 'com' AND (contains(lower(path), '/fr/') OR contains(lower(file_path), '/fr/'))",
    "endpoint_facets": f"WITH {DECLARATIONS_SQL} SELECT method, framework, count(*) AS endpoints FROM declarations GROUP BY ALL",
    "latest_run": f"{_RUNS} SELECT repo_id, arg_max(id, (created_at, id)) AS run_id, arg_max(status, (created_at, id)) AS status FROM runs GROUP BY repo_id",
    "recent_runs": f"{_RUNS} SELECT id, repo_id, status FROM runs ORDER BY created_at DESC, id LIMIT 100",
    "runs_with_repo": f"{_RUNS} SELECT id, repo_id, c_name AS repo FROM runs LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON c_custkey = repo_id WHERE status = 'O'",
    "runs_per_repo": f"{_RUNS} SELECT c_custkey AS repo_id, count(id) AS runs FROM customer LEFT JOIN runs ON c_custkey = repo_id GROUP BY 1",
    "repos_without_runs": f"{_RUNS} SELECT c_custkey AS repo_id, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT repo_id FROM runs WHERE status = 'P')",
    "repos_with_live_run": f"{_RUNS} SELECT c_custkey AS repo_id FROM customer WHERE c_custkey IN (SELECT repo_id FROM runs WHERE status = 'P')",
    "relations": """SELECT n_name AS model, r_name AS target, r_name IS NOT NULL AS resolved
FROM nation LEFT JOIN region ON r_regionkey = CASE WHEN n_nationkey % 7 = 0 THEN n_regionkey + 100 ELSE n_regionkey END""",
    "delete_guard": f"{_RUNS} (SELECT repo_id FROM runs EXCEPT SELECT repo_id FROM runs WHERE status = 'F') UNION SELECT repo_id FROM runs WHERE status = 'P'",
    "argmin_service": """WITH x AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS r FROM lineitem),
y AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY r, l_linenumber, l_suppkey) AS k FROM x) SELECT l_orderkey, l_suppkey AS service, r AS rank FROM y WHERE k = 1""",
    "first_match": """WITH li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
c AS (SELECT *, unnest([l_partkey * 3, l_partkey, l_suppkey]) AS k, unnest([0, 1, 2]) AS pos FROM li),
h AS (SELECT * FROM c WHERE k IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, arg_min(k, pos) AS resolved, min(pos) AS pos FROM h GROUP BY ALL""",
    "unique_definition": "SELECT p_name || ' ' || p_brand || ' ' || p_size AS name, min(p_partkey) AS id FROM part GROUP BY 1 HAVING count(*) = 1",
    "rollup_kinds": "SELECT coalesce(p_type, 'all') AS kind, count(*) AS symbols FROM part GROUP BY ROLLUP (p_type)",
    "framework_confidence": """WITH e AS (SELECT p_brand, p_type, CASE p_size % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.7 ELSE 0 END AS w FROM part WHERE p_size < 3 OR p_size > 48),
g AS (SELECT p_brand, round(CAST(sum(w) AS DOUBLE), 2) AS score, array_to_string(list_slice(list_sort(list(DISTINCT p_type)), 1, 4), ',') AS evidence FROM e GROUP BY p_brand)
SELECT p_brand, least(CAST(0.99 AS DOUBLE), round(least(CAST(1.0 AS DOUBLE), score), 2)) AS confidence, evidence FROM g WHERE score > 0""",
    "merged_dependencies": "SELECT lower(p_brand) AS name, arg_min(p_type, p_partkey) AS version, count(DISTINCT p_type) AS manifests FROM part GROUP BY 1",
    "overview": rf"""WITH {NODES_SQL} SELECT count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, count(DISTINCT language) AS languages, count(DISTINCT regexp_replace(path, '/?[^/]*$', '')) AS modules,
  count(*) FILTER (loc >= 40) AS large, max(loc) AS max_loc, round(avg(loc), 2) AS avg_loc FROM nodes""",
    "subtree_counts": f"""WITH {NODES_SQL}, x AS (SELECT string_split(path, '/') AS parts FROM nodes), y AS (SELECT parts, unnest(range(1, len(parts))) AS i FROM x)
SELECT array_to_string(list_slice(parts, 1, i), '/') AS folder, count(*) AS files FROM y GROUP BY 1""",
    "tree_order": f"""WITH {NODES_SQL}, x AS (SELECT DISTINCT split_part(path, '/', 1) AS name, contains(path, '/') AS folder FROM nodes)
SELECT name, folder, CAST(row_number() OVER (PARTITION BY folder ORDER BY lower(name)) AS INT) AS position FROM x""",
    "lanes": f"{_BOTH}{_DEGREE} SELECT layer, id, CAST(row_number() OVER (PARTITION BY layer ORDER BY coupling DESC, path, id) AS INT) AS place FROM coupled",
    "primary_keys": """WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM x WHERE k = 1""",
    "category_top": "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3",
    "classified": f"""WITH h AS (SELECT page_id, {", ".join(f"{_signal(w)} AS {k}" for k, w in _SIGNALS.items())} FROM pages), m AS (SELECT *, greatest({", ".join(_SIGNALS)}) AS most FROM h)
SELECT page_id, CASE WHEN most = 0 THEN 'general' {" ".join(f"WHEN {k} = most THEN '{k}'" for k in _SIGNALS)} END AS category FROM m""",
    "progress": """WITH g AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_orderpriority, strftime(day, '%Y-%m-%d') AS day, round(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY day) / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS progress FROM g""",
    "quota_range": """WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
u AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS used FROM e) SELECT *, used > 20 AS over FROM u""",
    "lease_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_seen, count(*) AS events FROM k GROUP BY user_id, s""",
    "live_leases": f"""SELECT user_id, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_seen FROM events GROUP BY user_id HAVING TIMESTAMP '{_NOW}' - max(ts) < INTERVAL 3 DAY""",
    "expired_chunks": f"SELECT event_type, count(*) AS expired FROM events WHERE ts + INTERVAL 24 HOUR <= TIMESTAMP '{_NOW}' GROUP BY 1",
    "active_distinct": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users, count(*) AS events FROM events GROUP BY 1",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(json_extract(props, '$.k')) AS n FROM events GROUP BY 1",
    "artifacts": f"""WITH {NODES_SQL} SELECT layer, '{{"layer":"' || layer || '","files":' || count(*) || ',"loc":' || CAST(sum(loc) AS BIGINT) || '}}' AS artifact FROM nodes GROUP BY layer""",
    "path_layers": """WITH x AS (SELECT doc_id, doc_id % 7 AS f, doc_id % 3 AS e, source FROM documents)
SELECT doc_id, ['src/api/v1', 'src/services/mail', 'tests/unit', 'app/models', 'lib/ui/hooks', 'examples/basic', 'pkg'][f + 1] || '/' || source || ['.py', '.md', '.ts'][e + 1] AS path,
  CASE WHEN f = 2 THEN 'test' WHEN e = 1 THEN 'docs' ELSE ['route', 'service', '', 'repository', 'ui', 'other', 'other'][f + 1] END AS layer,
  ['python', 'markdown', 'typescript'][e + 1] AS language, f = 2 AS test, f = 5 AS example FROM x""",
    "app_routes": "SELECT page_id, '/' || regexp_extract(url, '/([a-z]{2})/', 1) || '/:id' AS route FROM pages",
    "methods_split": "SELECT 'GET' AS method, count(*) AS n FROM pages UNION ALL SELECT 'POST', count(*) FROM pages WHERE page_id % 3 = 0",
}
