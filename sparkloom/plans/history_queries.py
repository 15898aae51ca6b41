"""Queries on versions, leases that end by timers, payloads, merged artifacts and rows set aside, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import records
from sparkloom.operators.records import Field, Shape
from sparkloom.operators.versions import RunTable
from sparkloom.plans.storage import shared_folder
from sparkloom.sources.proxy import table
from sparkloom.streaming import expiry

#: Seconds since the epoch of 2024-01-20.
_NOW = 1705708800


def _new(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("analysis_id"), "o_custkey")


def _history(spark: SparkSession, d: str) -> RunTable:
    """Orders as rows of runs by status: all, then run F anew, then a write that dies under way, then without run P."""
    runs, o = RunTable(spark, _new(spark, "runs")), _orders(spark, d)
    runs.write(o)
    runs.replace(o.where("analysis_id = 'F'").withColumn("o_custkey", -F.col("o_custkey")))
    broken = F.when(F.col("o_orderkey") % 100 == 7, F.raise_error(F.lit("planted failure"))).otherwise(F.col("o_custkey"))
    try:
        runs.replace(o.withColumn("o_custkey", broken.cast("long")))
    except PySparkException as e:
        if "planted failure" not in str(e):
            raise
    return runs


def run_versions(spark: SparkSession, d: str) -> DataFrame:
    """What a reader sees after two whole writes and one that failed."""
    runs = _history(spark, d)
    return runs.read()


def run_history(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each run in each version, after one run is deleted; the failed write left no version, and its files are swept."""
    runs = _history(spark, d)
    runs.delete(["P"])
    runs.versions.sweep(keep=3)
    each = [runs.read(v).groupBy("analysis_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_custkey").alias("customers")).withColumn("version", F.lit(v)) for v in (1, 2, 3)]
    return each[0].unionByName(each[1]).unionByName(each[2])


def chunk_purge(spark: SparkSession, d: str) -> DataFrame:
    """Events as indexed chunks of a run a day, ten days to live: what a purge leaves, by rewriting the days that hold older ones."""
    e = table(spark, d, "events")
    rows = e.select("event_id", F.date_format(F.col("ts").cast("timestamp"), "dd").alias("analysis_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("indexed_at"))
    chunks = RunTable(spark, _new(spark, "chunks"))
    chunks.write(rows)
    expiry.purged(chunks, "indexed_at", _NOW - 43200, 864000)
    return chunks.read()


def _streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files; a stream reads folders, so a table of one file is picked out of its folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    reader = spark.readStream.schema(table(spark, d, name).schema)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(f"{d}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def expired_leases(spark: SparkSession, d: str) -> DataFrame:
    """Events as heartbeats of a stream: leases of six hours that had ended when it stopped, ten minutes allowed for late ones."""
    stream = _streamed(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _new(spark, "leases")
    ended = expiry.expired_leases(stream, 21600, 600)
    ended.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(ended.schema).parquet(out).withColumnRenamed("key", "user_id")


def stage_progress(spark: SparkSession, d: str) -> DataFrame:
    """Orders as reports of runs by customer: stage by key, part by price."""
    names = F.array(*[F.lit(s) for s in (*expiry.STAGE_WEIGHTS, "complete")])
    o = table(spark, d, "orders")
    reports = o.select((F.col("o_custkey") % 200).alias("run"), "o_orderkey", F.element_at(names, (F.pmod(F.col("o_orderkey") * 7, F.lit(12)) + 1).cast("int")).alias("stage"), ((F.col("o_totalprice").cast("long") % 14 - 2) / 10.0).alias("part"))
    return expiry.weighted_progress(reports, expiry.STAGE_WEIGHTS, "run", "o_orderkey")


# ---- payloads ----------------------------------------------------------------------------------

REPO = Shape((
    Field("id", "c_custkey"), Field("full_name", "c_name"), Field("primary_language", "c_mktsegment"), Field("stars", "c_acctbal", "int"),
    Field("score", "c_acctbal", digits=1), Field("topics_of", "c_nationkey", "string"), Field("description", "missing", "string", ""),
))
RUN = Shape((Field("id", "o_orderkey"), Field("status", "o_orderstatus"), Field("progress", "part", digits=4, default=0.0), Field("started_at", "o_orderdate", time=True), Field("message", "o_orderpriority")))
ISSUE = Shape((Field("id", "s_suppkey"), Field("title", "s_name"), Field("severity", "s_nationkey", "string"), Field("penalty", "s_acctbal", "decimal(12,1)", digits=0), Field("line", "s_name", "int", -1)))
ENDPOINT = Shape((Field("id", "page_id"), Field("path", "url"), Field("bytes", "size", "long"), Field("method", "verb", default="GET"), Field("host", "at.host"), Field("secure", "at.secure", "boolean", False)))
BUNDLE = Shape((
    Field("id", "o_orderkey"),
    Field("run", whole=True, fields=(Field("status", "o_orderstatus"), Field("started_at", "o_orderdate", time=True))),
    Field("nodes", "items", fields=(Field("path", "l_partkey", "string"), Field("loc", "l_quantity", "int"), Field("kind", "l_returnflag"), Field("note", "l_comment", default="none")), most=3),
    Field("files", "parts", most=4),
    Field("owner", fields=(Field("id", "c_custkey"), Field("segment", "c_mktsegment", default="?"))),
))


def payload_repos(spark: SparkSession, d: str) -> DataFrame:
    return REPO.of(table(spark, d, "customer").withColumn("missing", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("of "), "c_mktsegment"))))


def payload_runs(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 1000 / 1024)
    return RUN.of(table(spark, d, "orders").withColumn("part", part))


def payload_issues(spark: SparkSession, d: str) -> DataFrame:
    return ISSUE.of(table(spark, d, "supplier")).withColumn("penalty", F.col("penalty").cast("long"))


def payload_endpoints(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    at = F.when(F.col("page_id") % 5 != 0, F.struct(host.alias("host"), F.startswith("url", F.lit("https")).alias("secure")))
    return ENDPOINT.of(p.select("page_id", "url", F.octet_length("html").alias("size"), F.when(F.col("page_id") % 2 == 0, "POST").alias("verb"), at.alias("at")))


def payload_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their first line items and their customer, as JSON."""
    li = table(spark, d, "lineitem").withColumn("l_comment", F.when(F.col("l_linenumber") % 2 == 0, "even"))
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_comment")))
    items = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(order.alias("items"))  # the few lines of an order
    items = items.withColumn("parts", F.array_sort(F.array_distinct(F.transform("items", lambda x: x["l_partkey"]))))
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.struct("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment")).alias("owner"))
    o = table(spark, d, "orders").join(items, "o_orderkey", "left").join(who.where("o_custkey % 5 != 0"), "o_custkey", "left")
    return BUNDLE.json(o, ["o_orderkey"])


def merged_overviews(spark: SparkSession, d: str) -> DataFrame:
    """Stored overviews made of events, and over them what is live: keys replaced, added, set to null, and objects in place of values."""
    e = table(spark, d, "events")
    text = lambda *parts: F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)])
    stored = text('{"run": {"id": ', "event_id", ', "type": "', "event_type", '", "props": ', "props", '}, "files": [1, 2], "stats": {"users": 1}, "note": "kept"}')
    live = F.when(F.col("event_id") % 4 == 0, text('{"run": {"props": {"k": null, "user": ', "user_id", '}, "stage": "done"}, "files": [3]}')).when(F.col("event_id") % 4 == 1, text('{"run": {"type": {"of": ', "user_id", '}}, "stats": 7}')).when(F.col("event_id") % 4 == 2, "not JSON")
    return records.deep_merged(e.select("event_id", stored.alias("stored"), live.alias("live")), "stored", "live", "payload").select("event_id", "payload")


# ---- rows set aside ----------------------------------------------------------------------------


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Events as texts, some of them broken: numbers that are none, times that are none, values beyond any bound, and no user."""
    i = F.col("event_id")
    return table(spark, d, "events").select(
        i.cast("string").alias("event_id"),
        F.when(i % 17 == 3, "soon").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).alias("ts"),
        F.when(i % 13 == 5, None).when(i % 19 == 4, "u7").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(i % 23 == 6, "1e400").when(i % 29 == 7, "12,5").when(i % 31 == 8, "-3").otherwise(F.col("value").cast("string")).alias("value"),
    )


def _checks() -> list[records.Check]:
    return [records.cast_check("event_id", "long"), records.cast_check("ts", "timestamp"), records.cast_check("user_id", "long"), records.cast_check("value", "double"), records.range_check("value", 0.0, 1e9)]


def quarantined(spark: SparkSession, d: str) -> DataFrame:
    _, bad = records.parted(_raw(spark, d), _checks())
    return bad.select(F.col("event_id").cast("long"), F.explode("problems").alias("p")).select("event_id", "p.column", "p.code", "p.detail")


def accepted(spark: SparkSession, d: str) -> DataFrame:
    good, _ = records.parted(_raw(spark, d), _checks())
    return good.select("event_id", F.unix_seconds("ts").alias("epoch"), "user_id", "value")


def quarantine_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows in, let through and set aside, and how many of these by their first problem."""
    rows = records.checked(_raw(spark, d), _checks())
    first = F.coalesce(F.get("problems", F.lit(0))["code"], F.lit("good"))
    return rows.groupBy(first.alias("code")).agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {
    f.__name__: f
    for f in (
        run_versions, run_history, chunk_purge, expired_leases, stage_progress, payload_repos, payload_runs, payload_issues, payload_endpoints, payload_bundles, merged_overviews,
        quarantined, accepted, quarantine_counts,
    )
}

_RUNS = "o AS (SELECT o_orderkey, o_orderstatus AS analysis_id, o_custkey FROM orders)"
_RAW = """raw AS (SELECT event_id AS i, CASE WHEN event_id % 17 = 3 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts,
  CASE WHEN event_id % 13 = 5 THEN NULL WHEN event_id % 19 = 4 THEN 'u7' ELSE CAST(user_id AS VARCHAR) END AS user_id,
  CASE WHEN event_id % 23 = 6 THEN '1e400' WHEN event_id % 29 = 7 THEN '12,5' WHEN event_id % 31 = 8 THEN '-3' ELSE CAST(value AS VARCHAR) END AS value FROM events),
bad AS (SELECT i AS event_id, 1 AS n, 'ts' AS "column", 'bad_type' AS code, 'not a timestamp: soon' AS detail FROM raw WHERE ts = 'soon'
  UNION ALL SELECT i, 2, 'user_id', 'bad_type', coalesce('not a long: ' || user_id, 'missing') FROM raw WHERE user_id IS NULL OR user_id = 'u7'
  UNION ALL SELECT i, 3, 'value', 'bad_type', 'not a double: ' || value FROM raw WHERE value = '12,5'
  UNION ALL SELECT i, 4, 'value', 'out_of_range', CASE value WHEN '-3' THEN '-3.0' ELSE 'Infinity' END || ' is outside 0.0 to 1000000000.0' FROM raw WHERE value IN ('-3', '1e400'))"""
_WEIGHTS = ", ".join(f"('{s}', {w}, {i})" for i, (s, w) in enumerate([*expiry.STAGE_WEIGHTS.items(), ("complete", 0.0)]))

ORACLES = {
    "run_versions": f"WITH {_RUNS} SELECT o_orderkey, analysis_id, CASE analysis_id WHEN 'F' THEN -o_custkey ELSE o_custkey END AS o_custkey FROM o",
    "run_history": f"""WITH {_RUNS}, v AS (SELECT 1 AS version, analysis_id, o_custkey FROM o UNION ALL SELECT 2, analysis_id, CASE analysis_id WHEN 'F' THEN -o_custkey ELSE o_custkey END FROM o
  UNION ALL SELECT 3, analysis_id, CASE analysis_id WHEN 'F' THEN -o_custkey ELSE o_custkey END FROM o WHERE analysis_id <> 'P')
SELECT version, analysis_id, count(*) AS rows, CAST(sum(o_custkey) AS BIGINT) AS customers FROM v GROUP BY ALL""",
    "chunk_purge": f"""WITH e AS (SELECT event_id, strftime(ts, '%d') AS analysis_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS indexed_at FROM events)
SELECT * FROM e WHERE indexed_at + 864000 > {_NOW - 43200}""",
    "expired_leases": """WITH e AS (SELECT user_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM e),
s AS (SELECT *, sum(CASE WHEN gap >= 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM g),
l AS (SELECT user_id, min(t) AS started, max(t) AS last_seen, max(t) + 21600000 AS expired_at, count(*) AS events FROM s GROUP BY user_id, n)
SELECT * FROM l WHERE expired_at < (SELECT max(t) - 600000 FROM e) OR EXISTS (SELECT 1 FROM l AS m WHERE m.user_id = l.user_id AND m.started > l.started)""",
    "stage_progress": f"""WITH w(stage, weight, k) AS (VALUES {_WEIGHTS}),
r AS (SELECT o_custkey % 200 AS run, o_orderkey, stage, weight, greatest(0.0, least(1.0, (CAST(trunc(o_totalprice) AS BIGINT) % 14 - 2) / 10.0)) AS part FROM orders JOIN w ON w.k = o_orderkey * 7 % 12),
b AS (SELECT *, max(part) OVER (PARTITION BY run, stage ORDER BY o_orderkey) AS best FROM r),
g AS (SELECT *, (best - coalesce(lag(best) OVER (PARTITION BY run, stage ORDER BY o_orderkey), 0)) * weight AS gain FROM b)
SELECT run, o_orderkey, round(sum(gain) OVER (PARTITION BY run ORDER BY o_orderkey), 6)::DOUBLE AS share FROM g""",
    "payload_repos": """SELECT c_custkey AS id, c_name AS full_name, c_mktsegment AS primary_language, CAST(trunc(c_acctbal) AS INT) AS stars, round(c_acctbal, 1) AS score,
  CAST(c_nationkey AS VARCHAR) AS topics_of, CASE WHEN c_custkey % 3 = 0 THEN 'of ' || c_mktsegment ELSE '' END AS description FROM customer""",
    "payload_runs": """SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 4 <> 0 THEN round(o_orderkey % 1000 / 1024, 4) ELSE 0.0 END::DOUBLE AS progress,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS started_at, o_orderpriority AS message FROM orders""",
    "payload_issues": "SELECT s_suppkey AS id, s_name AS title, CAST(s_nationkey AS VARCHAR) AS severity, CAST(round(CAST(s_acctbal AS DECIMAL(12,1)), 0) AS BIGINT) AS penalty, -1 AS line FROM supplier",
    "payload_endpoints": r"""SELECT page_id AS id, url AS path, CAST(strlen(html) AS BIGINT) AS bytes, CASE WHEN page_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN page_id % 5 <> 0 THEN regexp_extract(url, '^https?://([^/]+)', 1) END AS host, page_id % 5 <> 0 AND starts_with(url, 'https') AS secure FROM pages""",
    "payload_bundles": """WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag) AS r FROM lineitem),
n AS (SELECT l_orderkey AS o_orderkey, string_agg('{"path":"' || l_partkey || '","loc":' || CAST(l_quantity AS INT) || ',"kind":"' || l_returnflag || '","note":"' || CASE WHEN l_linenumber % 2 = 0 THEN 'even' ELSE 'none' END || '"}', ',' ORDER BY r) AS nodes
  FROM i WHERE r <= 3 GROUP BY 1),
p AS (SELECT l_orderkey AS o_orderkey, array_to_string(list_slice(list_sort(list_distinct(list(l_partkey))), 1, 4), ',') AS files FROM lineitem GROUP BY 1)
SELECT o_orderkey, '{"id":' || o_orderkey || ',"run":{"status":"' || o_orderstatus || '","started_at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '"},"nodes":[' || coalesce(nodes, '') || '],"files":'
  || coalesce('[' || files || ']', 'null') || ',"owner":' || CASE WHEN c_custkey % 5 <> 0 THEN '{"id":' || c_custkey || ',"segment":"' || CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment ELSE '?' END || '"}' ELSE 'null' END || '}' AS payload
FROM orders LEFT JOIN n USING (o_orderkey) LEFT JOIN p USING (o_orderkey) LEFT JOIN customer ON c_custkey = o_custkey""",
    "merged_overviews": """WITH e AS (SELECT event_id, user_id, event_type AS t, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"files":[3],"note":"kept","run":{"id":' || event_id || ',"props":{"k":null,"user":' || user_id || '},"stage":"done","type":"' || t || '"},"stats":{"users":1}}'
  WHEN 1 THEN '{"files":[1,2],"note":"kept","run":{"id":' || event_id || ',"props":{"k":' || k || '},"type":{"of":' || user_id || '}},"stats":7}'
  ELSE '{"files":[1,2],"note":"kept","run":{"id":' || event_id || ',"props":{"k":' || k || '},"type":"' || t || '"},"stats":{"users":1}}' END AS payload FROM e""",
    "quarantined": f'WITH {_RAW} SELECT event_id, "column", code, detail FROM bad',
    "accepted": f"""WITH {_RAW} SELECT i AS event_id, CAST(epoch(CAST(ts AS TIMESTAMP)) AS BIGINT) AS epoch, CAST(user_id AS BIGINT) AS user_id, CAST(value AS DOUBLE) AS value FROM raw WHERE i NOT IN (SELECT event_id FROM bad)""",
    "quarantine_counts": f"""WITH {_RAW}, f AS (SELECT event_id, arg_min(code, n) AS code FROM bad GROUP BY 1)
SELECT coalesce(code, 'good') AS code, count(*) AS rows FROM raw LEFT JOIN f ON event_id = i GROUP BY 1""",
}
