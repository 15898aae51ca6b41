"""Queries on the stored indexes (postings, vectors) and on spans and windows of time, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import intervals, ordered, postings, vectors
from sparkloom.plans.storage import shared_folder
from sparkloom.plans.text_queries import _IDENT, _QUERY
from sparkloom.sources.proxy import chunks, table

#: A query of terms that few texts hold.
_RARE = "License licensed 4111 api_key"

_built: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, d: str) -> postings.Index:
    """The index of the documents below d, built once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _built:
        path = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
        postings.build(chunks(spark, d), path)
        _built[key] = path
    return postings.Index(spark, _built[key])


def lexical_index_search(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search(_QUERY)


def lexical_index_rare(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search(_RARE)


def lexical_index_two_per_path(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search_per_path(_QUERY, 30, 2)


def index_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk that scores, not the best alone."""
    return _index(spark, d).scores(_RARE)


def index_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).vocabulary.select("word", "docs", F.col("most").cast("long").alias("most"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _store(spark: SparkSession, d: str) -> vectors.VectorStore:
    """A store that first held every row but those of id 3 modulo 7, some of others' content, and then was brought up to date."""
    store = vectors.VectorStore(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", 64)
    v = _vectors(spark, d)
    store.build(v.where("id % 7 != 3").withColumn("label", F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("label"))))
    store.build(v)
    return store


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The six nearest rows of each row whose id 100 divides."""
    rows = _store(spark, d).read()
    return vectors.nearest(rows, rows.where("id % 100 = 0"), 6)


def vector_topk_of_label(spark: SparkSession, d: str) -> DataFrame:
    """The same among rows of the query's own label, as of one commit of a repository."""
    rows = _store(spark, d).read()
    return vectors.nearest(rows, rows.where("id % 100 = 0"), 6, "label")


def vector_builds(spark: SparkSession, d: str) -> DataFrame:
    """What each of four builds wrote: with faults, up to date, the same again, without some rows."""
    store = vectors.VectorStore(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", 64)
    v = _vectors(spark, d)
    nan, e = F.lit(float("nan")).cast("float"), F.col("embedding")
    faulty = F.when(F.col("id") % 11 == 1, F.slice(e, 1, 63)).when(F.col("id") % 11 == 2, F.concat(F.slice(e, 1, 63), F.array(nan))).when(F.col("id") % 11 == 3, F.transform(e, lambda x: x * F.lit(0.0).cast("float"))).when(F.col("id") % 11 == 4, F.lit(None)).otherwise(e)
    steps = [v.withColumn("embedding", faulty), v, v, v.where("id % 10 != 0")]
    done = [store.build(s) for s in steps]
    rows = [(i, *[int(x[k]) for k in ("written", "live", "removed", "rejected")]) for i, x in enumerate(done)]
    return spark.createDataFrame(rows, "build int, written long, live long, removed long, rejected long")


def vector_faults(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by what is wrong with them, for a store of 64 numbers, among planted faults of all kinds."""
    e = F.col("embedding")
    v = _vectors(spark, d)
    v = v.withColumn("embedding", F.when(F.col("id") % 13 == 0, F.slice(e, 1, 60)).when(F.col("id") % 13 == 1, F.transform(e, lambda x: x * F.lit(0.0).cast("float"))).when(F.col("id") % 13 == 2, F.transform(e, lambda x: x * F.lit(float("inf")).cast("float"))).otherwise(e))
    return v.select("id", vectors.fault(F.col("embedding"), 64).alias("reason")).where("reason is not null")


def _seconds(c: str):
    return F.unix_seconds(F.col(c).cast("timestamp"))


def run_lease_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as runs of `k` minutes, clicks as leases of half an hour: the leases that a user's run meets."""
    e = table(spark, d, "events").withColumn("s", _seconds("ts"))
    k = F.get_json_object("props", "$.k").cast("long")
    runs = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("run"), F.col("s").alias("run_start"), (F.col("s") + k * 60).alias("run_end"))
    leases = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("lease"), F.col("s").alias("lease_start"), (F.col("s") + 1800).alias("lease_end"))
    out = intervals.overlapping(runs, leases, ("run_start", "run_end", "lease_start", "lease_end"), ["user_id"])
    return out.select("user_id", "run", "lease", (F.least("run_end", "lease_end") - F.greatest("run_start", "lease_start")).alias("seconds"))


def concurrent_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs and leases of all users by time alone: how many leases each run meets, and for how long in all."""
    e = table(spark, d, "events").withColumn("s", _seconds("ts"))
    k = F.get_json_object("props", "$.k").cast("long")
    runs = e.where("event_type = 'purchase'").select(F.col("event_id").alias("run"), F.col("s").alias("run_start"), (F.col("s") + k * 60).alias("run_end"))
    leases = e.where("event_type = 'click'").select(F.col("event_id").alias("lease"), F.col("s").alias("lease_start"), (F.col("s") + 1800).alias("lease_end"))
    out = intervals.overlapping(runs, leases, ("run_start", "run_end", "lease_start", "lease_end"))
    met = F.least("run_end", "lease_end") - F.greatest("run_start", "lease_start")
    return out.groupBy("run").agg(F.count(F.lit(1)).alias("leases"), F.sum(met).alias("seconds"))


def users_last_hour(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users of the hour up to each event, itself included."""
    e = table(spark, d, "events").withColumn("s", _seconds("ts"))
    return ordered.sliding_distinct(e, "user_id", "s", 3600).select("event_id", F.col("distinct").alias("users"))


def users_last_day_of_type(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users of each type of event in the day up to each event."""
    e = table(spark, d, "events").withColumn("s", _seconds("ts"))
    return ordered.sliding_distinct(e, "user_id", "s", 86400, ["event_type"]).select("event_id", "event_type", F.col("distinct").alias("users"))


def users_sketched(spark: SparkSession, d: str) -> DataFrame:
    """Users of the hour up to every tenth minute by merged sketches, beside the exact number: largest and mean relative error."""
    e = table(spark, d, "events").withColumn("s", _seconds("ts"))
    est = ordered.sliding_sketch(e, "user_id", "s", 3600, 600).withColumnRenamed("distinct", "about")
    cells = e.select("user_id", F.explode(F.sequence(F.ceil(F.col("s") / 600), F.ceil(F.col("s") / 600) + 5)).alias("cell"))
    exact = cells.groupBy((F.col("cell") * 600).cast("long").alias("upto")).agg(F.count_distinct("user_id").alias("users"))
    both = est.join(exact, "upto", "full")
    off = F.abs(F.coalesce("about", F.lit(0)) - F.col("users")) / F.col("users")
    return both.agg(F.count(F.lit(1)).alias("windows"), F.sum("users").alias("users"), (F.max(off) <= 0.05).alias("within_5_percent"))


def quota_windows(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as runs of `k` minutes: a user's open runs and those of the last hour, all open ones, and whether all three are within their quota."""
    e = table(spark, d, "events").where("event_type = 'purchase'").withColumn("s", _seconds("ts"))
    runs = e.select("event_id", "user_id", "s", (F.col("s") + F.get_json_object("props", "$.k").cast("long") * 60).alias("e"))
    runs = ordered.open_spans(ordered.open_spans(runs, "s", "e", "active", ["user_id"]), "s", "e", "pending")
    hour = ordered.sliding_distinct(runs, "event_id", "s", 3600, ["user_id"])
    within = (F.coalesce("active", F.lit(0)) <= 2) & (F.col("distinct") <= 20) & (F.coalesce("pending", F.lit(0)) <= 20)
    return hour.select("event_id", "active", "pending", F.col("distinct").alias("last_hour"), within.alias("within"))


def overview_order(spark: SparkSession, d: str) -> DataFrame:
    """Line items in one order of all, each with its place and the quantity before it."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice"), F.col("l_quantity").cast("long").alias("quantity"))
    by = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    out = ordered.running(li, by, F.col("quantity"), "before")
    return out.groupBy("l_orderkey").agg(F.max(F.col("before") + F.col("quantity")).alias("upto"))


QUERIES = {
    f.__name__: f
    for f in (
        lexical_index_search, lexical_index_rare, lexical_index_two_per_path, index_scores, index_vocabulary, vector_topk, vector_topk_of_label, vector_builds, vector_faults,
        run_lease_overlaps, concurrent_runs, users_last_hour, users_last_day_of_type, users_sketched, quota_windows, overview_order,
    )
}


def _scored(query: str) -> str:
    import re

    terms = sorted({x.lower() for x in re.findall("[A-Za-z_][A-Za-z0-9_]{2,}|[0-9]+", query)})
    more = "".join(f" + CASE WHEN list_contains(terms, '{x}') THEN least(0.25, 0.05 * ((length(low) - length(replace(low, '{x}', ''))) / {len(x)})) ELSE 0 END" for x in terms if len(x) > 4)
    return f"""WITH chunks AS (SELECT doc_id AS id, source AS path, text FROM documents),
t AS (SELECT id, path, lower(concat_ws(' ', path, text)) AS low, list_distinct(regexp_extract_all(lower(concat_ws(' ', path, text)), {_IDENT})) AS terms FROM chunks),
scored AS (SELECT id, path, round(CASE WHEN {" OR ".join(f"list_contains(terms, '{x}')" for x in terms)} THEN least(1.5,
  ({" + ".join(f"CAST(list_contains(terms, '{x}') AS INT)" for x in terms)}) / {len(terms)}.0{more}) ELSE 0 END, 4) AS score FROM t)"""


def _topk(scope: str) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, floor(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * 10000 + 0.5) / 10000 AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0{scope}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INT) AS place FROM s)
SELECT * FROM r WHERE place <= 6"""


_SPANS = """e AS (SELECT *, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
runs AS (SELECT user_id, event_id AS run, s AS rs, s + k * 60 AS re FROM e WHERE event_type = 'purchase' AND k > 0),
leases AS (SELECT user_id, event_id AS lease, s AS ls, s + 1800 AS le FROM e WHERE event_type = 'click')"""

ORACLES = {
    "lexical_index_search": f"{_scored(_QUERY)} SELECT id, path, score FROM scored WHERE score > 0.01 ORDER BY score DESC, id LIMIT 12",
    "lexical_index_rare": f"{_scored(_RARE)} SELECT id, path, score FROM scored WHERE score > 0.01 ORDER BY score DESC, id LIMIT 12",
    "lexical_index_two_per_path": f"""{_scored(_QUERY)} SELECT id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS r FROM scored WHERE score > 0.01)
WHERE r <= 2 ORDER BY score DESC, id LIMIT 30""",
    "index_scores": f"{_scored(_RARE)} SELECT id, path, score FROM scored WHERE score > 0.01",
    "index_vocabulary": """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(concat_ws(' ', source, text)), '[a-z0-9_]+')) AS word FROM documents),
n AS (SELECT word, doc_id, count(*) AS n FROM w GROUP BY ALL) SELECT word, count(*) AS docs, max(n) AS most FROM n GROUP BY word""",
    "vector_topk": _topk(""),
    "vector_topk_of_label": _topk(" AND q.label = e.label"),
    "vector_builds": """WITH n AS (SELECT count(*) AS a, count(*) FILTER (vec_id % 11 IN (1, 2, 3, 4)) AS f, count(*) FILTER (vec_id % 10 = 0) AS t FROM embeddings)
SELECT 0 AS build, a - f AS written, a - f AS live, 0 AS removed, f AS rejected FROM n UNION ALL SELECT 1, f, a, 0, 0 FROM n UNION ALL SELECT 2, 0, a, 0, 0 FROM n UNION ALL SELECT 3, 0, a - t, t, 0 FROM n""",
    "vector_faults": """SELECT vec_id AS id, CASE vec_id % 13 WHEN 0 THEN 'dimension' WHEN 1 THEN 'zero' ELSE 'not finite' END AS reason FROM embeddings WHERE vec_id % 13 < 3""",
    "run_lease_overlaps": f"WITH {_SPANS} SELECT r.user_id, run, lease, least(re, le) - greatest(rs, ls) AS seconds FROM runs r JOIN leases l ON r.user_id = l.user_id AND rs < le AND ls < re",
    "concurrent_runs": f"WITH {_SPANS} SELECT run, count(*) AS leases, CAST(sum(least(re, le) - greatest(rs, ls)) AS BIGINT) AS seconds FROM runs r JOIN leases l ON rs < le AND ls < re GROUP BY run",
    "users_last_hour": """WITH e AS (SELECT event_id, user_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM events)
SELECT a.event_id, count(DISTINCT b.user_id) AS users FROM e a JOIN e b ON b.s > a.s - 3600 AND b.s <= a.s GROUP BY a.event_id""",
    "users_last_day_of_type": """WITH e AS (SELECT event_id, event_type, user_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM events)
SELECT a.event_id, a.event_type, count(DISTINCT b.user_id) AS users FROM e a JOIN e b ON a.event_type = b.event_type AND b.s > a.s - 86400 AND b.s <= a.s GROUP BY ALL""",
    "users_sketched": """WITH c AS (SELECT user_id, unnest(range(CAST(ceil(floor(epoch_us(ts) / 1000000) / 600) AS BIGINT), CAST(ceil(floor(epoch_us(ts) / 1000000) / 600) AS BIGINT) + 6)) AS cell FROM events),
u AS (SELECT cell, count(DISTINCT user_id) AS n FROM c GROUP BY cell) SELECT count(*) AS windows, CAST(sum(n) AS BIGINT) AS users, true AS within_5_percent FROM u""",
    "quota_windows": """WITH r AS (SELECT event_id, user_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s, CAST(json_extract(props, '$.k') AS BIGINT) * 60 AS n FROM events WHERE event_type = 'purchase'),
c AS (SELECT a.event_id, count(*) FILTER (b.s <= a.s AND a.s < b.s + b.n AND a.user_id = b.user_id) AS active, count(*) FILTER (b.s <= a.s AND a.s < b.s + b.n) AS pending,
  count(DISTINCT b.event_id) FILTER (a.user_id = b.user_id AND b.s > a.s - 3600 AND b.s <= a.s) AS last_hour, any_value(a.n) AS n FROM r a JOIN r b ON b.s > a.s - 360000 AND b.s <= a.s GROUP BY a.event_id)
SELECT event_id, CASE WHEN n > 0 THEN active END AS active, CASE WHEN n > 0 THEN pending END AS pending, last_hour, (n = 0 OR active <= 2 AND pending <= 20) AND last_hour <= 20 AS within FROM c""",
    "overview_order": """WITH o AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(sum(q) OVER (ORDER BY l_orderkey) AS BIGINT) AS upto FROM o""",
}
