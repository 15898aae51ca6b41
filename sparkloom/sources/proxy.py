"""Records of a code base played by the driver's tables. Roles, not real code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files: parts. id, path, layer, loc, language."""
    p = table(spark, sf_dir, "part")
    path = F.concat_ws("/", "p_type", "p_brand", "p_name")
    return p.select(F.col("p_partkey").alias("id"), path.alias("path"), F.col("p_type").alias("layer"), F.col("p_size").cast("long").alias("loc"), F.col("p_brand").alias("language"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies: of a part's line items of one return flag, if they hold a first and a seventh line. source, target, kind, weight; no loops, one row a key."""
    n = table(spark, sf_dir, "part").count()
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("source"), F.col("l_returnflag").alias("flag"))
    items = items.agg(F.count(F.lit(1)).alias("weight"), F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"), F.min("l_suppkey").alias("first"), F.sum("l_suppkey").alias("total")).where("low = 1 and high = 7")
    target = F.when(F.col("flag") == "R", F.col("total") * 7).otherwise(F.col("first") * 20 + F.col("weight")) % F.lit(n)
    kind = F.when(F.col("flag") == "A", "import").when(F.col("flag") == "N", "call").otherwise("require")
    return items.select("source", target.alias("target"), kind.alias("kind"), "weight").where("source != target")


#: The same two tables for the checking SQL.
NODES_SQL = """nodes AS (SELECT p_partkey AS id, p_type || '/' || p_brand || '/' || p_name AS path, p_type AS layer,
  CAST(p_size AS BIGINT) AS loc, p_brand AS language FROM part)"""
EDGES_SQL = """edges AS (SELECT * FROM (SELECT l_partkey AS source,
    CAST((CASE l_returnflag WHEN 'R' THEN sum(l_suppkey) * 7 ELSE min(l_suppkey) * 20 + count(*) END) % (SELECT count(*) FROM part) AS BIGINT) AS target,
    CASE l_returnflag WHEN 'A' THEN 'import' WHEN 'N' THEN 'call' ELSE 'require' END AS kind, count(*) AS weight
  FROM lineitem GROUP BY l_partkey, l_returnflag HAVING min(l_linenumber) = 1 AND max(l_linenumber) = 7) WHERE source <> target)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repositories: orders of customers. id, repo_id, status, created_at."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repo_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint declarations: pages. method, path, file_path, line, framework, is_test, is_example."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)?", 1), "[0-9]+", ":id")
    return p.select(
        F.when(F.col("url").startswith("https"), "GET").otherwise("POST").alias("method"),
        path.alias("path"),
        host.alias("file_path"),
        F.col("page_id").alias("line"),
        F.regexp_extract(host, r"\.([a-z]+)$", 1).alias("framework"),
        host.startswith("m.").alias("is_test"),
        host.startswith("blog.").alias("is_example"),
    )


DECLARATIONS_SQL = r"""declarations AS (SELECT CASE WHEN url LIKE 'https%' THEN 'GET' ELSE 'POST' END AS method,
  regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)?', 1), '[0-9]+', ':id', 'g') AS path,
  regexp_extract(url, '^https?://([^/]+)', 1) AS file_path, page_id AS line,
  regexp_extract(regexp_extract(url, '^https?://([^/]+)', 1), '\.([a-z]+)$', 1) AS framework,
  starts_with(regexp_extract(url, '^https?://([^/]+)', 1), 'm.') AS is_test,
  starts_with(regexp_extract(url, '^https?://([^/]+)', 1), 'blog.') AS is_example FROM pages)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed chunks: documents. id, path, text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("path"), "text")
