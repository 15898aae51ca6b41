"""Endpoint operators over declarations (method, path, file_path, line, framework, is_test, is_example)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.storage import staged


def deduplicated(declarations: DataFrame) -> DataFrame:
    """One row a (method, path): the application's own declaration, and how many there are.

    Rank: no test, no example, a framework, shorter file path, file path, line. The best is the
    least struct of an aggregate, so no window sorts a hot path's rows.
    """
    rank = F.struct(
        F.col("is_test").cast("int").alias("t"), F.col("is_example").cast("int").alias("e"), F.when(F.coalesce(F.col("framework"), F.lit("")) == "", 1).otherwise(0).alias("f"),
        F.length("file_path").alias("n"), F.col("file_path"), F.coalesce("line", F.lit(0)).alias("line"),
    )
    g = declarations.groupBy("method", "path").agg(F.min(rank).alias("best"), F.countDistinct("file_path", "line").alias("declarations"))
    return g.select("method", "path", F.col("best.file_path").alias("file_path"), F.col("best.line").alias("line"), "declarations")


def stats(declarations: DataFrame) -> DataFrame:
    """One row: endpoints, unique paths, those of examples and of tests, and those declared more than once."""
    one = declarations.agg(F.count(F.lit(1)).alias("declared"), F.count_if("is_example").alias("from_examples"), F.count_if("is_test").alias("from_tests"), F.countDistinct("path").alias("unique_paths"))
    many = deduplicated(declarations).agg(F.count(F.lit(1)).alias("endpoints"), F.count_if(F.col("declarations") > 1).alias("multi_declared"))
    return one.join(many)  # one row each


def filtered(declarations: DataFrame, method: str | None = None, framework: str | None = None, needle: str | None = None) -> DataFrame:
    """Declarations by method, framework and a substring of path, file or (if they have one) handler, case aside; no wildcards."""
    out = declarations
    if method:
        out = out.where(F.contains(F.col("method"), F.lit(method.upper())))
    if framework:
        out = out.where(F.col("framework") == framework)
    if needle:
        n = F.lit(needle.lower())
        out = out.where(reduce(Column.__or__, [F.contains(F.lower(F.coalesce(c, F.lit(""))), n) for c in ("path", "file_path", "handler") if c in out.columns]))
    return out


def join_prefix(a, b):
    """Two route parts with one slash between and none at the end."""
    whole = F.concat_ws("/", F.nullif(F.btrim(a, F.lit("/")), F.lit("")), F.nullif(F.btrim(b, F.lit("/")), F.lit("")))
    return F.when(whole == "", "").otherwise(F.concat(F.lit("/"), whole))


def router_prefixes(routers: DataFrame, mounts: DataFrame, depth: int = 6) -> DataFrame:
    """Whole prefix of each router: rows (router, prefix).

    routers (router, own); mounts (child, parent, prefix). A router's prefix is the longest of its
    parents' whole prefix and the mount's, then its own; ties by text. Chains end after `depth`
    mounts, and a router is not mounted below itself, which ends cycles.
    """
    now = staged(routers.select("router", "own", F.array("router").alias("seen"), F.col("own").alias("prefix"), F.col("router").alias("top"), F.col("own").alias("tail")), "mounts")
    paths = now
    for _ in range(depth):
        up = now.join(mounts, F.col("top") == F.col("child")).where(~F.array_contains("seen", F.col("parent")))
        own = routers.select(F.col("router").alias("parent"), F.col("own").alias("parent_own"))
        up = up.join(own, "parent", "left").select(
            "router", "own", F.array_append("seen", F.col("parent")).alias("seen"),
            join_prefix(F.coalesce("parent_own", F.lit("")), join_prefix(mounts["prefix"], F.col("tail"))).alias("prefix"), F.col("parent").alias("top"),
        )
        now = staged(up.withColumn("tail", F.col("prefix")), "mounts")
        if now.isEmpty():
            break
        paths = paths.unionByName(now)
    return paths.groupBy("router").agg(F.max_by("prefix", F.struct(F.length("prefix"), "prefix")).alias("prefix"))
