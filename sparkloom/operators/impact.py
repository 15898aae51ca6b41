"""What a change of one file reaches, and why that may be risky."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import graph
from sparkloom.plans.storage import staged


def dependents(edges: DataFrame, target: DataFrame, depth: int = 2) -> DataFrame:
    """All dependents of target (id): (id, distance, via)."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return graph.reach(back, target, depth).where("distance > 0")


def cone(edges: DataFrame, target: DataFrame, depth: int = 2, n: int = 40) -> DataFrame:
    """Dependents to show: nearest first, n at the most."""
    return dependents(edges, target, depth).orderBy("distance", "id").limit(n)


def affected(endpoints: DataFrame, cone_: DataFrame, target: DataFrame, n: int = 30) -> DataFrame:
    """Endpoints (endpoint, id) whose file is target or in its cone."""
    near = target.select("id").unionByName(cone_.select("id"))
    return endpoints.join(near, "id", "left_semi").orderBy("endpoint").limit(n)


def related_tests(tests: DataFrame, edges: DataFrame, cone_: DataFrame, target: DataFrame) -> DataFrame:
    """Tests (id) that import the target, or lie in its cone: (id, reason), the stronger reason wins."""
    direct = tests.join(edges, F.col("id") == F.col("source")).join(target.select(F.col("id").alias("target")), "target", "left_semi").select("id", F.lit(0).alias("rank"), F.lit("imports the file").alias("reason"))
    far = tests.join(cone_.select("id"), "id", "left_semi").select("id", F.lit(1).alias("rank"), F.lit("depends on it").alias("reason"))
    return direct.unionByName(far).groupBy("id").agg(F.min_by("reason", "rank").alias("reason"))


def marked_within(edges: DataFrame, marked: DataFrame, hops: int) -> DataFrame:
    """Files (id) of which a marked file is a dependent within hops edges, the marked ones themselves included.

    The mark is handed on along the edges, one join a hop, so no pairs of files are built.
    """
    pairs, now = edges.select("source", "target").distinct(), marked.select("id").distinct()
    for _ in range(hops):
        on = pairs.join(now, F.col("source") == F.col("id"), "left_semi").select(F.col("target").alias("id"))
        now = staged(now.unionByName(on).distinct(), "marked")
    return now


def risks(nodes: DataFrame, edges: DataFrame, cycle_members: DataFrame, endpoints: DataFrame, tests: DataFrame, models: DataFrame, high: int = 12, fans: int = 5, complex_: int = 15) -> DataFrame:
    """Rows (id, level, risk) of all files.

    nodes have id, complexity (of their hardest symbol) and parse_error; endpoints and tests name files
    by id, models gives their number by file. Rules: high coupling, else many dependents; part of a
    cycle; endpoints in the file or within two steps of its dependents; models; high complexity; no
    test among the dependents within three steps; not parsed.
    """
    c = staged(graph.coupled(nodes, edges), "risks")
    own, near = endpoints.select("id").distinct(), marked_within(edges, endpoints, 2)
    direct = edges.join(tests.select(F.col("id").alias("source")).distinct(), "source", "left_semi").select(F.col("target").alias("id"))
    tested = marked_within(edges, direct, 2)
    rule = lambda df, level, risk: df.select("id", (level if not isinstance(level, str) else F.lit(level)).alias("level"), F.lit(risk).alias("risk"))
    exposed = c.join(near, "id", "left_semi").join(own.withColumn("own", F.lit(True)), "id", "left")
    rules = [
        rule(c.where(F.col("coupling") >= high), "high", "high coupling"),
        rule(c.where((F.col("coupling") < high) & (F.col("fan_in") >= fans)), "medium", "many dependents"),
        rule(cycle_members.select("id").distinct(), "high", "part of a cycle"),
        rule(exposed, F.when(F.col("own"), "high").otherwise("medium"), "endpoints in its cone"),
        rule(c.join(models.where("models > 0"), "id", "left_semi"), "high", "defines models"),
        rule(c.where(F.col("complexity") >= complex_), "medium", "high complexity"),
        rule(c.join(tested, "id", "left_anti"), "medium", "no related tests"),
        rule(c.where("parse_error is not null"), "low", "did not parse"),
    ]
    return reduce(DataFrame.unionByName, rules)
