"""Graph queries on the proxy graph, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import graph as g
from sparkloom.sources.proxy import EDGES_SQL, NODES_SQL, edges, nodes, table

_BOTH = f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}"
_DEGREE = """, degree AS (SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out
  FROM (SELECT source AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) GROUP BY id),
coupled AS (SELECT n.*, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out,
  coalesce(fan_in, 0) + coalesce(fan_out, 0) AS coupling FROM nodes n LEFT JOIN degree USING (id))"""
_MODULE = "split_part(path, '/', 1) || '/' || split_part(path, '/', 2)"


def coupling_hubs(spark: SparkSession, d: str) -> DataFrame:
    return g.hubs(nodes(spark, d), edges(spark, d))


def orphans(spark: SparkSession, d: str) -> DataFrame:
    return g.orphans(nodes(spark, d), edges(spark, d))


def edge_kind_stats(spark: SparkSession, d: str) -> DataFrame:
    return g.kind_stats(edges(spark, d))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return g.graph_stats(nodes(spark, d), edges(spark, d))


def layer_cards(spark: SparkSession, d: str) -> DataFrame:
    return g.per_layer(nodes(spark, d), edges(spark, d))


def layer_rollup(spark: SparkSession, d: str) -> DataFrame:
    return g.between(nodes(spark, d), edges(spark, d), F.col("layer"), "layer")


def module_rollup(spark: SparkSession, d: str) -> DataFrame:
    return g.between(nodes(spark, d), edges(spark, d), g.module_of(F.col("path")), "module")


def module_stats(spark: SparkSession, d: str) -> DataFrame:
    return g.modules(nodes(spark, d))


def module_page(spark: SparkSession, d: str) -> DataFrame:
    return g.module_page(nodes(spark, d), 12)


def top_view_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.top_view(nodes(spark, d), edges(spark, d), 200)


def layer_samples(spark: SparkSession, d: str) -> DataFrame:
    return g.layer_samples(nodes(spark, d))


def impact_cone(spark: SparkSession, d: str) -> DataFrame:
    """Dependents within three steps of the most depended-on file: search against the edges' direction."""
    e = edges(spark, d)
    root = g.coupled(nodes(spark, d), e).orderBy(F.desc("fan_in"), "path", "id").limit(1).select("id")
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return g.reach(back, root, 3)


def forward_trace(spark: SparkSession, d: str) -> DataFrame:
    """What each of the ten largest files reaches within two steps."""
    roots = nodes(spark, d).orderBy(F.desc("loc"), "path", "id").limit(10).select(F.col("id").alias("root"), "id")
    return g.reach(edges(spark, d), roots, 2, "root")


def strong_components(spark: SparkSession, d: str) -> DataFrame:
    return g.strong_components(edges(spark, d))


def strong_components_stepwise(spark: SparkSession, d: str) -> DataFrame:
    """The same by joins to the end, with nothing left for one task."""
    return g.strong_components(edges(spark, d), one_task_edges=0)


def cycles(spark: SparkSession, d: str) -> DataFrame:
    return g.cycles(edges(spark, d))


def duplicate_edges_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Union of two edge sets, one row for each (source, target, kind)."""
    e = edges(spark, d)
    both = e.where("kind = 'import'").unionByName(e.where("weight > 0 and kind != 'require'"))
    return both.dropDuplicates(["source", "target", "kind"]).select("source", "target", "kind")


def isolated_modules(spark: SparkSession, d: str) -> DataFrame:
    """Orphans that are no configuration layer, first ten by path."""
    o = g.orphans(nodes(spark, d), edges(spark, d)).where(~F.col("path").startswith("ECONOMY") & ~F.col("path").contains("#1"))
    return o.orderBy("path", "id").limit(10)


def coupling_findings(spark: SparkSession, d: str) -> DataFrame:
    """Of the 15 most coupled files (top first, threshold second) those of 12 and more."""
    c = g.coupled(nodes(spark, d), edges(spark, d)).orderBy(F.desc("coupling"), "path", "id").limit(15).where("coupling >= 12")
    severity = F.when(F.col("coupling") >= 20, "high").otherwise("medium")
    return c.select("id", "path", "coupling", severity.alias("severity"))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """One-hop lists of all files: direction, neighbour, kind."""
    e, keep = edges(spark, d), nodes(spark, d).select("id")
    out = keep.join(e, F.col("id") == F.col("source")).select("id", F.lit("out").alias("direction"), F.col("target").alias("neighbour"), "kind")
    into = keep.join(e, F.col("id") == F.col("target")).select("id", F.lit("in").alias("direction"), F.col("source").alias("neighbour"), "kind")
    return out.unionByName(into)


def external_counts(spark: SparkSession, d: str) -> DataFrame:
    """Import counts of external packages: line items by return flag and supplier, top 60."""
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("package")).agg(F.count(F.lit(1)).alias("imports")).orderBy(F.desc("imports"), "package").limit(60)


QUERIES = {
    f.__name__: f
    for f in (
        coupling_hubs, orphans, edge_kind_stats, graph_stats, layer_cards, layer_rollup, module_rollup, module_stats, module_page, top_view_edges, layer_samples,
        impact_cone, forward_trace, strong_components, strong_components_stepwise, cycles, duplicate_edges_dropped, isolated_modules, coupling_findings, neighbours, external_counts,
    )
}

_SCC = """, pairs AS (SELECT DISTINCT source, target FROM edges),
reach AS (SELECT source AS a, target AS b FROM pairs UNION SELECT r.a, p.target FROM reach r JOIN pairs p ON r.b = p.source),
mutual AS (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b),
scc AS (SELECT a AS id, least(a, min(b)) AS component FROM mutual GROUP BY a)"""
_BETWEEN = """SELECT s.{c} AS source_{n}, t.{c} AS target_{n}, CAST(sum(e.weight) AS BIGINT) AS weight, count(*) AS edges,
  array_to_string(list_sort(list(DISTINCT e.kind)), ',') AS kinds
FROM edges e JOIN x s ON e.source = s.id JOIN x t ON e.target = t.id WHERE s.{c} <> t.{c} GROUP BY ALL"""

ORACLES = {
    "coupling_hubs": f"{_BOTH}{_DEGREE} SELECT id, path, fan_in, fan_out, coupling FROM coupled WHERE coupling > 0 ORDER BY coupling DESC, path, id LIMIT 20",
    "orphans": f"{_BOTH} SELECT id, path FROM nodes WHERE id NOT IN (SELECT source FROM edges) AND id NOT IN (SELECT target FROM edges)",
    "edge_kind_stats": f"{_BOTH} SELECT kind, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM edges GROUP BY kind",
    "graph_stats": f"""{_BOTH}{_DEGREE} SELECT * FROM (SELECT count(*) AS nodes, count(*) FILTER (coupling >= 12) AS high_coupling, max(coupling) AS max_coupling FROM coupled),
  (SELECT count(*) AS edges, count(*) FILTER (kind = 'import') AS imports, count(*) FILTER (kind = 'call') AS calls FROM edges)""",
    "layer_cards": f"{_BOTH}{_DEGREE} SELECT layer, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(fan_in) AS BIGINT) AS fan_in, CAST(sum(fan_out) AS BIGINT) AS fan_out FROM coupled GROUP BY layer",
    "layer_rollup": f"{_BOTH}, x AS (SELECT * FROM nodes) " + _BETWEEN.format(c="layer", n="layer"),
    "module_rollup": f"{_BOTH}, x AS (SELECT id, {_MODULE} AS module FROM nodes) " + _BETWEEN.format(c="module", n="module"),
    "module_stats": f"""{_BOTH}, k AS (SELECT {_MODULE} AS module, layer, count(*) AS k, sum(loc) AS l FROM nodes GROUP BY ALL)
SELECT module, CAST(sum(k) AS BIGINT) AS files, CAST(sum(l) AS BIGINT) AS loc, first(layer ORDER BY k DESC, layer) AS layer FROM k GROUP BY module ORDER BY files DESC, module LIMIT 40""",
    "module_page": f"{_BOTH}, m AS (SELECT DISTINCT {_MODULE} AS module FROM nodes) SELECT module, (SELECT count(*) FROM m) AS total, (SELECT count(*) FROM m) > 12 AS truncated FROM m ORDER BY module LIMIT 12",
    "top_view_edges": f"""{_BOTH}{_DEGREE}, keep AS (SELECT id FROM coupled ORDER BY coupling DESC, path, id LIMIT 200)
SELECT source, target, kind, weight FROM edges WHERE source IN (SELECT id FROM keep) AND target IN (SELECT id FROM keep)""",
    "layer_samples": f"{_BOTH} SELECT layer, rank, id, path FROM (SELECT *, CAST(row_number() OVER (PARTITION BY layer ORDER BY path, id) AS INT) AS rank FROM nodes) WHERE rank <= 8",
    "impact_cone": f"""{_BOTH}{_DEGREE}, root AS (SELECT id FROM coupled ORDER BY fan_in DESC, path, id LIMIT 1),
walk AS (SELECT id, 0 AS d FROM root UNION SELECT e.source, w.d + 1 FROM walk w JOIN edges e ON e.target = w.id WHERE w.d < 3),
dist AS (SELECT id, min(d) AS distance FROM walk GROUP BY id)
SELECT x.id, x.distance, min(y.id) AS via FROM dist x LEFT JOIN edges e ON e.source = x.id LEFT JOIN dist y ON y.id = e.target AND y.distance = x.distance - 1 GROUP BY ALL""",
    "forward_trace": f"""{_BOTH}, roots AS (SELECT id FROM nodes ORDER BY loc DESC, path, id LIMIT 10),
walk AS (SELECT id AS root, id, 0 AS d FROM roots UNION SELECT w.root, e.target, w.d + 1 FROM walk w JOIN edges e ON e.source = w.id WHERE w.d < 2),
dist AS (SELECT root, id, min(d) AS distance FROM walk GROUP BY ALL)
SELECT x.root, x.id, x.distance, min(y.id) AS via FROM dist x LEFT JOIN edges e ON e.target = x.id LEFT JOIN dist y ON y.root = x.root AND y.id = e.source AND y.distance = x.distance - 1 GROUP BY ALL""",
    "strong_components": f"{_BOTH}{_SCC} SELECT id, component FROM scc",
    "strong_components_stepwise": f"{_BOTH}{_SCC} SELECT id, component FROM scc",
    "cycles": f"{_BOTH}{_SCC} SELECT component, count(*) AS size FROM scc GROUP BY component ORDER BY size DESC, component LIMIT 25",
    "duplicate_edges_dropped": f"{_BOTH} SELECT source, target, kind FROM edges WHERE kind <> 'require'",
    "isolated_modules": f"""{_BOTH} SELECT id, path FROM nodes WHERE id NOT IN (SELECT source FROM edges) AND id NOT IN (SELECT target FROM edges)
  AND path NOT LIKE 'ECONOMY%' AND path NOT LIKE '%#1%' ORDER BY path, id LIMIT 10""",
    "coupling_findings": f"""{_BOTH}{_DEGREE} SELECT id, path, coupling, CASE WHEN coupling >= 20 THEN 'high' ELSE 'medium' END AS severity
FROM (SELECT * FROM coupled ORDER BY coupling DESC, path, id LIMIT 15) WHERE coupling >= 12""",
    "neighbours": f"""{_BOTH}, keep AS (SELECT id FROM nodes)
SELECT id, 'out' AS direction, target AS neighbour, kind FROM keep JOIN edges ON id = source UNION ALL SELECT id, 'in', source, kind FROM keep JOIN edges ON id = target""",
    "external_counts": "SELECT l_suppkey AS package, count(*) AS imports FROM lineitem GROUP BY 1 ORDER BY imports DESC, package LIMIT 60",
}
