"""Dependency-graph operators over nodes (id, path, layer, loc, language) and edges (source, target, kind, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.plans.storage import staged


def coupled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with fan_in, fan_out and coupling; every edge counts, parallel kinds too."""
    end = lambda c, o, i: F.struct(F.col(c).alias("id"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    ends = edges.select(F.explode(F.array(end("source", 1, 0), end("target", 0, 1))).alias("e")).select("e.*")  # edges are read once
    degree = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    out = nodes.join(degree, "id", "left").na.fill(0, ["fan_in", "fan_out"])
    return out.withColumn("coupling", F.col("fan_in") + F.col("fan_out"))


def hubs(nodes: DataFrame, edges: DataFrame, n: int = 20) -> DataFrame:
    """The n most coupled nodes; ties by path, then id."""
    c = coupled(nodes, edges).where("coupling > 0")
    return c.select("id", "path", "fan_in", "fan_out", "coupling").orderBy(F.desc("coupling"), "path", "id").limit(n)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on no edge, but for entrypoints and tests where columns is_entrypoint and is_test say so."""
    for flag in ("is_entrypoint", "is_test"):
        if flag in nodes.columns:
            nodes = nodes.where(~F.coalesce(F.col(flag), F.lit(False)))
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return nodes.join(ends, "id", "left_anti").select("id", "path")


def kind_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"))


def graph_stats(nodes: DataFrame, edges: DataFrame, high: int = 12) -> DataFrame:
    """One row of totals: nodes, edges by kind, and nodes of high coupling."""
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("kind") == "import").alias("imports"), F.count_if(F.col("kind") == "call").alias("calls"))
    c = coupled(nodes, edges).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("coupling") >= high).alias("high_coupling"), F.max("coupling").alias("max_coupling"))
    return c.join(e)  # one row each


def per_layer(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Layer cards: files, lines and fan sums of each layer."""
    return coupled(nodes, edges).groupBy("layer").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"), F.sum("fan_in").alias("fan_in"), F.sum("fan_out").alias("fan_out"))


def between(nodes: DataFrame, edges: DataFrame, group: Column, name: str) -> DataFrame:
    """Edges rolled up to groups of nodes; those within one group are left out."""
    side = nodes.select("id", group.alias("g"))
    e = edges.join(side.toDF("source", "from"), "source").join(side.toDF("target", "to"), "target").where(F.col("from") != F.col("to"))
    return e.groupBy(F.col("from").alias(f"source_{name}"), F.col("to").alias(f"target_{name}")).agg(
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("edges"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")
    )


def module_of(path: Column) -> Column:
    """The first two components of a path that is deeper, else its folder, else the root."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 2, F.array_join(F.slice(parts, 1, 2), "/")).when(n == 2, F.element_at(parts, 1)).otherwise("(root)")


def modules(nodes: DataFrame, n: int = 40) -> DataFrame:
    """Modules by files, with their most frequent layer (ties by name)."""
    per = nodes.groupBy(module_of(F.col("path")).alias("module"), "layer").agg(F.count(F.lit(1)).alias("k"), F.sum("loc").alias("l"))
    top = F.min_by("layer", F.struct(-F.col("k"), "layer"))
    out = per.groupBy("module").agg(F.sum("k").alias("files"), F.sum("l").alias("loc"), top.alias("layer"))
    return out.orderBy(F.desc("files"), "module").limit(n)


def module_page(nodes: DataFrame, limit: int) -> DataFrame:
    """The first modules by name, and whether there are more."""
    m = nodes.select(module_of(F.col("path")).alias("module")).distinct()
    return m.withColumn("total", F.lit(m.count()).cast("long")).orderBy("module").limit(limit).withColumn("truncated", F.col("total") > limit)


def induced(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in keep (id)."""
    return edges.join(keep.select(F.col("id").alias("source")), "source", "left_semi").join(keep.select(F.col("id").alias("target")), "target", "left_semi")


def top_view(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Edges among the n most coupled nodes."""
    keep = staged(coupled(nodes, edges).orderBy(F.desc("coupling"), "path", "id").limit(n).select("id"), "top-view")
    return induced(nodes, edges, keep)


def layer_samples(nodes: DataFrame, n: int = 8) -> DataFrame:
    """The first n files of each layer by path."""
    w = Window.partitionBy("layer").orderBy("path", "id")
    return nodes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("layer", "rank", "id", "path")


def reach(edges: DataFrame, roots: DataFrame, depth: int, key: str | None = None) -> DataFrame:
    """Breadth first: (id, distance, via) within depth of roots (id); via is the least node one step nearer.

    With key, roots are (key, id) and each key has its own search. A level is one join with the
    edges and one anti join with what was seen, both dealt by node; levels are written tables.
    """
    keys = [key] if key else []
    step = edges.select("source", "target").distinct()
    seen = staged(roots.select(*keys, "id").distinct().select(*keys, "id", F.lit(0).alias("distance"), F.lit(None).cast("long").alias("via")), "reach")
    front = seen
    for d in range(1, depth + 1):
        nxt = front.join(step, front["id"] == step["source"]).groupBy(*keys, F.col("target").alias("nid")).agg(F.min("source").alias("via"))
        nxt = nxt.withColumnRenamed("nid", "id").join(seen.select(*keys, "id"), [*keys, "id"], "left_anti")
        front = staged(nxt.select(*keys, "id", F.lit(d).alias("distance"), "via"), "reach")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


#: Trimmed edges up to which one task finds the components; more are coloured by joins.
ONE_TASK_EDGES = 50_000


def _tarjan(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, least node of its component) for components of two and more, by an explicit stack."""
    out: dict[int, list[int]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    open_, stack, found = set(), [], []
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        open_.add(root)
        while work:
            node, rest = work[-1]
            for b in rest:
                if b not in index:
                    index[b] = low[b] = len(index)
                    stack.append(b)
                    open_.add(b)
                    work.append((b, iter(out.get(b, ()))))
                    break
                if b in open_:
                    low[node] = min(low[node], index[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        x = stack.pop()
                        open_.discard(x)
                        members.append(x)
                        if x == node:
                            break
                    if len(members) > 1:
                        found += [(x, min(members)) for x in members]
    return found


def _components_in_task(batches):
    import pandas as pd

    pairs = [p for b in batches for p in zip(b["source"].tolist(), b["target"].tolist(), strict=True)]
    yield pd.DataFrame(_tarjan(pairs), columns=["id", "component"]).astype("int64")


def _forward_min(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Least label that reaches each node along edges, from label (id, color)."""
    now = label
    while True:
        pushed = edges.join(now, edges["source"] == now["id"]).groupBy(F.col("target").alias("t")).agg(F.min("color").alias("c"))
        nxt = staged(now.join(pushed, now["id"] == pushed["t"], "left").select("id", F.least("color", F.coalesce("c", "color")).alias("color")), "scc")
        if nxt.join(now.withColumnRenamed("color", "was"), "id").where("color != was").isEmpty():
            return nxt
        now = nxt


def strong_components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(id, component): nodes in strongly connected components of two and more; component is the least id.

    Forward colouring: every node takes the least id that reaches it; what reaches back to its
    colour's root inside that colour is one component and is taken out; nodes without an edge in or
    out cannot lie on a cycle and are trimmed. Each step is a join and an aggregate over written
    tables, so no component has to fit in one task. What is left of at most one_task_edges edges is
    finished by one depth-first search.
    """
    e = staged(edges.where("source != target").select("source", "target").distinct(), "scc")
    found: DataFrame | None = None
    while True:
        n = e.count()
        while n > one_task_edges:  # trim
            e = staged(e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"), "scc")
            was, n = n, e.count()
            if was == n:
                break
        if not n:
            break
        if n <= one_task_edges:
            got = e.coalesce(1).mapInPandas(_components_in_task, "id long, component long")
            found = got if found is None else found.unionByName(got)
            break
        ids = e.select(F.col("source").alias("id")).distinct()
        color = _forward_min(e, staged(ids.select("id", F.col("id").alias("color")), "scc"))
        same = e.join(color.toDF("source", "cs"), "source").join(color.toDF("target", "ct"), "target").where("cs = ct")
        back = same.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("cs").alias("c"))
        roots = color.where("id = color").select(F.col("color").alias("c"), "id")
        members = roots
        front = staged(roots, "scc")
        back = staged(back, "scc")
        while not front.isEmpty():
            nxt = front.join(back, (front["id"] == back["source"]) & (front["c"] == back["c"])).select(front["c"], F.col("target").alias("id")).distinct()
            front = staged(nxt.join(members, ["c", "id"], "left_anti"), "scc")
            members = staged(members.unionByName(front), "scc")
        got = members.select("id", F.col("c").alias("component"))
        found = got if found is None else found.unionByName(got)
        out = members.select("id")
        e = staged(e.join(out.toDF("source"), "source", "left_anti").join(out.toDF("target"), "target", "left_anti").select("source", "target"), "scc")
    if found is None:
        return edges.select(F.col("source").alias("id"), F.col("source").alias("component")).limit(0)
    big = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return found.join(big, "component", "left_semi").select("id", "component")


def cycles(edges: DataFrame, n: int = 25) -> DataFrame:
    """The n largest strong components: component, size."""
    return strong_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component").limit(n)
