"""What the pages of a finished analysis show: cards, boards, capped graphs, prompts and the overview's counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import graph
from sparkloom.plans.storage import staged

# Fixed values.
VIEW_NODES, VIEW_EDGES = 1600, 12_000
SERVICE_RANK = ("service", "repository", "middleware", "util")


def layer_cards(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, samples: int = 12) -> DataFrame:
    """Rows (layer, files, loc, symbols, fan_in, fan_out, weight, kinds, samples), one a layer of nodes (id, path, layer, loc).

    weight and kinds are those of edges (source, target, kind, weight) that leave the layer; symbols (path) lie in its files;
    samples are its first paths. Each part is an aggregate by layer; only the few samples become an array.
    """
    n = staged(graph.coupled(nodes, edges), "cards")
    base = n.groupBy("layer").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"), F.sum("fan_in").alias("fan_in"), F.sum("fan_out").alias("fan_out"))
    per_path = symbols.groupBy("path").agg(F.count(F.lit(1)).alias("symbols"))
    own = n.join(per_path, "path").groupBy("layer").agg(F.sum("symbols").alias("symbols"))
    across = graph.between(n, edges, F.col("layer"), "layer")
    out = across.groupBy(F.col("source_layer").alias("layer")).agg(F.sum("weight").alias("weight"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("kinds", ","))))), ",").alias("kinds"))  # a row a pair of layers
    first = graph.layer_samples(nodes, samples).groupBy("layer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]), ",").alias("samples"))
    rows = reduce(lambda a, b: a.join(b, "layer", "left"), (base, own, out, first))
    return rows.select("layer", "files", "loc", F.coalesce("symbols", F.lit(0)).alias("symbols"), "fan_in", "fan_out", F.coalesce("weight", F.lit(0)).alias("weight"), F.coalesce("kinds", F.lit("")).alias("kinds"), "samples")


def graph_facets(nodes: DataFrame, edges: DataFrame, *facets: str, high: int = 12) -> DataFrame:
    """Rows (facet, value, nodes, loc, high_coupling) of each value of each facet of the nodes, in one aggregate."""
    sets = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]))
    rows = graph.coupled(nodes, edges).select(sets.alias("x"), "loc", "coupling")
    return rows.groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("nodes"), F.sum("loc").alias("loc"), F.count_if(F.col("coupling") >= high).alias("high_coupling"))


def endpoint_facets(routes: DataFrame) -> DataFrame:
    """Rows (facet, value, n) of routes (method, framework, auth, is_test, is_example): each method of a route, frameworks, and the totals."""
    split = F.transform(F.split("method", "/"), lambda m: F.struct(F.lit("method").alias("facet"), m.alias("value")))
    named = F.array(F.struct(F.lit("framework").alias("facet"), F.coalesce("framework", F.lit("unknown")).alias("value")), F.struct(F.lit("total").alias("facet"), F.lit("endpoints").alias("value")))
    marks = {"authenticated": F.coalesce("auth", F.lit(False)), "from_examples": F.col("is_example"), "from_tests": F.col("is_test")}
    told = F.array_compact(F.array(*[F.when(c, F.struct(F.lit("total").alias("facet"), F.lit(n).alias("value"))) for n, c in marks.items()]))
    return routes.select(F.explode(F.concat(split, named, told)).alias("x")).groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))


def capped_view(nodes: DataFrame, edges: DataFrame, most_nodes: int = VIEW_NODES, most_edges: int = VIEW_EDGES, layer: str | None = None, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that a view draws: the most coupled nodes (of one layer), and the heaviest edges (of one kind) among them; ties by name."""
    n = graph.coupled(nodes, edges)
    n = n.where(F.col("layer") == layer) if layer else n
    keep = staged(n.orderBy(F.desc("coupling"), "path", "id").limit(most_nodes), "view")
    e = graph.induced(nodes, edges if kind is None else edges.where(F.col("kind") == kind), keep)
    return keep, e.orderBy(F.desc("weight"), "source", "target", "kind").limit(most_edges)


def board(rows: DataFrame, name: str, value: Column, n: int, least: int) -> DataFrame:
    """Rows (board, path, name, value): the n greatest by value, ties by path and name, and of these the ones that reach least."""
    top = rows.select(F.lit(name).alias("board"), "path", "name", value.cast("long").alias("value")).orderBy(F.desc("value"), "path", "name").limit(n)
    return top.where(F.col("value") >= least)


def services_of(routes: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """routes (file_path, handler, line) with service: the file that the handler calls into whose layer ranks first, then by line of the call.

    Services come before repositories, middleware and utilities; other layers, the handler's own file and names of types are passed over.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in SERVICE_RANK]), F.col("layer"))
    made = calls.where("callee is not null and callee != path").where(~F.col("name").rlike("^[A-Z]"))
    to = made.select(F.col("path").alias("file_path"), F.element_at(F.split("parent", r"\."), -1).alias("handler"), F.col("line").alias("at"), F.col("callee").alias("file"))
    ranked = to.join(files.select(F.col("path").alias("file"), "layer"), "file").withColumn("rank", rank).where("rank > 0")
    best = ranked.groupBy("file_path", "handler").agg(F.min_by("file", F.struct("rank", "at", "file")).alias("service"))
    return routes.join(best, ["file_path", "handler"], "left")


def affected_workflows(steps: DataFrame, cone: DataFrame) -> DataFrame:
    """Rows (route, file): workflows with a step in a file of the cone (path), and the first such file."""
    return steps.join(cone.select(F.col("path").alias("file")).distinct(), "file", "left_semi").groupBy("route").agg(F.min_by("file", F.struct("step", "file")).alias("file"))


def symbols_holding(symbols: DataFrame, needle: str, n: int = 50) -> DataFrame:
    """Symbols (path, name, signature, doc) whose name, signature or docstring holds needle, case aside; shortest name first."""
    low = F.lit(needle.lower())
    inside = reduce(Column.__or__, [F.contains(F.lower(F.coalesce(c, F.lit(""))), low) for c in ("name", "signature", "doc")])
    return symbols.where(inside).orderBy(F.length("name"), "name", "path").limit(n)


def prompts(turns: DataFrame, excerpts: DataFrame, budget: int, keep: int = 6, turn_chars: int = 400) -> DataFrame:
    """Rows (conv_id, turns, excerpts, chars, prompt), one a conversation of turns (conv_id, turn, role, text).

    The prompt is the last `keep` turns, each cut to turn_chars, and then the excerpts (conv_id, path, start_line, text,
    score) numbered from the best on (ties by path and line) until their texts have spent the budget; the
    one that crosses it is cut. What a prompt holds is bounded by keep and budget before it is gathered, though a conversation's
    excerpts are ranked by one task's window; empty texts are no excerpts.
    """
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    said = turns.withColumn("_back", last).where(F.col("_back") <= keep)
    line = F.concat("role", F.lit(": "), F.left(F.coalesce("text", F.lit("")), F.lit(turn_chars)))
    history = said.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("s")))), lambda x: x["s"]), "\n").alias("history"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("score"), "path", "start_line")
    some = excerpts.where(F.length("text") > 0).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= budget)  # each spends a character at least
    spent = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = some.withColumn("_left", F.lit(budget) - spent).where("_left > 0")
    body = F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("\n"), F.left("text", F.col("_left").cast("int")))
    found = some.groupBy("conv_id").agg(F.count(F.lit(1)).alias("excerpts"), F.sum(F.least(F.length("text").cast("long"), "_left")).alias("chars"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", body.alias("s")))), lambda x: x["s"]), "\n\n").alias("found"))
    both = history.join(found, "conv_id", "left")
    return both.select("conv_id", "turns", F.coalesce("excerpts", F.lit(0)).alias("excerpts"), F.coalesce("chars", F.lit(0)).alias("chars"), F.concat_ws("\n\n", "history", "found").alias("prompt"))
