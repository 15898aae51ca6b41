"""What happens behind an endpoint: the calls from its handler on, the queries met on the way, and a report of each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.paths import basename, is_example, is_test
from sparkloom.plans.storage import staged

# Fixed values.
MAX_DEPTH, MAX_STEPS, MAX_VISITED = 7, 14, 41
SIGNALS = {
    "auth": ("auth", "login", "signin", "sign-in", "session", "token", "jwt", "oauth", "password", "credential", "logout"),
    "signup": ("register", "signup", "sign-up", "onboard", "create_user", "createuser"),
    "payment": ("payment", "billing", "invoice", "checkout", "stripe", "subscription", "order", "cart", "purchase"),
    "upload": ("upload", "file", "attachment", "media", "asset", "storage", "s3"),
    "search": ("search", "query", "filter", "lookup"),
    "notification": ("notification", "email", "mail", "sms", "webhook", "push"),
    "crud": ("create", "update", "delete", "list", "get", "post", "put", "patch"),
    "realtime": ("websocket", "socket", "sse", "eventsource", "subscribe", "channel"),
}
STEP_KINDS = {"ui": "ui", "route": "controller", "middleware": "middleware", "service": "service", "repository": "repository", "util": "util", "config": "external", "entrypoint": "controller", "other": "service", "test": "util"}
FIRST_CATEGORIES = ("auth", "payment", "signup")


def category(text: Column) -> Column:
    """The category with the most signals in the text, the first of equals; general without any."""
    low = F.lower(text)
    score = {c: reduce(lambda a, b: a + b, [low.contains(s).cast("int") for s in signals]) for c, signals in SIGNALS.items()}
    most = F.greatest(*score.values())
    return reduce(lambda out, c: out.when(score[c] == most, c), SIGNALS, F.when(F.coalesce(most, F.lit(0)) == 0, "general"))


def seeds(routes: DataFrame, keep: int = 60) -> DataFrame:
    """The routes (method, path, file_path, line, handler, framework, auth) traced first: signing in, paying and signing up, then by path."""
    text = F.concat_ws(" ", F.coalesce("path", F.lit("")), F.coalesce("handler", F.lit("")))
    rank = F.when(category(text).isin(*FIRST_CATEGORIES), 0).otherwise(1)
    return routes.orderBy(rank, "path", "file_path", "line", "method").limit(keep)


def _walk(starts: DataFrame, hops: DataFrame, known: DataFrame, layers: DataFrame) -> DataFrame:
    """Rows (workflow, file, name, at, trail, nth, layer): what each start (workflow, file, name) reaches, in the order of a breadth-first search.

    All starts are walked at once, level by level. `trail` is the calls that lead there, first ones first, so
    that the order within a level is that of trails. One row above MAX_VISITED a workflow is kept, to show
    that the walk was cut. Files of the test layer are reached but not left.
    """
    front = staged(starts.withColumns({"at": F.lit(0), "trail": F.array().cast("array<struct<line: int, target: string>>"), "nth": F.lit(1), "total": F.lit(1)}).join(layers, "file", "left").withColumn("layer", F.coalesce("layer", F.lit("other"))), "walk")
    seen = front
    for d in range(1, MAX_DEPTH + 1):
        near = front.where((F.col("layer") != "test") | (F.col("at") == 0)).select("workflow", "file", F.col("name").alias("caller"), "trail", "total")
        nxt = near.join(hops, ["file", "caller"]).select("workflow", F.col("callee").alias("file"), F.col("called").alias("name"), F.concat("trail", F.array(F.struct("line", "target"))).alias("trail"), "total")
        nxt = nxt.join(known, ["file", "name"], "left_semi").groupBy("workflow", "file", "name").agg(F.min("trail").alias("trail"), F.first("total").alias("before"))
        nxt = nxt.join(seen, ["workflow", "file", "name"], "left_anti")
        each = Window.partitionBy("workflow")
        nxt = nxt.withColumns({"nth": F.col("before") + F.row_number().over(each.orderBy("trail", "file", "name")), "total": (F.col("before") + F.count(F.lit(1)).over(each)).cast("int")}).where(F.col("nth") <= MAX_VISITED + 1)
        front = staged(nxt.withColumn("at", F.lit(d)).join(layers, "file", "left").withColumn("layer", F.coalesce("layer", F.lit("other"))).select(*seen.columns), "walk")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def traced(routes: DataFrame, calls: DataFrame, symbols: DataFrame, queries: DataFrame, layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of routes (method, path, file_path, line, handler, framework, auth): (steps, reports).

    steps: workflow, step, kind, label, file, line, and reports: workflow, trigger, category, scope,
    n_steps, confidence, truncated, description, files. calls are resolved calls (path, parent, target,
    name, line, callee), symbols (path, name, line), queries (path, parent, line, orm, table), layers
    (path, layer). Steps are the endpoint, a guard if it asks for one, the handler, what is called in
    breadth-first order until there are MAX_STEPS, and the last three kinds of query met, of the functions
    entered, else of their files close to the handler. A handler that no symbol is known for ends the trace.
    Repeated triggers of one handler are one workflow.
    """
    trigger = F.concat_ws(" ", F.coalesce("method", F.lit("ANY")), F.coalesce("path", F.lit("")))
    handler = F.coalesce("handler", F.lit(""))
    heads = routes.where("file_path is not null").withColumn("trigger", trigger).withColumn("entry", F.coalesce("handler", "file_path"))
    heads = heads.groupBy("trigger", "entry").agg(F.min_by(F.struct("method", "path", "file_path", "line", "handler", "framework", "auth"), F.struct("file_path", "line")).alias("r")).select("trigger", "r.*")
    heads = heads.withColumn("workflow", F.concat_ws(" ", "trigger", "file_path", handler)).withColumn("category", category(F.concat_ws(" ", "trigger", handler)))
    known = staged(symbols.groupBy(F.col("path").alias("file"), "name").agg(F.min("line").alias("first_line")), "known")
    by_file = layers.select(F.col("path").alias("file"), "layer").distinct()
    heads = heads.join(known.select(F.col("file").alias("file_path"), F.col("name").alias("handler"), F.col("first_line").alias("handler_line")), ["file_path", "handler"], "left")
    heads = staged(heads.withColumn("base", 2 + F.coalesce("auth", F.lit(False)).cast("int")), "heads")
    hops = calls.where("callee is not null").select(F.col("path").alias("file"), F.element_at(F.split(F.coalesce("parent", F.lit("")), r"\."), -1).alias("caller"), "callee", F.col("name").alias("called"), F.col("line").cast("int").alias("line"), "target").distinct()
    walk = staged(_walk(heads.where("handler_line is not null").select("workflow", F.col("file_path").alias("file"), F.col("handler").alias("name")), hops, known, by_file).join(heads.select("workflow", "base"), "workflow"), "walked")

    # a search takes one function after another; each adds all it calls, unless MAX_STEPS are there before
    fresh = walk.where((F.col("at") > 0) & (F.col("nth") <= MAX_VISITED))
    took = fresh.select("workflow", (F.col("at") - 1).alias("d"), F.expr("slice(trail, 1, size(trail) - 1)").alias("t"), F.lit(1).alias("adds"), (F.col("layer") != "test").cast("int").alias("n"), "at", "trail", "file", "name", "layer", "base")
    entered = walk.where((F.col("nth") <= MAX_VISITED) & ((F.col("layer") != "test") | (F.col("at") == 0))).select("workflow", F.col("at").alias("d"), F.col("trail").alias("t"), F.lit(0).alias("adds"), F.lit(0).alias("n"), "at", "trail", "file", "name", "layer", "base")
    line = Window.partitionBy("workflow").orderBy("d", "t", "adds", "trail", "file", "name").rowsBetween(Window.unboundedPreceding, -1)
    turns = took.unionByName(entered).withColumn("sofar", F.coalesce(F.sum("n").over(line), F.lit(0)))
    turn = Window.partitionBy("workflow", "d", "t")
    turns = turns.withColumn("open", (F.min(F.when(F.col("adds") == 0, F.col("sofar"))).over(turn) + F.col("base") < MAX_STEPS) & (F.col("d") < MAX_DEPTH))
    turns = staged(turns, "turns")
    called = turns.where("adds = 1 and n = 1 and open").join(known, ["file", "name"])
    steps = [
        heads.select("workflow", F.lit(0).alias("part"), F.lit(0).alias("d"), F.lit(None).cast(turns.schema["trail"].dataType).alias("t"), F.lit("api").alias("kind"), F.col("trigger").alias("label"), F.col("file_path").alias("file"), "line"),
        heads.where("auth").select("workflow", F.lit(1), F.lit(0), F.lit(None), F.lit("middleware"), F.lit("Authentication / authorisation check"), "file_path", "line"),
        heads.where("handler_line is not null").join(by_file.withColumnRenamed("file", "file_path"), "file_path", "left").select("workflow", F.lit(2), F.lit(0), F.lit(None), F.when(F.col("layer") == "service", "service").otherwise("controller"), "handler", "file_path", "handler_line"),
        called.select("workflow", F.lit(3), "at", "trail", _kind(F.col("layer")), "name", "file", "first_line"),
        _met(turns.where("adds = 0 and open"), queries).select("workflow", F.lit(4), "d", "t", F.lit("database"), "label", "file", "line"),
    ]
    every = reduce(DataFrame.union, steps)
    number = F.row_number().over(Window.partitionBy("workflow").orderBy("part", "d", "t", "file", "line", "label"))
    every = staged(every.select("workflow", number.alias("step"), "kind", "label", "file", F.col("line").cast("int").alias("line")), "steps")
    cut = walk.groupBy("workflow").agg(F.max((F.col("nth") > MAX_VISITED).cast("int")).alias("many"))
    ends = turns.groupBy("workflow").agg(F.max(F.when((F.col("adds") == 0) & ~F.col("open"), 1).otherwise(0)).alias("closed"))
    return every, _reports(heads, every, cut.join(ends, "workflow", "left"))


def _kind(layer: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in STEP_KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, layer), F.lit("service"))


def _met(entered: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (workflow, d, t, label, file, line): the last three labels of queries first met in the functions entered."""
    label = F.when(F.coalesce("table", F.lit("")) != "", F.concat_ws(" · ", F.coalesce("orm", F.lit("SQL")), "table")).otherwise(F.coalesce("orm", F.lit("SQL query")))
    q = queries.select(F.col("path").alias("file"), F.coalesce("parent", F.lit("")).alias("parent"), F.col("line").cast("int").alias("line"), label.alias("label"))
    three = lambda df, *keys: df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("line", "label"))).where("k <= 3").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line", "label"))).alias("met"))
    inside = three(q.select("file", F.explode(F.array_distinct(F.split("parent", r"\."))).alias("name"), "line", "label").where("name != ''"), "file", "name")
    around = three(q, "file").withColumnRenamed("met", "near")
    got = entered.join(inside, ["file", "name"], "left").join(around, "file", "left")
    rows = got.select("workflow", "d", "t", "file", F.explode(F.coalesce("met", F.when(F.col("d") <= 1, F.col("near")))).alias("m")).select("workflow", "d", "t", "file", "m.line", "m.label")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("workflow", "label").orderBy("d", "t", "line"))).where("k = 1")
    return first.withColumn("k", F.row_number().over(Window.partitionBy("workflow").orderBy(F.desc("d"), F.desc("t"), F.desc("line"), F.desc("label")))).where("k <= 3")


def _reports(heads: DataFrame, steps: DataFrame, ends: DataFrame) -> DataFrame:
    per = steps.groupBy("workflow").agg(F.count(F.lit(1)).alias("n_steps"), F.sort_array(F.collect_list(F.struct("step", "label"))).alias("labels"), F.slice(F.sort_array(F.collect_set("file")), 1, 20).alias("files"))  # a score of steps a workflow at most
    rows = heads.join(per, "workflow").join(ends, "workflow", "left")
    lost = F.col("handler_line").isNull()
    truncated = lost | (F.coalesce("many", F.lit(0)) + F.coalesce("closed", F.lit(0)) > 0)
    sure = 0.4 + F.least(F.lit(0.5), 0.08 * F.col("n_steps")) + F.when(F.col("framework").isNotNull(), 0.05).otherwise(0.0) - F.when(truncated, 0.08).otherwise(0.0)
    told = F.concat(F.col("trigger"), F.lit(" → "), F.array_join(F.transform(F.slice("labels", 3, 4), lambda x: x["label"]), " → "))
    told = F.when(F.col("n_steps") > 2, told).otherwise(F.concat(F.col("trigger"), F.lit(" handled in "), F.col("file_path")))
    scope = F.when(is_test(F.col("file_path")), "test").when(is_example(F.col("file_path")), "example").otherwise("application")
    return rows.select("workflow", "trigger", "category", scope.alias("scope"), "n_steps", F.when(lost, 0.35).otherwise(F.round(F.least(F.lit(0.95), sure), 2)).alias("confidence"), truncated.alias("truncated"), F.left(told, F.lit(220)).alias("description"), "files")


def listed(reports: DataFrame, keep: int = 24) -> DataFrame:
    """Reports by confidence, then steps, then trigger."""
    return reports.orderBy(F.desc("confidence"), F.desc("n_steps"), "trigger", "workflow").limit(keep)


def entering(steps: DataFrame, file: str, name: str | None, keep: int = 6) -> DataFrame:
    """Workflows whose steps pass a file, and in it the symbol `name` unless that is null."""
    hit = steps.where((F.col("file") == file) & (F.lit(True) if name is None else (F.col("label") == name)))
    return hit.select("workflow").distinct().orderBy("workflow").limit(keep)


def background(symbols: DataFrame, keep: int = 6) -> DataFrame:
    """Rows (path, trigger, tasks): files of tasks, workers and jobs whose first six symbols hold decorated functions or ones named task….

    symbols: path, name, kind, line, decorated.
    """
    some = symbols.where(F.lower("path").rlike("task|worker|jobs"))
    first = some.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("line", "name"))).where("k <= 6")
    tasks = first.where(F.col("kind").isin("function", "method") & (F.coalesce("decorated", F.lit(False)) | F.col("name").startswith("task")))
    g = tasks.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("tasks"))
    named = g.withColumn("trigger", F.concat(F.lit("background:"), basename(F.col("path"))))
    one = named.groupBy("trigger").agg(F.min_by(F.struct("path", "tasks"), "path").alias("r"))
    return one.select("r.path", "trigger", "r.tasks").orderBy("path").limit(keep)
