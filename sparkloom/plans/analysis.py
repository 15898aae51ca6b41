"""One analysis of a source tree: every table and report as a DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import paths as p
from sparkloom.functions import text as t
from sparkloom.operators import endpoints, extract, graph, impact, quality, resolve, retrieval, store, workflow
from sparkloom.plans.storage import hinted, staged
from sparkloom.sources import corpus

# Fixed values.
COMPLEX, LARGE, COUPLED, DUPLICATE_LINES, MANY_METHODS = 15, 700, 12, 8, 20
RUN_ALONE = r"/alembic/versions/|/migrations/|/scripts/|/bin/|/tools/|/management/commands/|\.d\.ts$|\.pyi$"
CODE = ("python", "javascript", "typescript", "go", "java", "ruby", "php", "rust", "c", "cpp", "csharp")


class Analysis:
    """files: rows (path, text, size, reason) as corpus.read_tree gives them. Tables are written once, when first used."""

    def __init__(self, files: DataFrame):
        self.spark = files.sparkSession
        self.files = staged(
            files.where("reason is null").select(
                "path", "text", "size", p.language(F.col("path")).alias("language"), p.layer(F.col("path")).alias("layer"), p.is_test(F.col("path")).alias("is_test"), p.is_example(F.col("path")).alias("is_example"),
                F.size(F.split(F.regexp_replace("text", r"\r?\n$", ""), "\n")).cast("long").alias("loc"), F.sha1(F.left("text", F.lit(200_000)).cast("binary")).alias("hash"),
            ),
            "files",
        )
        self.skipped = files.where("reason is not null").select("path", "size", "reason")

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str) -> Analysis:
        return cls(corpus.read_tree(spark, root))

    # ---- extracted tables ----
    @cached_property
    def records(self) -> DataFrame:
        return staged(extract.python_records(self.files), "records")

    @cached_property
    def other_records(self) -> DataFrame:
        return staged(extract.pattern_records(self.files), "other")

    @cached_property
    def symbols(self) -> DataFrame:
        """path, name, kind, parent, line, loc, complexity, exported, fidelity."""
        py = self.records.where("record = 'symbol'").select("path", "name", "kind", "parent", "line", F.greatest(F.lit(1), F.col("end_line") - F.col("line") + 1).alias("loc"), "complexity", "exported", F.size("names").alias("n_names"), "fidelity")
        other = self.other_records.where("record = 'symbol'").select("path", "name", "kind", "fidelity")
        return py.unionByName(other, allowMissingColumns=True)

    @cached_property
    def imports(self) -> DataFrame:
        """path, name, resolved, names, external."""
        py = resolve.resolved_imports(self.records.where("record = 'import'"), self.files).select("path", "name", "names", "level", "line", "resolved")
        other, script = self.other_records.where("record = 'import'"), p.language(F.col("path")).isin("javascript", "typescript", "jsx", "tsx")
        js = resolve.resolved_js(other.where(script), self.files, corpus.aliases(self.files)).select("path", "name", "resolved")
        rest = resolve.resolved_modules(other.where(~script), self.files, corpus.go_modules(self.files)).select("path", "name", "resolved")
        both = py.unionByName(js.unionByName(rest), allowMissingColumns=True)
        return staged(both.withColumn("external", F.col("resolved").isNull() & ~F.col("name").startswith(".") & (F.coalesce("level", F.lit(0)) == 0)), "imports")

    @cached_property
    def calls(self) -> DataFrame:
        return resolve.resolved_calls(self.records.where("record = 'call'").select("path", "parent", "name", "target", "line"), self.records.where("record = 'symbol'"), self.imports)

    @cached_property
    def edges(self) -> DataFrame:
        """source, target, kind, weight by path; import and call edges."""
        return staged(resolve.import_edges(self.imports).unionByName(resolve.call_weights(self.calls)).select("source", "target", "kind", F.col("weight").cast("long").alias("weight")), "edges")

    @cached_property
    def nodes(self) -> DataFrame:
        """Code files and all ends of edges, by path as id."""
        ends = self.edges.select(F.explode(F.array("source", "target")).alias("path"))
        code = F.coalesce(F.col("language").isin(*CODE), F.lit(False))
        other = hinted(staged(self.files.where(~code).select("path"), "others"))  # only these have to be looked for among the ends
        kept = self.files.where(~code).join(ends.join(other, "path", "left_semi").distinct(), "path", "left_semi")
        return self.files.where(code).unionByName(kept.select(*self.files.columns)).select(F.col("path").alias("id"), "path", "layer", "loc", "language", "is_test", "is_example")

    # ---- reports ----
    def dependencies(self) -> DataFrame:
        return graph.coupled(self.nodes, self.edges)

    def architecture(self) -> DataFrame:
        return graph.between(self.nodes, self.edges, F.col("layer"), "layer")

    def cycles(self) -> DataFrame:
        """Members of dependency cycles: id, component (both paths)."""
        ids = staged(self.nodes.select("id").distinct().withColumn("n", F.monotonically_increasing_id()), "ids")
        e = self.edges.join(ids.toDF("source", "a"), "source").join(ids.toDF("target", "b"), "target").select(F.col("a").alias("source"), F.col("b").alias("target"))
        found = graph.strong_components(e).join(ids.toDF("path", "id"), "id")
        names = found.groupBy("component").agg(F.min("path").alias("first"))
        return found.join(names, "component").select(F.col("path").alias("id"), F.col("first").alias("component"))

    def routes(self) -> DataFrame:
        """Routes as they are declared: router, local, method, file_path, line, framework, handler, auth, is_test, is_example."""
        r = self.records.where("record = 'route'")
        return r.select(F.concat_ws("#", "path", "target").alias("router"), F.col("name").alias("local"), F.col("kind").alias("method"), F.col("path").alias("file_path"), "line", F.col("detail").alias("framework"), F.col("parent").alias("handler"), "auth", p.is_test(F.col("path")).alias("is_test"), p.is_example(F.col("path")).alias("is_example"))

    def apis(self) -> DataFrame:
        """Routes with the whole prefix of their router: method, path, file_path, line, framework, handler, auth, is_test, is_example."""
        key = lambda path, name: F.concat_ws("#", path, name)
        r = self.records
        routers = r.where("record = 'router'").select(key("path", "name").alias("router"), F.coalesce("target", F.lit("")).alias("own"))
        known = routers.select("router").distinct()
        m = r.where("record = 'mount'").select("path", F.col("name").alias("child"), F.col("parent").alias("at"), F.col("target").alias("prefix"))
        head, tail = F.element_at(F.split("child", r"\."), 1), F.element_at(F.split("child", r"\."), -1)
        m = staged(m, "mounts")
        near = hinted(staged(m.select("path").distinct(), "mounting"))  # only what they import is looked at
        brought = self.imports.where("resolved is not null").join(near, "path", "left_semi").select("path", F.explode("names").alias("head"), "resolved").distinct()
        far = m.withColumn("head", head).join(brought, ["path", "head"], "left").select(F.coalesce(key(F.col("resolved"), tail), key(F.col("path"), F.col("child"))).alias("child"), key("path", "at").alias("parent"), "prefix")
        whole = endpoints.router_prefixes(routers, far.join(known.toDF("child"), "child", "left_semi"))
        out = self.routes().join(whole, "router", "left").withColumn("path", endpoints.join_prefix(F.coalesce("prefix", F.lit("")), F.col("local")))
        return out.select("method", "path", "file_path", "line", "framework", "handler", "auth", "is_test", "is_example")

    def database(self) -> DataFrame:
        """Models with their relations resolved by name, else by table: model, table, related, target, resolved, queries."""
        m = staged(self.records.where("record = 'model'").select("path", F.col("name").alias("model"), F.col("target").alias("table"), F.filter(F.split(F.coalesce("detail", F.lit("")), ","), lambda x: x != "").alias("relations")), "models")
        q = self.records.where("record = 'query'").groupBy(F.col("name").alias("model")).agg(F.count(F.lit(1)).alias("queries"))
        rel = m.select("model", "table", F.explode_outer("relations").alias("related"))
        by_name = m.select(F.col("model").alias("related"), F.col("model").alias("a")).distinct()
        by_table = m.select(F.col("table").alias("related"), F.col("model").alias("b")).distinct()
        got = rel.join(by_name, "related", "left").join(by_table, "related", "left").join(q, "model", "left")
        target = F.coalesce("a", "b")
        return got.select("model", "table", "related", target.alias("target"), target.isNotNull().alias("resolved"), F.coalesce("queries", F.lit(0)).cast("long").alias("queries"))

    def workflows(self) -> DataFrame:
        return resolve.workflows(self.records.where("record = 'route'"), self.calls, self.files.select("path", "layer"))

    @cached_property
    def traces(self) -> tuple[DataFrame, DataFrame]:
        """Steps and reports of the first sixty routes."""
        routes = workflow.seeds(self.apis().where("not is_test"))
        queries = self.records.where("record = 'query'").select("path", "parent", "line", F.col("target").alias("orm"), F.col("name").alias("table"))
        return workflow.traced(routes, self.calls, self.records.where("record = 'symbol'"), queries, self.files.select("path", "layer"))

    def trace_symbol(self, path: str, name: str) -> tuple[DataFrame, DataFrame]:
        """Steps and report of what one symbol calls."""
        s = self.records.where((F.col("record") == "symbol") & (F.col("path") == path) & (F.col("name") == name))
        routes = s.select(F.lit("CALL").alias("method"), F.col("name").alias("path"), F.col("path").alias("file_path"), "line", F.col("name").alias("handler"), F.lit(None).cast("string").alias("framework"), F.lit(False).alias("auth"))
        queries = self.records.where("record = 'query'").select("path", "parent", "line", F.col("target").alias("orm"), F.col("name").alias("table"))
        return workflow.traced(routes, self.calls, self.records.where("record = 'symbol'"), queries, self.files.select("path", "layer"))

    def background(self) -> DataFrame:
        return workflow.background(self.records.where("record = 'symbol'"))

    def hints(self) -> DataFrame:
        """Frameworks that each file's imports tell of."""
        return extract.framework_hints(self.imports)

    def chunks(self) -> DataFrame:
        """Chunks of the code files that parse."""
        broken = self.records.where("record = 'error'").select("path")
        files = self.files.where(F.col("language").isin(*CODE)).join(broken, "path", "left_anti")
        symbols = self.records.where("record = 'symbol'").select("path", "name", "kind", "parent", "line", "end_line", "doc")
        return retrieval.code_chunks(files, symbols.unionByName(self.other_records.where("record = 'symbol'").select("path", "name", "kind"), allowMissingColumns=True))

    def packages(self, n: int = 60) -> DataFrame:
        """External packages by imports."""
        head = F.element_at(F.split("name", r"[./]"), 1)
        return self.imports.where("external").groupBy(head.alias("package")).agg(F.count(F.lit(1)).alias("imports")).orderBy(F.desc("imports"), "package").limit(n)

    def manifests(self) -> DataFrame:
        return corpus.dependencies(self.files)

    def issues(self) -> DataFrame:
        """Findings: kind, severity, path, detail; most severe first, 200 at most."""
        n = staged(self.dependencies(), "coupled")
        s = self.symbols
        c = self.files.select(F.col("path").alias("id"), "path", "text")
        tested = self.records.join(self.files.where("is_test").select("path"), "path", "left_semi")
        names = tested.where("record = 'symbol'").select(F.regexp_replace("name", "^(?i)(test_|it_|should_)", "").alias("name")).union(tested.where("record = 'import'").select(F.explode("names")))
        exported = s.join(self.files.where("not is_test and not is_example and layer not in ('other', 'config', 'test', 'docs')").select("path"), "path", "left_semi").where("exported and kind in ('function', 'method', 'class')").select("path", "name", "loc")
        row = lambda df, kind, severity, detail: df.select(F.lit(kind).alias("kind"), (severity if not isinstance(severity, str) else F.lit(severity)).alias("severity"), "path", detail.cast("string").alias("detail"))
        parts = [
            row(self.cycles().groupBy(F.col("component").alias("path")).agg(F.count(F.lit(1)).alias("n")), "circular_dependency", F.when(F.col("n") > 2, "high").otherwise("medium"), F.col("n")),
            row(n.orderBy(F.desc("coupling"), "path").limit(15).where(F.col("coupling") >= COUPLED), "high_coupling", F.when(F.col("coupling") < 20, "medium").otherwise("high"), F.col("coupling")),
            row(self.files.where(F.col("language").isin(*CODE)).orderBy(F.desc("loc"), "path").limit(15).where(F.col("loc") >= LARGE), "large_module", "medium", F.col("loc")),
            row(s.where("kind in ('function', 'method')").orderBy(F.desc("complexity"), "path", "name").limit(12).where(F.col("complexity") >= COMPLEX), "high_complexity", "medium", F.col("name")),
            row(s.where((F.col("kind") == "class") & (F.col("n_names") >= MANY_METHODS)), "god_class", "medium", F.col("name")),
            row(resolve.missing_tests(exported, names), "missing_tests", "low", F.col("name")),
            row(graph.orphans(self.nodes.where("not is_test and not is_example and layer not in ('config', 'entrypoint')").where(~F.lower(F.concat(F.lit("/"), "path")).rlike(RUN_ALONE)), self.edges).orderBy("path").limit(10), "isolated_module", "info", F.col("path")),
            row(quality.secrets(c).withColumnRenamed("id", "path").orderBy("path", "line").limit(12), "possible_secret", F.when(p.is_test(F.col("path")) | p.is_example(F.col("path")), "low").otherwise("high"), F.concat_ws(":", "name", F.col("line").cast("string"))),
            row(quality.todos(c).withColumnRenamed("id", "path"), "tech_debt", "info", F.col("markers")),
        ]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).when(F.col("severity") == "low", 2).otherwise(3)
        return out.orderBy(rank, "kind", "path", "detail").limit(200)

    def health(self) -> DataFrame:
        return quality.health(self.issues(), self.symbols.count())

    def overview(self) -> DataFrame:
        f = self.files.agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"), F.countDistinct("language").alias("languages"), F.count_if("is_test").alias("test_files"), F.countDistinct(p.dirname(F.col("path"))).alias("modules"))
        r = self.records.agg(*[F.count_if(F.col("record") == k).alias(f"{k}s") for k in ("route", "model", "error")])
        return f.join(r).join(self.symbols.agg(F.count(F.lit(1)).alias("symbols"))).join(self.skipped.agg(F.count(F.lit(1)).alias("skipped")))  # one row each

    def references(self, name: str) -> DataFrame:
        """Who calls a symbol: path, caller, first line."""
        return self.calls.where(F.col("name") == name).groupBy("path", F.coalesce("parent", F.lit("<module>")).alias("caller")).agg(F.min("line").alias("line"))

    def search(self, query: str, n: int = 12) -> DataFrame:
        return retrieval.lexical_search(self.files.select(F.col("path").alias("id"), "path", "text"), query, n)

    def grep(self, needle: str, n: int = 60) -> DataFrame:
        return retrieval.grep(self.files.select(F.col("path").alias("id"), "path", "text"), needle, n)

    def impact(self, query: str, depth: int = 2) -> dict[str, DataFrame]:
        """Of the file meant by query: dependents, tests, endpoints."""
        target = staged(resolve.resolve_target(self.files, query).select(F.col("path").alias("id")), "target")
        ids = staged(self.nodes.select("id").withColumn("n", F.monotonically_increasing_id()), "ids")
        e = staged(self.edges.join(ids.toDF("source", "a"), "source").join(ids.toDF("target", "b"), "target").select(F.col("a").alias("source"), F.col("b").alias("target")), "edges")
        root = target.join(ids, "id").select(F.col("n").alias("id"))
        cone = staged(impact.dependents(e, root, depth), "cone")
        named = lambda df: df.join(ids.toDF("path", "id"), "id")
        tests = self.nodes.where("is_test").join(ids, "id").select(F.col("n").alias("id"))
        routes = self.apis().select(F.concat_ws(" ", "method", "path").alias("endpoint"), F.col("file_path").alias("id")).join(ids, "id").select("endpoint", F.col("n").alias("id"))
        return {
            "dependents": named(cone.orderBy("distance", "id").limit(40)).select("path", "distance"),
            "tests": named(impact.related_tests(tests, e, cone, root)).select("path", "reason"),
            "endpoints": named(impact.affected(routes, cone, root)).select("endpoint", "path"),
        }

    def insights(self, n: int = 3) -> DataFrame:
        """The most frequent layers of files."""
        return self.files.groupBy("layer").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "layer").limit(n)

    def docs(self) -> DataFrame:
        """The endpoints as one Markdown table a framework."""
        return store.markdown_table(self.apis(), ["method", "path", "file_path"], ["path", "method"], ["framework"])

    def bundle(self) -> DataFrame:
        """One JSON object with files, edges and endpoints."""
        return store.bundle({"files": self.files.select("path", "language", "layer", "loc"), "edges": self.edges, "apis": self.apis()})

    def ids(self, run: str) -> DataFrame:
        return self.files.select("path", t.stable_id(F.lit(run), F.col("path")).alias("id"))
