"""Reference resolution by joins: imports to files, calls to definitions, endpoints to workflows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.paths import basename, dirname, language
from sparkloom.plans.storage import FEW_ROWS, hinted, staged

#: Names of an import that are tried as submodules.
TRIED_NAMES = 8


def _up(folder: Column, levels: Column) -> Column:
    """folder without its last `levels` parts."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - levels, F.lit(0))), "/")


def _below(folder: Column, rest: Column) -> Column:
    return F.concat_ws("/", F.nullif(folder, F.lit("")), F.nullif(rest, F.lit("")))


def _folded(path: Column) -> Column:
    """path without `.` parts and with up to eight `..` parts taken off with the folder before each."""
    for _ in range(8):
        path = F.regexp_replace(F.regexp_replace(path, r"(^|/)\./", "$1"), r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    return path


def resolved_imports(imports: DataFrame, files: DataFrame, roots: tuple[str, ...] = ("", "src", "app", "lib")) -> DataFrame:
    """imports (path, name, level, names, line) with resolved: the first candidate that is a file, else null.

    Candidates in order: for a relative import, submodules of the base folder by imported name, the
    module, its package; for an absolute one the same below each root and each folder above the
    importing file, nearest last. Imports of one folder that read alike are resolved once; of their
    candidates only those in a folder that holds modules are joined with the files, as module paths
    (without `.py` or `/__init__.py`); the least place wins, so it is one equi-join and one aggregate at any size.
    """
    module = F.replace("name", F.lit("."), F.lit("/"))
    names = F.slice(F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda n: (n != "*") & (n != "")), 1, TRIED_NAMES)
    here = F.col("_here")
    near = _below(_up(here, F.greatest(F.col("level") - 1, F.lit(0))), module)
    parts = F.filter(F.split(here, "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    bases = F.when(F.col("level") > 0, F.array(near)).otherwise(F.transform(F.array_distinct(F.concat(F.array(*[F.lit(r) for r in roots]), above)), lambda r: _below(r, module)))
    tried = lambda b: F.concat(F.transform("_names", lambda n: F.concat(b, F.lit("/"), n)), F.array(b))
    rows = imports.withColumn("_here", dirname(F.col("path"))).withColumn("_names", names)
    rows = rows.withColumn("_key", F.unhex(F.md5(F.to_json(F.struct("_here", "name", "level", "_names")).cast("binary"))))
    asked = rows.select("_key", "_here", "name", "level", "_names").dropDuplicates(["_key"])
    each = asked.select("_key", F.posexplode(F.flatten(F.transform(bases, tried))).alias("place", "module"))
    path = F.col("path")
    known = files.select(F.explode(F.array_compact(F.array(
        F.when(path.endswith(".py"), F.struct(F.expr("left(path, length(path) - 3)").alias("module"), F.lit(0).alias("package"))),
        F.when(path.endswith("/__init__.py"), F.struct(F.expr("left(path, length(path) - 12)").alias("module"), F.lit(1).alias("package"))),
    ))).alias("m")).select("m.*")
    folders = staged(known.select(dirname(F.col("module")).alias("folder")).distinct(), "folders")
    if folders.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        each = each.withColumn("folder", dirname(F.col("module"))).join(F.broadcast(folders), "folder", "left_semi").drop("folder")
    best = each.join(known, "module").groupBy("_key").agg(F.min(F.struct("place", "package", "module")).alias("m"))
    hit = staged(best.select("_key", F.concat("m.module", F.when(F.col("m.package") == 1, "/__init__.py").otherwise(".py")).alias("resolved")), "resolved")
    return rows.join(hinted(hit), "_key", "left").drop("_key", "_here", "_names")


def resolved_js(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """JavaScript imports (path, name) with resolved; aliases (base, alias, target) are tried for bare names.

    Parent folders are folded by a regular expression applied as often as a specifier can hold them.
    """
    rel = _folded(_below(dirname(F.col("path")), F.col("name")))
    plain = imports.withColumn("import_id", F.sha2(F.to_json(F.struct("path", "name")), 256))
    near = plain.where(F.col("name").startswith(".")).select("import_id", F.lit(0).alias("rank"), rel.alias("base"))
    bare = plain.where(~F.col("name").startswith("."))
    # a prefix join by equality: each prefix of the specifier at a slash is one key
    parts = F.split("name", "/")
    keys = bare.select("import_id", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("alias"))
    named = keys.join(aliases, "alias").select("import_id", F.lit(0).alias("rank"), _below(F.col("base"), _below(F.col("target"), F.expr("substring(name, length(alias) + 2)"))).alias("base"))
    rooted = bare.select("import_id", F.explode(F.array(*[F.struct(F.lit(k + 1).alias("rank"), _below(F.lit(r), F.col("name")).alias("base")) for k, r in enumerate(("src", "app", "lib", "server", ""))])).alias("x")).select("import_id", "x.rank", "x.base")
    ends = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
    each = near.unionByName(named).unionByName(rooted).select("import_id", "rank", F.posexplode(F.array(*[F.concat("base", F.lit(e)) for e in ends])).alias("place", "candidate"))
    hit = each.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("import_id").agg(F.min_by("candidate", F.struct("rank", "place")).alias("resolved"))
    return plain.join(hit, "import_id", "left").drop("import_id")


def resolved_modules(imports: DataFrame, files: DataFrame, go_modules: DataFrame) -> DataFrame:
    """imports (path, name, kind) of Go, Java, Ruby, PHP, Rust, C and C++ files with resolved: the first place that is a file, else null.

    Every language names its places as keys: a path, a file's stem, its name, or a folder of Go files. files are
    grouped by key first, so that a name that many files share is one row (the least path), and imports meet
    them in one equi-join. go_modules (module) are those of the go.mod files; the longest that begins an import wins.
    A module's own name is its root folder. Names that no key can be made of, nulls included, stay unresolved.
    """
    path, name = F.col("path"), F.col("name")
    lang, stem = language(path), F.element_at(F.split(basename(path), r"\."), 1)
    keyed = files.select(path).where("path is not null").distinct()
    own = F.array(
        F.concat(F.lit("path:"), path), F.concat(F.lit("name:"), basename(path)), F.concat(F.lit("stem:"), stem),
        F.when(lang.isin("java", "kotlin", "scala"), F.concat(F.lit("class:"), stem)), F.when(path.endswith(".go") & ~path.endswith("_test.go"), F.concat(F.lit("go:"), dirname(path))),
    )
    places = keyed.select(F.explode(F.array_compact(own)).alias("key"), "path").groupBy("key").agg(F.min("path").alias("candidate"))
    src = "src" if not keyed.where(path.startswith("src/")).isEmpty() else ""

    def at(*options: Column) -> Column:
        return F.array(*[F.concat(F.lit("path:"), _folded(o)) for o in options])

    near = _below(dirname(path), name)
    last = lambda mark: F.element_at(F.split(name, mark), -1)
    php = F.replace(name, F.lit("\\"), F.lit("/"))
    rust = _below(F.lit(src), F.array_join(F.filter(F.split(F.regexp_replace(name, "(?:crate|self|super)::", ""), "::"), lambda p: p != ""), "/"))
    near_ruby = (F.col("kind") == "require_relative") | name.startswith(".") | name.startswith("app/")
    keys = (
        F.when(lang == "java", F.array(F.concat(F.lit("class:"), last(r"\."))))
        .when((lang == "ruby") & near_ruby, at(F.concat(near, F.lit(".rb")), F.concat(near, F.lit("/index.rb"))))
        .when(lang == "ruby", at(F.concat(name, F.lit(".rb"))))
        .when(lang == "php", F.concat(at(F.concat(php, F.lit(".php")), F.concat(php, F.lit("/index.php")), *[F.concat(F.lit(f"{r}/"), php, F.lit(".php")) for r in ("app", "src", "lib")]), F.array(F.concat(F.lit("stem:"), last(r"\\")))))
        .when(lang == "rust", at(F.concat(rust, F.lit(".rs")), F.concat(rust, F.lit("/mod.rs"))))
        .when(lang.isin("c", "cpp"), F.concat(at(near), F.array(F.concat(F.lit("name:"), basename(name)))))
    )
    rows = imports.withColumn("import_id", F.sha2(F.to_json(F.struct("path", "name", "kind")), 256))
    plain = rows.where(lang != "go").select("import_id", F.posexplode(keys).alias("place", "key"))
    # prefixes of a Go import at its slashes, longest first; the rest is a folder
    parts = F.split("name", "/")
    go = rows.where(lang == "go").select("import_id", "name", F.explode(F.transform(F.sequence(F.size(parts), F.lit(1)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(parts, 1, i), "/").alias("module")))).alias("x")).select("import_id", "name", "x.n", "x.module")
    go = go.join(go_modules.select("module").distinct(), "module").select("import_id", (-F.col("n")).alias("place"), F.concat(F.lit("go:"), F.expr("trim(LEADING '/' FROM substring(name, length(module) + 1))")).alias("key"))
    hit = plain.unionByName(go).join(places, "key").groupBy("import_id").agg(F.min_by("candidate", "place").alias("resolved"))
    return rows.join(hit, "import_id", "left").drop("import_id")


def import_edges(resolved: DataFrame) -> DataFrame:
    """Edges (source, target, kind, weight) of resolved imports without loops and repeats."""
    e = resolved.where("resolved is not null and resolved != path").select(F.col("path").alias("source"), F.col("resolved").alias("target"), F.lit("import").alias("kind"))
    return e.distinct().withColumn("weight", F.lit(1).cast("long"))


def resolved_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """calls (path, parent, name, target, line) with callee: the file that defines what is called, or null.

    Tried in order: the receiver's import, the name's import, the same file, the only definition of
    that name anywhere. What a file imports or defines is one row a word; calls meet it by file and word.
    The last try is made only for names that are left.
    """
    rows = calls.withColumn("head", F.element_at(F.split("target", r"\."), 1))
    brought = imports.where("resolved is not null").select("path", F.explode("names").alias("word"), "resolved", F.lit(None).cast("boolean").alias("here"))
    own = symbols.select("path", F.col("name").alias("word"), F.lit(None).cast("string").alias("resolved"), F.lit(True).alias("here"))
    words = staged(brought.unionByName(own).groupBy("path", "word").agg(F.min("resolved").alias("by_name"), F.max("here").alias("here")), "words")
    got = rows.join(words.withColumnRenamed("word", "name"), ["path", "name"], "left")
    heads = words.where("by_name is not null").select("path", F.col("word").alias("head"), F.col("by_name").alias("by_head"))
    dotted = got.where("head != name").join(heads, ["path", "head"], "left")
    plain = got.where("head = name or head is null").withColumn("by_head", F.lit(None).cast("string"))
    callee = F.coalesce("by_head", "by_name", F.when(F.col("here"), F.col("path")))
    part = staged(plain.unionByName(dotted).select(*calls.columns, callee.alias("callee")), "called")
    left = part.where("callee is null")
    names = staged(left.select("name").distinct(), "names")
    only = symbols.join(hinted(names), "name", "left_semi").groupBy("name").agg(F.min("path").alias("callee"), F.max("path").alias("last")).where("callee = last").drop("last")
    only = staged(only, "only")
    few = only.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    out = part.where("callee is not null").unionByName(left.drop("callee").join(F.broadcast(only) if few else only, "name", "left").select(*part.columns))
    return out if few else staged(out, "calls")


def call_edges(resolved: DataFrame) -> DataFrame:
    """Edges between files by distinct 'caller -> callee' names, with the first eight as samples."""
    pair = F.concat(F.coalesce("parent", F.lit("<module>")), F.lit(" -> "), F.col("name"))
    g = resolved.where("callee is not null and callee != path").groupBy(F.col("path").alias("source"), F.col("callee").alias("target")).agg(F.array_sort(F.collect_set(pair)).alias("pairs"))
    return g.select("source", "target", F.lit("call").alias("kind"), F.size("pairs").cast("long").alias("weight"), F.slice("pairs", 1, 8).alias("samples"))


def call_weights(resolved: DataFrame) -> DataFrame:
    """call_edges without samples: one shuffle by file, whose calls are counted in place."""
    pairs = resolved.where("callee is not null and callee != path").select(F.col("path").alias("source"), F.col("callee").alias("target"), F.coalesce("parent", F.lit("<module>")).alias("caller"), "name")
    g = pairs.repartition("source").distinct().groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
    return g.select("source", "target", F.lit("call").alias("kind"), "weight")


def workflows(routes: DataFrame, calls: DataFrame, layers: DataFrame, depth: int = 7, most_steps: int = 14) -> DataFrame:
    """Steps (route, step, distance, file, name) of each route: its handler and what that calls in turn.

    calls are resolved_calls; layers has (path, layer). All routes are walked at once, level by level;
    steps are numbered by distance, then file and name, and cut at most_steps. Later levels come after all
    earlier ones, so a route that has most_steps steps is walked no further, and none has more rows than that.
    """
    from pyspark.sql import Window

    at = layers.select(F.col("path").alias("file"), F.coalesce("layer", F.lit("other")).alias("layer")).distinct()
    hops = calls.where("callee is not null").select(F.col("path").alias("from"), F.element_at(F.split(F.coalesce("parent", F.lit("")), r"\."), -1).alias("caller"), F.col("callee").alias("file"), F.col("name").alias("name")).distinct()
    hops = staged(hops.join(at, "file", "left").select("from", "caller", "file", "name", F.coalesce("layer", F.lit("other")).alias("layer")), "hops")
    start = routes.select(F.concat_ws(" ", "kind", "name").alias("route"), F.col("path").alias("file"), F.col("parent").alias("name")).distinct()
    start = start.join(at, "file", "left").select("route", "file", "name", F.coalesce("layer", F.lit("other")).alias("layer"), F.lit(0).alias("distance"))
    each = Window.partitionBy("route")

    def level(rows: DataFrame, d: int) -> DataFrame:
        """The first rows of each route, with their place and whether the walk goes on from them."""
        found = rows.repartition("route").groupBy("route", "file", "name").agg(F.min("distance").alias("distance"), F.first("layer").alias("layer"))
        found = found.withColumn("step", F.row_number().over(each.orderBy("distance", "file", "name"))).where(F.col("step") <= most_steps)
        more = (F.max("step").over(each) < most_steps) & (F.max("distance").over(each) == d) & F.lit(d < depth)
        return staged(found.withColumn("more", more), "trace")

    done, now = [], level(start, 0)
    for d in range(1, depth + 1):
        done.append(now.where("not more"))
        seen = now.where("more").select("route", "file", "name", "layer", "distance")
        if seen.isEmpty():
            break
        front = seen.where(F.col("distance") == d - 1).select("route", F.col("file").alias("from"), F.col("name").alias("caller"))
        nxt = front.join(hops, ["from", "caller"]).select("route", "file", "name", "layer", F.lit(d).alias("distance"))
        now = level(seen.unionByName(nxt), d)
    else:
        done.append(now)
    steps = done[0]
    for x in done[1:]:
        steps = steps.unionByName(x)
    return steps.select("route", "step", "distance", "file", "name", "layer")


def resolve_target(files: DataFrame, query: str) -> DataFrame:
    """The file meant by query: exact path, else path ending in it, else file name, else the only path that holds it."""
    q = F.lit(query.strip("/"))
    rank = F.when(F.col("path") == q, 1).when(F.col("path").endswith(F.concat(F.lit("/"), q)), 2).when(basename(F.col("path")) == basename(q), 3).when(F.contains(F.lower("path"), F.lower(q)), 4)
    r = files.select("path", rank.alias("rank")).where("rank is not null")
    best = r.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("rank < 4 or n = 1")
    return best.orderBy("rank").limit(1).select("path", "rank")


def missing_tests(symbols: DataFrame, tested: DataFrame, n: int = 10) -> DataFrame:
    """Exported symbols (path, name, loc) none of whose name forms is in tested (name); longest first."""
    low = F.lower("name")
    parts = F.filter(F.transform(F.split("name", "(?=[A-Z])|_"), lambda p: F.lower(p)), lambda p: F.length(p) > 3)
    forms = F.array_distinct(F.concat(F.array(low, F.replace(low, F.lit("_"), F.lit(""))), parts))
    each = symbols.select("path", "name", F.explode(forms).alias("form"))
    hit = each.join(tested.select(F.lower("name").alias("form")).distinct(), "form", "left_semi").select("path", "name").distinct()
    return symbols.join(hit, ["path", "name"], "left_anti").orderBy(F.desc("loc"), "path", "name").limit(n)
