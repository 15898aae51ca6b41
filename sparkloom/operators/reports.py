"""Counts, metrics, filters and texts of the reports."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import ordered

# Fixed values.
MARKER_WEIGHT, ORM_START, ORM_STEP, ORM_MOST = 0.7, 0.6, 0.25, 0.95
LABELS = {
    "python": "Python", "typescript": "TypeScript", "tsx": "TypeScript (TSX)", "javascript": "JavaScript", "jsx": "JavaScript (JSX)", "go": "Go", "java": "Java", "ruby": "Ruby", "php": "PHP", "rust": "Rust",
    "csharp": "C#", "c": "C", "cpp": "C++", "kotlin": "Kotlin", "swift": "Swift", "scala": "Scala", "sql": "SQL", "prisma": "Prisma", "graphql": "GraphQL", "proto": "Protocol Buffers", "shell": "Shell", "yaml": "YAML",
    "json": "JSON", "markdown": "Markdown", "html": "HTML", "css": "CSS", "xml": "XML", "restructuredtext": "reStructuredText", "text": "Plain text", "toml": "TOML", "ini": "INI / config", "batch": "Batch",
    "docker": "Dockerfile", "make": "Make", "vue": "Vue", "svelte": "Svelte", "unknown": "Other (unrecognised)",
}


#: Excerpts whose lines are put together at once.
EXCERPT_BLOCK = 1024


def counted(rows: DataFrame, *facets: str) -> DataFrame:
    """Rows (facet, value, n): how often each value of each facet occurs, and all rows as facet 'all'."""
    sets = [F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]
    every = F.explode(F.array(F.struct(F.lit("all").alias("facet"), F.lit(None).cast("string").alias("value")), *sets))
    return rows.select(every.alias("x")).groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))


def quality_metrics(files: DataFrame, symbols: DataFrame, coupled: DataFrame) -> DataFrame:
    """One row over files (is_test, loc), symbols (complexity) and nodes (coupling): counts, test share, averages, maxima."""
    f = files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("is_test")).alias("test_files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"))
    f = f.withColumn("production_files", F.col("files") - F.col("test_files")).withColumn("test_file_ratio", F.round(F.col("test_files") / F.greatest(F.lit(1), F.col("files")), 3))
    s = symbols.agg(F.count(F.lit(1)).alias("symbols"), F.round(F.coalesce(F.avg("complexity"), F.lit(0.0)), 2).alias("avg_complexity"), F.coalesce(F.max("complexity"), F.lit(0)).alias("max_complexity"))
    c = coupled.agg(F.round(F.coalesce(F.avg("coupling"), F.lit(0.0)), 2).alias("avg_coupling"), F.count_if(F.col("coupling") == 0).alias("uncoupled"))
    return f.join(s).join(c)  # one row each


def holding(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """rows that hold needle, case and outer space aside, in one of the columns or in an item of an array column; all rows if it is empty."""
    n = needle.strip().lower()
    if not n:
        return rows
    inside = lambda c: F.contains(F.lower(c), F.lit(n))
    tests = [F.exists(F.col(c), inside) if rows.schema[c].dataType.typeName() == "array" else inside(F.col(c)) for c in columns]
    return rows.where(reduce(Column.__or__, [F.coalesce(x, F.lit(False)) for x in tests]))


def issues_shown(issues: DataFrame, kind: str | None = None, severity: str | None = None, needle: str = "") -> DataFrame:
    """Findings (kind, severity, title, files) of a kind and severity that hold needle in title or a file."""
    for name, want in (("kind", kind), ("severity", severity)):
        if want:
            issues = issues.where(F.col(name) == want)
    return holding(issues, needle, "title", "files")


def database_confidence(markers: DataFrame, orms: DataFrame) -> DataFrame:
    """Rows (name, kind, confidence, evidence): technologies by markers (name, kind, evidence, weight) found and ORM uses (name, path).

    Markers add up to 1 at most. Each use of an ORM adds to its markers, or to a start of its own, up
    to a cap that also cuts what markers gave. At most four evidences are shown, markers' first.
    """
    by = markers.groupBy("name").agg(F.min("kind").alias("kind"), F.round(F.least(F.lit(1.0), F.sum("weight")), 2).alias("start"), F.slice(F.array_sort(F.collect_set("evidence")), 1, 4).alias("found")).where("start > 0")
    used = orms.groupBy("name").agg(F.count(F.lit(1)).alias("uses"), F.slice(F.array_sort(F.collect_set("path")), 1, 4).alias("paths"))
    both = by.join(used, "name", "full")
    grown = F.least(F.lit(ORM_MOST), F.round(F.coalesce("start", F.lit(ORM_START)) + ORM_STEP * F.col("uses"), 2))
    none = F.array().cast("array<string>")
    seen = F.slice(F.concat(F.coalesce("found", none), F.coalesce("paths", none)), 1, 4)
    return both.select("name", F.coalesce("kind", F.lit("orm")).alias("kind"), F.when(F.col("uses").isNull(), F.col("start")).otherwise(grown).alias("confidence"), F.array_join(seen, ",").alias("evidence"))


def migration_only(migrations: DataFrame, models: DataFrame) -> DataFrame:
    """Tables (table, path) that migrations (path, table) name and no model (table) has; of several migrations the first path."""
    return migrations.join(models.select("table"), "table", "left_anti").groupBy("table").agg(F.min("path").alias("path"))


def known_orms(models: DataFrame) -> DataFrame:
    return models.select("orm").where("orm is not null and orm != 'unknown'").distinct()


def layer_notes(layers: DataFrame) -> DataFrame:
    """Rows (note) that the set of layers (layer) of a code base calls for."""
    have = layers.agg(F.collect_set("layer").alias("x"))  # a layer's name each
    has = lambda *names: F.arrays_overlap("x", F.array(*[F.lit(n) for n in names]))
    notes = [(has("ui") & has("route"), "front end and API"), (has("service"), "service layer"), (has("repository"), "data access layer"), (~has("service", "repository"), "layers by name only"), (has("test"), "tests")]
    return have.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in notes]))).alias("note"))


def handlers_elsewhere(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """routes (handler, path) whose handler no symbol (name, path) of their own file defines, with the first file that does, or null."""
    own = symbols.select(F.col("name").alias("handler"), "path").distinct()
    first = own.groupBy("handler").agg(F.min("path").alias("defined_in"))
    return routes.join(own, ["handler", "path"], "left_anti").join(first, "handler", "left")


def by_folded_name(repos: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (name) with the id of the repository (id, name) of that name, case aside."""
    key = repos.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("id"))
    return asked.withColumn("key", F.lower("name")).join(key, "key", "left").drop("key")


def citations(scored: DataFrame, most: int | None = None) -> DataFrame:
    """Rows (n, path, start_line, end_line, score) of the excerpts of a prompt, numbered by score, path and line; the first `most` if given.

    Numbers are places in ranges of the order, so any number of excerpts is numbered without one task for all.
    """
    order = [F.col("score").desc(), F.col("path"), F.col("start_line"), F.col("end_line")]
    if most is not None:
        scored = scored.orderBy(*order).limit(most)
    return ordered.ranked(scored, order, "_at").select((F.col("_at") + 1).cast("int").alias("n"), "path", "start_line", "end_line", F.round("score", 3).alias("score"))


def prompt_excerpts(scored: DataFrame, most: int | None = None) -> DataFrame:
    """One row (prompt): the numbered excerpts (path, start_line, end_line, text, score) of one prompt, best first; all, or the first `most` if given.

    Numbers are places in ranges of the order; each excerpt carries its own text, so equal places in a file stay
    apart. Tasks put blocks of excerpts together; the row itself is the whole prompt, so it must fit one value (2 GB).
    """
    order = [F.col("score").desc(), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("text")]
    if most is not None:
        scored = scored.orderBy(*order).limit(most)
    numbered = ordered.ranked(scored, order, "_at")
    line = F.concat(F.lit("["), (F.col("_at") + 1).cast("string"), F.lit("] "), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n"), "text")
    joined = lambda k, s: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(k), s.alias("s")))), lambda x: x["s"]), "\n\n")
    blocks = numbered.groupBy(F.floor(F.col("_at") / EXCERPT_BLOCK).alias("_block")).agg(joined("_at", line).alias("part"))
    return blocks.agg(F.nullif(joined("_block", F.col("part")), F.lit("")).alias("prompt"))


def highlighted(text: Column, query: str) -> Column:
    """text with each of the query's words of two letters and more in <mark>, case aside."""
    words = list(dict.fromkeys(w for w in query.split() if len(w) >= 2))
    return F.regexp_replace(text, "(?i)(" + "|".join(re.escape(w) for w in words) + ")", "<mark>$1</mark>") if words else text


def language_label(language: Column) -> Column:
    """The name to show: known labels, else the words with capitals."""
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, language), F.initcap(F.replace(language, F.lit("_"), F.lit(" "))))


def impact_lines(target: DataFrame, dependents: DataFrame, tests: DataFrame, risks: DataFrame) -> DataFrame:
    """One row (lines): the summary of an impact report over target (id, layer, loc), dependents (id, distance), tests (id) and risks (id, level, risk) of it."""
    d = dependents.agg(F.count_if(F.col("distance") == 1).alias("direct"), F.count(F.lit(1)).alias("every"))
    t = tests.agg(F.count(F.lit(1)).alias("tests"))
    r = risks.join(target.select("id"), "id", "left_semi").agg(F.slice(F.array_sort(F.collect_list(F.concat(F.lit("risk ["), F.col("level"), F.lit("]: "), F.col("risk")))), 1, 4).alias("risks"))  # eight rules at most
    head = [
        F.format_string("target: %s (layer %s, %s loc)", F.col("id").cast("string"), F.col("layer"), F.col("loc").cast("string")),
        F.format_string("files that depend on it: %s", F.col("direct").cast("string")),
        F.format_string("transitive dependents: %s", F.col("every").cast("string")),
        F.format_string("related tests: %s", F.col("tests").cast("string")),
    ]
    return target.join(d).join(t).join(r).select(F.array_join(F.concat(F.array(*head), F.col("risks")), "\n").alias("lines"))  # one row each
