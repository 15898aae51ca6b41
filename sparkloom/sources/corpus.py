"""Source trees and manifests as tables."""

from __future__ import annotations

import posixpath
import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.paths import basename, language
from sparkloom.operators import ordered
from sparkloom.plans.storage import staged

# Fixed values.
IGNORED_FOLDERS = ("node_modules", ".next", "dist", "build", "out", "target", "vendor", "__pycache__", ".venv", "venv", ".tox", ".cache", "coverage", ".idea", ".vscode", "site-packages", ".git")
BINARY = ("png", "jpg", "jpeg", "gif", "webp", "ico", "pdf", "zip", "gz", "bz2", "xz", "7z", "jar", "class", "pyc", "so", "dll", "exe", "bin", "woff", "woff2", "ttf", "mp3", "mp4", "sqlite", "db", "parquet", "lock")
MANIFESTS = ("package.json", "requirements.txt", "pyproject.toml", "go.mod", "Cargo.toml", "composer.json", "Gemfile", "pom.xml", "build.gradle", "setup.py")
MAX_FILES, MAX_BYTES, MAX_TOTAL, MAX_MANIFESTS, MAX_DEPENDENCIES = 4000, 1_048_576, 104_857_600, 12, 400


def is_binary(content: Column) -> Column:
    """A zero byte in the first KiB, or less than seven tenths printable in the first four."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    bad = F.regexp_count(head, F.lit(r"[\x00-\x08\x0E-\x1F\x7F]"))
    return F.contains(F.left(head, F.lit(1024)), F.lit("\x00")) | (bad > 0.3 * F.length(head))


def budgeted(files: DataFrame, max_files: int, max_total: int) -> DataFrame:
    """files (path, size, reason, ...) whose reason also says `over count` or `over budget`.

    Files without a reason are taken in order of path while they are at most max_files and at most
    max_total bytes in all; the rest gets a reason. A file too large for what is left is passed over
    and still counts, so that what is taken does not hang on gaps. Places and bytes before
    a file are running sums over ranges of paths, not one task's.
    """
    kept = ordered.running(files.where("reason is null"), [F.col("path")], F.lit(1), "_at")
    kept = ordered.running(kept, [F.col("path")], F.col("size"), "_before")
    why = F.when(F.col("_at") >= max_files, "over count").when(F.col("_before") + F.col("size") > max_total, "over budget")
    return kept.withColumn("reason", why).drop("_at", "_before").unionByName(files.where("reason is not null"))


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """Rows (path, size) of the files of no bytes below root, which Spark's file sources leave out."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    left, out = [at], []
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while left:
        for f in fs.listStatus(left.pop()):
            if f.isDirectory():
                if f.getPath().getName() not in IGNORED_FOLDERS:
                    left.append(f.getPath())
            elif f.getLen() == 0:
                out.append((f.getPath().toString(), 0))
    return spark.createDataFrame(out, "path string, length long")


def read_tree(spark: SparkSession, root: str, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES, max_total: int = MAX_TOTAL) -> DataFrame:
    """Rows (path, text, size, reason), one for each file below root; reason says why a file was passed over.

    Only files without a reason carry their text: the first by path, at most max_files and max_total bytes
    of them (budgeted). Empty files, which Spark's file sources leave out, are listed by the driver,
    ignored folders aside.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    named = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(base) + "/", "").alias("path")
    files = raw.select(named, F.col("length").alias("size"), "content")
    ignored = F.exists(F.split("path", "/"), lambda s: s.isin(*IGNORED_FOLDERS))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    early = F.when(ignored, "ignored folder").when(suffix.isin(*BINARY), "binary suffix").when(F.col("size") == 0, "empty").when(F.col("size") > max_bytes, "too large")
    light = files.select("path", "size", F.when(early.isNotNull(), early).when(is_binary(F.col("content")), "binary content").alias("reason"))
    none = empty_files(spark, root).select(named, F.col("length").alias("size"))
    light = staged(light.unionByName(none.select("path", "size", early.alias("reason"))), "tree")
    light = staged(budgeted(light, max_files, max_total), "tree")
    kept = light.where("reason is null").select("path", "size", "reason")  # at most max_files rows
    texts = files.select("path", F.decode("content", "UTF-8").alias("text")).join(F.broadcast(kept) if max_files <= MAX_FILES else kept, "path")
    return texts.select("path", "text", "size", "reason").unionByName(light.where("reason is not null").select("path", F.lit(None).cast("string").alias("text"), "size", "reason"))


def read_tarballs(spark: SparkSession, path: str, max_entries: int = 40_000, max_bytes: int = MAX_BYTES, max_total: int = MAX_TOTAL) -> DataFrame:
    """Rows (archive, path, text, size, reason), one for each file in .tar.gz files; only safe ones without a reason carry their text.

    Reasons: `unsafe path`, `link`, `empty`, `too large`, `over budget` (max_total expanded bytes of an archive, in its
    order) and `over count` (one row with the path of the first entry past max_entries, where reading ends).
    """

    def members(batches):
        import io
        import tarfile

        def row(tar, m, left):
            safe = not m.name.startswith("/") and ".." not in m.name.split("/")
            why = "unsafe path" if not safe else "link" if m.issym() or m.islnk() else "empty" if not m.size else "too large" if m.size > max_bytes else "over budget" if m.size > left else None
            return (posixpath.normpath(m.name) if safe else m.name), None if why else tar.extractfile(m).read().decode("utf-8", "replace"), m.size, why

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows, left = [], max_total
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for k, m in enumerate(tar):
                        if k >= max_entries:
                            rows.append((name, m.name, None, m.size, "over count"))
                            break
                        if m.isfile() or m.issym() or m.islnk():
                            rows.append((name, *row(tar, m, left)))
                            left -= m.size if rows[-1][4] is None else 0
                        if len(rows) >= 500:
                            yield pd.DataFrame(rows, columns=["archive", "path", "text", "size", "reason"])
                            rows = []
                yield pd.DataFrame(rows, columns=["archive", "path", "text", "size", "reason"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(members, "archive string, path string, text string, size long, reason string")


def _toml_dependencies(text: str, name: str) -> list[tuple[str, str]]:
    data, out = tomllib.loads(text), []
    if name == "Cargo.toml":
        for part in ("dependencies", "dev-dependencies", "build-dependencies"):
            out += [(k, v if isinstance(v, str) else str(v.get("version", ""))) for k, v in data.get(part, {}).items()]
        return out
    project = data.get("project", {})
    for spec in [*project.get("dependencies", []), *[x for xs in project.get("optional-dependencies", {}).values() for x in xs]]:
        if m := re.match(r"\s*([A-Za-z0-9_.-]+)(?:\[[^\]]*\])?\s*([^;]*)", spec):
            out.append((m[1], m[2].strip()))
    poetry = data.get("tool", {}).get("poetry", {})
    for part in [poetry.get("dependencies", {}), *[g.get("dependencies", {}) for g in poetry.get("group", {}).values()]]:
        out += [(k, v if isinstance(v, str) else str(v.get("version", ""))) for k, v in part.items() if k != "python"]
    return out


_PAIRS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType())]))


@F.pandas_udf(_PAIRS)
def toml_dependencies(text: pd.Series, name: pd.Series) -> pd.Series:
    def one(t, n):
        try:
            return [{"name": a, "version": b} for a, b in _toml_dependencies(t, n)]
        except (tomllib.TOMLDecodeError, AttributeError):
            return []

    return pd.Series([one(t, n) for t, n in zip(text, name, strict=True)])


def _pairs(text: Column, pattern: str) -> Column:
    """(name, version) from the two groups of a pattern."""
    got = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2)]
    return F.zip_with(*got, lambda a, b: F.struct(a.alias("name"), F.btrim(b).alias("version")))


def _json_pairs(text: Column, sections: tuple[str, ...]) -> Column:
    parsed = F.from_json(text, ", ".join(f"`{s}` map<string,string>" for s in sections))
    each = [F.coalesce(F.transform(F.map_entries(parsed[s]), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"))), F.array().cast("array<struct<name: string, version: string>>")) for s in sections]
    return F.concat(*each)


def dependencies(files: DataFrame) -> DataFrame:
    """Rows (manifest, ecosystem, name, version) of the first manifests by path.

    JSON, line and XML formats are read by column functions; TOML by one pandas function.
    """
    name = basename(F.col("path"))
    m = files.where(name.isin(*MANIFESTS)).orderBy("path").limit(MAX_MANIFESTS).withColumn("file", basename(F.col("path")))
    t = F.col("text")
    line = r"(?m)^\s*([A-Za-z0-9_.-]+)(?:\[[^\]]*\])?[ \t]*((?:[=<>!~]=?|===)[^;#\r\n]*)?(?:[;#].*)?$"
    found = (
        F.when(F.col("file") == "package.json", _json_pairs(t, ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")))
        .when(F.col("file") == "composer.json", _json_pairs(t, ("require", "require-dev")))
        .when(F.col("file") == "requirements.txt", _pairs(F.regexp_replace(t, r"(?m)^\s*(?:#|-).*$", ""), line))
        .when(F.col("file") == "go.mod", _pairs(t, r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/[^\s]+)\s+(v[^\s]+)"))
        .when(F.col("file") == "Gemfile", _pairs(t, r"""(?m)^\s*gem\s+['"]([^'"]+)['"](?:\s*,\s*['"]([^'"]+)['"])?"""))
        .when(F.col("file") == "pom.xml", _pairs(t, r"(?s)<dependency>.*?<artifactId>([^<]+)</artifactId>(?:\s*<version>([^<]*)</version>)?"))
        .when(F.col("file") == "build.gradle", _pairs(t, r"""(?m)^\s*(?:implementation|api|compile|testImplementation)\s*\(?['"]([^:'"]+:[^:'"]+)(?::([^'"]+))?"""))
        .when(F.col("file") == "setup.py", _pairs(F.regexp_extract(t, r"(?s)install_requires\s*=\s*\[(.*?)\]", 1), r"""['"]([A-Za-z0-9_.-]+)([^'"]*)['"]"""))
        .otherwise(toml_dependencies(t, F.col("file")))
    )
    ecosystem = F.when(F.col("file").isin("package.json"), "npm").when(F.col("file").isin("go.mod"), "go").when(F.col("file").isin("Cargo.toml"), "cargo").when(F.col("file").isin("composer.json"), "composer").when(F.col("file").isin("Gemfile"), "rubygems").when(F.col("file").isin("pom.xml", "build.gradle"), "maven").otherwise("pypi")
    out = m.select(F.col("path").alias("manifest"), ecosystem.alias("ecosystem"), F.explode(F.slice(found, 1, MAX_DEPENDENCIES)).alias("d"))
    return out.select("manifest", "ecosystem", "d.name", F.nullif(F.col("d.version"), F.lit("")).alias("version"))


def aliases(files: DataFrame) -> DataFrame:
    """Rows (base, alias, target) from tsconfig.json and jsconfig.json; comments and trailing commas allowed."""
    bare = F.regexp_replace(F.regexp_replace("text", r'(?m)("(?:[^"\\]|\\.)*")|//[^\r\n]*|(?s:/\*.*?\*/)', "$1"), r",(\s*[}\]])", "$1")
    c = F.from_json(bare, "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>")["compilerOptions"]
    rows = files.where(basename(F.col("path")).isin("tsconfig.json", "jsconfig.json")).select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), c["baseUrl"].alias("url"), F.explode(c["paths"]).alias("alias", "targets"))
    strip = lambda x: F.regexp_replace(x, r"/?\*$", "")
    base = F.concat_ws("/", F.nullif("folder", F.lit("")), F.nullif(F.regexp_replace(F.coalesce("url", F.lit("")), r"^\./?|/$|^\.$", ""), F.lit("")))
    return rows.select(base.alias("base"), strip(F.col("alias")).alias("alias"), F.explode("targets").alias("t")).select("base", "alias", strip(F.regexp_replace("t", r"^\./", "")).alias("target"))


def go_modules(files: DataFrame) -> DataFrame:
    """Rows (path, module) of the go.mod files."""
    found = F.regexp_extract("text", r"(?m)^\s*module\s+(\S+)", 1)
    return files.where(basename(F.col("path")) == "go.mod").select("path", found.alias("module")).where("module != ''")


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language(F.col("path")))
