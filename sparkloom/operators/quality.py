"""Quality rules over texts and measured rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as t

# Fixed patterns and values.
TODO = r"(?i)\b(TODO|FIXME|HACK|XXX)\b[:\s](.{0,90})"
SECRET_NAMES = ("api[_-]?key", "secret[_-]?key", "access[_-]?token", "auth[_-]?token", "private[_-]?key", "client[_-]?secret", "db_password")
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\d+|[^\sA-Za-z0-9_]"
PASSED_OVER = ("self", "this", "def", "function", "const", "let", "var")
PLACEHOLDERS = ("changeme", "your-key-here", "xxx", "todo", "placeholder", "example", "test", "secret")
SEVERITY_WEIGHT = {"high": 1.0, "medium": 0.6, "low": 0.3, "info": 0.1}
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2, "info": 3}


def normal_prefix(c, n: int = 240):
    """Identity of a text's first n tokens (names, numbers, single signs) without some keywords: what duplicates share."""
    every = F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    kept = F.filter(every, lambda x: ~x.isin(*PASSED_OVER))
    return F.sha1(F.array_join(F.slice(kept, 1, n), " "))


def duplicate_groups(chunks: DataFrame, least_lines: int = 8) -> DataFrame:
    """Groups of chunks of at least least_lines lines with equal normalised prefixes: shingle, members, first, paths."""
    long = chunks.where(F.size(F.split("text", "\n")) >= least_lines)
    g = long.groupBy(normal_prefix(F.col("text")).alias("shingle"))
    return g.agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first"), F.countDistinct("path").alias("paths")).where("members > 1")


def secrets(chunks: DataFrame, most_chars: int | None = 200_000, names: tuple[str, ...] = SECRET_NAMES) -> DataFrame:
    """Credentials written out: id, name, value_chars, line; those that hold a placeholder, name or value, are passed over.

    Only the first most_chars of a text are read; None reads all of it.
    """
    pattern = F.lit(rf"""(?i)\b({"|".join(names)})\b\s*[:=]\s*['"]([^'"]{{12,}})['"]""")
    body = F.col("text") if most_chars is None else F.left("text", F.lit(most_chars))
    part = lambda k: F.regexp_extract_all("body", pattern, F.lit(k))
    hit = F.arrays_zip(part(0).alias("whole"), part(1).alias("name"), part(2).alias("value"))
    rows = chunks.select("id", body.alias("body")).where(F.regexp("body", pattern)).select("id", "body", F.explode(hit).alias("h"))
    plain = F.exists(F.array(*[F.lit(p) for p in PLACEHOLDERS]), lambda p: F.contains(F.lower(F.col("h.whole")), p))
    at = F.position(F.col("h.whole"), F.col("body")) - 1
    return rows.where(~plain).select("id", F.lower("h.name").alias("name"), F.length("h.value").alias("value_chars"), t.line_of(F.col("body"), at).alias("line"))


def todos(chunks: DataFrame) -> DataFrame:
    """Markers of unfinished work: id, markers."""
    n = F.regexp_count("text", F.lit(TODO))
    return chunks.select("id", n.cast("long").alias("markers")).where("markers > 0")


def todo_samples(chunks: DataFrame, n: int = 6) -> DataFrame:
    """The first n markers by chunk and place: id, at, sample."""
    found = F.regexp_extract_all("text", F.lit(TODO), F.lit(0))
    return chunks.select("id", F.posexplode(found).alias("at", "sample")).orderBy("id", "at").limit(n).select("id", "at", t.truncated(F.col("sample"), 80).alias("sample"))


def health(issues: DataFrame, symbols: int) -> DataFrame:
    """One row: issues, penalty and the health score of 0 to 100."""
    weight = F.lit(0.0)
    for k, v in SEVERITY_WEIGHT.items():
        weight = F.when(F.col("severity") == k, F.lit(v)).otherwise(weight)
    p = issues.agg(F.count(F.lit(1)).alias("issues"), F.round(F.coalesce(F.sum(weight), F.lit(0.0)), 4).alias("penalty"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(100 - F.col("penalty") / F.lit(max(1.0, symbols / 40)) * 10))).cast("long")
    return p.withColumn("score", score).withColumn("label", F.when(score >= 80, "strong").when(score >= 60, "fair").otherwise("needs attention"))
