"""Run-partitioned tables: replace, delete, upsert, artifacts, bundles and Markdown exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def replace_run(df: DataFrame, path: str) -> None:
    """Writes df (analysis_id, ...) so that the runs it holds are replaced and all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(path)


def delete_run(spark: SparkSession, paths: list[str], analysis_id: str) -> None:
    """Drops the run's partition from every table."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        part = jvm.org.apache.hadoop.fs.Path(f"{p}/analysis_id={analysis_id}")
        fs = part.getFileSystem(conf)
        if fs.exists(part):
            fs.delete(part, True)


def orphaned(repos: DataFrame, runs: DataFrame) -> DataFrame:
    """Repositories that no run is left of."""
    return repos.join(runs.select(F.col("repo_id").alias("id")), "id", "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in place of those of the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row of each key with the greatest `by`."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max(F.struct(by, *[c for c in rest if c != by])).alias("x"))
    return g.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def first_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order, over the whole table and not slice by slice."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def artifact(df: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """One JSON artifact of each key: keys, kind, payload (a sorted array of the other columns)."""
    rest = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(rest))).alias("payload")).withColumn("kind", F.lit(kind))


def bundle(parts: dict[str, DataFrame]) -> DataFrame:
    """One row (bundle): a JSON object with a sorted array for each part."""
    out: DataFrame | None = None
    for name, df in parts.items():
        one = df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
        out = one if out is None else out.join(one)  # one row each
    return out.select(F.to_json(F.struct(*parts)).alias("bundle"))


def markdown_table(df: DataFrame, columns: list[str], order: list[str], by: list[str]) -> DataFrame:
    """One Markdown table (by, markdown) a group, its rows in order."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"])
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return df.groupBy(*by).agg(F.concat(F.lit(head + "\n"), F.array_join(rows, "\n")).alias("markdown"))


#: Bytes of a file that are shown.
SHOWN_BYTES = 400_000


def files_shown(asked: DataFrame, stored: DataFrame, checkout: DataFrame, remote: DataFrame, most: int = SHOWN_BYTES) -> DataFrame:
    """Rows (path, origin, content, truncated), one for each asked path: the text stored with the run, else that of the checkout, else the remote one.

    stored and checkout are (path, text), remote is (path, base64); a path stands once in each. A text is cut
    to `most` bytes at a character's end; what no source holds is empty, of origin `none`, and counts as truncated.
    """
    rows = asked.select("path").join(stored.select("path", F.col("text").alias("_stored")), "path", "left").join(checkout.select("path", F.col("text").alias("_checkout")), "path", "left")
    rows = rows.join(remote.select("path", F.try_to_binary("base64", F.lit("base64")).cast("string").alias("_remote")), "path", "left")
    origin = F.when(F.col("_stored").isNotNull(), "stored").when(F.col("_checkout").isNotNull(), "checkout").when(F.col("_remote").isNotNull(), "remote").otherwise("none")
    text = F.coalesce("_stored", "_checkout", "_remote", F.lit(""))
    # in a binary that reads each byte as a character, those of a character that the cut goes through are left out
    head = F.decode(F.substring(text.cast("binary"), 1, most), "ISO-8859-1")
    whole = F.regexp_replace(head, "[À-ÿ][\u0080-¿]{0,2}$", "")
    split = F.substring(text.cast("binary"), most + 1, 1).between(F.lit(b"\x80"), F.lit(b"\xbf"))
    long = F.octet_length(text) > most
    cut = F.encode(F.when(split, whole).otherwise(head), "ISO-8859-1").cast("string")
    return rows.select("path", origin.alias("origin"), F.when(long, cut).otherwise(text).alias("content"), (long | (origin == "none")).alias("truncated"))


def index_status(now: Column, indexed_at: Column, model: Column, want_model: str, ttl_hours: int) -> Column:
    """missing, expired (the boundary included), stale model or ready."""
    return (
        F.when(indexed_at.isNull(), "missing")
        .when(indexed_at + F.expr(f"INTERVAL {ttl_hours} HOURS") <= now, "expired")
        .when(model != want_model, "stale model")
        .otherwise("ready")
    )


def sql_kind(c: Column) -> Column:
    """Kind of a statement by its first word; raw if that is none of the known."""
    word = F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1))
    return F.when(word.isin("select", "insert", "update", "delete"), word).when(word.isin("create", "alter", "drop"), "ddl").when(word == "with", "select").otherwise("raw")


def sql_tables(c: Column) -> Column:
    """Distinct lower-case table names after FROM, JOIN, INTO, UPDATE and DELETE FROM."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\b(?:from|join|into|update)\s+[\"`\[]?([A-Za-z_][\w.]*)"), F.lit(1)), lambda t: F.lower(t))))
