"""Benchmark decontamination with spaced seeds; built-in column functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: By the least number of tokens of an item: masks over consecutive tokens; a 0 marks a token that may differ.
#: Enumerated: at every token of both sides, each set hits all substitutions that SHARE allows in a
#: stretch of that many tokens (of WINDOW, for longer items), and so in any longer one with as many.
MASKS = {
    5: ("1111", "11101", "11011", "10111"),
    7: ("11111", "111011", "110111"),
    10: ("111011", "11010011", "11111"),
    13: ("111010111", "11011001011", "101001110011"),
}
#: Items of fewer tokens are no evidence of a leak.
SHORT = min(MASKS)
#: A leak: of WINDOW aligned tokens (of all, if the item has fewer) at least SHARE are equal.
WINDOW, SHARE = 13, 0.8


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def _seeded(rows: DataFrame, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    """Rows (*keep, at, seed): a hash for each mask at each token of h; compiled, as no function over arrays is used."""
    seed = lambda m: F.when(F.col("at") + len(m) <= F.size("h"), F.xxhash64(F.lit(m), *[F.get("h", F.col("at") + c) for c, x in enumerate(m) if x == "1"]))
    out = rows.select(*keep, "h", F.posexplode("h").alias("at", "_token"))
    return out.select(*keep, "at", F.explode(F.array(*[seed(m) for m in masks])).alias("seed")).where("seed is not null")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (row_key, items, best_share): of each distinct document that holds a benchmark passage.

    items: the ids of the items found, ascending. row_key: digest of id and text, see common.row_key.
    Seeds of both sides are joined; each hit fixes an alignment of item and document, and each
    alignment is then verified token by token. A candidate that only shares a hash is rejected there.
    """
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item"), token_hashes(F.col(item_text)).alias("h"))
    items = common.staged(items.where(F.size("h") >= SHORT).distinct().withColumn("n", F.size("h")), "leak-items")
    rows = docs.select(common.row_key(id_col, text_col).alias("row_key"), token_hashes(F.col(text_col)).alias("h"))

    least = [*MASKS, 1 << 30]
    has = {n: F.col("n").between(n, least[k + 1] - 1) for k, n in enumerate(MASKS)}
    seeds = reduce(DataFrame.unionByName, [_seeded(items.where(has[n]), ["item", "n"], MASKS[n]) for n in MASKS])
    seeds = common.staged(seeds.withColumnRenamed("at", "item_at"), "leak-seeds")
    some = items.agg(*[F.max(x) for x in has.values()]).first()
    masks = tuple(dict.fromkeys(m for n, x in zip(MASKS, some) if x for m in MASKS[n])) or MASKS[SHORT]
    found = _seeded(rows, ["row_key"], masks).join(common.sized(seeds, 80), "seed")
    found = found.select("row_key", "item", "n", (F.col("at") - F.col("item_at")).alias("shift"))
    found = common.staged(found.distinct(), "leak-hits")
    note = found.groupBy("row_key").agg(F.collect_list(F.struct("item", "n", "shift")).alias("hits"))  # bounded by document and items
    note = common.staged(note, "leak-notes")
    note = common.sized(note, 100, F.size("hits"), 24)
    texts = docs.select(common.row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("t")).join(note, "row_key")
    pairs = texts.select("row_key", token_hashes(F.col("t")).alias("dh"), "hits")
    # of a document only the stretch that lies beside the item goes on with a hit
    pairs = pairs.select("row_key", "dh", F.explode("hits").alias("x")).select(
        "row_key", "x.item", "x.shift", F.slice("dh", F.greatest(F.lit(0), F.col("x.shift")) + 1, F.col("x.n") + F.least(F.lit(0), F.col("x.shift"))).alias("dh")
    )
    pairs = pairs.join(common.sized(items, 60, F.col("n"), 8), "item")
    b = F.greatest(F.lit(0), -F.col("shift"))
    m = F.least(F.size("dh"), F.col("n") - b)
    same = F.zip_with(F.slice("dh", F.lit(1), m), F.slice("h", b + 1, m), lambda x, y: F.when(x == y, 1).otherwise(0))
    wide = F.least(F.lit(WINDOW), F.col("n"))
    pairs = common.staged(pairs.where(m >= wide).select("row_key", "item", wide.alias("w"), same.alias("same")), "leak-aligned")
    windows = F.transform(F.sequence(F.lit(0), F.size("same") - F.col("w")), lambda i: F.aggregate(F.slice("same", i + 1, F.col("w")), F.lit(0), lambda s, x: s + x))
    share = pairs.select("row_key", "item", (F.array_max(windows) / F.col("w")).alias("share")).where(F.col("share") >= SHARE)
    return share.groupBy("row_key").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("share").alias("best_share"))


def leak_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Rows (doc_id, n_items, items, best_share, leaked), one per input row.

    items: comma-joined ids of the benchmark items found. A null or short text holds no leak, a null
    item is skipped, and an empty benchmark gives no leak. Repeated rows each get their row; null
    ids are ordinary ids. Extra columns are ignored.
    """
    leaks = common.staged(find_leaks(docs, benchmark, id_col, text_col, **kw), "leaks")
    ids = docs.select(F.col(id_col).alias("doc_id"), common.row_key(id_col, text_col).alias("row_key"))
    out = ids.join(common.sized(leaks, 120, F.size("items"), 8), "row_key", "left")
    return out.select(
        "doc_id",
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), F.lit("")).alias("items"),
        F.coalesce("best_share", F.lit(0.0)).alias("best_share"),
        F.col("items").isNotNull().alias("leaked"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs without the documents that hold a benchmark passage."""
    leaks = common.staged(find_leaks(docs, benchmark, id_col, text_col, **kw).select(F.col("row_key").alias("_leak")), "leaks")
    return docs.withColumn("_leak", common.row_key(id_col, text_col)).join(common.sized(leaks, 80), "_leak", "left_anti").select(*docs.columns)
