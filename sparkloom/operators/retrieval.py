"""Search and retrieval over chunks (id, path, text) and vectors (id, embedding)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as t
from sparkloom.plans.storage import staged


def lexical_search(chunks: DataFrame, query: str, n: int = 12, least: float = 0.01, per_path: int | None = None) -> DataFrame:
    """The n best chunks by lexical score; ties by id. With per_path, at most so many of a path."""
    import re

    body = F.lower(F.concat_ws(" ", "path", "text"))  # a score above 0 needs one of the terms, which is cheap to see
    some = [F.contains(body, F.lit(x)) for x in sorted({x.lower() for x in re.findall(t.IDENTIFIER, query)})]
    s = chunks.where(reduce(Column.__or__, some, F.lit(False))).withColumn("score", F.round(t.lexical_score(query, F.concat_ws(" ", "path", "text")), 4)).where(F.col("score") > least).select("id", "path", "score")
    if per_path:
        w = Window.partitionBy("path").orderBy(F.desc("score"), "id")
        s = s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_path).drop("r")
    return s.orderBy(F.desc("score"), "id").limit(n)


def grep(chunks: DataFrame, needle: str, n: int = 60) -> DataFrame:
    """Chunks that hold the needle, case aside; first by id."""
    return chunks.where(F.contains(F.lower("text"), F.lit(needle.lower()))).select("id", "path", t.truncated(F.col("text"), 260).alias("snippet")).orderBy("id").limit(n)


def grep_terms(chunks: DataFrame, query: str, n: int = 60) -> DataFrame:
    """Chunks whose terms include all of the query's."""
    import re

    wanted = F.array(*[F.lit(x) for x in sorted({x.lower() for x in re.findall(t.IDENTIFIER, query)})])
    return chunks.where(F.size(F.array_except(wanted, t.terms(F.col("text")))) == 0).select("id", "path").orderBy("id").limit(n)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def cosine_topk(vectors: DataFrame, query: list[float], k: int = 6) -> DataFrame:
    """The k nearest vectors by exact cosine; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = vectors.where(F.size("embedding") == len(query)).select("id", F.round(cosine(F.col("embedding"), q), 4).alias("score"))
    return s.orderBy(F.desc("score"), "id").limit(k)


def round_robin(chunks: DataFrame, n: int, least_chars: int = 40, most_chars: int = 3500) -> DataFrame:
    """First chunk of each path in order of first appearance, then each path's second, and so on."""
    ok = chunks.where((F.length("text") >= least_chars) & ~F.col("path").contains("..")).dropDuplicates(["id"])
    ok = ok.withColumn("depth", F.row_number().over(Window.partitionBy("path").orderBy("id")))
    firsts = ok.groupBy("path").agg(F.min("id").alias("first"))
    return ok.where(F.col("depth") <= n).join(firsts, "path").orderBy("depth", "first").limit(n).select("id", "path", "depth", F.least(F.length("text"), F.lit(most_chars)).alias("chars"))


def doc_slices(chunks: DataFrame, size: int = 4000, least: int = 40) -> DataFrame:
    """Slices of size characters, with the line on which each begins; shorter ones than least are left out."""
    n = F.length("text")
    s = chunks.where(n > 0).select("id", "text", F.explode(F.sequence(F.lit(0), n - 1, F.lit(size))).alias("start"))
    s = s.withColumn("slice", F.substr("text", F.col("start") + 1, F.lit(size)))
    breaks = F.length("slice") - F.length(F.replace("slice", F.lit("\n"), F.lit("")))
    w = Window.partitionBy("id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("breaks", breaks).withColumn("line", F.coalesce(F.sum("breaks").over(w), F.lit(0)) + 1)
    return s.where(F.length(F.btrim("slice")) >= least).select("id", "start", "line", F.length("slice").alias("chars"))


def code_chunks(files: DataFrame, symbols: DataFrame, body: int = 4000, most: int = 6000, head: int = 2500) -> DataFrame:
    """Rows (path, symbol, kind, start_line, end_line, text, tokens): a chunk for each function, method, class and component, and one for a file of two symbols at most.

    files: path, text, language; symbols: path, name, kind, parent, line, end_line, doc. A file's symbols are
    brought to its row and their lines cut from it there, so a text is not repeated for each of them. Symbols
    without lines give no chunk; a file whose first `head` characters hold 60 or less is left out, and so is a null text.
    """
    s = symbols.groupBy("path").agg(F.collect_list(F.struct("line", "end_line", "name", "kind", "parent", "doc")).alias("all"))  # the symbols of one file
    rows = files.where("text is not null").select("path", "text", "language").join(s, "path", "left").withColumn("all", F.coalesce("all", F.array().cast(s.schema["all"].dataType)))
    lines = F.split("text", r"\r\n|[\n\r]")
    kept = F.filter("all", lambda x: x["kind"].isin("function", "method", "class", "component") & x["line"].isNotNull() & x["end_line"].isNotNull())
    cut = F.transform(kept, lambda x: F.struct(x.alias("s"), F.array_join(F.slice(lines, x["line"], F.greatest(x["end_line"] - x["line"] + 1, F.lit(0))), "\n").alias("code")))
    each = rows.select("path", "language", F.explode(cut).alias("x")).select("path", "language", "x.s.*", "x.code")
    code = F.when(F.length("code") > body, F.concat(F.left("code", F.lit(body)), F.lit("\n… (truncated)"))).otherwise(F.col("code"))
    within = F.coalesce(F.concat(F.lit(" in class "), "parent"), F.lit(""))
    purpose = F.coalesce(F.concat(F.lit("purpose: "), "doc", F.lit("\n")), F.lit(""))
    whole = F.concat(F.lit("file: "), "path", F.lit("\nlanguage: "), "language", F.lit("\nsymbol: "), "kind", F.lit(" "), "name", within, F.lit("\n"), purpose, F.lit("code:\n"), code)
    out = each.select("path", F.col("name").alias("symbol"), F.lit("symbol").alias("kind"), F.col("line").alias("start_line"), "end_line", whole.alias("text"))
    first = rows.where(F.size("all") <= 2).withColumn("head", F.left("text", F.lit(head))).where(F.length(F.regexp_replace("head", r"^\s+|\s+$", "")) > 60)
    file = F.concat(F.lit("file: "), "path", F.lit("\nlanguage: "), "language", F.lit("\ncontent:\n"), "head")
    small = first.select("path", F.lit(None).cast("string"), F.lit("file"), F.lit(1), F.greatest(F.lit(1), F.regexp_count("head", F.lit("\n"))), file, F.greatest(F.lit(1), F.floor(F.length("head") / 4)))
    return out.withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length("text") / 4))).union(small).withColumn("text", F.left("text", F.lit(most)))


def term_index(chunks: DataFrame, most: int = 800) -> DataFrame:
    """Distinct terms of each chunk in order of first place, most at the most: id, n_terms, digest."""
    kept = F.slice(t.terms(F.col("text")), 1, most)
    return chunks.select("id", F.size(kept).alias("n_terms"), F.sha1(F.array_join(kept, " ")).alias("digest"))


def recent_turns(turns: DataFrame, keep: int) -> DataFrame:
    """The last `keep` turns of each conversation, in order, with the characters up to and with each."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = turns.withColumn("back", last).where(F.col("back") <= keep)
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("chars", F.sum(F.length("text")).over(upto)).select("conv_id", "turn", "role", "chars")


def query_text(turns: DataFrame, users: int = 3, most: int = 2400) -> DataFrame:
    """Retrieval query of each conversation: its last user turns by line breaks, last `most` characters."""
    u = turns.where("role = 'user'").withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= users)
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return u.groupBy("conv_id").agg(F.right(F.array_join(said, "\n"), F.lit(most)).alias("query"))


def within_budget(chunks: DataFrame, budget: int) -> DataFrame:
    """Excerpts in order of id until the characters are spent; the last one is cut."""
    w = Window.partitionBy("path").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    return chunks.withColumn("left", left).where("left > 0").select("id", "path", F.least(F.length("text").cast("long"), F.col("left")).alias("chars"))


#: UTF-8 bytes of short needles that one pass over the chunks looks for together.
NEEDLE_BYTES = 4 << 20


def _searcher(needles: list[tuple]):
    """Finds all needles (id, text) in each chunk by one automaton, in the time of reading the chunk and its hits."""

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        machine = ahocorasick.Automaton()
        for i, text in needles:
            machine.add_word(text, [*machine.get(text, []), i])
        machine.make_automaton()
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(n, i) for n in {n for _, held in machine.iter(text) for n in held}] if text else []
            yield pa.record_batch([pa.array([n for n, _ in rows], pa.int64()), pa.array([i for _, i in rows], b.column(0).type)], ["needle_id", "id"])

    return run


def mentions(chunks: DataFrame, needles: DataFrame, words: int = 5) -> DataFrame:
    """Rows (needle_id, id): chunks (id, text) that hold a needle (needle_id, needle) as it stands, each pair once.

    A needle's inner words are whole words wherever it occurs. Of a needle with `words` of them the first
    are an exact key: both sides are joined on its 64-bit hash and each candidate is then searched. The shorter
    needles have no such key, or one that half of all texts hold; they are looked for together, by an automaton
    of at most NEEDLE_BYTES of needles a pass over the chunks. needle_id is a whole number; empty and null needles are not looked for.
    """
    split = lambda c: F.array_remove(F.split(c, r"\s+"), "")
    given = needles.where(F.length("needle") > 0).withColumn("w", split(F.col("needle")))
    given = staged(given.withColumn("long", F.size("w") >= words + 2), "needles")
    keyed = given.where("long").select("needle_id", "needle", F.xxhash64(F.slice("w", 2, words)).alias("key"))
    w = split(F.col("text"))
    rows = chunks.select("id", w.alias("w")).where(F.size("w") >= words)
    runs = rows.select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - words + 1), lambda i: F.xxhash64(F.slice("w", i, words))))).alias("key"))
    out = runs.join(keyed, "key").select("id", "needle_id", "needle").join(chunks.select("id", "text"), "id").where(F.contains(F.col("text"), F.col("needle"))).select("needle_id", "id").distinct()
    short = given.where("not long").select(F.col("needle_id").cast("long"), "needle")
    size = short.agg(F.coalesce(F.sum(F.octet_length("needle")), F.lit(0)).alias("b")).first()["b"]
    waves = -(-size // NEEDLE_BYTES)
    kind = dict(chunks.dtypes)["id"]
    for k in range(waves):
        some = short.where(F.pmod(F.xxhash64(F.lit("wave"), "needle_id", "needle"), F.lit(waves)) == k).collect()  # about NEEDLE_BYTES
        out = out.unionByName(chunks.select("id", "text").mapInArrow(_searcher([tuple(r) for r in some]), f"needle_id long, id {kind}").distinct())
    return out
