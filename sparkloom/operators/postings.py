"""A stored inverted index, and ranked search that reads postings in place of texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as t
from sparkloom.operators.ordered import ranked
from sparkloom.plans.storage import staged

#: A stretch of word characters, in lower-case text. Whatever can match a term lies within one.
STRETCH = "[a-z0-9_]+"
#: Ids that share a block of postings; a block's arrays hold no more.
BLOCK = 1024
#: Words looked up by a pushed-down list at most; more are joined.
LISTED = 1000
#: Blocks that are searched first; each further wave has four times as many.
FIRST_WAVE = 4


def build(chunks: DataFrame, path: str) -> None:
    """Writes the index of chunks (id, path, text) below path: postings, vocabulary and documents.

    A posting row is a stretch of word characters (`word`) in one block of ids: the sorted ids, how often
    each holds the word, and the greatest of those counts. So a word that all texts hold is many
    rows of bounded size. ids are unique whole numbers; rows without one are not indexed. A null path
    or text is empty.
    """
    low = F.lower(F.concat_ws(" ", "path", "text"))
    rows = chunks.where("id is not null").select(F.col("id").cast("long"), F.floor(F.col("id") / BLOCK).alias("block"), F.explode(F.regexp_extract_all(low, F.lit(STRETCH), F.lit(0))).alias("word"))
    each = rows.groupBy("word", "block", "id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    lists = each.groupBy("word", "block").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("p"), F.max("n").alias("most"))  # at most BLOCK ids
    lists = lists.select("word", "block", F.col("p.id").alias("ids"), F.col("p.n").alias("ns"), "most", F.size("p").alias("docs"))
    lists.repartitionByRange("word", "block").sortWithinPartitions("word", "block").write.option("compression", "zstd").parquet(f"{path}/postings")
    chunks.where("id is not null").select(F.col("id").cast("long"), F.floor(F.col("id") / BLOCK).alias("block"), "path").write.parquet(f"{path}/documents")
    spark = chunks.sparkSession
    spark.read.parquet(f"{path}/postings").groupBy("word").agg(F.sum("docs").alias("docs"), F.max("most").alias("most")).write.parquet(f"{path}/vocabulary")


class Index:
    """Search in what build() wrote, by the rules of functions.text.lexical_score."""

    def __init__(self, spark: SparkSession, path: str):
        self.postings, self.vocabulary, self.documents = (spark.read.parquet(f"{path}/{x}") for x in ("postings", "vocabulary", "documents"))

    def _matched(self, terms: list[str]) -> DataFrame:
        """Words of the vocabulary that hold a term: (word, hits, times), for each term whether it is one of the word's tokens and how often it occurs in it."""
        tokens = t.identifiers(F.col("word"))
        long = [x for x in terms if len(x) > 4]
        some = reduce(Column.__or__, [F.contains(F.col("word"), F.lit(x)) for x in terms])
        hits = F.array(*[F.array_contains(tokens, x).cast("int") for x in terms])
        times = F.array(*[t.occurrences(F.col("word"), F.lit(x)).cast("long") if x in long else F.lit(0).cast("long") for x in terms])
        rows = self.vocabulary.where(some).select("word", hits.alias("hits"), times.alias("times"))
        return rows.where(F.exists("hits", lambda x: x > 0) | F.exists("times", lambda x: x > 0))

    def _found(self, terms: list[str]) -> DataFrame:
        """The postings of the matched words, with their hits and times."""
        words = staged(self._matched(terms), "words")
        few = [r["word"] for r in words.select("word").limit(LISTED + 1).collect()]
        if len(few) > LISTED:
            return self.postings.join(words, "word")
        return self.postings.where(F.col("word").isin(few)).join(F.broadcast(words), "word")  # at most LISTED rows

    @staticmethod
    def _score(terms: list[str], hit: list[Column], times: list[Column]) -> Column:
        count = reduce(Column.__add__, hit)
        score = count / F.lit(float(len(terms)))
        for x, h, n in zip(terms, hit, times, strict=True):
            if len(x) > 4:
                score = score + F.when(h > 0, F.least(F.lit(0.25), 0.05 * n)).otherwise(0.0)
        return F.round(F.when(count > 0, F.least(F.lit(1.5), score)).otherwise(0.0), 4)

    def _scored(self, found: DataFrame, terms: list[str]) -> DataFrame:
        """Rows (id, score) of the documents that the postings name."""
        k = range(len(terms))
        each = found.select(F.explode(F.arrays_zip("ids", "ns")).alias("p"), "hits", "times")
        sums = [F.max(F.get("hits", F.lit(i))).alias(f"h{i}") for i in k] + [F.sum(F.get("times", F.lit(i)) * F.col("p.ns")).alias(f"t{i}") for i in k]
        g = each.groupBy(F.col("p.ids").alias("id")).agg(*sums)
        return g.select("id", self._score(terms, [F.col(f"h{i}") for i in k], [F.col(f"t{i}") for i in k]).alias("score"))

    def scores(self, query: str, least: float = 0.01) -> DataFrame:
        """Rows (id, path, score) of all chunks that score above least."""
        terms = sorted({x.lower() for x in re.findall(t.IDENTIFIER, query)})
        if not terms:
            return self.documents.select("id", "path", F.lit(0.0).alias("score")).where("false")
        found = self._scored(self._found(terms), terms).where(F.col("score") > least)
        return found.join(self.documents.select("id", "path"), "id").select("id", "path", "score")

    def _bounds(self, found: DataFrame, terms: list[str]) -> DataFrame:
        """Blocks (block, bound, at) from the one that may hold the best score on, ties by block. Reads no lists of ids."""
        k = range(len(terms))
        sums = [F.max(F.get("hits", F.lit(i))).alias(f"h{i}") for i in k] + [F.sum(F.get("times", F.lit(i)) * F.col("most")).alias(f"t{i}") for i in k]
        b = found.groupBy("block").agg(*sums).select("block", self._score(terms, [F.col(f"h{i}") for i in k], [F.col(f"t{i}") for i in k]).alias("bound"))
        return staged(ranked(b, [F.col("bound").desc(), F.col("block")], "at"), "bounds")

    def search(self, query: str, n: int = 12, least: float = 0.01) -> DataFrame:
        """The n best chunks (id, path, score), ties by id: the rows of retrieval.lexical_search.

        Blocks are searched from the highest bound on, in growing waves, until the next block's
        bound is below the n-th best score, or equals it while its ids come after. n rows pass the driver.
        """
        spark, terms = self.postings.sparkSession, sorted({x.lower() for x in re.findall(t.IDENTIFIER, query)})
        best: list[tuple[float, int]] = []
        self.blocks_read = self.blocks_known = 0
        if terms:
            found = self._found(terms)
            bounds = self._bounds(found, terms).where(F.col("bound") > least)
            self.blocks_known = bounds.count()
            wave = FIRST_WAVE
            while self.blocks_read < self.blocks_known:
                upto = self.blocks_read + wave
                now = bounds.where((F.col("at") >= self.blocks_read) & (F.col("at") < upto)).select("block")
                rows = self._scored(found.join(now, "block", "left_semi"), terms).where(F.col("score") > least)
                best += [(-r["score"], r["id"]) for r in rows.orderBy(F.desc("score"), "id").limit(n).collect()]  # n rows
                best = sorted(best)[:n]
                self.blocks_read, wave = min(upto, self.blocks_known), wave * 4
                after = bounds.where(F.col("at") == self.blocks_read).first()
                if after and len(best) == n and (-after["bound"], after["block"] * BLOCK) > best[-1]:
                    break
        got = spark.createDataFrame([(i, -s) for s, i in best], "id long, score double")
        held = self.documents.where(F.col("id").isin([i for _, i in best])).select("id", "path")
        return held.join(F.broadcast(got), "id").select("id", "path", "score").orderBy(F.desc("score"), "id")  # n rows

    def search_per_path(self, query: str, n: int, per_path: int, least: float = 0.01) -> DataFrame:
        """As search(), of each path at most per_path chunks; all that score are ranked within their path."""
        w = Window.partitionBy("path").orderBy(F.desc("score"), "id")
        s = self.scores(query, least).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_path).drop("_r")
        return s.orderBy(F.desc("score"), "id").limit(n)
