"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CACHE_SCHEMA = "tokenizer binary, content binary, n_tokens long"
#: Characters in all segments of the memo that a Python worker keeps before it starts anew, and of a
#: segment that is kept: longer ones, as in texts without spaces, rarely come again.
MEMO_CHARS, MEMO_SEGMENT = 4_000_000, 64


def _model_path(model: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(model)


def tokenizer_digest(model: str) -> bytes:
    """Digest of the vocabulary's bytes and the library's version."""
    import sentencepiece

    with open(_model_path(model), "rb") as f:
        return hashlib.sha256(sentencepiece.__version__.encode() + b"\0" + f.read()).digest()


_counters: dict[str, Counter] = {}


class Counter:
    """Counts the tokens of texts as the library does.

    If no piece holds a space after another character, merges never cross the place before a run of
    spaces, so segments that start there are encoded one by one and each distinct one only once.
    Otherwise whole texts are encoded.
    """

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=_model_path(model))
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        # the segments also rely on: a dummy prefix, spaces kept, no other normalisation
        plain = [len(self.sp.encode(x)) for x in ("  ", " ")] and self.sp.encode("a  b", out_type=str) != self.sp.encode("a b", out_type=str)
        same = self.sp.decode(self.sp.encode("ﬁ ①")) == "ﬁ ①" and self.sp.encode("a", out_type=str) == ["▁a"]
        self.split = plain and same and not any(re.search("[^▁]▁", p) for p in pieces)
        # a lone space, as at a text's end, is a segment without characters, which the library would skip
        self.memo: dict[str, int] = {"": len(self.sp.encode("a ")) - len(self.sp.encode("a"))}
        self.held = 0
        self.segments = re.compile(" ( *[^ ]*)").findall

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.sp.encode(texts, num_threads=1)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.split:
            return self.whole(texts)
        out, memo = [], self.memo
        for t in texts:
            if not t:
                out.append(0)
                continue
            parts = self.segments(" " + t.replace("▁", " "))
            if long := [x for x in parts if len(x) > MEMO_SEGMENT]:
                parts = [x for x in parts if len(x) <= MEMO_SEGMENT]
            n = sum(sum(self.whole(long[i : i + 1000])) for i in range(0, len(long), 1000))
            if miss := [x for x in set(parts) if x not in memo]:
                if self.held > MEMO_CHARS:
                    space = memo[""]
                    memo.clear()
                    memo[""], self.held = space, 0
                    miss = [x for x in set(parts) if x]
                memo.update(zip(miss, self.whole(miss), strict=True))
                self.held += sum(map(len, miss))
            out.append(n + sum(map(memo.__getitem__, parts)))
        return out


def counter(model: str) -> Counter:
    if model not in _counters:
        _counters[model] = Counter(model)
    return _counters[model]


def _encode(model: str):
    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(counter(model).counts(b.column(1).to_pylist()), pa.int64())], ["content", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Rows (id_col, n_bytes, n_tokens, over_limit), one per input row.

    A text's SHA-256 digest and the tokenizer's digest are looked up in the cache at cache_path (a
    new one if None); only distinct texts that it lacks are encoded, and their counts are appended.
    Null texts count as empty: 0 bytes, 0 tokens. Repeated ids each keep their own row. Other input
    columns are ignored, so clashing names do no harm. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    cache_path = cache_path or common.work_dir(spark, "token-cache")
    version = tokenizer_digest(model)
    src = docs.select(F.col(id_col).alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    src = src.withColumn("content", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    keys = common.staged(src.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")
    known = _cache(spark, cache_path).where(F.col("tokenizer") == F.lit(version)).select("content", F.lit(True).alias("hit"))
    per = keys.groupBy("content").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).join(known, "content", "left")
    # only texts that are cached or copied need a note; for the others, absence says: encode
    notes = common.staged(per.where("hit or n > 1").select("content", "hit", "first_id"), "token-notes")
    miss = src.join(common.sized(notes.withColumn("noted", F.lit(True)), 120), "content", "left")
    miss = miss.where("noted is null or (hit is null and doc_id <=> first_id)")
    new = miss.select("content", "text").mapInArrow(_encode(model), "content binary, n_tokens long")
    new.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").option("compression", "zstd").parquet(cache_path)
    got = _cache(spark, cache_path).where(F.col("tokenizer") == F.lit(version)).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    got = common.sized(common.staged(got, "token-counts"), 80)  # a plain table, so that a hot text's rows may be split
    return keys.join(got, "content").select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; none where it does not exist yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)
