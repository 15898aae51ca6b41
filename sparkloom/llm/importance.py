"""Importance resampling: documents drawn by how their hashed n-grams resemble a target's."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Buckets that the n-grams' CRC-32 is dealt to; the tables a task holds have one number each.
BUCKETS = 10_000
#: Runs of 1 to this many words are features.
GRAMS = 3
#: Texts with more bytes are cut, and a chunk owns the words that start in as many bytes.
CHUNK_BYTES = 1 << 16
#: Words a document needs to be drawn, and the percentage of those with so many that is drawn.
LEAST_WORDS, DRAWN_PERCENT = 20, 5
#: Bytes in a batch of chunks.
BATCH_BYTES = 4 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

# ---- CRC-32 of many words, and of words joined by spaces, at once -------------------------------

#: Words up to so many bytes are hashed together, byte after byte; longer ones singly.
SHORT_WORD = 64


def _crc_steps() -> np.ndarray:
    """What a CRC-32 register's low byte becomes when it is shifted out."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_STEP = _crc_steps()


def _zero_byte(c: np.ndarray) -> np.ndarray:
    return _STEP[c & np.uint32(0xFF)] ^ (c >> np.uint32(8))


def _applied(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The linear map given by its values on each of the register's four bytes, tables (4, 256)."""
    byte = np.uint32(0xFF)
    return tables[0][c & byte] ^ tables[1][(c >> np.uint32(8)) & byte] ^ tables[2][(c >> np.uint32(16)) & byte] ^ tables[3][c >> np.uint32(24)]


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Maps for 0 to SHORT_WORD appended zero bytes, and for 1, 2, 4, ... of them."""
    one = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    near = [one]
    for _ in range(SHORT_WORD):
        near.append(_zero_byte(near[-1]))
    far = [near[1]]
    for _ in range(31):
        far.append(_applied(far[-1], far[-1]))
    return np.stack(near), np.stack(far)


_NEAR, _FAR = _shift_tables()
_SPACE = np.uint32(zlib.crc32(b" "))


def _shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers c after n zero bytes each."""
    near, byte = np.minimum(n, SHORT_WORD), np.uint32(0xFF)
    out = _NEAR[near, 0, c & byte]
    for k in (1, 2, 3):
        out ^= _NEAR[near, k, (c >> np.uint32(8 * k)) & byte]
    if (n > SHORT_WORD).any():
        rows = np.flatnonzero(n > SHORT_WORD)
        x, left = c[rows], n[rows]
        for k in range(int(left.max()).bit_length()):
            bit = (left >> k) & 1 == 1
            x[bit] = _applied(_FAR[k], x[bit])
        out[rows] = x
    return out


def _joined(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 of texts a, a space and words b of n bytes, from those of a and b."""
    return _shifted(_zero_byte(a) ^ _SPACE, n) ^ b


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, first and end byte of each word, and the n+1 word offsets of the texts."""
    low = _FOLD[raw]
    word = _IN_WORD[low]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | edge[1 : len(raw)]
    end[:-1] &= ~word[1:] | edge[1 : len(raw)]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return low, s, e, np.searchsorted(s, at)


def word_crcs(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    n, c = e - s, np.full(len(s), 0xFFFFFFFF, np.uint32)
    at = np.flatnonzero(n <= SHORT_WORD)
    j = 0
    while len(at):
        c[at] = _zero_byte(c[at] ^ low[s[at] + j])
        j += 1
        at = at[n[at] > j]
    c ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(n > SHORT_WORD):
        c[i] = zlib.crc32(low[s[i] : e[i]])
    return c


def feature_buckets(raw: np.ndarray, at: np.ndarray, own: np.ndarray):
    """For 1 to GRAMS words: the bucket of the feature that starts at each word, first word and number of features of each text.

    own: how many of a text's words may start a feature; all of them if negative.
    """
    low, s, e, first = words_of(raw, at)
    n, c = e - s, word_crcs(low, s, e)
    have, run = np.diff(first), c
    own = np.where(own < 0, have, own)
    for k in range(1, GRAMS + 1):
        if k > 1:
            run = _joined(run[:-1], c[k - 1 :], n[k - 1 :]) if len(c) >= k else np.zeros(0, np.uint32)
        yield (run % np.uint32(BUCKETS)).astype(np.int64), first[:-1], np.clip(have - k + 1, 0, own)


def _texts(batch: pa.RecordBatch):
    """Row ranges of a batch of (..., own, text) with their bytes, offsets and own."""
    raw, at = common.utf8_of(batch.column(batch.num_columns - 1))
    own = batch.column(batch.num_columns - 2).to_numpy()
    for i, j in common.cuts(at):
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i], own[i:j]


def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for _, _, raw, at, own in _texts(b):
            for bucket, first, n in feature_buckets(raw, at, own):
                step = np.zeros(len(bucket) + 1, np.int64)
                some = n > 0
                np.add.at(step, first[some], 1)
                np.add.at(step, (first + n)[some], -1)
                total += np.bincount(bucket[np.cumsum(step[:-1]) > 0], minlength=BUCKETS)
    hit = np.flatnonzero(total)
    yield pa.record_batch([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])


def _weigh(gains: np.ndarray):
    """Adds n_words (that start features), n_features and weight to the columns before own and text."""

    def run(batches):
        for b in batches:
            out = np.zeros((3, b.num_rows), np.int64)
            for i, j, raw, at, own in _texts(b):
                for k, (bucket, first, n) in enumerate(feature_buckets(raw, at, own)):
                    sums = np.zeros(len(bucket) + 1, np.int64)
                    np.cumsum(gains[bucket], out=sums[1:])
                    some = n > 0
                    out[0, i:j] += n * (k == 0)
                    out[1, i:j] += n
                    out[2, i:j][some] += sums[(first + n)[some]] - sums[first[some]]
            names = [*b.schema.names[:-2], "n_words", "n_features", "weight"]
            yield pa.record_batch([*[b.column(i) for i in range(b.num_columns - 2)], *map(pa.array, out)], names)

    return run


def _cut(batches):
    """Chunks (row_key, chunk, own, text) of long texts: the words that start in CHUNK_BYTES, and GRAMS - 1 words more."""
    names, rows, held = ["row_key", "chunk", "own", "text"], [], 0
    types = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
    packed = lambda rows: pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    for b in batches:
        for i in range(b.num_rows):
            raw, at = common.utf8_of(b.column(1).slice(i, 1))
            _, s, e, _ = words_of(raw, at)
            cuts = np.searchsorted(s, np.arange(0, len(raw) + CHUNK_BYTES, CHUNK_BYTES))
            for chunk, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if lo < hi:
                    piece = raw[s[lo] : e[min(hi + GRAMS - 1, len(s)) - 1]].tobytes()
                    rows.append((b.column(0)[i].as_py(), chunk, int(hi - lo), piece))
                    held += len(piece)
                if held >= BATCH_BYTES:
                    yield packed(rows)
                    rows, held = [], 0
    if rows:
        yield packed(rows)


class Texts:
    """The texts of a table, long ones in chunks that are written once and dealt to all tasks.

    A chunk owns the words that start in its stretch and carries the next GRAMS - 1 words, so each
    feature starts in exactly one chunk and lies within it.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        common.small_batches(docs.sparkSession)
        text = common.text_or_empty(text_col)
        rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), common.row_key(id_col, text_col).alias("row_key"))
        long = rows.where(F.octet_length("text") > CHUNK_BYTES)
        self.short = rows.where(F.octet_length("text") <= CHUNK_BYTES).select("doc_id", F.lit(-1).cast("long").alias("own"), F.col("text").cast("binary").alias("text"))
        self.ids = common.staged(long.select("doc_id", "row_key"), "importance-ids")
        pieces = long.select("row_key", F.col("text").cast("binary")).mapInArrow(_cut, "row_key binary, chunk long, own long, text binary")
        self.chunks = common.staged(pieces.repartition("row_key", "chunk"), "importance-chunks")

    def counts(self) -> np.ndarray:
        """Features in each bucket, over all rows: BUCKETS numbers, however large the table."""
        got = self.short.select("own", "text").unionByName(self.chunks.select("own", "text")).mapInArrow(_count, "bucket long, n long")
        got = got.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(BUCKETS, np.int64)
        out[got["bucket"].to_numpy()] = got["n"].to_numpy()
        return out

    def weights(self, gains: np.ndarray) -> DataFrame:
        """Rows (doc_id, n_words, n_features, weight), one a row of the table; a long text's chunks are summed."""
        sums = ["n_words", "n_features", "weight"]
        kinds = ", ".join(f"{c} long" for c in sums)
        short = self.short.mapInArrow(_weigh(gains), f"doc_id {dict(self.short.dtypes)['doc_id']}, {kinds}")
        each = self.chunks.mapInArrow(_weigh(gains), f"row_key binary, chunk long, {kinds}").dropDuplicates(["row_key", "chunk"])
        each = common.staged(each.groupBy("row_key").agg(*[F.sum(c).alias(c) for c in sums]), "importance-long")
        long = self.ids.join(common.sized(each, 90), "row_key", "left").select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in sums])
        return short.unionByName(long)


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much more likely a bucket is in the target), both smoothed by one a bucket."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = lambda s, t: (t + 1.0) * s_all / ((s + 1.0) * t_all)
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(source, target, strict=True)], np.int64)


def importance_report(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", seed: int = 42) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank), one per input row.

    Words are runs of digits, a to z and other non-ASCII characters, A to Z in lower case; features
    are all runs of 1 to GRAMS words. A document's weight is the sum of its features' gains
    (bucket_gains of docs and target); its score adds seeded Gumbel noise from its id. Of the
    documents with LEAST_WORDS words, DRAWN_PERCENT of a hundred with the highest scores are drawn
    and numbered; ties go to the smaller id, null ids last. Null texts are empty: no features,
    weight 0. A null id has the noise of an empty one. Repeated rows each count and may each be
    drawn. Without target texts all gains come from the smoothing. Extra columns are ignored; an
    empty table gives no rows.
    """
    texts = Texts(docs, id_col, text_col)
    gains = bucket_gains(texts.counts(), Texts(target, target_id, target_text).counts())
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), F.lit(8)), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    rows = texts.weights(gains).withColumn("score", F.col("weight") + noise).withColumn("_tie", F.monotonically_increasing_id())
    rows = common.staged(rows, "importance-scores")
    able = rows.where(F.col("n_words") >= LEAST_WORDS)
    draw = able.count() * DRAWN_PERCENT // 100
    ranked = common.rank_all(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features"), F.col("_tie")], "at")
    names = [F.col("doc_id").alias(id_col), "n_features", "weight", "score"]
    drawn = ranked.select(*names, F.when(F.col("at") < draw, F.col("at") + 1).cast("long").alias("rank"))
    return drawn.unionByName(rows.where(F.col("n_words") < LEAST_WORDS).select(*names, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The rows of docs whose id is drawn, with `rank`; ids must be unique. See importance_report."""
    drawn = common.staged(importance_report(docs, target, id_col, **kw).where("rank is not null").select(F.col(id_col).alias("_id"), F.col("rank").alias("_rank")), "importance-drawn")
    out = docs.join(common.sized(drawn, 40), F.col(id_col) == F.col("_id"))
    return out.select(*[c for c in docs.columns if c != "rank"], F.col("_rank").alias("rank"))
