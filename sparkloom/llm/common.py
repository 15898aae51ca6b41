"""Shared pieces: work folders, written stages, size-checked joins and word hashing."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract here defines it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Estimated bytes up to which a joined side may be broadcast; larger sides are shuffled.
BROADCAST_BYTES = 48 << 20
#: Text bytes that one numpy pass handles at once.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and the master is local (tests) is a local folder used and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


#: Folders that staged() has written in this process, in order; see cleared().
_written: list[str] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many folders staged() has written so far, for cleared()."""
    return len(_written)


def cleared(spark: SparkSession, a: int, b: int) -> None:
    """Deletes the folders that staged() wrote as number a to b - 1, once no result reads them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written[a:b]:
        if path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    _written[a:b] = [""] * (b - a)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches given to Python by bytes as well as rows, for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def sized(side: DataFrame, row_bytes: int, items: Column | None = None, item_bytes: int = 0, limit: int | None = None) -> DataFrame:
    """side with a broadcast hint if its rows, and the items in their arrays, fit the limit; else unchanged (a shuffled join).

    side must be cheap to scan: a staged table.
    """
    total = F.count(F.lit(1)) * row_bytes + (F.coalesce(F.sum(items), F.lit(0)) * item_bytes if items is not None else F.lit(0))
    return F.broadcast(side) if side.agg(total.alias("b")).first()["b"] <= (BROADCAST_BYTES if limit is None else limit) else side


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def digest_of(c: str | Column = "text") -> Column:
    """SHA-256 of a text's UTF-8 bytes; a null is empty."""
    return F.unhex(F.sha2(text_or_empty(c).cast("binary"), 256))


def row_key(id_col: str, text_col: str) -> Column:
    """SHA-256 of a row's id and text: rows that agree in both, and no others, share it. A null id is an id of its own."""
    name = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    return F.unhex(F.sha2(F.concat(name, F.lit("\0"), text_or_empty(text_col)).cast("binary"), 256))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """array<int>: for each of the ints in values, op (+ or greatest, from 0) over those before it.

    Values are taken in blocks of about the root of their number, first the blocks' totals, then within
    each, since an array that grows by one value at a time is copied as often: n ** 1.5, not n ** 2.
    """
    none = F.array().cast("array<int>")

    def within(block: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(block, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        w = F.ceil(F.sqrt(F.size(v))).cast("int")
        cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x["v"]) - 1) / x["w"]).cast("int")), lambda k: F.slice(x["v"], k * x["w"] + 1, x["w"]))
        blocks = let(F.struct(v.alias("v"), w.alias("w")), cut)
        total = lambda b: F.aggregate(b, F.lit(0), op)
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, within(F.transform(bs, total), F.lit(0)), within)))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def rank_all(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """df with its 0-based position in the order of by, without one task holding all rows.

    Rows are range-partitioned; a partition's offset is the number of rows in those before it.
    """
    from pyspark.sql import Window

    part = staged(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "rank")
    sizes = sorted((r["_part"], r["count"]) for r in part.groupBy("_part").count().collect())  # one row a partition
    offsets, at = [], 0
    for p, n in sizes:
        offsets.append((p, at))
        at += n
    if not offsets:
        return part.drop("_part").withColumn(name, F.lit(0).cast("long"))
    start = df.sparkSession.createDataFrame(offsets, "_part int, _start long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return part.join(F.broadcast(start), "_part").withColumn(name, within + F.col("_start")).drop("_part", "_start")


# ---- word hashing on Arrow buffers ------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _wrapping(f):
    """f with 64-bit overflow, which the hashes want, not reported."""

    @functools.wraps(f)
    def run(*args):
        with np.errstate(over="ignore"):
            return f(*args)

    return run


def _powers_of(base: np.uint64, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[key] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that the low bits depend on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and the n+1 offsets; a null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type) and not pa.types.is_large_binary(arr.type):
        arr = arr.cast(pa.large_string() if pa.types.is_string(arr.type) else pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_large_string(arr.type) else b"")
    at = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if not len(at):
        at = np.zeros(1, np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def cuts(at: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges [a, b) whose texts have about most bytes at the most, or one row."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def _prefix_sums(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * P**i over all bytes before each of the ascending places, slice after slice."""
    out, carry, lo = np.zeros(len(places), np.uint64), np.uint64(0), 0
    for o in range(0, len(raw), SLICE_BYTES):
        part = raw[o : o + SLICE_BYTES]
        scale = np.uint64(pow(int(_P), o, 1 << 64))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers_of(_P, len(part), "p"), out=total[1:])
        hi = int(np.searchsorted(places, o + len(part), "right"))
        out[lo:hi] = carry + scale * total[places[lo:hi] - o]
        carry, lo = carry + scale * total[-1], hi
    return out


def _inverse_powers(places: np.ndarray) -> np.ndarray:
    """P**-i for each of the places i, from two small tables."""
    high = places // SLICE_BYTES
    far = np.array([pow(int(_P_INV), k * SLICE_BYTES, 1 << 64) for k in range(int(high[-1]) + 1 if len(high) else 0)], np.uint64)
    return far[high] * _powers_of(_P_INV, SLICE_BYTES, "i")[places - high * SLICE_BYTES]


@_wrapping
def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word, and the n+1 word offsets of the texts.

    Beside the words' own rows only a few flags a byte are held, however long a text or word is.
    """
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(at), np.int64)
    word = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:n]
    end = word
    end[:-1] &= ~word[1:] | edge[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    h = mix((_prefix_sums(raw, e) - _prefix_sums(raw, s)) * _inverse_powers(s) + (e - s).astype(np.uint64))
    return h, s, e, np.searchsorted(s, at)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive values from each place on; len(h) - k + 1 of them, or none."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _powers_of(_P, n, "p"), out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * _powers_of(_P_INV, n, "i")[: n - k + 1])
