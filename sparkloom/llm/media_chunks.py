"""Media payloads in content-defined chunks that are stored once."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FRAME = 576
#: Chunk bounds in bytes; a cut falls where the low MASK bits of the gear hash are zero.
MIN_CHUNK, MAX_CHUNK, MASK = 512, 16384, (1 << 11) - 1
#: Bytes that the hash at a place depends on; below MIN_CHUNK, so that a cut depends on its chunk alone.
SPAN = 16
MAGIC = b"CDC1"

_GEAR = np.frombuffer(b"".join(hashlib.sha256(b"gear%d" % i).digest()[:4] for i in range(256)), np.uint32)


def padded(raw: bytes) -> bytes:
    """raw and bytes 255 up to a positive multiple of FRAME."""
    n = max(1, -(-len(raw) // FRAME)) * FRAME
    return raw + b"\xff" * (n - len(raw))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling gear hash h[i] = 2 h[i-1] + G[b[i]] over the last SPAN bytes, for all places at once.

    The window is doubled: the hash over 2m bytes is that over the last m plus the one before, shifted by m.
    """
    h, m = _GEAR[data], 1
    while m < SPAN:
        h[m:] += h[:-m] << np.uint32(m)
        m *= 2
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """End places of the chunks of one payload, the last being its length."""
    n, ends, start = len(data), [], 0
    at = np.flatnonzero((gear_hashes(data) & np.uint32(MASK)) == 0) + 1
    while n - start > MIN_CHUNK:
        i = int(np.searchsorted(at, start + MIN_CHUNK))
        end = min(int(at[i]) if i < len(at) else n, start + MAX_CHUNK, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunked(payload: bytes) -> tuple[list[bytes], list[int]]:
    """SHA-256 digests and lengths of a payload's chunks, in order."""
    view, a, digests, lengths = memoryview(payload), 0, [], []
    for e in chunk_ends(np.frombuffer(payload, np.uint8)):
        digests.append(hashlib.sha256(view[a:e]).digest())
        lengths.append(e - a)
        a = e
    return digests, lengths


def _recipes(batches):
    for b in batches:
        raw, at = common.utf8_of(b.column(1))
        data = raw.tobytes()
        found = [chunked(padded(data[a:e])) for a, e in zip(at, at[1:])]
        yield pa.record_batch([b.column(0), pa.array([d for d, _ in found], pa.list_(pa.binary()))], ["key", "digests"])


def _stores(batches):
    """The rows of the store; `held` has the places that others share: positive if this row stores it."""
    for b in batches:
        raw, at = common.utf8_of(b.column(1))
        data, held, out = raw.tobytes(), b.column(2).to_pylist(), []
        for k, (a, e) in enumerate(zip(at, at[1:])):
            payload = padded(data[a:e])
            digests, lengths = chunked(payload)
            mark, own, shared, p = {abs(x) - 1: x > 0 for x in held[k] or ()}, [], [], 0
            for i, n in enumerate(lengths):
                if i not in mark:
                    own.append(payload[p : p + n])
                elif mark[i]:
                    shared.append({"digest": digests[i], "bytes": payload[p : p + n]})
                p += n
            out.append((digests, lengths, sorted(mark), b"".join(own), shared, len(payload), hashlib.sha256(payload).digest()))
        cols = list(zip(*out)) if out else [[]] * 7
        kinds = (pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())])), pa.int64(), pa.binary())
        names = ("digests", "lengths", "apart", "own", "shared", "payload_bytes", "payload_digest")
        yield pa.record_batch([b.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["key", *names])


STORE = "key binary, digests array<binary>, lengths array<int>, apart array<int>, own binary, shared array<struct<digest: binary, bytes: binary>>, payload_bytes long, payload_digest binary"


def write_store(docs: DataFrame, path: str) -> None:
    """Writes the store of rows (doc_id, text, key) to path.

    A row holds a payload's ordered chunk list and the bytes of the chunks that no other place has.
    A chunk with several places is stored by one of them, elected by a join on its digest.
    """
    lists = common.staged(docs.select("key", "text").mapInArrow(_recipes, "key binary, digests array<binary>"), "media-lists")
    copies = docs.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = common.staged(copies.select("key", "first_id"), "media-copies")
    places = lists.groupBy("key").agg(F.first("digests").alias("digests")).select("key", F.posexplode("digests").alias("pos", "digest"))
    owner = places.groupBy("digest").agg(F.min(F.struct("key", "pos")).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "owner")
    owner = common.sized(common.staged(owner, "media-owners"), 200)  # a plain table, so that a hot chunk's rows may be split
    mark = F.when((F.col("owner.key") == F.col("key")) & (F.col("owner.pos") == F.col("pos")), F.col("pos") + 1).otherwise(-F.col("pos") - 1)
    held = places.join(owner, "digest").groupBy("key").agg(F.collect_list(mark.cast("int")).alias("held"))  # at most one entry a chunk of one payload
    notes = held.join(copies.withColumn("copied", F.lit(True)), "key", "full")
    notes = common.sized(common.staged(notes.select("key", "held", "first_id", F.coalesce("copied", F.lit(False)).alias("copied")), "media-notes"), 300)
    rows = docs.join(notes, "key", "left").where("copied is null or not copied or doc_id <=> first_id")
    rows.select("key", "text", "held").mapInArrow(_stores, STORE).write.option("compression", "zstd").parquet(path)


def media_bytes_of(digests: list[bytes], lengths: list[int]) -> bytes:
    """The stored form's head: a magic number, the number of chunks, then each one's digest and length."""
    return MAGIC + len(lengths).to_bytes(8, "big") + b"".join(d + n.to_bytes(4, "big") for d, n in zip(digests, lengths, strict=True))


def rebuilt(digests: list[bytes], lengths: list[int], apart: list[int], own: bytes, fetched: dict[bytes, bytes]) -> bytes:
    """The payload from its ordered chunk list; raises if a chunk's bytes lack its digest."""
    far, parts, p = set(apart), [], 0
    for i, (d, n) in enumerate(zip(digests, lengths, strict=True)):
        if i in far:
            part = fetched[d]
        else:
            part = own[p : p + n]
            p += n
        if hashlib.sha256(part).digest() != d:
            raise ValueError(f"chunk {d.hex()} is damaged")
        parts.append(part)
    return b"".join(parts)


def feature_of(samples: np.ndarray, n_chunks: int) -> str:
    """Of 8-bit samples: chunks, mean, root mean square and entropy in bits."""
    counts = np.bincount(samples, minlength=256)
    v, n = np.arange(256), len(samples)
    p = counts[counts > 0] / n
    mean, rms = (counts * v).sum() / n, np.sqrt((counts * v * v).sum() / n)
    return f"chunks={n_chunks};mean={mean:.4f};rms={rms:.4f};entropy={-(p * np.log2(p)).sum() + 0.0:.4f}"


MEDIA = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches):
    for b in batches:
        out = []
        for r in b.to_pylist():
            fetched = {x["digest"]: x["bytes"] for x in (r.get("fetched") or ())}
            payload = rebuilt(r["digests"], r["lengths"], r["apart"], r["own"], fetched)
            if hashlib.sha256(payload).digest() != r["payload_digest"] or len(payload) != r["payload_bytes"]:
                raise ValueError(f"payload {r['payload_digest'].hex()} is damaged")
            head = media_bytes_of(r["digests"], r["lengths"])
            form = hashlib.sha256(head)
            form.update(payload)
            out.append((r["key"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(head) + len(payload), form.hexdigest(), feature_of(np.frombuffer(payload, np.uint8), len(r["lengths"]))))
        cols = list(zip(*out)) if out else [[]] * 7
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in MEDIA.split(", ")])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Rows of MEDIA: each stored payload, rebuilt from its chunks, verified and measured.

    Rows whose chunks are all their own are rebuilt where they lie; the others fetch what they lack
    by a join of digests, which moves those rows and the shared chunks only.
    """
    store = spark.read.schema(STORE).parquet(path)
    names = ["key", "digests", "lengths", "apart", "own", "payload_bytes", "payload_digest"]
    near = store.where("size(apart) = 0").select(*names).mapInArrow(_read, MEDIA)
    chunks = store.select(F.explode("shared").alias("s")).select("s.digest", "s.bytes").dropDuplicates(["digest"])
    chunks = common.staged(chunks, "media-chunks")  # a plain table, so that a hot chunk's wants may be split
    wants = store.where("size(apart) > 0").select("key", F.explode(F.array_distinct(F.transform("apart", lambda i: F.get("digests", i)))).alias("digest"))
    fetched = wants.distinct().join(chunks, "digest").groupBy("key").agg(F.collect_list(F.struct("digest", "bytes")).alias("fetched"))
    far = store.where("size(apart) > 0").select(*names).join(fetched, "key").mapInArrow(_read, MEDIA)
    return near.unionByName(far)


def media_report(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a media payload and reads it back; one row per document.

    Columns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature. A null text is empty and gives one frame of bytes 255. Equal texts share one payload,
    repeated rows and null ids included. Extra columns are ignored; an empty table gives no rows.
    The stored form is the head (see media_bytes_of) and the chunks in order.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    path = path or common.work_dir(spark, "media-store")
    src = docs.select(F.col(id_col).alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    src = src.withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    write_store(src, path)
    media = common.staged(read_store(spark, path).dropDuplicates(["key"]), "media-read")
    ids = src.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"))
    names = [x.split()[0] for x in MEDIA.split(", ")][1:]
    return ids.join(media, "key").select("doc_id", "n_bytes", *names)
