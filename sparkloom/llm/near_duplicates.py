"""An n-gram Jaccard join: MinHash bands propose, full n-gram sets decide."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

N_WORDS, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.9999, 128
#: Texts and n-gram bytes of a block; larger cells are verified block against block.
BLOCK_TEXTS, BLOCK_BYTES = 2048, 16 << 20


def choose_bands(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows): the longest bands with which a pair at the threshold meets in one with
    probability recall, of at most `most` hashes; longer bands propose fewer pairs in vain."""
    best = (most, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else max(1, math.ceil(math.log1p(-recall) / math.log1p(-p)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n words in a row; a shorter text is one n-gram, an empty one none."""
    if not len(h):
        return h
    return np.unique(common.window_hashes(h, min(n, len(h))))


def _sets(batch_text: pa.Array, n: int):
    """The n-gram set of each text, slice after slice."""
    raw, at = common.utf8_of(batch_text)
    for a, b in common.cuts(at):
        h, _, _, w = common.words_of(raw[at[a] : at[b]], at[a : b + 1] - at[a])
        for i in range(b - a):
            yield shingles(h[w[i] : w[i + 1]], n)


def _signer(n: int, bands: int, rows: int, seed: int):
    def run(batches):
        rng = np.random.default_rng(seed)
        mul = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        turn = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for b in batches:
            keys, sizes, sigs, held, count = [], [], [], [], 0

            def flush():
                full = [x for x in held if len(x)]
                if full:
                    x = np.concatenate(full)
                    at = np.cumsum([0, *map(len, full[:-1])])
                    least = np.stack([np.minimum.reduceat(x * m + c, at) for m, c in zip(mul, add, strict=True)], 1).reshape(len(full), bands, rows)
                    out = iter(common.mix((common.mix(least) * turn).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64))
                sigs.extend(next(out) if len(x) else [] for x in held)
                held.clear()

            for s in _sets(b.column(2), n):
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sizes.append(len(s))
                held.append(s)
                count += len(s)
                if count > 300_000:
                    flush()
                    count = 0
            flush()
            yield pa.record_batch([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "content", "key", "size", "bands"])

    return run


def _set_maker(n: int):
    def run(batches):
        for b in batches:
            sets = pa.array([s.tobytes() for s in _sets(b.column(b.schema.get_field_index("text")), n)], pa.binary())
            names = ["comp", "key", "copies", "cells", "bands"]
            yield pa.record_batch([*[b.column(b.schema.get_field_index(c)) for c in names], sets], [*names, "grams"])

    return run


def verify(keys: list[bytes], copies: np.ndarray, sets: list[np.ndarray], part: np.ndarray, bands: np.ndarray, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of texts whose sets reach the threshold: each one's component (least place) and number of linked copies.

    Only pairs within part 0, or between parts 0 and 1 if there are both, are looked at, and of these
    only those that share a band (any if band is -1, else this one and none before it) are compared.
    Common n-grams are kept as bits, rare ones as lists of places, so memory stays within that of the sets.
    """
    g, t = len(keys), Fraction(threshold).limit_denominator(1000)
    size = np.array([len(s) for s in sets], np.int64)
    _, inv = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(g), size)
    df = np.bincount(inv)
    dense = df[inv] > max(1, g // 64)
    column = np.cumsum(df > max(1, g // 64)) - 1
    words = -(-int(column[-1] + 1) // 64) if len(column) else 0
    bits = np.zeros((g, max(1, words)), np.uint64)
    c = column[inv[dense]]
    np.bitwise_or.at(bits, (owner[dense], c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))
    rare = ~dense & (df[inv] > 1)
    order = np.argsort(inv[rare], kind="stable")
    r_inv, r_owner = inv[rare][order], owner[rare][order]
    post = np.searchsorted(r_inv, np.arange(len(df) + 1)) if len(r_inv) else None
    mine = np.searchsorted(owner[rare], np.arange(g + 1)) if len(r_inv) else None
    r_by_owner = inv[rare]
    two = bool(part.any())
    label, links = np.arange(g), np.zeros(g, np.int64)
    for i in range(g):
        if two and part[i]:
            continue
        other = np.flatnonzero(part) if two else np.arange(i + 1, g)
        lo, hi = size[i] * t, size[i] / t
        other = other[(size[other] >= lo) & (size[other] <= hi)]
        if len(other):
            same = bands[other] == bands[i]
            other = other[same.any(1) if band < 0 else ~same[:, :band].any(1)]
        if not len(other):
            continue
        inter = np.bitwise_count(bits[other] & bits[i]).sum(1, dtype=np.int64)
        if post is not None:
            f = r_by_owner[mine[i] : mine[i + 1]]
            if len(f):
                inter += np.bincount(np.concatenate([r_owner[post[x] : post[x + 1]] for x in f]), minlength=g)[other]
        hit = other[inter * t.denominator >= (size[i] + size[other] - inter) * t.numerator]
        if len(hit):
            links[i] += copies[hit].sum()
            links[hit] += copies[i]
            merged = np.unique(label[np.append(hit, i)])
            if len(merged) > 1:
                label[np.isin(label, merged)] = merged[0]
    return label, links


def _verifier(threshold: float):
    def close(rows, band):
        keys = [r[0] for r in rows]
        part = np.array([r[3] for r in rows], bool)
        bands = np.array([r[4] for r in rows], np.int64)
        label, links = verify(keys, np.array([r[1] for r in rows], np.int64), [np.frombuffer(r[2], np.uint64) for r in rows], part, bands, band, threshold)
        return keys, [keys[x] for x in label], links

    def run(batches):
        rows, at, seen, out = [], None, set(), ([], [], [])

        def end():
            if len(rows) > 1:
                for o, x in zip(out, close(rows, at[1]), strict=True):
                    o.extend(x)
            rows.clear()
            seen.clear()

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for comp, band, value, i, j, key, copies, second, bands, grams in zip(*cols, strict=True):
                if (comp, band, value, i, j) != at:
                    end()
                    at = (comp, band, value, i, j)
                if (key, second) not in seen:  # a repeated row
                    seen.add((key, second))
                    rows.append((key, copies, grams, second, bands))
            yield pa.record_batch([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["a", "b", "links"])
            out = ([], [], [])
        end()
        yield pa.record_batch([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["a", "b", "links"])

    return run


def _blocks() -> Column:
    """How many blocks a cell of the grouped keys needs."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")


def _celled(want: DataFrame) -> DataFrame:
    """want (comp, key, size, bands, ...) with cells: array of (band, value, blocks, block), where a key meets others.

    The keys of a group that fits a block meet in one cell (band -1). Those of a larger group, which
    chance may have chained, meet in a cell for each band hash that several of them share, and a
    cell has as many blocks as it needs. So a key's set goes to at most as many cells as it has bands.
    """
    spread = lambda blocks: F.pmod(F.xxhash64("key"), blocks).cast("int")
    groups = common.sized(common.staged(want.groupBy("comp").agg(_blocks()), "jaccard-groups"), 40)  # a plain table, so that the rows of a hot group may be split
    grouped = common.staged(want.join(groups, "comp"), "jaccard-grouped")
    one = grouped.where("blocks = 1").withColumn("cells", F.array(F.struct(F.lit(-1).alias("band"), F.lit(0).cast("long").alias("value"), F.lit(1).alias("blocks"), F.lit(0).alias("block"))))
    large = grouped.where("blocks > 1")
    places = large.select("comp", "key", "size", F.posexplode("bands").alias("band", "value"))
    shared = common.sized(common.staged(places.groupBy("comp", "band", "value").agg(_blocks(), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "jaccard-cells"), 60)
    cells = places.join(shared, ["comp", "band", "value"]).groupBy("key").agg(F.collect_list(F.struct("band", "value", "blocks", spread(F.col("blocks")).alias("block"))).alias("cells"))  # at most one a band
    many = large.join(common.staged(cells, "jaccard-met"), "key")
    return one.unionByName(many).drop("blocks")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_WORDS, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(texts, classes), both staged.

    texts: one row (doc_id, content, key) per input row; key names its n-gram set.
    classes: one row (key, root, links) per key that is linked to another; root is the least key of
    its class of linked keys, links the number of documents of other keys with Jaccard >= threshold.

    Equal sets are one key from the start. Keys that share a band hash are tied to the least key of
    that band, never to each other, and the components of these ties are the candidate groups. Each
    key's set then goes to the cells where it meets others (_celled): its group, or the bands
    that it shares if the group is larger than a block. Only pairs that share a band are compared,
    each pair once, in blocks of bounded size; only links' counts and each key's component leave a block.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    bands, rows = choose_bands(threshold, recall, MAX_HASHES)
    src = docs.select(F.col(id_col).alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    src = src.withColumn("content", common.digest_of("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    signed = src.select("doc_id", "content", "text").mapInArrow(_signer(n, bands, rows, seed), f"doc_id {kind}, content binary, key binary, size long, bands array<long>")
    signed = common.staged(signed, "jaccard-signed")
    texts = signed.select("doc_id", "content", "key")

    places = signed.select("key", F.explode("bands").alias("band"))
    least = places.groupBy("band").agg(F.min("key").alias("b"), F.max("key").alias("last")).where("b < last").select("band", "b")
    least = common.sized(common.staged(least, "jaccard-bands"), 80)  # a plain table, so that a hot band's rows may be split
    ties = places.join(least, "band").where("key != b").select(F.col("key").alias("a"), "b").distinct()
    groups = components(ties)
    groups = common.staged(groups.unionByName(groups.select(F.col("b").alias("a"), "b").distinct()).toDF("key", "comp"), "jaccard-groups")

    per_key = signed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "content")).alias("one"), F.max("size").alias("size"), F.any_value("bands").alias("bands"))
    want = _celled(common.staged(groups.join(per_key, "key"), "jaccard-want"))
    want = common.staged(want.select("comp", "key", "copies", "cells", "bands", F.col("one.doc_id").alias("one_id"), F.col("one.content").alias("content")), "jaccard-blocks")
    held = src.join(common.sized(want, 220, F.size("cells") + F.size("bands"), 16), "content").where("doc_id <=> one_id").select("comp", "key", "copies", "cells", "bands", "text")
    kind = "array<struct<band:int,value:bigint,blocks:int,block:int>>"
    sets = held.mapInArrow(_set_maker(n), f"comp binary, key binary, copies long, cells {kind}, bands array<long>, grams binary")
    # block x of a cell meets every block y: as first side where x <= y, as second where y < x
    meets = sets.withColumn("cell", F.explode("cells")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("cell.blocks") - 1)))
    x = F.col("cell.block")
    meets = meets.select("comp", "cell.band", "cell.value", F.least(x, "y").alias("i"), F.greatest(x, "y").alias("j"), "key", "copies", (F.col("y") < x).alias("second"), "bands", "grams")
    place = ["comp", "band", "value", "i", "j"]
    pairs = meets.repartition(*place).sortWithinPartitions(*place)
    found = common.staged(pairs.mapInArrow(_verifier(threshold), "a binary, b binary, links long"), "jaccard-links")
    roots = components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links")).where("links > 0")
    classes = links.join(roots.toDF("key", "root"), "key", "left").select("key", F.coalesce("root", "key").alias("root"), "links")
    return texts, common.staged(classes, "jaccard-classes")


def _rooted(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """texts with root, links (of other keys)."""
    out = texts.join(common.sized(classes, 160), "key", "left")
    return out.withColumn("root", F.coalesce("root", "key")).withColumn("links", F.coalesce("links", F.lit(0)))


def jaccard_report(docs: DataFrame, **kw) -> DataFrame:
    """Rows (doc_id, class_id, n_links), one per input row.

    Documents whose n-gram sets reach the threshold are linked; class_id is the least doc_id that
    links reach, n_links the number of other documents that a document is linked to. Texts of fewer
    words than an n-gram are one n-gram; null, empty and blank texts have no n-gram and form one
    class. A class without ids has a null class_id. An empty table gives no rows.
    """
    texts, classes = jaccard_classes(docs, **kw)
    rooted = common.staged(_rooted(texts, classes), "jaccard-rooted")
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    same = rooted.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    # plain tables, so that the rows of a hot class or copied text may be split
    ids, same = common.sized(common.staged(ids, "jaccard-ids"), 60), common.sized(common.staged(same, "jaccard-same"), 60)
    return rooted.join(ids, "root").join(same, "key").select("doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))


def keep_one_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs with one document of each class: that of the least id, then least content digest; of repeated rows one."""
    texts, classes = jaccard_classes(docs, id_col=id_col, text_col=text_col, **kw)
    rooted = common.staged(_rooted(texts, classes).select("root", "doc_id", "content"), "jaccard-rooted")
    per = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1")
    per = common.staged(per.select("root", "one"), "jaccard-kept")
    many = rooted.join(per, "root").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("content") == F.col("one.content")))
    # what happens to a row whose class has several; a row without a note is alone in its class
    notes = many.groupBy(F.col("content").alias("_content"), F.col("doc_id").alias("_id")).agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows"))
    notes = common.sized(common.staged(notes, "jaccard-notes"), 120)
    marked = docs.withColumn("_digest", common.digest_of(text_col))
    marked = marked.join(notes, (F.col("_digest") == F.col("_content")) & F.col(id_col).eqNullSafe(F.col("_id")), "left")
    once = marked.where("_kept is null or (_kept and _rows = 1)").select(*docs.columns)
    again = marked.where("_kept and _rows > 1").dropDuplicates(["_content", "_id"]).select(*docs.columns)
    return once.unionByName(again)
