"""Removal of long repeated word sequences with prefix-partitioned suffix trees.

Only suffixes that start at anchors are kept: the places of the least hash of half a window's words
within any window (winnowing, the first of equals), so every window has one anchor, at the same offset
wherever it repeats, and an anchor stands for the windows that chose it. The first
words of a suffix are the prefix that deals suffixes to groups; prefixes of one document only are
dropped. Prefixes have variable length: where over GROUP_ROWS suffixes share one, each of them becomes
several with a quarter of the slack (window less prefix), which start where it did or some words before
it, and again, up to the whole window; together they stand for the same windows. A group then fits
one task. Its suffixes, and the words before them read backwards, are each sorted into a
tree (an order and the depths common to neighbours); a window that starts `back` words before the
prefix is one node of either tree, and internal nodes that together are a window deep are repeats.
Consecutive repeated windows of a document form its maximal repeats. With whole windows as prefixes a
group is one node, of which only the least document matters, so it may have any size.

Groups and windows are told apart by hashes of words: prefixes of half a window by 64 bits, after
which all other words are compared one by one by 64 bits each; longer prefixes by 128 bits.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 50
#: Suffixes that share a prefix, in one task (about 0.5 kB each); more of them get longer prefixes.
GROUP_ROWS = 40_000


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over w values from each place on; len(x) - w + 1 of them."""
    m, out = 1, x
    while 2 * m <= w:
        out = f(out[:-m], out[m:])
        m *= 2
    return f(out[: len(x) - w + 1], out[w - m : w - m + len(x) - w + 1]) if w > m else out


#: Words, or anchors, of one text that are handled at once.
PART_WORDS, PART_ANCHORS = 200_000, 10_000


def slacks(window: int) -> list[int]:
    """Window less prefix, from the shortest prefixes to the whole window."""
    out = [window - window // 2]
    while out[-1]:
        out.append(out[-1] // 4)
    return out


def _picked(h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    gram = window // 2
    n, w = len(h), window - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none.astype(np.uint64), none, none
    g = common.window_hashes(h, gram) & ~np.uint64(1)
    pick = _sliding(np.arange(n - gram + 1), w, lambda x, y: np.where(g[x] <= g[y], x, y))
    start = np.arange(n - window + 1)
    end = np.repeat(at[1:], np.diff(at))
    start = start[start + window <= end[: len(start)]]  # windows within one text
    pick = pick[start]
    first = np.flatnonzero(np.diff(pick, prepend=-1))
    last = np.append(first[1:], len(pick))[: len(first)] - 1
    p = pick[first]
    return p, g[p], start[first], start[last]


def picked(h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors among the words h of the texts that at delimits, their prefix hashes, and the first and last start of the windows that chose each."""
    if len(h) <= PART_WORDS + window:
        return _picked(h, at, window)
    found = []
    for o in range(0, len(h), PART_WORDS):  # parts overlap, so that every window lies in one; an anchor may have some windows in either
        part = h[o : o + PART_WORDS + window - 1]
        p, g, a, b = _picked(part, np.clip(at - o, 0, len(part)), window)
        found.append((p + o, g, a + o, b + o))
    return tuple(np.concatenate(x) for x in zip(*found))


def anchors_of(h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors and their prefix hashes."""
    p, g, _, _ = picked(h, at, window)
    p, first = np.unique(p, return_index=True)
    return p, g[first]


def _rows_of(batch: pa.RecordBatch):
    """(slice of the batch, word hashes, word offsets of its texts) for a batch whose third column is the text."""
    raw, at = common.utf8_of(batch.column(2))
    for x, y in common.cuts(at):
        h, _, _, w = common.words_of(raw[at[x] : at[y]], at[x : y + 1] - at[x])
        yield batch.slice(x, y - x), h, w


def _anchor_rows(window: int):
    def run(batches):
        for b in batches:
            for rows, h, w in _rows_of(b):
                p, g, a, z = picked(h, w, window)
                doc = np.searchsorted(w, p, "right") - 1
                d, base = pa.array(doc), window - window // 2 + 1
                place = ((p - w[doc]) * base + (p - z)) * base + (p - a)
                yield pa.record_batch([pa.array(g.view(np.int64)), rows.column(0).take(d), rows.column(1).take(d), pa.array(place)], ["prefix", "rid", "ord", "place"])

    return run


def _asked(lists: pa.Array, w: np.ndarray, part: int):
    """(text, place) of the places asked for, `part` at a time."""
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    for i in range(0, len(doc), part):
        yield doc[i : i + part], np.asarray(flat)[i : i + part].astype(np.int64)


def _fixed(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * 8), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())


SUFFIX = "prefix binary, hot boolean, rid binary, ord long, pos int, back int, ahead int, left binary, right binary"


def _suffix_rows(window: int):
    """The suffixes at the places asked for (place, least and most words before of its windows, and 1 if its prefix is hot, in one number), with the words that its windows have before and after their prefixes.

    A window that starts b words before its anchor is among the suffix's if b <= back and side - b <= ahead.
    """
    gram, side = window // 2, window - window // 2
    base, k = side + 1, np.arange(side)

    def run(batches):
        for b in batches:
            for rows, h, w in _rows_of(b):
                g = common.window_hashes(h, gram) & ~np.uint64(1)
                for doc, q in _asked(rows.column(3), w, PART_ANCHORS):
                    hot, q = pa.array(q % 2 == 1), q // 2
                    pos, ahead, back, d = q // base // base, side - q // base % base, q % base, pa.array(doc)
                    p = w[doc] + pos
                    left = np.where(k < back[:, None], h[np.maximum(p[:, None] - 1 - k, 0)], 0)
                    right = np.where(k < ahead[:, None], h[np.minimum(p[:, None] + gram + k, len(h) - 1)], 0)
                    yield pa.record_batch([_fixed(g[p][:, None]), hot, rows.column(0).take(d), rows.column(1).take(d), pa.array(pos.astype(np.int32)), pa.array(back.astype(np.int32)), pa.array(ahead.astype(np.int32)), _fixed(left), _fixed(right)], [c.split()[0] for c in SUFFIX.split(", ")])

    return run


LONGER = SUFFIX.replace(" hot boolean,", "")


def _matrix(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.uint64)


def _longer_rows(slack: int, less: int):
    """The suffixes of slack `less` that stand for the windows of each suffix of slack `slack`: its prefix and some words on either side."""
    steps = [(min(j, slack - less), max(0, j - slack + less)) for j in range(0, slack + 1, less + 1)]  # words before, and windows that the step before has

    def run(batches):
        for batch in batches:
            col = {n: batch.column(batch.schema.get_field_index(n)) for n in ("prefix", "rid", "ord", "pos", "back", "ahead", "left", "right")}
            prefix, left, right = (_matrix(col[n]) for n in ("prefix", "left", "right"))
            pos, back, ahead = (np.asarray(col[n]) for n in ("pos", "back", "ahead"))
            for a, had in steps if batch.num_rows else ():
                b = slack - less - a
                behind, before = np.minimum(back - a, less), np.minimum(ahead - b, less - had)
                i = np.flatnonzero((back >= a) & (ahead >= b) & (behind + before >= less))
                words = common.mix(np.concatenate([np.full((len(i), 1), a, np.uint64), prefix[i], left[i, :a], right[i, :b]], 1))
                odd = np.random.default_rng([slack, a]).integers(0, 1 << 63, (words.shape[1], 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                key = common.mix(np.stack([(words * odd[:, c]).sum(1, dtype=np.uint64) for c in range(2)], 1))
                take = pa.array(i)
                yield pa.record_batch(
                    [_fixed(key), col["rid"].take(take), col["ord"].take(take), pa.array((pos[i] - a).astype(np.int32)), pa.array(behind[i].astype(np.int32)), pa.array(before[i].astype(np.int32)), _words(left[i, a : a + less]), _words(right[i, b : b + less])],
                    [c.split()[0] for c in LONGER.split(", ")],
                )

    return run


def _words(x: np.ndarray) -> pa.Array:
    return _fixed(x) if x.shape[1] else pa.array([b""] * len(x), pa.binary())


def _tree(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Node of each row at each depth 0..k of the trees over the rows' words, one tree for each group.

    Rows are sorted; where neighbours share fewer than d words, a new node of depth d begins.
    """
    n, k = words.shape
    order = np.lexsort([*words.T[::-1], group])
    s, g = words[order], group[order]
    differ = np.ones((n, k), bool)
    differ[1:] = s[1:] != s[:-1]
    new = np.ones((n, k + 1), bool)
    new[1:, 0] = g[1:] != g[:-1]
    new[:, 1:] = np.maximum.accumulate(differ, 1) | new[:, :1]
    nodes = np.empty((n, k + 1), np.int64)
    nodes[order] = np.cumsum(new, 0)
    return nodes


def repeats(prefix: np.ndarray, order: np.ndarray, back: np.ndarray, ahead: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of each suffix and offset b (windows start b words before it): whether an earlier document has that window."""
    side = left.shape[1]
    before, after = _tree(prefix, left), _tree(prefix, right)
    out = np.zeros((len(prefix), side + 1), bool)
    for b in range(side + 1):
        ok = np.flatnonzero((back >= b) & (ahead >= side - b))
        if len(ok) < 2:
            continue
        key = before[ok, b] * (np.int64(len(prefix)) + 1) + after[ok, side - b]
        _, node = np.unique(key, return_inverse=True)
        first = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, node, order[ok])
        out[ok, b] = first[node] < order[ok]
    return out


#: runs: first and last start of each run of consecutive windows, flat.
SPANS = "rid binary, ord long, runs array<int>"


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct (doc, start) in order: the doc, and first and last start, of each run of consecutive starts."""
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return doc[first], np.stack([start[first], start[last]], 1)


def _spans(rid: pa.Array, order: np.ndarray, row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """A SPANS row for each row of (rid, order) that has repeated windows, which start at `start`."""
    key = rid.dictionary_encode()
    _, name, doc = np.unique(np.stack([np.asarray(key.indices, np.int64), order], 1), axis=0, return_index=True, return_inverse=True)
    both = np.unique(np.stack([doc.ravel()[row], start], 1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
    ids, pairs = _runs(both[:, 0], both[:, 1])
    new = np.flatnonzero(np.diff(ids, prepend=-1))
    at = np.append(new, len(ids)).astype(np.int32) * 2
    one = pa.array(name[ids[new]])
    return pa.record_batch([rid.take(one), pa.array(order).take(one), pa.ListArray.from_arrays(pa.array(at), pa.array(pairs.ravel().astype(np.int32)))], ["rid", "ord", "runs"])


def _subtrees():
    """Suffixes of one slack sorted by prefix in; the maximal runs of repeated windows of each document out."""

    def close(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        col = lambda n: t.column(n).combine_chunks()
        prefix = np.asarray(col("prefix").dictionary_encode().indices)
        order, pos, back, ahead = (np.asarray(col(c)) for c in ("ord", "pos", "back", "ahead"))
        row, b = np.nonzero(repeats(prefix, order, back, ahead, _matrix(col("left")), _matrix(col("right"))))
        return _spans(col("rid"), order, row, pos[row] - b)

    def run(batches):
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0)
            # whole groups only: what shares the last prefix waits for the next batch
            last = b.num_rows - 1
            while last and key[last - 1] == key[b.num_rows - 1]:
                last -= 1
            if rows + last >= 20_000 and (last or key[0] != held[-1].column(0)[held[-1].num_rows - 1]):
                yield close([*held, b.slice(0, last)] if last else held)
                held, rows = [], 0
                b = b.slice(last)
            held.append(b)
            rows += b.num_rows
        if held:
            yield close(held)

    return run


def _whole(batches):
    """Repeated windows (rid, ord, starts) in, their runs out."""
    for b in batches:
        lists = b.column(2)
        row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
        yield _spans(b.column(0), np.asarray(b.column(1)), row, np.asarray(lists.flatten()).astype(np.int64))


def covered(n: int, runs: np.ndarray, window: int) -> np.ndarray:
    """Of n words, which lie in a window that starts in one of the runs."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[::2], 1)
    np.add.at(edge, np.minimum(runs[1::2] + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def _kept(texts: list[bytes], copied: list, runs: list, window: int):
    """(n_words, n_removed, kept) of each text."""
    for text, later_copy, r in zip(texts, copied, runs, strict=True):
        words = text.split()
        if later_copy and len(words) >= window:
            yield len(words), len(words), b""
        elif r:
            gone = covered(len(words), np.array(r), window)
            yield len(words), int(gone.sum()), b" ".join(w for w, x in zip(words, gone) if not x)
        else:
            yield len(words), 0, b" ".join(words)


def _keeper(window: int, with_text: bool):
    def run(batches):
        for b in batches:
            raw, at = common.utf8_of(b.column(1))
            data = raw.tobytes()
            got = list(_kept([data[x:y] for x, y in zip(at, at[1:])], b.column(2).to_pylist(), b.column(3).to_pylist(), window))
            last = pa.array([k.decode() for _, _, k in got], pa.string()) if with_text else pa.array([hashlib.sha256(k).hexdigest() for _, _, k in got], pa.string())
            yield pa.record_batch([b.column(0), pa.array([x for x, _, _ in got], pa.int64()), pa.array([x for _, x, _ in got], pa.int64()), last], ["doc_id", "n_words", "n_removed", "kept" if with_text else "kept_sha256"])

    return run


def _order(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit((1 << 63) - 1))


def repeated_runs(src: DataFrame, window: int, group_rows: int) -> DataFrame:
    """Rows (rid, ord, runs): of the windows that an earlier document of src (rid, ord, text) has too.

    A row of src is known by ord (its id) and rid (128 bits of its text's digest) together.
    """
    anchors = common.staged(src.select("rid", "ord", "text").mapInArrow(_anchor_rows(window), "prefix long, rid binary, ord long, place long"), "sub-anchors")
    shared = _shared(anchors)
    hot = F.when(F.col("n") > group_rows, 1).otherwise(0)
    asked = anchors.join(common.sized(shared, 60), "prefix").groupBy("rid", "ord").agg(F.collect_list(F.col("place") * 2 + hot).alias("places"))  # at most one entry an anchor of one document
    asked = common.staged(asked, "sub-asked")
    rows = src.join(common.sized(asked, 140, F.size("places"), 8), ["rid", "ord"]).select("rid", "ord", "text", "places")
    rows = common.staged(rows.mapInArrow(_suffix_rows(window), SUFFIX), "sub-suffixes")
    few, many, out, steps = rows.where("not hot").drop("hot"), rows.where("hot").drop("hot"), [], slacks(window)
    any_hot = bool(shared.where(F.col("n") > group_rows).limit(1).count())
    for slack, less in zip(steps, [*steps[1:], 0]):
        out.append(few.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_subtrees(), SPANS))
        if not any_hot:
            break
        longer = common.staged(many.mapInArrow(_longer_rows(slack, less), LONGER), "sub-longer")
        shared = _shared(longer)
        mine = longer.join(common.sized(shared, 90), "prefix")
        if not less:  # whole windows
            whole = mine.where("ord > first").groupBy("rid", "ord").agg(F.collect_list("pos").alias("starts"))  # a few entries a word of one document
            out.append(whole.mapInArrow(_whole, SPANS))
            break
        few, many = (mine.where(x).select(longer.columns) for x in (F.col("n") <= group_rows, F.col("n") > group_rows))
        any_hot = bool(shared.where(F.col("n") > group_rows).limit(1).count())
    return reduce(DataFrame.unionByName, out).groupBy("rid", "ord").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _shared(suffixes: DataFrame) -> DataFrame:
    """Rows (prefix, first, n): prefixes of several documents; a plain table, so that a hot prefix's rows may be split."""
    per = suffixes.groupBy("prefix").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count(F.lit(1)).alias("n"))
    return common.staged(per.where("first < last").select("prefix", "first", "n"), "sub-shared")


def _searched(docs: DataFrame, id_col: str, text_col: str, window: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """docs as (doc_id, ord, text, content, rid, first), and the repeated runs (rid, ord, runs) of those that are no later copies."""
    common.small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), _order(F.col(id_col)).alias("ord"), common.text_or_empty(text_col).alias("text"))
    src = src.withColumn("content", common.digest_of("text")).withColumn("rid", F.expr("substring(content, 1, 16)"))
    copies = src.groupBy("content").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("content", "first")
    copies = common.sized(common.staged(copies, "sub-copies"), 120)
    # every window of a later copy starts in the first one too, so one of equal texts is searched
    noted = src.join(copies, "content", "left")
    runs = common.staged(repeated_runs(noted.where("first is null or ord = first"), window, group_rows), "sub-runs")
    return noted, common.sized(runs, 100, F.size("runs"), 4)


def _without_repeats(docs: DataFrame, id_col: str, text_col: str, window: int, group_rows: int, with_text: bool) -> DataFrame:
    noted, runs = _searched(docs, id_col, text_col, window, group_rows)
    out = noted.join(runs, ["rid", "ord"], "left").select("doc_id", "text", F.coalesce(F.col("ord") > F.col("first"), F.lit(False)).alias("copied"), "runs")
    kind = docs.schema[id_col].dataType.simpleString()
    return out.mapInArrow(_keeper(window, with_text), f"doc_id {kind}, n_words long, n_removed long, {'kept' if with_text else 'kept_sha256'} string")


def _merged(window: int):
    """Maximal repeats from each document's runs, which may touch or overlap."""

    def run(batches):
        for b in batches:
            ids, first, size = [], [], []
            for i, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                last = None
                for x, y in sorted(zip(runs[::2], runs[1::2], strict=True)):
                    if last is not None and x <= last + 1:
                        last = max(last, y)
                        size[-1] = last + window - first[-1]
                    else:
                        last = y
                        ids.append(i)
                        first.append(x)
                        size.append(y + window - x)
            yield pa.record_batch([pa.array(ids, b.schema.field(0).type), pa.array(first, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "first_word", "n_words"])

    return run


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (doc_id, first_word, n_words): the longest stretches whose windows all start in documents of smaller id too.

    Later copies of a whole text have no rows, as all of their windows repeat; other odd cases as in substring_report.
    """
    noted, runs = _searched(docs, id_col, text_col, window, group_rows)
    kind = docs.schema[id_col].dataType.simpleString()
    return noted.join(runs, ["rid", "ord"]).where("first is null or ord = first").select("doc_id", "runs").mapInArrow(_merged(window), f"doc_id {kind}, first_word long, n_words long")


def substring_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), one per input row.

    A word goes if it lies in `window` consecutive words that also start in a document of smaller
    id. Null ids come after all others and not before each other; rows of one id do not remove each
    other's words. A null text has no words. Extra columns are ignored; no rows give no rows.
    """
    return _without_repeats(docs, id_col, text_col, window, group_rows, False)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): the kept words joined by one space."""
    return _without_repeats(docs, id_col, text_col, window, group_rows, True)
