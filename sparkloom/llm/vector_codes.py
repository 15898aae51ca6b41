"""Product codes of vectors: codebooks by Lloyd rounds with Elkan's bounds, kept as columns between rounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Parts of a vector, entries of a part's codebook, rounds, and whole-number steps of one.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole numbers beyond this are no components: squared distances stay exact in 64 bits up to 8,000 a part.
LARGEST = 1 << 24
#: Bounds are widened by this share, far more than their arithmetic can err.
SLACK = 1e-6
ROWS = 1000

State = "vec_id {0}, label {1}, ints binary, code binary, upper binary, scale binary, lower binary, error long"


def _whole(batches):
    """(vec_id, label, ints) of the vectors without null, non-finite or too large components."""
    for b in batches:
        vectors = b.column(2)
        flat = vectors.flatten()  # leaves out what null rows hold
        n = pa.compute.fill_null(pa.compute.list_value_length(vectors), 0).to_numpy().astype(np.int64)
        x = np.floor(pa.compute.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
        good = np.abs(x) <= LARGEST  # false for what is no number
        at = np.concatenate([[0], np.cumsum(n)])
        wrong = np.concatenate([[0], np.cumsum(~good)])
        keep = (wrong[at[1:]] == wrong[at[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False)
        ints = np.where(good, x, 0).astype("<i4")
        rows = [ints[at[i] : at[i + 1]].tobytes() for i in np.flatnonzero(keep)]
        mask = pa.array(keep)
        yield pa.record_batch([b.column(0).filter(mask), b.column(1).filter(mask), pa.array(rows, pa.binary())], ["vec_id", "label", "ints"])


def _matrix(col: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of a binary column as a matrix; shorter rows end in zeros."""
    raw, at = common.utf8_of(col)
    size = np.dtype(kind).itemsize * width
    if len(raw) == size * len(col):
        return raw.view(kind).reshape(len(col), width) if raw.flags.c_contiguous else np.ascontiguousarray(raw).view(kind).reshape(len(col), width)
    out = np.zeros((len(col), size), np.uint8)
    for i in range(len(col)):
        out[i, : at[i + 1] - at[i]] = raw[at[i] : at[i + 1]]
    return out.view(kind)


def _packed(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.array([r.tobytes() for r in x.reshape(len(x), -1)], pa.binary())


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of matching rows, summed component by component."""
    out = np.zeros(len(x), np.int64)
    for j in range(x.shape[1]):
        gap = x[:, j] - entries[:, j]
        out += gap * gap
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First assignment of a part's rows: code, upper bounds and a lower bound for each entry, from all distances."""
    far = np.stack([_squares(x, np.broadcast_to(c, x.shape)) for c in book], axis=1)
    code = far.argmin(1)  # the first of equal ones
    root = np.sqrt(far.astype(np.float64))
    return code, root[np.arange(len(x)), code] * (1 + SLACK), root * (1 - SLACK)


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entries of a part's rows after the entries moved, with new bounds; ties go to the lower entry.

    A row whose upper bound is below half the distance from its entry to any other stays as it is.
    Else an entry is compared only if neither its lower bound nor half its distance from the row's
    entry exceeds the upper bound; both tests are strict, so that an entry as near as the row's own is
    always compared, in whole numbers.
    """
    upper = upper + moved[code] * (1 + SLACK)
    lower = np.maximum(lower - moved * (1 + SLACK), 0)
    between = np.sqrt(np.stack([_squares(book, np.broadcast_to(c, book.shape)) for c in book]).astype(np.float64)) / 2 * (1 - SLACK)
    np.fill_diagonal(between, np.inf)
    rows = np.flatnonzero(upper >= between.min(1)[code])
    if not len(rows):
        return code, upper, lower
    own, mine = code[rows], x[rows]
    best = _squares(mine, book[own])
    tight = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    i, k = np.nonzero((lower[rows] <= tight[:, None]) & (between[own] <= tight[:, None]) & (np.arange(len(book)) != own[:, None]))
    far = _squares(mine[i], book[k])
    lower[rows, own] = np.sqrt(best.astype(np.float64)) * (1 - SLACK)
    lower[rows[i], k] = np.sqrt(far.astype(np.float64)) * (1 - SLACK)
    least = best.copy()
    np.minimum.at(least, i, far)
    new = np.where(best == least, own, len(book))
    tied = far == least[i]
    np.minimum.at(new, i[tied], k[tied])
    code, upper = code.copy(), upper.copy()
    code[rows], upper[rows] = new, np.sqrt(least.astype(np.float64)) * (1 + SLACK)
    return code, upper, lower


def _round(books: np.ndarray, moved: np.ndarray | None, exact: bool):
    """Assigns the parts of rows (vec_id, label, ints[, code, upper, scale, lower, error]) to books (parts, entries, width).

    Lower bounds are kept in a byte each, rounded down to 1/255 of the largest of a part's; upper bounds
    in 32 bits, rounded up.
    """
    parts, entries, width = books.shape

    def run(batches):
        for b in batches:
            n = b.num_rows
            ints = _matrix(b.column(2), "<i4", parts * width).astype(np.int64).reshape(n, parts, width)
            codes, uppers = np.zeros((n, parts), np.uint8), np.zeros((n, parts), "<f4")
            scales, lowers = np.zeros((n, parts), "<f4"), np.zeros((n, parts, entries), np.uint8)
            error = np.zeros(n, np.int64)
            if moved is not None:
                codes, uppers, scales = _matrix(b.column(3), "u1", parts), _matrix(b.column(4), "<f4", parts), _matrix(b.column(5), "<f4", parts)
                lowers = _matrix(b.column(6), "u1", parts * entries).reshape(n, parts, entries)
                codes, uppers, scales, lowers = (np.array(a) for a in (codes, uppers, scales, lowers))
            for p in range(parts):
                x = np.ascontiguousarray(ints[:, p])
                if moved is None:
                    code, upper, lower = nearest(x, books[p])
                else:
                    lower = lowers[:, p] * (scales[:, p].astype(np.float64) * (1 - SLACK))[:, None]
                    code, upper, lower = reassign(x, books[p], moved[p], codes[:, p].astype(np.int64), uppers[:, p].astype(np.float64), lower)
                codes[:, p] = code
                if exact:
                    error += _squares(x, books[p][code])
                    continue
                uppers[:, p] = upper * (1 + SLACK)
                scale = (lower.max(1) / 255).astype("<f4")
                step = np.where(scale > 0, scale, 1).astype(np.float64) * (1 + SLACK)
                scales[:, p], lowers[:, p] = scale, np.clip(lower / step[:, None], 0, 255).astype(np.uint8)
            kept = [pa.nulls(n, pa.binary())] * 3 if exact else [_packed(uppers), _packed(scales), _packed(lowers.reshape(n, parts * entries))]
            ints_out = pa.nulls(n, pa.binary()) if exact else b.column(2)
            names = ["vec_id", "label", "ints", "code", "upper", "scale", "lower", "error"]
            yield pa.record_batch([b.column(0), b.column(1), ints_out, _packed(codes), *kept, pa.array(error)], names)

    return run


def _sums(parts: int, entries: int, width: int):
    """One task's sums and counts of each entry's parts: parts * entries rows at the most."""

    def run(batches):
        total = np.zeros((parts * entries, width + 1), np.int64)
        for b in batches:
            ints = _matrix(b.column(0), "<i4", parts * width).reshape(-1, width)
            slot = (_matrix(b.column(1), "u1", parts) + np.arange(parts) * entries).ravel()
            order = np.argsort(slot, kind="stable")
            used, first = np.unique(slot[order], return_index=True)
            if len(used):
                total[used, :width] += np.add.reduceat(ints[order].astype(np.int64), first, axis=0)
                total[used, width] += np.diff(np.append(first, len(slot)))
        hit = np.flatnonzero(total[:, width])
        lists = pa.array(total[hit].tolist(), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(hit, pa.int64()), lists], ["slot", "sums"])

    return run


def _updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries as the floored means of their parts, whole over all rows; unused entries stay."""
    parts, entries, width = books.shape
    each = state.select("ints", "code").mapInArrow(_sums(parts, entries, width), "slot long, sums array<long>")
    got = each.select("slot", F.posexplode("sums").alias("j", "v")).groupBy("slot", "j").agg(F.sum("v").alias("v")).toArrow()  # at most parts * entries * (width + 1) rows
    total = np.zeros((parts * entries, width + 1), np.int64)
    total[got["slot"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy()
    total = total.reshape(parts, entries, width + 1)
    count = total[..., width:]
    return np.where(count > 0, total[..., :width] // np.maximum(count, 1), books)


def fitted_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, code, error), and the codebooks as whole numbers (parts, entries, width).

    Components are floor(256 x). Vectors that are null or hold null, non-finite or too large
    (over 65536) components are left out. Shorter vectors, and lengths that parts do not divide, count
    as ending in zeros. The codebooks start as the parts of the first `entries` vectors by id (then by
    content, null ids last; fewer if there are fewer), and each round assigns all parts and then
    replaces the entries. Between rounds the state is a written table: codes, upper bounds and a
    lower bound for each entry. A task holds the codebooks, which do not grow with the table.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    kinds = dict(vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label")).dtypes)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>"))
    packed = common.staged(rows.mapInArrow(_whole, f"vec_id {kinds['vec_id']}, label {kinds['label']}, ints binary"), "code-ints")
    longest = (packed.agg(F.max(F.octet_length("ints")).alias("n")).first()["n"] or 0) // 4
    width = max(1, -(-longest // parts))
    seeds = [r["ints"] for r in packed.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()]  # entries rows
    books = _matrix(pa.array(seeds, pa.binary()), "<i4", parts * width).astype(np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    names, schema = ["vec_id", "label", "ints"], State.format(kinds["vec_id"], kinds["label"])
    if not seeds:
        return packed.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).where("false"), books
    state, moved = packed, None
    for _ in range(rounds):
        a = common.written()
        state = common.staged(state.select(*names).mapInArrow(_round(books, moved, False), schema), "code-state")
        common.cleared(spark, a - 1, a)  # the table that the round read
        new = _updated(state, books)
        moved, books = np.sqrt(((new - books).astype(np.float64) ** 2).sum(2)), new
        names = ["vec_id", "label", "ints", "code", "upper", "scale", "lower", "error"]
    a = common.written()
    out = common.staged(state.select(*names).mapInArrow(_round(books, moved, True), schema).select("vec_id", "label", "code", "error"), "code-out")
    common.cleared(spark, a - 1, a)
    return out, books


def code_report(vectors: DataFrame, **kw) -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256), one per kept vector; see fitted_codes.

    code has two hex digits a part; label_error sums error over equal labels, nulls together. Rows that
    share an id each count. Extra columns are ignored; an empty table gives no rows.
    """
    out, books = fitted_codes(vectors, **kw)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = common.staged(out.groupBy("label").agg(F.sum("error").alias("label_error")), "code-labels")
    sums = common.sized(sums.withColumnRenamed("label", "of"), 64)
    return out.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
