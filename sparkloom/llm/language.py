"""Language by Bayesian fusion of text, declared language, address suffix and host priors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Hashed byte trigrams of the text model.
BUCKETS = 1 << 15
#: Labelled documents of each language that train the text model, at most about this many.
TRAIN_DOCS = 1500
#: Labels that get a text model, those of most documents (128 KB each in every task). Any other label is known by
#: being declared: it is given where a document declares it and no model fits its text.
MODELS = 256
#: Documents that a label needs for a text model of its own, or as many as the most frequent label has, if fewer.
LEAST_DOCS = 4
#: Weight of a trigram's log likelihood (neighbouring trigrams overlap, so each is worth a third).
TEMPER = 1 / 3
#: Strength of the prior above: of the suffix for a host, of all documents for a suffix.
HOST_STRENGTH, SUFFIX_STRENGTH = 20.0, 20.0
UNKNOWN, UNKNOWN_PRIOR = "und", 0.001
#: Share of each language's model that is spread over all trigrams, as the unknown language's is.
UNSEEN = 0.2
#: Posteriors are added up as whole numbers of this size, so that sums do not depend on their order.
UNIT = 1_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20  # digits and punctuation


def trigrams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of the texts, runs of non-letters being one space, and the text of each."""
    f = _FOLD[raw]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keep = np.ones(len(f), bool)
    keep[1:] = (f[1:] != 0x20) | (f[:-1] != 0x20)
    keep[at[:-1][at[:-1] < len(f)]] = True  # a text's first place does not hang on the text before
    f, doc = f[keep].astype(np.uint32), doc[keep]
    if len(f) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (f[:-2] << np.uint32(16)) | (f[1:-1] << np.uint32(8)) | f[2:]
    ok = (doc[:-2] == doc[2:]) & ((f[:-2] != 0x20) | (f[1:-1] != 0x20)) & ((f[1:-1] != 0x20) | (f[2:] != 0x20))
    key = ((key * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)
    return key[ok], doc[:-2][ok]


def named_language(c: Column) -> Column:
    """A label without case and blanks around it; none if nothing is left."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def _counter(batches):
    for b in batches:
        lang = np.asarray(b.column(0).to_pylist(), object)
        for x in dict.fromkeys(lang):
            raw, at = common.utf8_of(b.column(1).filter(pa.array(lang == x)))
            n = np.zeros(BUCKETS, np.int64)
            for i, j in common.cuts(at):
                n += np.bincount(trigrams(raw[at[i] : at[j]], at[i : j + 1] - at[i])[0], minlength=BUCKETS)
            hit = np.flatnonzero(n)
            yield pa.record_batch([pa.array([x] * len(hit), pa.string()), pa.array(hit), pa.array(n[hit])], ["lang", "bucket", "n"])


def train(docs: DataFrame, label_col: str, id_col: str, text_col: str, train_docs: int, seed: int = 5) -> tuple[list[str], np.ndarray, Column]:
    """Languages, how often each has each trigram (BUCKETS, languages), and the place of the language that a document trains (-1: none).

    Counted on a seeded sample of about train_docs labelled documents, whole texts, of each of the
    MODELS most frequent labels that have LEAST_DOCS. Without labelled documents there is only the
    unknown language.
    """
    label = named_language(F.col(label_col))
    named = docs.where(label.isNotNull() & F.col(text_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in named.groupBy(label.alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MODELS).collect()}
    langs = sorted(x for x, n in sizes.items() if n >= min(LEAST_DOCS, max(sizes.values())))
    table = np.zeros((BUCKETS, len(langs)), np.float32)
    if not langs:
        return langs, table, F.lit(-1)
    of = lambda f: F.try_element_at(F.create_map(*[y for x in langs for y in (F.lit(x), f(x))]), label)
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.lit(1 << 20)) / float(1 << 20)
    drawn = u < of(lambda x: F.lit(min(1.0, train_docs / sizes[x])))
    sample = named.where(F.coalesce(drawn, F.lit(False))).select(label.alias("lang"), F.col(text_col).alias("text"))
    counts = sample.mapInArrow(_counter, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # columns, at most BUCKETS rows a language
    place = {x: i for i, x in enumerate(langs)}
    table[got["bucket"].to_numpy(), np.array([place[x] for x in got["lang"].to_pylist()], np.int64)] = got["n"].to_numpy()
    own = F.when(F.col(text_col).isNotNull() & drawn, of(lambda x: F.lit(place[x])))
    return langs, table, F.coalesce(own, F.lit(-1))


def _log_model(counts: np.ndarray, total: np.ndarray | float, seen: int) -> np.ndarray:
    """Log likelihood of trigrams seen so often among total; that of the unknown language where there are none."""
    share = np.where(total > 0, 1 - UNSEEN, 0.0)
    return np.log(share * counts / np.maximum(total, 1) + (1 - share) / seen)


def _scorer(counts: np.ndarray):
    """Adds ll (log likelihood of the text in each language, then in the unknown one) and grams to the columns before own and text.

    A document that trained a language (own) is judged there by the counts of the others alone.
    """

    def run(batches):
        total, seen = counts.sum(0, dtype=np.float64), max(1, int((counts.sum(1) > 0).sum()))
        table = np.concatenate([_log_model(counts, total, seen), np.full((len(counts), 1), -np.log(seen))], 1).astype(np.float32)
        for b in batches:
            raw, at = common.utf8_of(b.column(b.num_columns - 1))
            own = b.column(b.num_columns - 2).to_numpy()
            n = len(at) - 1
            ll, grams = np.zeros((n, table.shape[1])), np.zeros(n, np.int64)
            for i, j in common.cuts(at, common.SLICE_BYTES * 8 // max(8, table.shape[1])):
                key, doc = trigrams(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                if not len(key):
                    continue
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                ll[i + doc[first]] = np.add.reduceat(table[key], first, axis=0)
                grams[i : j] += np.bincount(doc, minlength=j - i)
                for lo, hi in zip(first, np.append(first[1:], len(key)), strict=True):
                    if (k := own[i + doc[lo]]) >= 0:
                        each, times = np.unique(key[lo:hi], return_counts=True)
                        ll[i + doc[lo], k] = (times * _log_model(counts[each, k] - times, total[k] - (hi - lo), seen)).sum()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * table.shape[1] + 1, table.shape[1], dtype=np.int32)), pa.array(np.round(ll, 3).ravel()))
            yield pa.record_batch([*[b.column(i) for i in range(b.num_columns - 2)], lists, pa.array(grams)], [*b.schema.names[:-2], "ll", "grams"])

    return run


def _softmax(x: Column) -> Column:
    """Probabilities from log weights; the array is used once, as an argument."""
    weights = F.transform(F.array(F.struct(x.alias("v"), F.array_max(x).alias("m"))), lambda s: F.transform(s["v"], lambda v: F.exp(v - s["m"])))
    return F.element_at(F.transform(weights, lambda w: F.transform(w, lambda v: v / F.aggregate(w, F.lit(0.0), lambda a, y: a + y))), 1)


def _added(p: str, k: int) -> list[Column]:
    return [F.sum(F.round(F.get(F.col(p), F.lit(i)) * UNIT).cast("long")).alias(f"c{i}") for i in range(k)]


def _array(k: int, f) -> Column:
    return F.array(*[f(i) for i in range(k)])


def suffix_of(host: Column) -> Column:
    """What follows the host's last dot; null for a name without one."""
    return F.nullif(F.lower(F.regexp_extract(host, r"\.([A-Za-z][A-Za-z0-9-]*)\.?(?::\d+)?$", 1)), F.lit(""))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str | None = "source", suffix_col: str | None = None, label_col: str | None = None, train_docs: int = TRAIN_DOCS, threshold: float = 0.5) -> DataFrame:
    """Rows (row_key, language, confidence, kept), one per distinct id and text; see language_report.

    log P(l | all) = TEMPER * log P(text | l) + log P(declared | l) + log P(l | host) + const, where

    - P(text | l) is a trigram model trained on labelled documents (label_col, or else declared_col); a
      document that trained a model is judged without its own trigrams, so a label that nobody else
      uses says no more about a text than the unknown language does,
    - P(declared | l) comes from counts of declared languages by language of the text,
    - P(l | host) is the host's mean of text posteriors, smoothed by its suffix's, and that by all.

    Hosts, suffixes and declared languages are counted over all documents by grouped aggregation.
    A label of fewer than LEAST_DOCS documents, or beyond the MODELS most frequent, has no model: it
    is given where a document declares it and the unknown language is the best. Without letters there is no text evidence and the document
    is not kept; nor is one whose best language is still the unknown one (all trigrams alike) or has
    less than threshold.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    langs, counts, own = train(docs, label_col or declared_col, id_col, text_col, train_docs)
    k = len(langs) + 1
    host = F.col(host_col).cast("string") if host_col else F.lit(None).cast("string")
    suffix = F.col(suffix_col) if suffix_col else suffix_of(host)
    src = docs.select(
        common.row_key(id_col, text_col).alias("row_key"),
        F.coalesce(named_language(F.col(declared_col)), F.lit("")).alias("declared"),
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(suffix, F.lit("")).alias("suffix"),
        own.alias("own"),
        common.text_or_empty(text_col).alias("text"),
    )
    scored = src.mapInArrow(_scorer(counts), "row_key binary, declared string, host string, suffix string, ll array<double>, grams long")
    prior = [np.log((1 - UNKNOWN_PRIOR) / max(1, k - 1))] * (k - 1) + [np.log(UNKNOWN_PRIOR)]
    flat = F.array(*[F.lit(float(x)) for x in prior])
    text_part = F.transform("ll", lambda v: v * F.lit(TEMPER))
    scored = scored.withColumn("lt", text_part).withColumn("p", _softmax(F.zip_with("lt", flat, lambda a, b: a + b)))
    scored = common.staged(scored.drop("ll"), "lang-scored")

    known = scored.where("grams > 0")
    every_c = F.aggregate(_array(k, lambda i: F.col(f"c{i}")), F.lit(0).cast("long"), lambda a, x: a + x)
    hosts = common.staged(known.groupBy("host", "suffix").agg(*_added("p", k)).withColumn("all", every_c), "lang-hosts")
    sums = [F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]
    total = hosts.agg(*sums).first()
    whole = [(total[i] or 0) / UNIT + (1.0 if i < k - 1 else UNKNOWN_PRIOR) for i in range(k)]
    whole = [x / sum(whole) for x in whole]
    mean = lambda at, above, strength: _array(k, lambda i: (F.col(f"c{i}") / UNIT + F.lit(strength) * above(i)) / (F.col("all") / UNIT + F.lit(strength))).alias(at)
    suffixes = hosts.groupBy("suffix").agg(*sums, F.sum("all").alias("all")).select("suffix", mean("above", lambda i: F.lit(whole[i]), SUFFIX_STRENGTH))
    suffixes = common.sized(common.staged(suffixes, "lang-suffixes"), 40 + 8 * k)  # a plain table, so that the hosts of a hot suffix may be split
    priors = hosts.join(suffixes, "suffix").select("host", "suffix", mean("prior", lambda i: F.get("above", F.lit(i)), HOST_STRENGTH))
    priors = common.sized(common.staged(priors, "lang-priors"), 60 + 8 * k)

    # how often each text language declares what, smoothed by how often anything declares it
    said = common.staged(known.where("declared != ''").groupBy("declared").agg(*_added("p", k)).withColumn("all", every_c), "lang-declared")
    each = said.agg(*sums, F.count(F.lit(1)).alias("kinds")).first()
    every = sum((each[i] or 0) for i in range(k)) / UNIT
    share = F.col("all") / UNIT / F.lit(max(every, 1.0))
    likely = said.select("declared", _array(k, lambda i: F.log((F.col(f"c{i}") / UNIT + share) / F.lit((each[i] or 0) / UNIT + 1))).alias("said"))
    likely = common.sized(common.staged(likely, "lang-likely"), 60 + 8 * k)

    base = F.array(*[F.lit(float(np.log(x))) for x in whole])
    fused = scored.join(priors, ["host", "suffix"], "left").join(likely, "declared", "left")
    fused = fused.withColumn("lp", F.coalesce(F.transform("prior", lambda v: F.log(v)), base)).withColumn("ld", F.coalesce("said", F.array(*[F.lit(0.0)] * k)))
    fused = fused.select("row_key", "declared", "grams", _softmax(F.zip_with(F.zip_with("lt", "lp", lambda a, b: a + b), "ld", lambda a, b: a + b)).alias("post"))
    fused = fused.withColumn("best", F.array_max("post")).withColumn("at", F.array_position("post", F.col("best")).cast("int"))
    unmodelled = (F.col("declared") != "") & ~F.array_contains(F.array(*[F.lit(x) for x in (*langs, UNKNOWN)]), F.col("declared"))
    names = F.array(*[F.lit(x) for x in langs], F.when(unmodelled, F.col("declared")).otherwise(UNKNOWN))
    letters = F.col("grams") > 0
    out = fused.select(
        "row_key",
        F.when(letters, F.element_at(names, F.col("at"))).otherwise(UNKNOWN).alias("language"),
        F.when(letters, F.round("best", 6)).otherwise(0.0).alias("confidence"),
    )
    return out.withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("confidence") >= threshold))


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Rows (doc_id, language, confidence, kept), one per input row.

    Null or blank texts, and those without letters, are "und" with confidence 0. Null declared
    languages and hosts add no evidence of their own; case and blanks around a label do not count.
    Ties go to the language first by name.
    Extra columns are ignored; an empty table gives no rows.
    """
    found = common.staged(identify(docs, id_col, text_col, **kw).groupBy("row_key").agg(F.first("language").alias("language"), F.first("confidence").alias("confidence"), F.first("kept").alias("kept")), "lang-found")
    ids = docs.select(F.col(id_col).alias("doc_id"), common.row_key(id_col, text_col).alias("row_key"))
    return ids.join(common.sized(found, 110), "row_key").drop("row_key")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs without those whose language was not identified."""
    gone = identify(docs, id_col, text_col, **kw).where("not kept").select(F.col("row_key").alias("_gone")).distinct()
    gone = common.sized(common.staged(gone, "lang-gone"), 80)
    return docs.withColumn("_gone", common.row_key(id_col, text_col)).join(gone, "_gone", "left_anti").select(*docs.columns)


def page_languages(pages: DataFrame) -> DataFrame:
    """Rows (page_id, language, confidence, kept) of raw pages: markup, address and text together."""
    html = F.coalesce(F.col("html"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&[a-z]+;", " ")
    rows = pages.select(
        "page_id",
        bare.alias("text"),
        F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit("")).alias("lang"),
        F.nullif(F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")).alias("source"),
    )
    return language_report(common.staged(rows, "lang-pages"), id_col="page_id").withColumnRenamed("doc_id", "page_id")
