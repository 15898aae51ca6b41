"""Mixing sources to target weights by capped water-filling and seeded whole-document repetitions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Hash slots that a source's documents of one size class are dealt to; the sample is cut between slots.
SLOTS = 1024


def words_in(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(common.WORD)).cast("long")


def _fill(sources: DataFrame, total: float) -> float:
    """The level L at which targets min(L * weight, cap) sum to total.

    Each pass clamps the sources whose share is above their cap and shares what is left by weight
    among the others, until none is above. A pass is one aggregate of the staged source table.
    """
    level = 0.0
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        r = sources.agg(F.sum(F.when(over, F.col("cap")).otherwise(0)).alias("a"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("w")).first()
        if not r["w"] or (new := (total - r["a"]) / r["w"]) <= level:
            return level
        level = new


def _cut(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per size class of a source, the slot below which documents get one repetition more.

    Classes go from long to short documents; what one class takes too much or too little is carried
    to the next, so that the total ends near the wanted words.
    """
    whole, want, size = int(pdf["whole"].iloc[0]), float(pdf["want"].iloc[0]), float(pdf["source_size"].iloc[0])
    share, carry, out = (want / size if size else 0.0), 0.0, []
    for kind, g in sorted(pdf.groupby("size_class"), key=lambda x: -x[0]):
        g = g.sort_values("slot")
        sums = [0.0, *g["words"].cumsum()]
        need = share * sums[-1] + carry
        best = min(range(len(sums)), key=lambda i: (abs(sums[i] - need), i))
        carry = need - sums[best]
        cut = 0 if best == 0 else int(g["slot"].iloc[best - 1]) + 1
        out.append((pdf["skey"].iloc[0], int(kind), whole, cut, int(size), float(pdf["target"].iloc[0])))
    return pd.DataFrame(out, columns=["skey", "size_class", "whole", "cut", "source_size", "target"])


def _marked(docs: DataFrame, text_col: str, source_col: str, id_col: str, seed: int) -> DataFrame:
    """docs with _size, _skey, _class and _slot."""
    slot = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.lit(SLOTS)).cast("int")
    out = docs.withColumn("_size", words_in(F.col(text_col)))
    return out.withColumns({
        "_skey": F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string"))),
        "_class": F.when(F.col("_size") > 0, F.floor(F.log2("_size"))).otherwise(-1).cast("int"),
        "_slot": slot,
    })


def mix_plan(marked: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """Rows (skey, size_class, whole, cut, source_size, target) from rows (_skey, _size, _class, _slot)."""
    hist = common.staged(
        marked.groupBy("_skey", "_class", "_slot").agg(F.sum("_size").alias("words")).toDF("skey", "size_class", "slot", "words"), "mix-hist"
    )
    sums = common.staged(hist.groupBy("skey").agg(F.sum("words").alias("source_size")), "mix-sums")
    ranked = common.rank_all(sums, [F.col("skey")], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = common.staged(ranked.withColumn("weight", weight).withColumn("cap", max_epochs * F.col("source_size")), "mix-sources")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = _fill(sources, total)
    target = F.least(F.lit(level) * F.col("weight"), F.col("cap").cast("double"))
    goal = sources.select("skey", "source_size", target.alias("target"))
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = hist.join(common.sized(goal, 120), "skey").groupBy("skey").applyInPandas(
        _cut, "skey string, size_class int, whole long, cut int, source_size long, target double"
    )
    return common.staged(plan, "mix-plan")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all if None) of every document, and _size, source_size, target, repeats.

    Size is the number of words. Sources in code-point order, null last, weigh `weights` in turn and
    share `share` times all sizes; a target stops at max_epochs times its source's size and the
    excess goes to the others by weight (_fill). A source's target is met by whole repetitions of
    all its documents and one more of a seeded sample of them. Documents of one size class that
    share a hash slot go together, so reruns, repeated rows and null ids agree. Null or empty texts
    have size 0 and get the same repetitions as their class. An empty table gives no rows.
    """
    names = keep if keep is not None else docs.columns
    marked = _marked(docs, text_col, source_col, id_col, seed)
    light = common.staged(marked.select("_skey", "_size", "_class", "_slot").groupBy("_skey", "_class", "_slot").agg(F.sum("_size").alias("_size")), "mix-light")
    plan = mix_plan(light, weights, share, max_epochs).toDF("_skey", "_class", "_whole", "_cut", "_source_size", "_target")
    out = marked.join(common.sized(plan, 120), ["_skey", "_class"])
    repeats = F.col("_whole") + F.when(F.col("_slot") < F.col("_cut"), 1).otherwise(0)
    return out.select(*names, "_size", F.col("_source_size"), F.col("_target"), repeats.alias("_repeats"))


def mix_report(docs: DataFrame, **kw) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken): taken counts a document's words in the mix."""
    m = mixed(docs, keep=["doc_id"], **kw)
    return m.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_repeats")).alias("taken"))


def mix_rows(docs: DataFrame, **kw) -> DataFrame:
    """The documents that the mix takes, each once, with the number of its repetitions as `repeats`.

    Texts are not copied; a reader repeats a row as often as that, or see repeated.
    """
    m = mixed(docs, **kw).where("_repeats > 0")
    return m.select(*[c for c in docs.columns if c != "repeats"], F.col("_repeats").cast("int").alias("repeats"))


def repeated(mix: DataFrame) -> DataFrame:
    """The rows of mix_rows as often as the mix takes them, numbered from 1 by `repeat` in place of `repeats`."""
    return mix.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats")))).drop("repeats")
