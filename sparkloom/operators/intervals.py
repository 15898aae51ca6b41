"""Joins of spans of time by overlap, without comparing all pairs of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.storage import staged


def _level(start: Column, end: Column) -> Column:
    """The least b such that the span is at most 2 ** b long: it touches at most two stretches of 2 ** b."""
    return F.when(end - start <= 1, 0).otherwise(F.ceil(F.log2((end - start).cast("double")))).cast("int")


def overlapping(left: DataFrame, right: DataFrame, spans: tuple[str, str, str, str], by: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose spans [start, end) overlap: all columns of both, those of by once.

    spans names left's start and end and right's; whole numbers. Empty spans and those with a null bound overlap nothing.
    by are columns in both, compared as equal. A span of at most 2 ** b units is of level b and touches
    at most two stretches of that length. A pair meets in the longer one's level: each row goes to
    the stretches it touches in its own level and, shorter as it is there, in all higher levels
    that the other side has, at most two in each; so rows grow by the number of levels (at most 64, in
    practice few), not with the spans' lengths. Of the stretches that both touch the first counts, so a
    pair is given once. The test of the bounds themselves follows.
    """
    by = by or []
    ls, le, rs, re = spans
    spark = left.sparkSession
    if clash := set(left.columns) & set(right.columns) - set(by):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    whole = lambda df, s, e: staged(df.where(F.col(s) < F.col(e)).withColumns({"_s": F.col(s).cast("long"), "_e": F.col(e).cast("long"), "_b": _level(F.col(s).cast("long"), F.col(e).cast("long"))}), "spans")
    a, b = whole(left, ls, le), whole(right, rs, re)
    levels = [sorted(r[0] for r in x.select("_b").distinct().collect()) for x in (a, b)]  # at most 64 numbers a side

    def dealt(df: DataFrame, others: list[int], side: str) -> DataFrame:
        up = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col("_b"))
        rows = df.withColumn("_at", F.explode(F.concat(F.array("_b"), up)))
        width = F.expr("shiftleft(1L, _at)")
        first = F.floor(F.col("_s") / width)
        rows = rows.withColumn("_first", first).withColumn("_cell", F.explode(F.sequence(first, F.floor((F.col("_e") - 1) / width))))
        return rows.withColumnsRenamed({c: f"{c}{side}" for c in ("_s", "_e", "_b", "_first")})

    pairs = dealt(a, levels[1], "l").join(dealt(b, levels[0], "r"), [*by, "_at", "_cell"])
    met = (F.col("_at") == F.greatest("_bl", "_br")) & (F.col("_cell") == F.greatest("_firstl", "_firstr"))
    pairs = pairs.where(met & (F.col("_sl") < F.col("_er")) & (F.col("_sr") < F.col("_el")))
    return pairs.select(*by, *[c for c in left.columns if c not in by], *[c for c in right.columns if c not in by])
