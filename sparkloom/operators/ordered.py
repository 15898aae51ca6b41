"""Ranks and running sums over a whole table's order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.plans.storage import staged


def running(df: DataFrame, by: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows before each, in the order of by, as `name` (long).

    Rows are range-partitioned by the order and written; a partition's offset is the sum of those
    before it, so one row a partition passes the driver. by should tell all rows apart, or nearly
    so: rows that agree in it share a partition and their order is any. A null value counts 0.
    """
    spark = df.sparkSession
    part = staged(df.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0))).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ordered")
    sums = sorted((r["_part"], r["s"]) for r in part.groupBy("_part").agg(F.sum("_value").alias("s")).collect())  # one row a partition
    starts, at = [], 0
    for p, s in sums:
        starts.append((p, at))
        at += s
    if not starts:
        return part.drop("_part", "_value").withColumn(name, F.lit(0).cast("long"))
    start = spark.createDataFrame(starts, "_part int, _start long")
    before = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    out = part.withColumn("_sum", F.coalesce(F.sum("_value").over(before), F.lit(0)))
    return out.join(F.broadcast(start), "_part").withColumn(name, F.col("_sum") + F.col("_start")).drop("_part", "_value", "_sum", "_start")


def ranked(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """df with each row's 0-based place in the order of by."""
    return running(df, by, F.lit(1), name)


def sliding_distinct(events: DataFrame, key: str, at: str, width: int, groups: list[str] | None = None) -> DataFrame:
    """events with `distinct`: how many keys its group has in the `width` units of time up to it, itself included.

    at is a whole number; an event at t sees those of (t - width, t], of equal times all. A key counts from
    an event to its next one or to t + width, whichever is first: one difference up, one down, and
    the running sum of the differences by group and time is the count, since a group's differences cancel
    out. Null keys are no keys; events without a time have no count. Without groups all events
    are one group, whose sum is still taken in ranges of time.
    """
    groups = groups or []
    seen = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(*groups, key, F.col(at).cast("long").alias("_at")).distinct()
    until = F.lead("_at").over(Window.partitionBy(*groups, key).orderBy("_at"))
    spans = seen.withColumn("_end", F.least(F.coalesce(until, F.col("_at") + width), F.col("_at") + width))
    steps = spans.select(*groups, F.explode(F.array(F.struct(F.col("_at").alias("t"), F.lit(1).alias("step")), F.struct(F.col("_end").alias("t"), F.lit(-1).alias("step")))).alias("s"))
    steps = steps.groupBy(*groups, F.col("s.t").alias("_t")).agg(F.sum("s.step").alias("_step"))
    counts = running(steps, [F.col(c) for c in (*groups, "_t")], F.col("_step"), "_before")
    counts = staged(counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], "_t", (F.col("_before") + F.col("_step")).alias("distinct")), "distinct")
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(groups)]
    match = F.col(at).cast("long") == F.col("_t")
    for c in same:
        match = match & c
    # a time at which only null keys stand has no difference of its own
    absent = events.where(F.col(key).isNull()).select(*events.columns, F.lit(None).cast("long").alias("distinct"))
    out = events.where(F.col(key).isNotNull()).join(counts, match, "left").select(*events.columns, "distinct")
    return out.unionByName(absent)


def open_spans(spans: DataFrame, start: str, end: str, name: str, groups: list[str] | None = None) -> DataFrame:
    """spans with `name`: how many spans [start, end) of its group are open at its start, itself included.

    Bounds are whole numbers; a span without one, or one that ends where it starts or before, is never open and has
    a null. One difference up and one down a span, and the running sum by group and time is the count.
    """
    groups = groups or []
    whole = F.coalesce(F.col(start) < F.col(end), F.lit(False))
    ends = F.array(F.struct(F.col(start).cast("long").alias("t"), F.lit(1).alias("step")), F.struct(F.col(end).cast("long").alias("t"), F.lit(-1).alias("step")))
    steps = spans.where(whole).select(*groups, F.explode(ends).alias("s")).groupBy(*groups, F.col("s.t").alias("_t")).agg(F.sum("s.step").alias("_step"))
    counts = running(steps, [F.col(c) for c in (*groups, "_t")], F.col("_step"), "_before")
    counts = staged(counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], "_t", (F.col("_before") + F.col("_step")).alias(name)), "open")
    match = F.col(start).cast("long") == F.col("_t")
    for i, c in enumerate(groups):
        match = match & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    some = spans.where(whole).join(counts, match, "left").select(*spans.columns, name)
    return some.unionByName(spans.where(~whole).select(*spans.columns, F.lit(None).cast("long").alias(name)))


def sliding_sketch(events: DataFrame, key: str, at: str, width: int, step: int, groups: list[str] | None = None) -> DataFrame:
    """Rows (groups, upto, distinct): estimated keys in the width units up to each multiple of step (a divisor of width).

    Each step's keys become one sketch (Spark's HLL), which is merged into the width / step windows that hold it,
    so what moves is sketches, however many events there are. Windows that hold no event have no row.
    """
    groups = groups or []
    cells = events.where(F.col(key).isNotNull()).groupBy(*groups, F.ceil(F.col(at) / step).cast("long").alias("_cell")).agg(F.hll_sketch_agg(key).alias("_sketch"))
    wide = cells.select(*groups, "_sketch", F.explode(F.sequence(F.col("_cell"), F.col("_cell") + width // step - 1)).alias("_cell"))
    out = wide.groupBy(*groups, "_cell").agg(F.hll_sketch_estimate(F.hll_union_agg("_sketch")).alias("distinct"))
    return out.select(*groups, (F.col("_cell") * step).alias("upto"), "distinct")
