"""Leases, rate limits and quotas: batch forms and their streaming counterparts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RATE_SECONDS, RATE_MOST = 60.0, 12
LEASE_SECONDS, HEARTBEAT_SECONDS = 1800, 15


def leases(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Inactivity leases of each user: sessions that end after so many minutes without an event."""
    s = events.withColumn("at", F.col("ts").cast("timestamp"))
    g = s.groupBy("user_id", F.session_window("at", f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return g.select("user_id", F.col("w.start").alias("start"), (F.col("w.end") - F.expr(f"INTERVAL {minutes} MINUTES")).alias("last_seen"), "events")


def live_leases(events: DataFrame, now: str, minutes: int = 30) -> DataFrame:
    """Users whose last event is less than so many minutes before now."""
    last = events.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last_seen"))
    return last.where(F.to_timestamp(F.lit(now)) - F.col("last_seen") < F.expr(f"INTERVAL {minutes} MINUTES"))


def quota_usage(events: DataFrame, seconds: int = 3600, most: int = 20) -> DataFrame:
    """Of each event, how many of its user fall in the `seconds` up to it, and whether that passes the quota."""
    e = events.withColumn("epoch", F.unix_seconds(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("epoch").rangeBetween(-seconds, 0)
    return e.withColumn("used", F.count(F.lit(1)).over(w)).select("event_id", "user_id", "used", (F.col("used") > most).alias("over"))


def rate_limited(events: DataFrame, seconds: float = RATE_SECONDS, most: int = RATE_MOST) -> DataFrame:
    """Rows (event_id, user_id, accepted): at most `most` accepted events in any `seconds`.

    Denied events do not count, so each user's log is walked in order. A user's events of one time
    are ordered by id. After a pause of `seconds` nothing accepted before matters, so a log is cut
    there and each stretch is walked by itself; a task holds one stretch's accepted times at a time.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log: deque = deque()  # a stretch's rows follow each other, over batches too
        for pdf in batches:
            accepted = []
            for first, t in zip(pdf["first"], pdf["epoch"], strict=True):
                if first:
                    log.clear()
                while log and log[0] <= t - seconds:
                    log.popleft()
                accepted.append(len(log) < most)
                if accepted[-1]:
                    log.append(t)
            yield pd.DataFrame({"event_id": pdf["event_id"], "user_id": pdf["user_id"], "accepted": accepted})

    e = events.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("epoch"))
    w = Window.partitionBy("user_id").orderBy("epoch", "event_id")
    e = e.withColumn("fresh", (F.col("epoch") - F.lag("epoch").over(w) >= seconds).cast("int")).withColumn("stretch", F.sum(F.coalesce("fresh", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = e.withColumn("first", F.coalesce(F.col("fresh") == 1, F.lit(True))).select("event_id", "user_id", "stretch", "epoch", "first").repartition("user_id", "stretch").sortWithinPartitions("user_id", "stretch", "epoch", "event_id")
    return dealt.mapInPandas(walk, "event_id long, user_id long, accepted boolean")


def rate_limited_stream(events: DataFrame, seconds: float = RATE_SECONDS, most: int = RATE_MOST) -> DataFrame:
    """rate_limited over a stream of (event_id, user_id, epoch); the state is a user's accepted times."""

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["epoch", "event_id"])
        accepted = []
        for t in pdf["epoch"]:
            log = [x for x in log if x > t - seconds]
            accepted.append(len(log) < most)
            if accepted[-1]:
                log.append(t)
        state.update((log,))
        yield pd.DataFrame({"event_id": pdf["event_id"], "user_id": pdf["user_id"], "accepted": accepted})

    return events.groupBy("user_id").applyInPandasWithState(walk, "event_id long, user_id long, accepted boolean", "log array<double>", "append", GroupStateTimeout.NoTimeout)


def heartbeats_stream(events: DataFrame, ttl: int = LEASE_SECONDS, least: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Leases over a stream of (user_id, epoch): rows (user_id, started, last_seen) after each batch.

    A heartbeat within min(least, ttl / 3) of the last one is ignored; one at ttl or more begins anew.
    """

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, last = state.get if state.exists else (None, None)
        for t in sorted(pd.concat(list(batches))["epoch"]):
            if last is None or t - last >= ttl:
                started = last = t
            elif t - last >= min(least, ttl / 3):
                last = t
        state.update((started, last))
        yield pd.DataFrame({"user_id": [key[0]], "started": [started], "last_seen": [last]})

    return events.groupBy("user_id").applyInPandasWithState(walk, "user_id long, started double, last_seen double", "started double, last_seen double", "update", GroupStateTimeout.NoTimeout)
