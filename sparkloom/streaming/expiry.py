"""Leases that end by timers, purging by age, and progress of stages as streams report it."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators.versions import RunTable


def expired_leases(events: DataFrame, ttl: int, delay: int, key: str = "user_id", at: str = "ts") -> DataFrame:
    """Rows (key, started, last_seen, expired_at, events) of each lease once it has ended, over a stream (times in milliseconds).

    A lease is a key's events with less than ttl seconds between neighbours; it ends ttl after the
    last. State is one row a key with a live lease: an event-time timer drops it, and gives the
    lease out, once the watermark (the greatest time seen less delay) has passed the end. So state is
    bounded by the keys seen in the last ttl + delay, and keys that never come back leave none.
    Events older than the watermark are dropped, as everywhere; null keys and times make no lease. A lease whose end the
    watermark never reaches is not given out.
    """
    life = ttl * 1000

    def walk(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ended = []
        if state.hasTimedOut:
            started, last, n = state.get
            ended.append((started, last, n))
            state.remove()
        else:
            started, last, n = state.get if state.exists else (None, None, 0)
            for t in sorted(pd.concat([b["epoch"] for b in batches])):
                if last is not None and t - last >= life:
                    ended.append((started, last, n))
                    last = None
                started, n = (t, 1) if last is None else (min(started, t), n + 1)
                last = t if last is None else max(last, t)
            end = int(last) + life
            if end < state.getCurrentWatermarkMs():  # its end has passed while it was on its way
                ended.append((started, last, n))
                state.remove()
            else:
                state.update((int(started), int(last), int(n)))
                state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        if ended:
            yield pd.DataFrame([(who[0], int(a), int(b), int(b) + life, int(k)) for a, b, k in ended], columns=["key", "started", "last_seen", "expired_at", "events"])

    e = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, f"{delay} seconds")
    e = e.select(F.col(key).cast("long").alias("key"), F.col(at), F.unix_millis(F.col(at).cast("timestamp")).alias("epoch"))
    schema = "key long, started long, last_seen long, expired_at long, events long"
    return e.groupBy("key").applyInPandasWithState(walk, schema, "started long, last_seen long, events long", "append", GroupStateTimeout.EventTimeTimeout)


def purged(table: RunTable, at: str, now: int, ttl: int) -> dict:
    """Rewrites the runs of a versioned table that hold rows older than ttl (at + ttl <= now) without those rows, as one version.

    Runs without such a row keep their files. A row without a time never expires. Returns the version and how many runs were
    rewritten and rows went; if none, no version is written.
    """
    rows = table.read()
    old = F.col(at).isNotNull() & (F.col(at) + ttl <= now)
    counts = rows.groupBy(table.key).agg(F.count_if(old).alias("gone"), F.count_if(~old).alias("kept")).where("gone > 0").collect()  # a row a run
    out = {"version": table.versions.state()[0], "runs": len(counts), "rows": sum(r["gone"] for r in counts)}
    if counts:
        keys = [r[table.key] for r in counts]
        stay = rows.where(F.coalesce(F.col(table.key).isin([k for k in keys if k is not None]), F.lit(None in keys)) & ~old)
        out["version"] = table.replace(stay, also=keys)
    return out


class StageProgress(StreamingQueryListener):
    """Progress of a run whose stages are streams, as one share that never falls.

    stages: (name, weight, rows expected) in order; a stage's share is its weight among all, and a
    stream whose name is a stage's counts its input rows against what is expected. What is past
    the expected rows counts as all of it, and a stage whose stream has ended is whole.
    """

    def __init__(self, stages: list[tuple[str, float, int]]):
        self.stages, self.total = stages, sum(w for _, w, _ in stages) or 1.0
        self.rows: dict[str, int] = {}
        self.ended: set[str] = set()
        self.names: dict[str, str] = {}
        self.best, self._lock = 0.0, threading.Lock()

    def share(self) -> float:
        done = 0.0
        for name, weight, expected in self.stages:
            part = 1.0 if name in self.ended else min(1.0, self.rows.get(name, 0) / max(1, expected))
            done += weight * part
        with self._lock:
            self.best = max(self.best, round(done / self.total, 6))
            return self.best

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        self.rows[p["name"]] = self.rows.get(p["name"], 0) + sum(s.get("numInputRows", 0) for s in p["sources"])
        self.share()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception is None:
            self.ended.add(self.names.get(str(event.runId), ""))
        self.share()


#: The stages of a run in order, with their weights.
STAGE_WEIGHTS: dict[str, float] = {
    "queued": 0.02,
    "resolving": 0.06,
    "fetching": 0.20,
    "detecting": 0.08,
    "parsing": 0.24,
    "extracting_apis": 0.08,
    "extracting_database": 0.08,
    "graphing": 0.10,
    "workflows": 0.06,
    "quality": 0.05,
    "indexing": 0.03,
}


def weighted_progress(reports: DataFrame, weights: dict[str, float], key: str, order: str) -> DataFrame:
    """Rows (key, order, share): after each report (key, order, stage, part), the weighted share of all stages that is done.

    Of a stage the greatest part reported so far counts, so the share never falls, however late a report
    comes in; parts outside 0 to 1 are cut, a null part is 0, and stages without a weight count nothing.
    Reports of one key are ordered by `order`, which tells them apart.
    """
    of = F.create_map(*[x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w)))])
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("part").cast("double"), F.lit(0.0))))
    within = Window.partitionBy(key, "stage").orderBy(order)
    best = F.max("_part").over(within.rowsBetween(Window.unboundedPreceding, 0))
    rows = reports.withColumn("_part", part).withColumn("_best", best)
    gain = (F.col("_best") - F.coalesce(F.lag("_best").over(within), F.lit(0.0))) * F.coalesce(F.try_element_at(of, F.col("stage")), F.lit(0.0))
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("_gain").over(upto) / F.lit(float(sum(weights.values())))
    return rows.withColumn("_gain", gain).select(key, order, F.round(share, 6).alias("share"))
