"""Runs, leases and browser sessions over time; identities of repositories and commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A session is touched when this many seconds have passed since it was last.
TOUCH_SECONDS = 60


class NotReady(LookupError):
    """A run that does not exist, is not visible or has not finished."""


def released(leases: DataFrame, run_id, session_id, now: float, ttl: float) -> DataFrame:
    """One row (run_id, orphaned): whether a run has no live owner once a session has let go of it.

    leases are (run_id, session_id, last_seen); a lease lives while it was seen within ttl seconds.
    """
    rest = leases.where((F.col("run_id") == run_id) & (F.col("session_id") != session_id) & (F.col("last_seen") > now - ttl))
    return rest.agg((F.count(F.lit(1)) == 0).alias("orphaned")).select(F.lit(run_id).alias("run_id"), "orphaned")


def swept(runs: DataFrame, leases: DataFrame, sessions: DataFrame, now: float, lease_ttl: float, session_ttl: float) -> DataFrame:
    """Rows (kind, id) that a sweep deletes: stale leases' runs and sessions as pairs, expired sessions, ownerless runs.

    A lease at exactly lease_ttl is stale, a session at exactly its expiry is expired; runs (id) left
    without any lease go as well. As a foreachBatch body this is the periodic sweeper.
    """
    stale = F.col("last_seen") <= now - lease_ttl
    gone = leases.where(stale).select(F.lit("lease").alias("kind"), F.concat_ws("/", "run_id", "session_id").alias("id"))
    old = sessions.where((F.col("expires_at") <= now) | (F.col("last_seen") < now - session_ttl)).select(F.lit("session").alias("kind"), F.col("id").cast("string").alias("id"))
    orphans = runs.join(leases.where(~stale).select(F.col("run_id").alias("id")), "id", "left_anti").select(F.lit("run").alias("kind"), F.col("id").cast("string").alias("id"))
    return gone.unionByName(old).unionByName(orphans)


def sliding_sessions(requests: DataFrame, ttl: float, touch: float = TOUCH_SECONDS) -> DataFrame:
    """Rows (session_id, visit, opened, last_touch, requests) of requests (session_id, epoch).

    A request within ttl of the last touch keeps a session; later it opens a new one. A touch is only
    written when `touch` seconds have passed, so expiry counts from the last written one. Logs are cut
    at pauses of ttl and each stretch is walked by itself.
    """
    import pandas as pd
    from pyspark.sql import Window

    def walk(batches):
        now = None  # the visit that is open: session, opened, last touch, requests; rows of a session follow each other, over batches too
        for pdf in batches:
            out = []
            for session, first, t in zip(pdf["session_id"], pdf["first"], pdf["epoch"], strict=True):
                if now is None or first or t >= now[2] + ttl:
                    if now is not None:
                        out.append(now)
                    now = [session, t, t, 0]
                elif t - now[2] >= touch:
                    now[2] = t
                now[3] += 1
            yield pd.DataFrame(out, columns=["session_id", "opened", "last_touch", "requests"])
        if now is not None:
            yield pd.DataFrame([now], columns=["session_id", "opened", "last_touch", "requests"])

    w = Window.partitionBy("session_id").orderBy("epoch")
    # after a pause of ttl a new session opens whatever was touched before
    cut = requests.withColumn("fresh", (F.col("epoch") - F.lag("epoch").over(w) >= ttl).cast("int"))
    cut = cut.withColumn("stretch", F.sum(F.coalesce("fresh", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kind = requests.schema["session_id"].dataType.simpleString()
    dealt = cut.withColumn("first", F.coalesce(F.col("fresh") == 1, F.lit(True))).select("session_id", "stretch", "epoch", "first").repartition("session_id", "stretch").sortWithinPartitions("session_id", "stretch", "epoch")
    done = dealt.mapInPandas(walk, f"session_id {kind}, opened double, last_touch double, requests long")
    return done.withColumn("visit", F.row_number().over(Window.partitionBy("session_id").orderBy("opened"))).select("session_id", "visit", "opened", "last_touch", "requests")


def reusable(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (repo_id, branch, session_id, force) with run_id: the newest queued or running run of the same session, repository and branch, or null for a new run."""
    open_ = runs.where(F.col("status").isin("queued", "running")).groupBy("repo_id", "branch", "session_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("run_id"))
    return wanted.join(open_, ["repo_id", "branch", "session_id"], "left").withColumn("run_id", F.when(~F.col("force"), F.col("run_id")))


def ready(runs: DataFrame, run_id) -> DataFrame:
    """The one row of a finished run; raises NotReady otherwise."""
    one = runs.where((F.col("id") == run_id) & (F.col("status") == "complete"))
    if one.isEmpty():
        raise NotReady(f"run {run_id} is not there or has not finished")
    return one


def with_default(branches: DataFrame, most: int = 100) -> DataFrame:
    """branches (repo_id, place, name) with is_default: the first of main and master in a repository's first `most`, else its first."""
    from pyspark.sql import Window

    some = branches.withColumn("r", F.row_number().over(Window.partitionBy("repo_id").orderBy("place"))).where(F.col("r") <= most)
    first = some.groupBy("repo_id").agg(F.min(F.struct(F.when(F.col("name").isin("main", "master"), 0).otherwise(1).alias("rank"), F.col("r"))).alias("x"))
    return some.join(first, "repo_id").select("repo_id", "name", (F.col("r") == F.col("x.r")).alias("is_default"))


def repo_key(full_name: Column) -> Column:
    """owner/name in lower case; null if it is not two parts of letters, digits, dots, dashes and underscores."""
    name = F.trim(full_name)
    return F.when(name.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"), F.lower(name))


def clean_commit(sha: Column) -> Column:
    """A commit in lower case; null if it is not 7 to 64 hexadecimal digits."""
    return F.when(F.trim(sha).rlike("^[0-9a-fA-F]{7,64}$"), F.lower(F.trim(sha)))


def scrubbed(chunks: DataFrame, mark: str = "__INDEX__ ") -> DataFrame:
    """chunks (path, symbol, text) whose text is an excerpt rewritten to an index entry; entries stay."""
    entry = F.concat(F.lit(mark), F.col("path"), F.lit(" "), F.coalesce("symbol", F.lit("")))
    return chunks.withColumn("text", F.when(F.col("text").startswith(mark), F.col("text")).otherwise(entry))


def since(seconds: Column) -> Column:
    """A time span in words, largest unit only."""
    out = F.when(seconds < 60, "just now")
    for most, unit, name in ((3600, 60, "m"), (86_400, 3600, "h"), (2_592_000, 86_400, "d"), (31_536_000, 2_592_000, "mo")):
        out = out.when(seconds < most, F.concat(F.floor(seconds / unit).cast("string"), F.lit(f"{name} ago")))
    return out.otherwise(F.concat(F.floor(seconds / 31_536_000).cast("string"), F.lit("y ago")))
