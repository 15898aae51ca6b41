"""Rate limits and leases: batch, stream and plain Python agree."""

import random

from pyspark.sql import functions as F

from sparkloom.streaming import sessions as s


def events(n=400, users=6):
    rng = random.Random(3)
    t = 1_700_000_000.0
    out = []
    for i in range(n):
        t += rng.choice([0.0, 0.5, 1.0, 4.0, 40.0])
        out.append((i, rng.randrange(users), t))
    return out


def accepted(rows, seconds, most):
    log, out = {}, {}
    for i, u, t in sorted(rows, key=lambda r: (r[2], r[0])):
        mine = [x for x in log.get(u, []) if x > t - seconds]
        out[i] = len(mine) < most
        log[u] = [*mine, t] if out[i] else mine
    return out


def test_rate_limit_batch(spark):
    rows = events()
    df = spark.createDataFrame(rows, "event_id long, user_id long, epoch double").withColumn("ts", F.timestamp_micros((F.col("epoch") * 1e6).cast("long")))
    got = {r.event_id: r.accepted for r in s.rate_limited(df, 60.0, 3).collect()}
    assert got == accepted(rows, 60.0, 3) and not all(got.values())


def _stream(spark, tmp_path, parts, f, mode):
    """The sink's rows after each part arrived as a file and the query ran over what is new."""
    out = []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "event_id long, user_id long, epoch double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        df = f(spark.readStream.schema("event_id long, user_id long, epoch double").parquet(f"{tmp_path}/in"))
        kept = []
        q = df.writeStream.outputMode(mode).foreachBatch(lambda b, _, kept=kept: kept.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        out.append(kept)
    return out


def test_rate_limit_stream(spark, tmp_path):
    rows = events(120)
    first, second = _stream(spark, tmp_path, (rows[:60], rows[60:]), lambda d: s.rate_limited_stream(d, 60.0, 3), "append")
    assert {r.event_id: r.accepted for r in (*first, *second)} == accepted(rows, 60.0, 3)


def test_leases_stream(spark, tmp_path):
    rows = events(80)
    got = {}
    for part in _stream(spark, tmp_path, (rows[:40], rows[40:]), lambda d: s.heartbeats_stream(d, 60, 15), "update"):
        got |= {r.user_id: (r.started, r.last_seen) for r in part}
    want = {}
    for _, u, t in rows:
        start, last = want.get(u, (None, None))
        want[u] = (t, t) if last is None or t - last >= 60 else (start, t) if t - last >= 15 else (start, last)
    assert got == want
