"""Versions, leases that end by timers, payloads, merged JSON and rows set aside."""

import json
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import records
from sparkloom.operators.records import Field, Shape
from sparkloom.operators.versions import Conflict, RunTable
from sparkloom.plans.storage import shared_folder
from sparkloom.streaming import expiry


def folder(spark):
    return f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"


RUN = "analysis_id string, id int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_versions_of_runs(spark):
    t = RunTable(spark, folder(spark))
    with pytest.raises(KeyError):
        t.read()
    make = lambda rows: spark.createDataFrame(rows, RUN)
    first = [("a", 1), ("a", 2), ("b", 3), (None, 4), ("null", 5), ("x=/ y", 6), ("", 7)]
    assert t.write(make(first)) == 1
    assert rows_of(t.read()) == sorted(first, key=repr)
    assert t.replace(make([("a", 10), ("c", 11)])) == 2
    second = [("a", 10), ("c", 11), *first[2:]]
    assert rows_of(t.read()) == sorted(second, key=repr) and rows_of(t.read(1)) == sorted(first, key=repr)
    assert rows_of(t.read(runs=["a", None])) == [("a", 10), (None, 4)]
    with pytest.raises(Exception, match="stop"):
        t.replace(make(first).withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("int")))
    assert rows_of(t.read()) == sorted(second, key=repr) and t.versions.numbers() == [1, 2]
    assert t.delete([None, "x=/ y", ""]) == 3
    third = [("a", 10), ("b", 3), ("c", 11), ("null", 5)]
    assert rows_of(t.read()) == third
    assert t.versions.sweep(keep=1) == 1  # what the failed write left; the first folder still holds two runs
    assert rows_of(t.read()) == third and t.versions.numbers() == [3]
    with pytest.raises(Exception):
        t.read(1)


def test_one_of_two_writers_gets_a_conflict(spark):
    t = RunTable(spark, folder(spark))
    t.write(spark.createDataFrame([("a", 1)], RUN))
    base, m = t.versions.state()
    t.replace(spark.createDataFrame([("a", 2)], RUN))
    with pytest.raises(Conflict):
        t.versions.commit(m, base)
    assert rows_of(t.read()) == [("a", 2)]


def test_a_manifest_cut_short_is_passed_over(spark):
    t = RunTable(spark, folder(spark))
    t.write(spark.createDataFrame([("a", 1)], RUN))
    out = t.versions._fs.create(t.versions._path(f"{t.versions.path}/manifests/{2:012d}.json"), False)
    out.write(bytearray(b'{"parts": ['))
    out.close()
    assert rows_of(t.read()) == [("a", 1)]
    assert t.replace(spark.createDataFrame([("b", 2)], RUN)) == 3 and rows_of(t.read()) == [("a", 1), ("b", 2)]


def test_purge_rewrites_what_holds_old_rows(spark):
    t = RunTable(spark, folder(spark))
    t.write(spark.createDataFrame([("a", 10), ("a", 90), ("b", 95), ("c", 5), (None, 1), (None, None), ("a", 50)], "analysis_id string, at long"))
    assert expiry.purged(t, "at", 100, 50) == {"version": 2, "runs": 3, "rows": 4}
    assert rows_of(t.read()) == sorted([("a", 90), ("b", 95), (None, None)], key=repr)
    _, m = t.versions.state()
    assert any("=b" in p["runs"] and "=b" not in p["dropped"] for p in m["parts"][:1])  # run b was not written again
    assert expiry.purged(t, "at", 100, 50) == {"version": 2, "runs": 0, "rows": 0}


def streamed(spark, files, ttl, delay):
    """Leases that a stream of files, one a batch, gives out; and the rows its state still holds."""
    src, out = folder(spark), folder(spark)
    schema = "user_id long, ts timestamp"
    for rows in files:
        df = spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds(F.col("s") + 10_000).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files go in order of their time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = expiry.expired_leases(stream, ttl, delay).writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out)
    q.awaitTermination()
    state = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    got = spark.read.schema("key long, started long, last_seen long, expired_at long, events long").parquet(out)
    return sorted((r["key"], *(r[c] // 1000 - 10_000 for c in ("started", "last_seen", "expired_at")), r["events"]) for r in got.collect()), state


def test_leases_end_by_timers_and_leave_no_state(spark):
    many = [(100 + i, 10) for i in range(60)]  # users that never come back
    files = [[(1, 0), (1, 50), (1, 120), (2, 30), (None, 40), *many], [(1, 150), (2, 400), (3, 410)], [(3, 1000)], [(4, 2000)]]
    got, state = streamed(spark, files, 100, 20)
    want = [(1, 0, 150, 250, 4), (2, 30, 30, 130, 1), (2, 400, 400, 500, 1), (3, 410, 410, 510, 1), (3, 1000, 1000, 1100, 1)]
    assert got == sorted(want + [(u, 10, 10, 110, 1) for u, _ in many])
    assert max(state) >= 62 and state[-1] == 1  # the last lease alone is live


def test_progress_of_streams_never_falls(spark):
    src, rows = folder(spark), 40
    spark.range(rows).repartition(4).write.parquet(src)
    p = expiry.StageProgress([("fetching", 0.2, rows), ("parsing", 0.6, 10 * rows), ("later", 0.2, 5)])
    spark.streams.addListener(p)
    try:
        shares = [p.share()]
        for name in ("fetching", "parsing"):
            q = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src).writeStream.queryName(name).format("noop").option("checkpointLocation", folder(spark)).trigger(availableNow=True).start()
            q.awaitTermination()
            for _ in range(100):
                if name in p.ended:
                    break
                time.sleep(0.1)
            shares.append(p.share())
    finally:
        spark.streams.removeListener(p)
    assert shares == [0.0, 0.2, 0.8] and p.rows["fetching"] == rows


def test_weighted_progress(spark):
    rows = [(1, 1, "fetching", 0.5), (1, 2, "parsing", 1.0), (1, 3, "fetching", 0.25), (1, 4, "fetching", 7.0), (1, 5, "unknown", 1.0), (1, 6, "queued", None), (1, 7, None, 1.0), (2, 8, "indexing", -1.0)]
    df = spark.createDataFrame(rows, "run int, at int, stage string, part double")
    got = {r["at"]: r["share"] for r in expiry.weighted_progress(df, expiry.STAGE_WEIGHTS, "run", "at").collect()}
    assert got == pytest.approx({1: 0.1, 2: 0.34, 3: 0.34, 4: 0.44, 5: 0.44, 6: 0.44, 7: 0.44, 8: 0.0})
    assert sum(expiry.STAGE_WEIGHTS.values()) == pytest.approx(1)


def test_shapes(spark):
    shape = Shape((
        Field("id", "run.id", "string"), Field("n", "run.n", "int", -1), Field("items", "items", fields=(Field("a", "x.a"), Field("b", "b", default="?"), Field("c", "cs", fields=(Field("d"),))), most=2),
        Field("tags", most=1), Field("at", time=True), Field("whole", whole=True, fields=(Field("n", "run.n"),)), Field("none", "sub", fields=(Field("z"),)),
    ))
    schema = "run struct<id: int, n: string>, items array<struct<x: struct<a: int>, b: string, cs: array<struct<d: int>>>>, tags array<string>, at timestamp, sub struct<z: int>"
    rows = [((1, "7"), [((2,), None, [(3,)]), ((4,), "q", None), ((5,), "r", [])], ["t", "u"], None, None), ((None, "x"), None, None, None, (9,)), (None, [], [], None, None)]
    df = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds(F.lit(86400)))
    got = [json.loads(r["payload"]) for r in shape.json(df.withColumn("k", F.monotonically_increasing_id()), ["k"]).orderBy("k").collect()]
    at = "1970-01-02T00:00:00"
    assert got == [
        {"id": "1", "n": 7, "items": [{"a": 2, "b": "?", "c": [{"d": 3}]}, {"a": 4, "b": "q", "c": []}], "tags": ["t"], "at": at, "whole": {"n": "7"}, "none": None},
        {"id": None, "n": -1, "items": [], "tags": None, "at": at, "whole": {"n": "x"}, "none": {"z": 9}},
        {"id": None, "n": -1, "items": [], "tags": [], "at": at, "whole": {"n": None}, "none": None},
    ]


def merge(a, b):
    return {k: (merge(a[k], b[k]) if isinstance(a[k], dict) and isinstance(b[k], dict) else b[k]) if k in a and k in b else (b[k] if k in b else a[k]) for k in sorted({*a, *b})}


def test_merge_as_by_plain_recursion(spark):
    rng = random.Random(6)

    def value(depth):
        if depth and rng.random() < 0.6:
            return {k: value(depth - 1) for k in rng.sample("abcd", rng.randrange(4))}
        return rng.choice([1, "s", None, [1, {"a": 2}], True, 2.5, ""])

    objects = [({k: value(3) for k in "abc"}, {k: value(3) for k in "bcd"}) for _ in range(60)]
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(objects)]
    rows += [(100, None, '{"a": 1}'), (101, '{"a": 1}', None), (102, "{broken", '{"a": {"b": 1}}'), (103, None, None), (104, "[1]", '{"a": 1}'), (105, '{"a": {"b": 1}}', "null")]
    df = spark.createDataFrame(rows, "id int, old string, new string")
    got = {r["id"]: r["out"] for r in records.deep_merged(df, "old", "new", "out").collect()}
    for i, (a, b) in enumerate(objects):
        assert json.loads(got[i]) == merge(a, b), (a, b)
    assert got[100] == '{"a":1}' and got[101] == '{"a":1}' and got[102] == '{"a":{"b":1}}' and got[103] is None and got[104] == '{"a":1}' and got[105] == "null"
    assert records.deep_merged(df.limit(0), "old", "new", "out").count() == 0


def test_rows_that_fail_are_set_aside(spark):
    rows = [("1", "2024-01-01", "5"), ("x", "never", None), (None, None, "1e9"), ("2", "2024-02-30", "7"), ("3", "2024-01-01", "-1"), ("3", "2024-01-01", "-1")]
    df = spark.createDataFrame(rows, "id string, day string, n string")
    checks = [records.cast_check("id", "int"), records.cast_check("day", "date", required=False), records.cast_check("n", "double"), records.range_check("n", 0, 100)]
    good, bad = records.parted(df, checks)
    assert good.count() + bad.count() == len(rows) and good.count() == 1
    assert dict(good.dtypes) == {"id": "int", "day": "date", "n": "double"} and dict(bad.dtypes)["id"] == "string"
    codes = {tuple(r[:3]): [(p["column"], p["code"]) for p in r["problems"]] for r in bad.collect()}
    assert codes["x", "never", None] == [("id", "bad_type"), ("day", "bad_type"), ("n", "bad_type")]
    assert codes[None, None, "1e9"] == [("id", "bad_type"), ("n", "out_of_range")] and codes["3", "2024-01-01", "-1"] == [("n", "out_of_range")]
