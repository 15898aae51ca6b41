"""A vector store that is written in steps, and exact nearest vectors of many queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.versions import Versions
from sparkloom.plans.storage import staged

#: Bytes of query vectors that one pass over the stored vectors takes along.
WAVE_BYTES = 32 << 20
#: Stored vectors and queries that are multiplied at once.
ROWS, QUERIES = 1024, 512
#: Scores are ranked as multiples of this share, so that equal ones are ordered by id.
PLACES = 10_000


def fault(vector: Column, dim: int | None) -> Column:
    """Why a vector cannot be stored; null if it can."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(vector, lambda x: x != 0)
    length = F.when(F.size(vector) != dim, "dimension") if dim is not None else F.when(F.size(vector) == 0, "dimension")
    return F.when(vector.isNull(), "missing").when(length.isNotNull(), length).when(bad, "not finite").when(zero, "zero")


class VectorStore:
    """Vectors below path in segments; a version names its segments and says which row of which segment is live.

    build() compares content digests (128 bits) with the last version's and writes only vectors that
    are new or changed. The table of live keys holds no vectors. Versions are committed as in versions.Versions.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None):
        self.versions, self.spark, self.dim = Versions(spark, path), spark, dim

    def _digest(self, columns: list[str]) -> Column:
        both = [F.hex(F.xxhash64(F.lit(seed), *columns)) for seed in (1, 2)]
        return F.concat(*[F.lpad(x, 16, "0") for x in both])

    def build(self, vectors: DataFrame) -> dict:
        """Brings the store to the rows of vectors (id, embedding, other columns); returns what was done.

        Rows without an id, with a vector that cannot be stored (fault), or beside a row of the same id whose
        digest is smaller, go to the version's table of rejects (id, reason). Returns version and
        the numbers of rows written, live, removed and rejected. If nothing differs, nothing is written.
        """
        base, m = self.versions.state()
        names = [c for c in vectors.columns]
        rows = vectors.withColumn("_reason", F.coalesce(F.when(F.col("id").isNull(), "no id"), fault(F.col("embedding"), self.dim))).withColumn("_digest", self._digest(names))
        light = staged(rows.select("id", "_reason", "_digest"), "vector-keys")
        first = light.where("_reason is null").groupBy("id").agg(F.min("_digest").alias("_digest"), F.count(F.lit(1)).alias("_n"))
        now = staged(first, "vector-now")
        old = self.spark.read.parquet(self.versions.where(m["live"])) if base else self.spark.createDataFrame([], "id long, _digest string, _segment string")
        kept = now.join(old, ["id", "_digest"], "left").select("id", "_digest", "_segment")
        kept = staged(kept, "vector-live")
        fresh = kept.where("_segment is null").select("id", "_digest")
        counts = kept.agg(F.count(F.lit(1)).alias("live"), F.count_if(F.col("_segment").isNull()).alias("written")).first()
        removed = old.join(now.select("id"), "id", "left_anti").count()
        rejects = light.where("_reason is not null").select("id", F.col("_reason").alias("reason")).unionByName(now.where("_n > 1").select("id", F.lit("repeated id").alias("reason"), F.explode(F.sequence(F.lit(2), F.col("_n")))).select("id", "reason"))
        out = {"version": base, "written": counts["written"], "live": counts["live"], "removed": removed, "rejected": rejects.count()}
        if base and not out["written"] and not removed and out["rejected"] == m["rejected"]:
            return out
        folders = {x: self.versions.folder() for x in ("live", "rejects", "segment")}
        segments = list(m.get("segments", []))
        if out["written"] or not base:
            new = rows.where("_reason is null").join(fresh, ["id", "_digest"], "left_semi").dropDuplicates(["id"]).select(*names)
            new.write.option("compression", "zstd").parquet(self.versions.where(folders["segment"]))
            segments.append(folders["segment"])
        kept.select("id", "_digest", F.coalesce("_segment", F.lit(folders["segment"])).alias("_segment")).write.parquet(self.versions.where(folders["live"]))
        rejects.write.parquet(self.versions.where(folders["rejects"]))
        used = [r[0] for r in self.spark.read.parquet(self.versions.where(folders["live"])).select("_segment").distinct().collect()]  # at most a row a build
        segments = [s for s in segments if s in used] or segments[-1:]
        manifest = {"live": folders["live"], "rejects": folders["rejects"], "segments": segments, "rejected": out["rejected"], "folders": [folders["live"], folders["rejects"], *segments]}
        return out | {"version": self.versions.commit(manifest, base)}

    def read(self) -> DataFrame:
        """The live vectors of the last version."""
        _, m = self.versions.state()
        live = self.spark.read.parquet(self.versions.where(m["live"])).select("id", "_segment")
        parts = [self.spark.read.parquet(self.versions.where(s)).withColumn("_segment", F.lit(s)) for s in m["segments"]]
        if len(parts) == 1 and parts[0].count() == live.count():
            return parts[0].drop("_segment")  # nothing in it is dead
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.join(live, ["id", "_segment"], "left_semi").drop("_segment")

    def rejects(self) -> DataFrame:
        return self.spark.read.parquet(self.versions.where(self.versions.state()[1]["rejects"]))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _heaps(ids: np.ndarray, queries: np.ndarray, scopes: np.ndarray | None, k: int):
    """One task's k best of each query over all its batches, as rows (query, id, score): k a query at the most."""

    def run(batches):
        best = np.full((len(ids), k), -(1 << 40), np.int64)
        of = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                order = np.argsort(part.column(0).to_numpy(), kind="stable")
                rows = part.column(0).to_numpy()[order]
                v = _unit(_matrix(part.column(1), queries.shape[1]))[order]
                scope = part.column(2).to_numpy(zero_copy_only=False)[order] if scopes is not None else None
                for q in range(0, len(ids), QUERIES):
                    score = np.floor(queries[q : q + QUERIES] @ v.T * PLACES + 0.5).astype(np.int64)
                    if scopes is not None:
                        score[scopes[q : q + QUERIES, None] != scope[None, :]] = -(1 << 40)
                    take = min(k, len(rows))
                    key = -score * ROWS + np.arange(len(rows))  # rows are in order of id
                    top = np.argpartition(key, take - 1, axis=1)[:, :take] if take < len(rows) else np.broadcast_to(np.arange(len(rows)), key.shape)
                    s = np.concatenate([best[q : q + QUERIES], np.take_along_axis(score, top, 1)], 1)
                    i = np.concatenate([of[q : q + QUERIES], rows[top]], 1)
                    by = np.lexsort((i, -s), axis=1)[:, :k]
                    best[q : q + QUERIES], of[q : q + QUERIES] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)
        hit = best > -(1 << 40)
        yield pa.record_batch([pa.array(np.repeat(ids, hit.sum(1))), pa.array(of[hit]), pa.array(best[hit])], ["query", "id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame:
    """Rows (query, id, score, place): the k vectors of greatest cosine for each query, ties by id, exactly.

    vectors and queries are (id, embedding[, scope]), all of one length, whole-number ids and without faults (a VectorStore
    has no others). With scope a query sees only the vectors whose scope equals its own; a null
    sees none. Scores have four places, and rank so. Queries are dealt to waves of at most about
    WAVE_BYTES; a wave is one pass over the vectors, in which a task multiplies blocks and keeps k
    rows a query. These are merged by query.
    """
    spark = vectors.sparkSession
    names = ["id", "embedding", *([scope] if scope else [])]
    held = queries.select(*names) if not scope else queries.select(*names).where(F.col(scope).isNotNull())
    size = held.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    schema = "query long, id long, score long"
    found = spark.createDataFrame([], schema)
    rows = vectors.select(F.col("id").cast("long"), "embedding", *([F.col(scope).cast("string").alias("scope")] if scope else []))
    rows = rows.where("scope is not null") if scope else rows
    waves = max(1, -(-size["n"] * (size["dim"] or 1) * 8 // WAVE_BYTES))
    for w in range(waves if size["n"] else 0):
        got = held.where(F.pmod(F.xxhash64(F.lit("wave"), "id"), F.lit(waves)) == w).toArrow().combine_chunks()  # about WAVE_BYTES
        ids = got.column("id").to_numpy().astype(np.int64)
        if not len(ids):
            continue
        scopes = np.array([str(x) for x in got.column(scope).to_pylist()], object) if scope else None
        q = _unit(_matrix(got.column("embedding").combine_chunks(), size["dim"]))
        found = found.unionByName(rows.mapInArrow(_heaps(ids, q, scopes, k), schema))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query", "id", (F.col("score") / PLACES).alias("score"), "place")
