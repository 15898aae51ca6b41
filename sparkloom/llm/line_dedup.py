"""Line dedup over documents: line hashes live in levelled, sorted, bucketed runs that batches are joined against."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: ASCII white space, stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys shorter than this, in code points, are never dropped.
LEAST_CHARS = 20
#: Documents that hold a key from which on it is dropped in all but one of them.
LEAST_DOCS = 3
#: Runs of one level that are merged into one of the next.
FANOUT = 3
#: Batches that a whole table is fed to the runs in.
BATCHES = 6
#: Estimated bytes of a decided line in a broadcast table.
DECIDED_BYTES = 90


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(text: Column) -> Column:
    """array<binary>: 128 bits of SHA-256 of each line's key; null for a line whose key is too short."""
    bare = F.transform(lines_of(text), lambda x: F.btrim(x, F.lit(BLANKS)))
    plain = lambda x: F.char_length(x) == F.octet_length(x)
    keys = F.transform(bare, lambda x: F.when(plain(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER)))
    return F.transform(keys, lambda x: F.when(F.char_length(x) >= LEAST_CHARS, F.substring(F.unhex(F.sha2(x.cast("binary"), 256)), 1, 16)))


class LineRuns:
    """An index of line hashes below path: runs sorted by hash, each a table with the same buckets.

    An entry is (hash, docs, last): how many documents of the batches behind the run hold the line,
    and the greatest of their ids. A batch becomes one run of level 0; FANOUT runs of a level are
    merged into one of the next. As all runs have the same buckets, a batch is dealt out once and
    the runs it is joined with stay where they are. A run's folder is named after the batches it
    covers, and counts once Spark has marked it as written: a folder inside another's range is left
    over from a merge, and is passed over. So a job that died half-way leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path, fanout
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(path))] if self._fs.exists(self._path(path)) else []
        found = [x for x in found if x.startswith("run-") and self._fs.exists(self._path(f"{path}/{x}/_SUCCESS"))]
        spans = [tuple(map(int, x.split("-")[1:4])) for x in found]
        self.buckets = spans[0][2] if spans else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        inside = lambda a, b: a != b and b[0] <= a[0] and a[1] <= b[1]
        self.runs: dict[tuple[int, int], DataFrame] = {a[:2]: self._opened(a[0], a[1]) for a in sorted(spans) if not any(inside(a, b) for b in spans)}

    def _folder(self, first: int, last: int) -> str:
        return f"{self.path}/run-{first}-{last}-{self.buckets}"

    def _opened(self, first: int, last: int) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (hash BINARY, docs BIGINT, last BIGINT) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{self._folder(first, last)}'")
        return self.spark.table(name)

    def _written(self, entries: DataFrame, first: int, last: int) -> DataFrame:
        """Writes entries as the run of the batches first to last; what a dead job left there is replaced."""
        self._fs.delete(self._path(self._folder(first, last)), True)
        rows = entries.select("hash", "docs", "last").repartition(self.buckets, "hash")
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, "hash").sortBy("hash").option("path", self._folder(first, last)).saveAsTable(name)
        return self.spark.table(name)

    def unseen(self, hashed: DataFrame) -> DataFrame:
        """The rows of hashed whose hash no run holds: merge-anti-joined with one run after another."""
        for run in self.runs.values():
            hashed = hashed.join(run.select("hash").hint("merge"), "hash", "left_anti")
        return hashed

    def add(self, held: DataFrame, least_docs: int = LEAST_DOCS) -> None:
        """Adds a batch: distinct rows (hash, doc_id); a document belongs to one batch.

        Hashes that a run knows from enough documents, one of them with a greater id, tell nothing
        new: the anti-join takes them out, and the others become the batch's own run.
        """
        own = held.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last")).alias("own")
        for run in self.runs.values():
            known = run.where(F.col("docs") >= least_docs).hint("merge").alias("known")
            later = F.col("known.last") >= F.col("own.last")
            own = own.join(known, (F.col("own.hash") == F.col("known.hash")) & (F.col("own.last").isNull() | later), "left_anti").alias("own")
        at = max((b for _, b in self.runs), default=-1) + 1
        self.runs[at, at] = self._written(own, at, at)
        self._compact()

    def _compact(self) -> None:
        """Merges the newest FANOUT runs of one length into one, as often as there are so many."""
        while True:
            spans = sorted(self.runs)[-self.fanout :]
            if len(spans) < self.fanout or len({b - a for a, b in spans}) > 1:
                return
            first, last = spans[0][0], spans[-1][1]
            merged = self._written(self._merged(spans), first, last)
            for a, b in spans:
                del self.runs[a, b]
                self._fs.delete(self._path(self._folder(a, b)), True)
            self.runs[first, last] = merged

    def _merged(self, spans: list[tuple[int, int]]) -> DataFrame:
        # the filter makes the union one of rows: a union of column batches sets partitions side by side
        # but is planned as if it had brought equal buckets together, and would count a hash twice
        parts = [self.runs[x].where("hash is not null") for x in spans]
        rows = functools.reduce(DataFrame.unionByName, parts)
        return rows.groupBy("hash").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def decided(self, least_docs: int = LEAST_DOCS) -> DataFrame:
        """Rows (hash, last): the lines of least_docs documents or more, and the document that keeps them."""
        if not self.runs:
            return self.spark.createDataFrame([], "hash binary, last long")
        return self._merged(sorted(self.runs)).where(F.col("docs") >= least_docs).select("hash", "last")


def _hashed(docs: DataFrame, id_col: str, text_col: str, batches: int) -> DataFrame:
    """Written rows (row_key, doc_id, hashes, again, batch); again: other rows have the same id."""
    doc = F.col(id_col).cast("long").alias("doc_id")
    rows = docs.select(common.row_key(id_col, text_col).alias("row_key"), doc, line_hashes(common.text_or_empty(text_col)).alias("hashes"))
    again = common.staged(docs.groupBy(doc).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id", F.lit(True).alias("again")), "line-ids")
    again = common.sized(again, 32).withColumnRenamed("doc_id", "id")
    rows = rows.join(again, F.col("doc_id").eqNullSafe(F.col("id")), "left").drop("id")
    batch = F.pmod(F.xxhash64(F.lit("batch"), "doc_id"), F.lit(batches)).cast("int")
    return common.staged(rows.select("row_key", "doc_id", "hashes", F.coalesce("again", F.lit(False)).alias("again"), batch.alias("batch")), "line-hashes")


def _masks(docs: DataFrame, runs: LineRuns, id_col: str, text_col: str, batches: int) -> DataFrame:
    """Rows (row_key, mask, n_dropped) of the documents that lose lines; mask has a 1 for each dropped line."""
    hashed = _hashed(docs, id_col, text_col, batches)
    held = lambda rows: rows.select("doc_id", F.explode(F.array_distinct(F.array_compact("hashes"))).alias("hash"))
    for i in range(batches):
        batch = hashed.where(F.col("batch") == i)
        runs.add(held(batch.where("not again")).unionByName(held(batch.where("again")).distinct()))
    decided = common.sized(common.staged(runs.decided(), "line-decided"), DECIDED_BYTES)
    lines = hashed.select("row_key", "doc_id", F.posexplode("hashes").alias("pos", "hash")).where("hash is not null")
    gone = lines.join(decided, "hash").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = gone.groupBy("row_key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    ahead = lambda x, i: x - F.when(i > 0, F.get("gone", i - 1)).otherwise(F.lit(-1)) - 1
    mask = F.array_join(F.transform("gone", lambda x, i: F.concat(F.repeat(F.lit("0"), ahead(x, i)), F.lit("1"))), "")
    return common.staged(gone.select("row_key", mask.alias("mask"), F.size("gone").cast("long").alias("n_dropped")), "line-masks")


def _marked(docs: DataFrame, id_col: str, text_col: str, batches: int, runs: LineRuns | None) -> DataFrame:
    """docs with _kept (the text without dropped lines, null if none was) and _dropped."""
    runs = runs or LineRuns(docs.sparkSession, common.work_dir(docs.sparkSession, "line-runs"))
    masks = _masks(docs, runs, id_col, text_col, batches).withColumnsRenamed({"row_key": "_row", "mask": "_mask", "n_dropped": "_dropped"})
    masks = common.sized(masks, 80, F.octet_length("_mask"), 1)
    out = docs.withColumn("_row", common.row_key(id_col, text_col)).join(masks, "_row", "left").drop("_row")
    left = F.zip_with(lines_of(common.text_or_empty(text_col)), F.split("_mask", ""), lambda x, m: F.when(F.coalesce(m, F.lit("")) != "1", x))
    return out.withColumn("_kept", F.when(F.col("_mask").isNotNull(), F.array_join(left, "\n"))).drop("_mask")


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, runs: LineRuns | None = None) -> DataFrame:
    """docs, whose texts have lost the lines that LEAST_DOCS documents hold, but for the document of the greatest id.

    A line's key is the line without ASCII white space at its ends, A to Z in lower case; keys under
    LEAST_CHARS code points stay. runs may hold earlier batches, against which docs are then judged
    too. Rows that share an id are one document; a null id is one document, less than all others.
    Null texts stay null. A text that loses all its lines becomes empty.
    """
    out = _marked(docs, id_col, text_col, batches, runs)
    return out.withColumn(text_col, F.coalesce("_kept", F.col(text_col))).select(*docs.columns)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, kept_sha256), one per input row; see without_common_lines.

    A null or empty text is one empty line. Extra columns are ignored; an empty table gives no rows.
    """
    out = _marked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", batches, None)
    text = common.text_or_empty("text")
    n = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    kept = F.sha2(F.coalesce("_kept", text).cast("binary"), 256)
    return out.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce("_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_sha256"))
