"""Tables in versions: data goes to new folders, one small manifest makes a version visible at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEY = "_key"


class Conflict(RuntimeError):
    """Another writer has committed since the version that a write was based on."""


class Versions:
    """Numbered manifests below path/manifests; each is a JSON object that names the folders its version needs.

    A manifest is created under its number or not at all, so of two writers on one base one gets
    Conflict. A manifest cut short by a dying writer is no JSON and is passed over. What no manifest
    names is invisible, and sweep() deletes it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def numbers(self) -> list[int]:
        return [int(x.split(".")[0]) for x in self._names(f"{self.path}/manifests") if x.endswith(".json")]

    def state(self, number: int | None = None) -> tuple[int, dict]:
        """Number and manifest of the last committed version (or of the one asked for); (0, {}) if there is none."""
        for n in sorted(self.numbers(), reverse=True) if number is None else [number]:
            text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{n:012d}.json").first()
            try:
                return n, json.loads(text[0] if text else "")
            except json.JSONDecodeError:
                continue
        if number is not None:
            raise KeyError(f"no version {number}")
        return 0, {}

    def folder(self) -> str:
        """Name of a new folder for data, below path/data."""
        return uuid.uuid4().hex

    def where(self, folder: str) -> str:
        return f"{self.path}/data/{folder}"

    def commit(self, manifest: dict, base: int) -> int:
        """Makes manifest (with `folders`, all names it needs) the version after base."""
        number = max(self.numbers(), default=0) + 1
        if self.state()[0] != base:
            raise Conflict(f"version {base} is not the last one any more")
        at = self._path(f"{self.path}/manifests/{number:012d}.json")
        if self._fs.exists(at):
            raise Conflict(f"version {number} was committed meanwhile")
        out = self._fs.create(at, False)  # fails if it exists
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return number

    def sweep(self, keep: int = 1) -> int:
        """Deletes all but the last `keep` versions, and folders that none of those names; returns how many folders went.

        Not while a write is under way, whose folder no manifest names yet.
        """
        kept, last = set(), []
        for n in sorted(self.numbers(), reverse=True):
            if len(last) < keep and (m := self._valid(n)) is not None:
                last.append(n)
                kept |= set(m["folders"])
            else:
                self._fs.delete(self._path(f"{self.path}/manifests/{n:012d}.json"), False)
        gone = [x for x in self._names(f"{self.path}/data") if x not in kept]
        for x in gone:
            self._fs.delete(self._path(self.where(x)), True)
        return len(gone)

    def _valid(self, number: int) -> dict | None:
        try:
            return self.state(number)[1]
        except KeyError:
            return None


def _named(runs: list) -> list[str]:
    """Partition names of runs; a null run has one of its own."""
    return ["null" if r is None else f"={r}" for r in runs]


class RunTable:
    """A table of runs (a key column), in versions.

    A version is a list of written folders, and for each the runs that later writes took out of it.
    Folders are partitioned by run, so what was taken out, and the runs a reader does not ask for, are not read.
    The manifest grows with the number of runs taken out of folders that still hold others.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "analysis_id"):
        self.versions, self.key = Versions(spark, path), key

    def _written(self, df: DataFrame) -> tuple[str, list[str]]:
        """Writes df to a new folder: its name and the runs in it (their number bounds what the driver gets)."""
        folder = self.versions.folder()
        at = self.versions.where(folder)
        df.withColumn(KEY, F.coalesce(F.concat(F.lit("="), F.col(self.key).cast("string")), F.lit("null"))).write.partitionBy(KEY).parquet(at)
        names = self.versions.spark.read.schema(StructType([*df.schema]).add(KEY, "string")).parquet(at).select(KEY).distinct()
        return folder, [r[0] for r in names.collect()]

    def _commit(self, base: int, parts: list[dict], schema: StructType) -> int:
        parts = [p for p in parts if set(p["runs"]) - set(p["dropped"])]
        return self.versions.commit({"parts": parts, "schema": schema.json(), "folders": [p["folder"] for p in parts]}, base)

    def write(self, df: DataFrame) -> int:
        """df as the table's whole content, from the new version on."""
        base, _ = self.versions.state()
        folder, runs = self._written(df)
        return self._commit(base, [{"folder": folder, "runs": runs, "dropped": []}], df.schema)

    def replace(self, df: DataFrame, also: list | None = None) -> int:
        """The runs that df holds (and those of `also`, which it may lack) in place of the present ones; all others stay.

        Fails as a whole or not at all.
        """
        base, m = self.versions.state()
        folder, runs = self._written(df)
        return self._commit(base, [*self._without(m, [*runs, *_named(also or [])]), {"folder": folder, "runs": runs, "dropped": []}], df.schema)

    def delete(self, runs: list) -> int:
        base, m = self.versions.state()
        return self._commit(base, self._without(m, _named(runs)), StructType.fromJson(json.loads(m["schema"])))

    @staticmethod
    def _without(manifest: dict, runs: list[str]) -> list[dict]:
        return [p | {"dropped": sorted(set(p["dropped"]) | (set(runs) & set(p["runs"])))} for p in manifest.get("parts", [])]

    def read(self, version: int | None = None, runs: list | None = None) -> DataFrame:
        """Rows of the last committed version (or an earlier one that is still kept), of all runs or some."""
        n, m = self.versions.state(version)
        if not n:
            raise KeyError("nothing is committed yet")
        spark, schema = self.versions.spark, StructType.fromJson(json.loads(m["schema"]))
        out = spark.createDataFrame([], schema)
        for p in m["parts"]:
            rows = spark.read.schema(StructType([*schema]).add(KEY, "string")).parquet(self.versions.where(p["folder"]))
            if p["dropped"]:
                rows = rows.where(~F.col(KEY).isin(p["dropped"]))
            if runs is not None:
                rows = rows.where(F.col(KEY).isin(_named(runs)))
            out = out.unionByName(rows.drop(KEY))
        return out
