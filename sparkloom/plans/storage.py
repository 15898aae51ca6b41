"""Written tables in the shared folder, to cut lineage between iterations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted side is broadcast.
FEW_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names; a local one only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written below the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(side: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """side, which must be cheap to count (a staged table), with a broadcast hint if it has at most `most` rows; else unchanged."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def dealt(df: DataFrame, rows: int, each: int, *keys: str) -> DataFrame:
    """df with about `each` of its `rows` rows a task, and no fewer tasks than cores: for work that its bytes do not tell of."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), *keys)
