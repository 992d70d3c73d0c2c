"""Session settings that results depend on."""

from __future__ import annotations

import math
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Spark 4.1.2 lets a union keep its children's partitioning and then leaves out the exchange that an aggregation or
#: window over it needs; rows of one key can then stay apart, and counts come out wrong. Off, unions lose their partitioning.
#: Batches for Python are bounded by bytes too: rows are whole texts, and ten thousand of them are much for one worker.
#: Recursive queries are bounded by their own conditions, not by a number of rows.
REQUIRED = {"spark.sql.unionOutputPartitioning": "false", "spark.sql.cteRecursionRowLimit": "-1", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


#: Where Python workers find this package, if it is not installed.
ROOT = str(Path(__file__).resolve().parents[1])


def prepare(spark: SparkSession) -> SparkSession:
    """Puts the required settings in place; called wherever a plan begins."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for k, v in REQUIRED.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def prepared(df: DataFrame) -> DataFrame:
    prepare(df.sparkSession)
    return df


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder; a temporary folder only where none is named on a local master."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            at = tempfile.mkdtemp(prefix="patchloom-")
        sc.setCheckpointDir(at)
    return df.checkpoint()


#: Rows that a task sorts or gathers at once.
ROWS = 1 << 19


def dealt(df: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """df dealt out by keys into parts of about so many rows, however many there are: what a task sorts or gathers does not
    grow with the table. A number of parts that is asked for is neither merged nor split by size, and an aggregation by the
    keys then gathers in the parts alone, not before they are dealt, in as much of the table as a file's part holds."""
    parts = max(prepared(df).sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows))
    return df.repartition(parts, *keys)
