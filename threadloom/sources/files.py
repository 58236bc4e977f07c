"""Files that are read once: a state table of path, length and time of change decides what is new."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

STATE = "path string, length bigint, modified timestamp"
#: Paths that one read is given; more changed files are read in further parts.
PATHS = 10_000


def signatures(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, length, modified)`` of the files under a folder; only their metadata is looked at."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def changed(found: DataFrame, state: DataFrame) -> DataFrame:
    """Signatures that the state doesn't hold: new files, and those of other length or time."""
    return found.join(state.select("path", "length", "modified").distinct(), ["path", "length", "modified"], "left_anti")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state table, empty where none was written yet."""
    try:
        return spark.read.schema(STATE).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], STATE)


def ingest_changed(spark: SparkSession, folder: str, state: str, take: Callable[[list[str]], None], pattern: str = "*") -> int:
    """Gives the paths of new and changed files to ``take`` and notes their signatures; the number of files taken.

    Signatures are noted after ``take`` is done with them, so a run that stops
    half-way takes the rest again. What is listed at the start is what counts:
    a file that changes meanwhile has another signature at the next run.
    """
    fresh = sorted(changed(signatures(spark, folder, pattern), read_state(spark, state)).collect())  # metadata of new files
    for start in range(0, len(fresh), PATHS):
        part = fresh[start : start + PATHS]
        take([r["path"] for r in part])
        spark.createDataFrame(part, STATE).coalesce(1).write.mode("append").parquet(state)
    return len(fresh)


def state_folder(root: str) -> str:
    return f"{root}/signatures-{uuid.uuid4().hex}"
