"""Incremental forms: file streams with checkpoints, upserts, de-duplication and the thread gate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.storage import shared_dir


def incremental_ingest(spark: SparkSession, landing: str, schema, out: str, keep=None) -> None:
    """Everything new in ``landing`` is appended to ``out`` once; a stopped run resumes from the checkpoint beside it."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(landing)
    if keep is not None:
        stream = stream.where(keep)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()


def dedupe_stream(spark: SparkSession, landing: str, schema, key: str, ts: str, out: str, late: str = "30 days") -> None:
    """As ``incremental_ingest``, with repeated keys dropped within the watermark, so state is bounded by time."""
    stream = spark.readStream.schema(schema).parquet(landing).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()


def daily_counts_stream(spark: SparkSession, landing: str, schema, ts: str, out: str) -> None:
    """Counts of tumbling days; a day is final once the watermark has passed it, later rows are left to the batch backlog."""
    stream = spark.readStream.schema(schema).parquet(landing).withWatermark(ts, "1 day")
    counts = stream.groupBy(F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("other").alias("handles")).select(F.col("w.start").alias("day"), "n", "handles")
    counts.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()


def thread_gate_stream(spark: SparkSession, landing: str, schema, out: str) -> None:
    """Judged records (thread, id, keep, scope) through a gate with one flag of state a thread.

    Emits (thread, id, action): keep, drop, or retract for the whole thread
    when it becomes excluded after records of it went through.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def gate(key, frames, state: GroupState):
        closed = state.get[0] if state.exists else False
        for f in frames:
            closes = bool((f["scope"] == "thread").any())
            rows = []
            if closes and not closed:
                rows.append((key[0], "", "retract"))
            closed = closed or closes
            rows += [(key[0], i, "keep" if k and not closed else "drop") for i, k in zip(f["id"], f["keep"], strict=True)]
            yield pd.DataFrame(rows, columns=["thread", "id", "action"])
        state.update((closed,))

    stream = spark.readStream.schema(schema).parquet(landing).groupBy("thread")
    gated = stream.applyInPandasWithState(gate, "thread string, id string, action string", "closed boolean", "append", GroupStateTimeout.NoTimeout)
    gated.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()


def landing_of(df: DataFrame, files: int = 4) -> str:
    """Writes ``df`` as a landing folder of the shared storage and gives its path."""
    path = f"{shared_dir(df.sparkSession)}/landing-{uuid.uuid4().hex}"
    df.repartition(files).write.parquet(path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
