"""Hooks: sources of one's own, another scrubber, a transcriber."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    """``probe`` says why there is nothing to read, or None; ``extract`` gives records."""

    name: str
    probe: Callable[[SparkSession], str | None]
    extract: Callable[[SparkSession], DataFrame]


def extract_all(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """The records of every source that has some, in one table; columns that a source lacks are null."""
    ready = [s.extract(spark).withColumn("plugin", F.lit(s.name)) for s in sources if s.probe(spark) is None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ready)


def scrub_with(docs: DataFrame, scrubber: Callable[[Column], Column] | None = None, text: str = "text") -> DataFrame:
    """Adds ``scrubbed``: by the caller's column function, or by the library's own masking."""
    from threadloom.operators.privacy import scrub_text

    return scrub_text(docs, text) if scrubber is None else docs.withColumn("scrubbed", scrubber(F.col(text)))


def transcribe(files: DataFrame, transcriber: Callable[[bytes, str], list[tuple[str, str]] | None] | None = None) -> DataFrame:
    """(path, content) of audio files to ``(path, text, needs_transcript)``; without a transcriber, or where it gives None, a file waits."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                turns = transcriber(bytes(content), path) if transcriber else None
                rows.append((path, "\n".join(f"{s}: {t}" for s, t in turns or []), turns is None))
            yield pd.DataFrame(rows, columns=["path", "text", "needs_transcript"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, needs_transcript boolean")
