"""Small helpers that the operators share inside tasks."""

from __future__ import annotations

import ctypes
import gc
import re
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose texts a task holds as Python objects at a time.
ROWS = 500


def fold_of(key: str, parts: int) -> Column:
    """crc32 of a key's text, modulo ``parts``; null keys give null."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def crc_fold(key: object, parts: int) -> int | None:
    return None if key is None else zlib.crc32(str(key).encode()) % parts


_FINE = 1 << 52


def picked(key: Column, seed: str, share: Column | float) -> Column:
    """True for about ``share`` of all keys, by hash; fine enough for any number of rows."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(_FINE)) < F.lit(share) * float(_FINE)


@contextmanager
def collector_off():
    """No garbage collection inside: memos of many small objects hold no cycles, and scanning them takes a third of the time.

    Afterwards a worker, which serves many tasks, gives its memory back.
    """
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        gc.collect()
        release()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that runs without collection and leaves nothing behind in the worker."""

    def work(batches):
        with collector_off():
            yield from run(batches)

    return work


def release() -> None:
    """Give unused memory back to the system, in a task or on the driver between two steps."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``ROWS`` rows, where the session names no size: ten thousand texts at a time fill an executor."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, ROWS)


def per_batch(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Map Arrow batches as dicts of lists; ``make`` runs once in a task and gives the function of a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with collector_off():
            work = make()
            try:
                for batch in batches:
                    for start in range(0, batch.num_rows, ROWS):
                        part = batch.slice(start, ROWS)
                        out = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
            finally:
                work = out = None  # a worker serves many tasks: nothing of one stays for the next

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


#: The pattern that cuts text at every lone space; ``chunks`` is right for it alone.
SPACE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: All white space but the plain space and the line feed.
_ODD_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def plain_spaces(text: str) -> bool:
    """Whether all spaces of a text stand alone between two other characters that are no white space."""
    return not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in _ODD_SPACES))


def plain_lines(text: str) -> bool:
    """Whether ``SPACE_PATTERN`` takes every line feed of a text of plain spaces as a match of its own: three in a row, or two at the end, share a match."""
    return "\n\n\n" not in text and text[-2:] != "\n\n"


def chunks(text: str) -> list[str]:
    """Cut at every single space that stands between two characters that are no white space.

    Patterns like ``SPACE_PATTERN`` always start a match at such a space and
    never look back over it, so the pieces can be tokenized apart: the first as
    it is, each of the others with its space put back in front.
    """
    return text.split(" ") if plain_spaces(text) else _LONE_SPACE.split(text)
