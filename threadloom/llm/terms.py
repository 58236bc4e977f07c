"""Terms of UTF-8 texts, cut as bytes: one pass maps every byte, a second splits at what is no part of a term."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F


def _table(digits: bool) -> bytes:
    """A-Z become a-z; a-z, bytes from 0x80 on (all of them parts of longer characters) and perhaps 0-9 stay; the rest are spaces."""
    kept = lambda b: b >= 0x80 or chr(b).isalpha() or (digits and chr(b).isdigit())
    return bytes((ord(chr(b).lower()) if b < 0x80 else b) if kept(b) else 0x20 for b in range(256))


LETTERS, LETTERS_DIGITS = _table(False), _table(True)


def term_runs(text: bytes, table: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """Maximal runs of the table's letters, A-Z lower-cased, in order; a very long text comes in several lists, none cut inside a term."""
    mapped, start = text.translate(table), 0
    while len(mapped) - start > size:
        cut = mapped.find(b" ", start + size)
        if cut < 0:
            break
        yield mapped[start:cut].split()
        start = cut
    yield (mapped[start:] if start else mapped).split()


def raw(column: str) -> Column:
    """A text column as bytes; null is empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))
