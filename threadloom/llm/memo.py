"""Encoding whole texts chunk by chunk, with a bounded memo."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from threadloom.llm.text import chunks, plain_lines, plain_spaces

#: Entries of a task's memo of chunks; about 80 MB.
MOST = 400_000
_STOPS = ".,;:!?#$*%&|<>"
#: A character beyond the Latin letters that every pattern here takes for one kind.
WIDE = re.compile("[\u0250-\U0010ffff]")


def _strings(values: pa.Array) -> list[str]:
    """``values.to_pylist()``, by way of one long string where no value holds the mark between them."""
    if not len(values):
        return []
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values)
    out = pc.binary_join(whole, pa.scalar("\x00", values.type))[0].as_py().split("\x00")
    return out if len(out) == len(values) else values.to_pylist()


class ChunkCoder:
    """Encodes texts whose pattern never looks over a lone space (see ``text.chunks``).

    ``encode_many`` gives the ids of strings as little-endian 32-bit integers.
    Such a pattern takes a line feed before a character of any other kind as a
    match of its own, so plain texts are cut there too: a chunk that begins a
    line keeps its line feed, all others get their space back.
    Arrow finds the distinct chunks of a batch; each is looked up once, and the
    ids of the texts are gathered by position. The memo has two generations:
    when the young one is full it becomes the old one, and what is met again
    moves up. What moved up once is taken along at the next change, so
    frequent words stay.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], most: int = MOST):
        self.encode_many, self.half = encode_many, most // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.lasting: list[str] = []
        self.stops: dict[str, bytes] = {}

    def _learn(self, wanted: list[str]) -> None:
        young, old, stops = self.young, self.old, self.stops
        fresh, stopped = {}, []
        for c in wanted:
            if (v := old.get(c)) is not None:
                young[c] = v
                self.lasting.append(c)
            elif (word := c.rstrip(_STOPS)) is not c and (bare := word[1:] if word[:1] == "\n" else word).isalpha() and (bare.isascii() or not WIDE.search(bare)):
                # signs behind letters are a match of their own
                stopped.append((c, word, c[len(word) :]))
                if word not in young:
                    if (v := old.get(word)) is not None:
                        young[word] = v
                    else:
                        fresh[word] = None
            else:
                fresh[c] = None
        words = list(fresh)
        young.update(zip(words, self.encode_many([w if w[:1] == "\n" else " " + w for w in words]), strict=True))
        if len(stops) > 10_000:
            stops.clear()
        signs = list({s for _, _, s in stopped if s not in stops})
        stops.update(zip(signs, self.encode_many(signs), strict=True))
        for c, word, sign in stopped:
            young[c] = young[word] + stops[sign]

    def _split(self, texts: list[str], kind: int) -> tuple[pa.Array, np.ndarray]:
        """Chunks of all texts (all of one kind) one after another, and where each text's begin; the end comes last."""
        if kind == 0:
            parts = [chunks(t) for t in texts]
            return pa.array([c for some in parts for c in some], pa.large_string()), np.cumsum([0, *map(len, parts)])
        parts = pc.split_pattern(pa.array([t.replace("\n", " \n") for t in texts] if kind == 2 else texts, pa.large_string()), " ")
        return parts.flatten(), parts.offsets.to_numpy().astype(np.int64)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts; plain ones, those of plain lines and the others are split apart."""
        out: list[bytes] = [b""] * len(texts)
        kinds = [plain_spaces(t) * (1 + plain_lines(t)) for t in texts]
        for kind in range(3):
            own = [i for i, k in enumerate(kinds) if k == kind]
            if own:
                for i, code in zip(own, self._encode([texts[i] for i in own], kind), strict=True):
                    out[i] = code
        return out

    def _encode(self, texts: list[str], kind: int) -> list[bytes]:
        if len(self.young) > self.half:
            taken = {c: self.young[c] for c in self.lasting[-self.half // 2 :]}
            self.old, self.young, self.lasting = self.young, taken, list(taken)
        parts, starts = self._split(texts, kind)
        heads = self.encode_many(parts.take(pa.array(starts[:-1])).to_pylist())
        coded = parts.dictionary_encode()
        which, words = coded.indices.to_numpy().astype(np.int64), _strings(coded.dictionary)
        values = list(map(self.young.get, words))
        if None in values:
            self._learn([w for w, v in zip(words, values, strict=True) if v is None])
            get = self.young.__getitem__
            values = [get(w) if v is None else v for w, v in zip(words, values, strict=True)]
        # the first chunk of a text has no space before it
        which[starts[:-1]] = len(words) + np.arange(len(texts))
        values += heads
        flat = np.frombuffer(b"".join(values), dtype="<u4")
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        begins = np.cumsum(sizes) - sizes
        size = sizes[which]
        ends = np.cumsum(size)
        ids = flat[np.repeat(begins[which] - ends + size, size) + np.arange(int(ends[-1]))].tobytes()
        bounds = (np.append(0, ends)[starts] * 4).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
