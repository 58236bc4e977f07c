"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

The leaf of a live position holds the rank of the pair that starts there
(with the position as tie-break), inner nodes the minimum, so the root names
the leftmost pair of the lowest rank. A merge changes three leaves: the merged
position, its left neighbour and the position that dies; each change climbs
log2(width) levels.

Short pieces are many: they are encoded together, one numpy row each, in
trees of equal width. A long piece gets a tree of its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from threadloom.llm.memo import ChunkCoder
from threadloom.llm.text import SPACE_PATTERN, per_batch

#: Pieces up to this many bytes are encoded in rows; longer ones alone.
ROW_WIDTH = 32
_INF = np.int32(2**31 - 1)
_MODELS: dict[tuple[str, str], ByteBpe] = {}


class ByteBpe:
    """Ranks of a ``.tiktoken`` file and the pattern that cuts text before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.spaced = pattern == SPACE_PATTERN
        self.vocabulary = {i: t for t, i in ranks.items()}
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self._keys = np.array(sorted(pairs), dtype=np.int64)
        self._ranks = np.array([pairs[k] for k in self._keys.tolist()], dtype=np.int32)
        self._byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        """One model a Python worker; the file must be where every worker can open it."""
        if (path, pattern) not in _MODELS:
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            _MODELS[path, pattern] = cls(ranks, pattern)
        return _MODELS[path, pattern]

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or -1; ids below 0 stand for nothing."""
        wanted = left.astype(np.int64) << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self._keys, wanted), len(self._keys) - 1)
        return np.where((self._keys[at] == wanted) & (right >= 0) & (left >= 0), self._ranks[at], -1)

    def merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, of each piece of at most ``width`` bytes (a power of two)."""
        n, span = len(pieces), 2 * width
        sizes = np.fromiter(map(len, pieces), dtype=np.int32, count=n)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(n, width)
        here = np.arange(width, dtype=np.int32)
        ids = np.full((n, width + 1), -1, dtype=np.int32)  # the last column stands for no position
        ids[:, :width] = np.where(here < sizes[:, None], self._byte_id[raw], -1)
        after = np.full((n, width + 1), width, dtype=np.int32)
        after[:, :width] = np.where(here + 1 < sizes[:, None], here + 1, width)
        before = np.empty((n, width + 1), dtype=np.int32)
        before[:, 1:], before[:, 0] = here, width
        rank = self._pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        tree = np.full((n, span), _INF, dtype=np.int32)
        tree[:, width:] = np.where(rank >= 0, rank * width + here, _INF)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        keep, tree, ids, after, before = ids, tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        rows = np.flatnonzero(tree[1::span] < _INF)
        while len(rows):
            root, line = rows * span, rows * (width + 1)
            best = tree[root + 1]
            at, made = best % width, best // width
            gone = after[line + at]
            then, prior = after[line + gone], before[line + at]
            ids[line + at], ids[line + gone] = made, -1
            after[line + at] = then
            before[line + then] = at
            after[line + width], before[line + width] = width, width
            fresh = self._pair_ranks(np.concatenate([made, ids[line + prior]]), np.concatenate([ids[line + then], made]))
            fresh = np.where(fresh >= 0, fresh * width + np.concatenate([at, prior]), _INF)
            tree[root + width + gone] = _INF
            tree[root + width + at] = fresh[: len(rows)]
            some = prior < width
            up, left = root[some], prior[some]
            tree[up + width + left] = fresh[len(rows) :][some]
            for base, where in ((root, gone), (root, at), (up, left)):
                node = (width + where) >> 1
                for _ in range(width.bit_length() - 1):
                    two = base + 2 * node
                    tree[base + node] = np.minimum(tree[two], tree[two + 1])
                    node = node >> 1
            rows = rows[tree[root + 1] < _INF]
        live = keep[:, :width] >= 0
        flat = keep[:, :width][live].astype("<u4").tobytes()
        ends = (np.cumsum(live.sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge_long(self, piece: bytes) -> list[int]:
        """Token ids of one piece of any length, in O(n log n)."""
        n, pairs = len(piece), self.pairs
        width = 1 << max(1, (n - 1).bit_length())
        ids = [self.ranks[piece[i : i + 1]] for i in range(n)]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        none = (1 << 62, 0)
        tree = [none] * (2 * width)

        def leaf(i: int) -> tuple[int, int]:
            j = after[i]
            rank = pairs.get(ids[i] << 32 | ids[j]) if j >= 0 else None
            return none if rank is None else (rank, i)

        for i in range(n):
            tree[width + i] = leaf(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: tuple[int, int]) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] is not none:
            rank, i = tree[1]
            j = after[i]
            ids[i], after[i] = rank, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return out

    def _encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Little-endian 32-bit ids of each distinct piece; a piece that is a token itself is taken whole."""
        out, by_width = {}, {}
        for piece in pieces:
            if (whole := self.ranks.get(piece)) is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(piece) > ROW_WIDTH:
                out[piece] = np.array(self.merge_long(piece), dtype="<u4").tobytes()
            else:
                by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(piece)
        for width, some in by_width.items():
            for start in range(0, len(some), 4096):
                part = some[start : start + 4096]
                out.update(zip(part, self.merge_rows(part, width), strict=True))
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of strings as little-endian 32-bit integers; each distinct match of the pattern is encoded once."""
        matches = [self._matches(t) for t in texts]
        ids = self._encode_pieces(list({p for some in matches for p in some}))
        return [ids[some[0]] if len(some) == 1 else b"".join([ids[p] for p in some]) for some in matches]

    def _matches(self, text: str) -> list[bytes]:
        # a space and plain letters are one match and need no search
        if self.spaced and text[:1] == " " and (word := text[1:]).isalpha() and max(word) < "\u0250":
            return [text.encode()]
        return [m.encode("utf-8", "surrogatepass") for m in self.pattern.findall(text)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers."""
        return self.coder()(texts)

    def coder(self) -> Callable[[list[str]], list[bytes]]:
        """An encoder of batches of texts with a bounded memo, which lives as long as the encoder; other patterns get texts whole."""
        return ChunkCoder(self.encode_many).encode_batch if self.spaced else self.encode_many

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, round_trip)``: ids as little-endian 32-bit integers, and whether they decode to the text.

    Null texts count as empty: no ids. Repeated rows and null keys are
    encoded like any other row. There is no shuffle; a worker keeps a bounded
    memo of chunks, so memory doesn't grow with the input.
    """

    def make():
        model = ByteBpe.load(path, pattern)
        encode_batch = model.coder()  # its memo lives as long as the task

        def work(batch):
            texts = [t or "" for t in batch["text"]]
            coded = encode_batch(texts)
            same = [model.decode(c) == t.encode("utf-8", "surrogatepass") for c, t in zip(coded, texts, strict=True)]
            return {"doc_id": batch["doc_id"], "n_tokens": [len(c) // 4 for c in coded], "ids": coded, "round_trip": same}

        return work

    return per_batch(docs.select("doc_id", "text"), make, "doc_id bigint, n_tokens bigint, ids binary, round_trip boolean")


def encode_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``; the ids themselves never leave the task."""

    def make():
        model = ByteBpe.load(path, pattern)
        encode_batch = model.coder()  # its memo lives as long as the task

        def work(batch):
            coded = encode_batch([t or "" for t in batch["text"]])
            return {
                "doc_id": batch["doc_id"],
                "n_tokens": [len(c) // 4 for c in coded],
                "ids_sha256": [hashlib.sha256(c).hexdigest() for c in coded],
                "decoded_sha256": [hashlib.sha256(model.decode(c)).hexdigest() for c in coded],
            }

        return work

    return per_batch(docs.select("doc_id", "text"), make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
