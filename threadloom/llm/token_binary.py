"""Token ids in binary segments under a Re-Pair grammar.

Documents are put in ascending doc_id order by range partitions, encoded, and
cut into segments of about ``SEGMENT_TOKENS`` ids; a document is never cut. In each
segment frequent pairs of neighbouring symbols are replaced by nonterminals,
round after round, until no pair pays. A segment file holds the rules, the
number of ids each rule expands to, and the symbols, so a reader finds any
document, or any range of ids, by summing expansion lengths and expanding
only the symbols it needs.

Segment layout, all little-endian: magic ``RPTK``, then five 32-bit counts
(version, documents, rules, symbols, first nonterminal), then per document
the 64-bit doc_id with an 8-bit null flag and the 32-bit number of symbols,
per rule two 32-bit symbols and a 64-bit expansion length, then the symbols as
32-bit integers.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.memo import WIDE, ChunkCoder
from threadloom.llm.text import collector_off, per_batch
from threadloom.storage import materialize

#: Ids of a segment; a longer document has a segment of its own.
SEGMENT_TOKENS = 1_000_000
#: Pairs replaced in a round, and the least count that pays.
PAIRS, LEAST = 8192, 8
END_ID = 0
_MAGIC = b"RPTK"
_BIN_BITS = 20
#: Words that the library is given as one string, and words of letters alone.
_JOINED, _LETTERS = 4096, 512
#: Characters and rows that are encoded together: a word is looked up once in a piece, and large pieces repeat more of theirs.
PIECE, _ROWS = 8_000_000, 10_000
#: Entries of a worker's memo of chunks; about 240 MB.
_MEMO = 1_200_000


def _byte_signs() -> str:
    """The sign that byte-level vocabularies write for each byte."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


def _letters(text: str) -> bool:
    return text.isalpha() and (text.isascii() or not WIDE.search(text))


class LibraryCoder:
    """The ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives, by way of distinct words.

    The library is slow on many small strings, so words that a memo doesn't
    hold are encoded together as one string and its ids are cut where a token
    begins with a space; words behind a line feed are cut likewise, if no token
    holds a line feed and anything but white space. This needs a byte-level model that cuts text at every
    lone space; with any other file, and for texts that hold an added token,
    the library gets the whole text. Words of letters alone are one match of
    its pattern, so they go to the library's model without cutting and
    without the bookkeeping of offsets that goes with it, if no merge of the
    model spans a letter and a space. The memo lives as long as the object.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        spec = json.loads(self.model.to_str())
        shape = spec["pre_tokenizer"] or {}
        lone = not spec["normalizer"] and shape.get("type") == "ByteLevel" and shape.get("use_regex") and not shape.get("add_prefix_space")
        self.added = [t["content"] for t in spec["added_tokens"]]
        # how such vocabularies write the space and the line feed
        self.spaced, self.lined = self._beginning("\u0120"), self._beginning("\u010a")
        self.words = ChunkCoder(self._many, _MEMO) if lone else None
        self.signs = _byte_signs()
        self.bare = Tokenizer(self.model.model) if lone and self._apart(spec["model"]) else None

        self.lines = self.bare is not None and self._lines_apart()

    def _beginning(self, sign: str) -> np.ndarray:
        table = np.zeros(self.model.get_vocab_size(), dtype=bool)
        for token, i in self.model.get_vocab().items():
            table[i] = token.startswith(sign)
        return table

    def _lines_apart(self) -> bool:
        """Whether line feeds before and behind anything but white space are tokens of their own."""
        value = {sign: b for b, sign in enumerate(self.signs)}
        tokens = [t for t in self.model.get_vocab() if "\u010a" in t]
        # what is white space as a whole stands for nothing else
        return "\u010a" in tokens and all(bytes(value.get(c, 65) for c in t).decode(errors="replace").isspace() for t in tokens)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, model: dict) -> bool:
        """Whether words of letters behind spaces get the ids that each gets alone, when the model gets them in one string."""
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
            return False
        value = {sign: b for b, sign in enumerate(self.signs)}
        for token in model["vocab"]:
            if "\u0120" in token[1:] and all(c in value for c in token):
                raw = bytes(value[c] for c in token)
                for at in [i for i, b in enumerate(raw) if b == 32 and i]:
                    last = raw[:at].decode(errors="ignore")[-1:]
                    if not last or last.isalpha() or not raw[:at].endswith(last.encode()):
                        return False
        return True

    def _cut(self, model, words: list[str], size: int, begins: np.ndarray, signs: str | None = None) -> list[bytes]:
        """Ids of words that begin with the same sign, ``size`` of them at a time as one string, written in ``signs`` if those are given; ``begins`` tells the tokens that begin with that sign."""
        cut = []
        for start in range(0, len(words), size):
            part = words[start : start + size]
            text = "".join(part)
            if signs:
                text = text.replace(" ", signs[32]).replace("\n", signs[10]) if text.isascii() else text.encode().decode("latin-1").translate(signs)
            ids = np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.append(np.flatnonzero(begins[ids]), len(ids)) * 4
            if len(stops) != len(part) + 1:
                raise ValueError("the vocabulary doesn't begin a token at every space and line")
            flat, bounds = ids.tobytes(), stops.tolist()
            cut += [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        return cut

    def _many(self, texts: list[str]) -> list[bytes]:
        kinds, sorts, lines = [], ([], [], [], [], []), self.lines
        for t in texts:
            w, first, kind = t[1:], t[:1], 4
            if first == " ":
                if self.bare is not None and _letters(w):
                    kind = 0
                # one plain space, which begins a match behind the end of any such word
                elif w != "" and " " not in w and not w[0].isspace() and not w[-1].isspace():
                    kind = 1
            elif lines and first == "\n":
                if _letters(w):
                    kind = 2
                elif w.split() == [w]:
                    kind = 3
            kinds.append(kind)
            sorts[kind].append(t)
        done = [
            iter(self._cut(self.bare, sorts[0], _LETTERS, self.spaced, self.signs)),
            iter(self._cut(self.model, sorts[1], _JOINED, self.spaced)),
            iter(self._cut(self.bare, sorts[2], _LETTERS, self.lined, self.signs)),
            iter(self._cut(self.model, sorts[3], _JOINED, self.lined)),
            iter(self._whole(sorts[4])),
        ]
        return [next(done[kind]) for kind in kinds]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if self.words is None:
            return self._whole(texts)
        plain = [not any(a in t for a in self.added) for t in texts]
        easy, hard = iter(self.words.encode_batch([t for t, p in zip(texts, plain, strict=True) if p])), iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(easy) if p else next(hard) for p in plain]


#: The coder of this worker process, by its file: a worker serves many tasks, which meet the same words.
_CODERS: dict[tuple, LibraryCoder] = {}


def worker_coder(path: str) -> LibraryCoder:
    """The process's coder of a file; another file, or a changed one, takes its place."""
    found = os.stat(path)
    key = path, found.st_size, found.st_mtime_ns
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = LibraryCoder(path)
    return _CODERS[key]


def _bins(pairs: np.ndarray, bits: int) -> np.ndarray:
    return (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def compress(ids: np.ndarray, first: int, pairs: int = PAIRS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """``(symbols, rules)`` of ids; rule i is a pair of symbols named ``first + i``. The end id joins no pair.

    A round counts all pairs exactly and replaces the ``pairs`` most frequent
    ones all at once, until none occurs ``least`` times. A pair that is too
    rare stays so, since new neighbours always have a new symbol; later rounds
    count only the places that can still pay. Pairs are first counted by bins
    of a hash: a bin of fewer than ``least`` holds no pair that pays, so only
    the others are sorted.
    """
    seq, rules = ids.astype(np.uint32), []
    inner = seq != END_ID
    live = inner & np.append(inner[1:], False)[: len(seq)]
    while True:
        at = np.flatnonzero(live)
        pair = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
        bits = min(_BIN_BITS, max(10, len(pair).bit_length() - 1))
        bins = _bins(pair, bits)
        some = (np.bincount(bins, minlength=1 << bits) >= least)[bins]
        live[at] = some
        some = np.flatnonzero(some)  # positions are taken faster than by a mask
        at, pair, bins = at[some], pair[some], bins[some]
        ordered = np.sort(pair)
        edge = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, dtype=np.int64)
        found, counts = ordered[edge], np.diff(np.append(edge, len(ordered)))
        good = counts >= least
        found, counts = found[good], counts[good]
        if not len(found):
            break
        if len(found) > pairs:
            found = np.sort(found[np.argpartition(-counts, pairs)[:pairs]])
        # a bin names one of the pairs to replace; what is another pair is searched among all
        named = np.full(1 << bits, -1, dtype=np.int32)
        named[_bins(found, bits)] = np.arange(len(found))
        which = named[bins]
        likely = np.flatnonzero(which >= 0)
        which, wanted = which[likely].astype(np.int64), pair[likely]
        miss = np.flatnonzero(found[which] != wanted)
        which[miss] = np.minimum(np.searchsorted(found, wanted[miss]), len(found) - 1)
        same = np.flatnonzero(found[which] == wanted)
        place, which = at[likely[same]], which[same]
        # of neighbouring hits that overlap, every second one counts
        breaks = np.flatnonzero(np.diff(place, prepend=-2) != 1)
        run = np.arange(len(place)) - np.repeat(breaks, np.diff(np.append(breaks, len(place))))
        even = np.flatnonzero(run & 1 == 0)
        place, which = place[even], which[even]
        hit = np.bincount(which, minlength=len(found)) > 0
        used, name = np.flatnonzero(hit), np.cumsum(hit) - 1
        seq[place] = (first + len(rules) + name[which]).astype(np.uint32)
        rules.extend(zip((found[used] >> np.uint64(32)).tolist(), (found[used] & np.uint64(0xFFFFFFFF)).tolist(), strict=True))
        keep = np.ones(len(seq), dtype=bool)
        keep[place + 1] = False
        keep = np.flatnonzero(keep)
        seq, live = seq[keep], live[keep]
        # the new symbols, where they stand now, and the places before them can pay again
        place -= np.arange(len(place))
        live[place] = np.append(seq, END_ID)[place + 1] != END_ID
        before = place[1:] - 1 if place[0] == 0 else place - 1
        live[before] = (seq[before] != END_ID) & (seq[before + 1] != END_ID)
    return seq, np.array(rules, dtype=np.int64).reshape(-1, 2)


def _in_turn(rules: np.ndarray, first: int) -> Iterator[tuple[int, int]]:
    """Slices of rules that use only rules before the slice."""
    latest = np.maximum.accumulate(rules.max(axis=1)) - first if len(rules) else rules[:, 0]
    start = 0
    while start < len(rules):
        stop = int(np.searchsorted(latest, start))
        yield start, stop
        start = stop


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule stands for; a rule uses only earlier rules."""
    lengths = np.ones(first + len(rules), dtype=np.int64)
    for start, stop in _in_turn(rules, first):
        lengths[first + start : first + stop] = lengths[rules[start:stop]].sum(axis=1)
    return lengths[first:]


def pack(doc_ids: list[int | None], ids: list[np.ndarray], first: int) -> bytes:
    """A segment's bytes; every document's ids end with the end id, which occurs nowhere else in ``ids``."""
    end = np.zeros(1, dtype=np.uint32)
    body = np.concatenate([y for x in ids for y in (x.astype(np.uint32) + np.uint32(1), end)]) if ids else end[:0]
    symbols, rules = compress(body, first + 1)
    ends = np.flatnonzero(symbols == END_ID)
    head = np.array([1, len(doc_ids), len(rules), len(symbols), first + 1], dtype="<u4")
    parts = [
        np.array([d or 0 for d in doc_ids], dtype="<i8"),
        np.array([d is None for d in doc_ids], dtype=np.uint8),
        np.diff(ends, prepend=-1).astype("<u4"),
        rules.astype("<u4"),
        expansion_lengths(rules, first + 1).astype("<i8"),
        symbols.astype("<u4"),
    ]
    return _MAGIC + head.tobytes() + b"".join(p.tobytes() for p in parts)


class Segment:
    """Reader of one segment; expands only what is asked for."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a token segment")
        _, docs, rules, symbols, self.first = np.frombuffer(data, "<u4", 5, 4).tolist()
        at = 24
        take = []
        for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", 2 * rules), ("<i8", rules), ("<u4", symbols)):
            take.append(np.frombuffer(data, kind, n, at))
            at += take[-1].nbytes
        keys, null, counts, pairs, self.lengths, self.symbols = take
        self.doc_ids = [None if n else d for d, n in zip(keys.tolist(), null.tolist(), strict=True)]
        self.stops = np.cumsum(counts.astype(np.int64))
        self.rules = pairs.reshape(-1, 2).astype(np.int64)
        self._table = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All plain symbols, then all rules expanded, one after another; where each begins, and its length."""
        if self._table is None:
            sizes = np.append(np.ones(self.first, dtype=np.int64), self.lengths)
            starts = np.cumsum(sizes) - sizes
            flat = np.arange(int(sizes.sum()), dtype=np.uint32)
            self._table = flat, starts, sizes
            for a, b in _in_turn(self.rules, self.first):
                made = self.expand(self.rules[a:b].reshape(-1))
                flat[(at := int(starts[self.first + a])) : at + len(made)] = made
        return self._table

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if not len(symbols):
            return symbols
        flat, starts, sizes = self._expansions()
        size = sizes[symbols]
        ends = np.cumsum(size)
        return flat[np.repeat(starts[symbols] - ends + size, size) + np.arange(int(ends[-1]))]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document without its end id."""
        start = int(self.stops[i - 1]) if i else 0
        return self.expand(self.symbols[start : int(self.stops[i]) - 1]).astype(np.int64) - 1

    def documents(self) -> list[np.ndarray]:
        body = self.expand(self.symbols).astype(np.int64)
        ends = np.flatnonzero(body == END_ID)
        return [body[a + 1 : b] - 1 for a, b in zip([-1, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def coded(self) -> Iterator[memoryview]:
        """Every document's ids with its end id, as little-endian 32-bit integers."""
        body = self.expand(self.symbols)
        stops = (np.flatnonzero(body == END_ID) + 1) * 4
        flat = memoryview((body - (body != END_ID)).astype("<u4").tobytes())
        for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True):
            yield flat[a:b]


def text_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of batches, put together into pieces of about ``PIECE`` characters, whatever the size of a batch."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text or "")
            held += len(texts[-1])
            if held >= PIECE or len(keys) >= _ROWS:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def write_segments(docs: DataFrame, path: str, tag: str = "token-segments", vocabulary: int = 50_257) -> DataFrame:
    """``(part, seq, n_docs, n_ids, data)``: one row a segment, written to the shared folder.

    (part, seq) follow ascending doc_id, null ids first. Null texts are
    documents of no ids; repeated rows are documents of their own. The files
    are Parquet rows of segment bytes, so any store that Spark reaches holds
    them. A task keeps one segment in memory.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the row's place parts repeated rows, which are equal in all else
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
    rows = rows.repartitionByRange(parts, "doc_id", "h", "n").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    shape = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])

    def segments(batches):
        part, seq, model = TaskContext.get().partitionId(), 0, worker_coder(path)
        keys, ids, held = [], [], 0

        def flush():
            nonlocal seq, keys, ids, held
            data = pack(keys, ids, vocabulary)
            out = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(keys)], "n_ids": [held + len(keys)], "data": [data]}, schema=shape)
            seq, keys, ids, held = seq + 1, [], [], 0
            return out

        for some, texts in text_pieces(batches):
            coded = model.encode_batch(texts)
            del texts
            for key, code in zip(some, coded, strict=True):
                one = np.frombuffer(code, dtype="<u4")
                if held and held + len(one) > SEGMENT_TOKENS:
                    yield flush()
                keys.append(key)
                ids.append(one)
                held += len(one)
        if keys:
            yield flush()

    def run(batches):
        with collector_off():
            yield from segments(batches)

    return materialize(rows.mapInArrow(run, "part int, seq int, n_docs bigint, n_ids bigint, data binary"), tag)


def read_segments(segments: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from written segments; ``start`` counts the ids of all documents before."""
    sizes = segments.select("part", "seq", "n_ids")
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("held"))
    before = totals.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("part_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = sizes.withColumn("inside", inside).join(before, "part").select("part", "seq", (F.col("part_start") + F.col("inside")).alias("first"))

    def make():
        def work(batch):
            out = {"part": [], "seq": [], "doc_id": [], "offset": [], "n_tokens": [], "ids_crc32": []}
            for part, seq, data in zip(batch["part"], batch["seq"], batch["data"], strict=True):
                segment, at = Segment(data), 0
                for key, code in zip(segment.doc_ids, segment.coded(), strict=True):
                    n = len(code) // 4
                    for name, value in (("part", part), ("seq", seq), ("doc_id", key), ("offset", at), ("n_tokens", n), ("ids_crc32", zlib.crc32(code))):
                        out[name].append(value)
                    at += n
            return out

        return work

    few = segments.select("part", "seq", "data")
    read = per_batch(few, make, "part int, seq int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """Encode, write, and read back: the digest of every document in the files."""
    return read_segments(write_segments(docs, path))
