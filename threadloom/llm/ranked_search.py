"""Ranked lexical search: Block-Max MaxScore over an inverted index in shards.

``build_index`` writes one row for each term of a shard: its postings, sorted
by document and packed as variable-length bytes in blocks of ``BLOCK``, and
beside them a head for every block (last document, largest occurrence count,
fewest words of a document, where its bytes end). A shard is what one task
reads, in pieces of at most ``SHARD_POSTINGS``; every row of the table is in it.

``search`` runs each query on each shard. Lists are taken by falling global
bound. While documents not seen so far could still reach the threshold (the
k-th best score known), a list is essential and read whole. From then on only
the documents met so far are looked up: a document whose score, plus the bound
of the one block that could hold it, plus the bounds of the lists to come,
stays under the threshold is dropped before the block is unpacked. Every shard
hands on its k best; Spark merges them. Bounds are never below true scores and
ties are kept, so the result is that of scoring all documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.terms import LETTERS_DIGITS, raw, term_runs
from threadloom.llm.text import ROWS, collector_off, release
from threadloom.storage import materialize

TOP = 50
BLOCK = 128
SHARD_POSTINGS = 1_000_000
#: (item, term) pairs that go to the tasks at a time; more items are searched in further passes.
QUERY_PAIRS = 200_000
#: Words that a building task holds as objects at a time.
HELD_WORDS = 400_000
BILLION = 1_000_000_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "shard bigint, term string, held bigint, words bigint, heads binary, data binary, ids array<bigint>"
_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("held", pa.int64()), ("words", pa.int64()), ("heads", pa.binary()), ("data", pa.binary()), ("ids", pa.list_(pa.int64()))])


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first, the top bit set on all bytes but a value's last; and where each value ends."""
    size = np.ones(len(values), dtype=np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= (1 << bits)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(5):
        has = size > k
        byte = (values[has] >> (7 * k)) & 127
        out[ends[has] - size[has] + k] = byte | ((size[has] > k + 1).astype(np.int64) << 7)
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    """The values that ``pack`` wrote."""
    last = data < 128
    start = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(data) else np.zeros(0, dtype=np.int64)
    within = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * within), start) if len(start) else np.zeros(0, dtype=np.int64)


class _Shard:
    """Postings of the documents that a building task has met since the last shard."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.numbers: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.flat: list[bytes] = []
        self.owners: list[tuple[int, int]] = []
        self.postings = 0

    def add(self, key: int | None, text: bytes) -> None:
        length = 0
        for words in term_runs(text, LETTERS_DIGITS):
            if words:
                length += len(words)
                self.flat += words
                self.owners.append((len(self.ids), len(words)))
                if len(self.flat) > HELD_WORDS:
                    self.count()
        if length:  # rows without a term can't be found and count nowhere
            self.ids.append(key)
            self.lengths.append(length)

    def count(self) -> None:
        """Turn the words held into (term, document, occurrences)."""
        if not self.flat:
            return
        coded = pa.array(self.flat, pa.large_binary()).dictionary_encode()
        numbers = self.numbers
        term = np.array([numbers.setdefault(t, len(numbers)) for t in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()]
        doc = np.repeat([d for d, _ in self.owners], [n for _, n in self.owners])
        key, times = np.unique((doc << 32) | term, return_counts=True)
        self.parts.append(((key & 0xFFFFFFFF).astype(np.int32), (key >> 32).astype(np.int32), times.astype(np.int64)))
        self.postings += len(key)
        self.flat, self.owners = [], []

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The shard's index: documents first (a null term), then its terms in order."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array(self.lengths, dtype=np.int64)[order]
        own = [[shard], [None], [len(order)], [int(lengths.sum())], [b""], [lengths.tobytes()], [[self.ids[i] for i in order]]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(own, _ARROW, strict=True)], schema=_ARROW)
        names = sorted(self.numbers)
        rank = np.empty(len(names), dtype=np.int64)
        rank[[self.numbers[n] for n in names]] = np.arange(len(names))
        key = np.concatenate([(rank[t] << 32) | place[d] for t, d, _ in self.parts])
        times = np.concatenate([n for _, _, n in self.parts])
        self.parts, self.numbers = [], {}
        by = np.argsort(key, kind="stable")
        key, times = key[by], times[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))  # a long text is counted in pieces
        times, key = np.add.reduceat(times, first), key[first]
        term, doc = key >> 32, key & 0xFFFFFFFF
        starts = np.searchsorted(term, np.arange(len(names) + 1))
        held = np.diff(starts)
        fresh = (np.arange(len(key)) - starts[term]) % BLOCK == 0
        delta = doc.copy()
        delta[1:] -= doc[:-1]
        delta[fresh] = doc[fresh]
        values = np.empty(2 * len(key), dtype=np.int64)
        values[0::2], values[1::2] = delta, times
        data, ends = pack(values)
        ends = ends[1::2]  # of postings
        begin = np.flatnonzero(fresh)
        last = np.append(begin[1:], len(key)) - 1
        base = np.append(0, ends)[starts]  # of each term's bytes
        heads = np.stack([doc[last], np.maximum.reduceat(times, begin), np.minimum.reduceat(lengths[doc], begin), ends[last] - base[term[last]]], axis=1).astype("<i8")
        head_at = np.searchsorted(begin, starts) * heads.shape[1] * 8
        columns = [
            pa.array(np.full(len(names), shard)),
            pa.array([n.decode("utf-8", "replace") for n in names], pa.string()),
            pa.array(held),
            pa.array(np.add.reduceat(times, starts[:-1])),
            _binary(head_at, heads.tobytes()),
            _binary(base, data.tobytes()),
            pa.nulls(len(names), pa.list_(pa.int64())),
        ]
        table = pa.RecordBatch.from_arrays(columns, schema=_ARROW)
        for at in range(0, len(names), 20_000):
            yield table.slice(at, 20_000)


def _binary(ends: np.ndarray, data: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(data)])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = SHARD_POSTINGS) -> DataFrame:
    """The index of every row: ``(shard, term, held, words, heads, data, ids)``.

    A row with a null term stands for its shard's documents: their ids in
    order (null ids first), their number of terms in ``data``. Rows without a
    term (null and empty texts) are in no shard; repeated rows are documents
    of their own; a text of any length is one document, in one shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made = _Shard(), TaskContext.get().partitionId() << 24
        with collector_off():
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    part = batch.slice(start, ROWS)
                    for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        shard.add(k, t)
                    shard.count()
                    if shard.postings > most:
                        yield from shard.rows(made)
                        shard, made = _Shard(), made + 1
                        release()
            if shard.ids:
                yield from shard.rows(made)

    return docs.select(F.col(key).cast("bigint").alias("id"), raw(text).alias("text")).mapInArrow(run, INDEX)


class _List:
    """Postings of a term in a shard: heads at hand, blocks unpacked when asked for."""

    def __init__(self, heads: bytes, data: bytes, held: int, norms: np.ndarray, norm_of):
        head = np.frombuffer(heads, dtype="<i8").reshape(-1, 4)
        self.last, self.ends, self.norms = head[:, 0], head[:, 3], norms
        self.bounds = _impact(head[:, 1], norm_of(head[:, 2]))
        self.bound = int(self.bounds.max())
        self.data = np.frombuffer(data, dtype=np.uint8)
        self.docs, self.impacts = np.zeros(held, dtype=np.int64), np.zeros(held, dtype=np.int64)
        self.open = np.zeros(len(head), dtype=bool)

    def unpack(self, blocks: np.ndarray) -> None:
        """Make the postings of these blocks readable."""
        blocks = blocks[~self.open[blocks]]
        if not len(blocks):
            return
        begins = np.append(0, self.ends[:-1])[blocks]
        values = unpack(np.concatenate([self.data[a:b] for a, b in zip(begins, self.ends[blocks], strict=True)]))
        sizes = np.minimum(BLOCK, len(self.docs) - blocks * BLOCK)
        at = np.cumsum(sizes) - sizes
        slots = np.repeat(blocks * BLOCK - at, sizes) + np.arange(int(sizes.sum()))
        summed = np.cumsum(values[0::2])
        docs = summed - np.repeat(np.append(0, summed)[at], sizes)
        self.docs[slots], self.impacts[slots] = docs, _impact(values[1::2], self.norms[docs])
        self.open[blocks] = True


def _impact(times: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied by: rises with occurrences, falls with the document's length."""
    return (BILLION * times) // (1000 * times + 20 * norm)


def best(lists: list[tuple[int, _List]], docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (place, score) of a shard for weighted lists, by falling score, then place; scores of 0 are left out."""
    lists = sorted(lists, key=lambda x: -x[0] * x[1].bound)
    rest = np.append(np.cumsum([w * x.bound for w, x in lists][::-1])[::-1], 0)
    score, least, i = np.zeros(docs, dtype=np.int64), 0, 0
    while i < len(lists) and rest[i] >= max(1, least):  # unseen documents may still be among the best
        weight, postings = lists[i]
        postings.unpack(np.arange(len(postings.open)))
        score[postings.docs] += weight * postings.impacts
        if docs >= k:
            least = int(np.partition(score, docs - k)[docs - k])
        i += 1
    met = np.flatnonzero((score > 0) & (score + rest[i] >= least))
    for (weight, postings), later in zip(lists[i:], rest[i + 1 :], strict=True):
        block = np.searchsorted(postings.last, met)
        inside = block < len(postings.last)
        most = np.zeros(len(met), dtype=np.int64)
        most[inside] = weight * postings.bounds[block[inside]]
        alive = score[met] + most + later >= least
        met, block, inside = met[alive], block[alive], inside[alive]
        looked, block = met[inside], block[inside]
        needed = np.unique(block)
        postings.unpack(needed)
        if len(needed):
            sizes = np.minimum(BLOCK, len(postings.docs) - needed * BLOCK)
            at = np.cumsum(sizes) - sizes
            slots = np.repeat(needed * BLOCK - at, sizes) + np.arange(int(sizes.sum()))
            docs_in = postings.docs[slots]
            found = np.minimum(np.searchsorted(docs_in, looked), len(docs_in) - 1)
            same = docs_in[found] == looked
            score[looked[same]] += weight * postings.impacts[slots[found[same]]]
        if len(met) >= k:
            least = max(least, int(np.partition(score[met], len(met) - k)[len(met) - k]))
        met = met[score[met] + later >= least]
    order = np.lexsort((met, -score[met]))[:k]
    met = met[order]
    return met, score[met]


def query_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, id, term)``: distinct terms of every distinct (key, text); null texts have none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = items.select(F.col(key).alias("id"), F.col(text).alias("said")).distinct()
    terms = F.array_distinct(F.regexp_extract_all(F.translate("said", upper, lower), F.lit(TERM), F.lit(0)))
    return rows.select(F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("said")), 256).alias("item"), "id", F.explode(terms).alias("term"))


def search(index: DataFrame, items: DataFrame, k: int = TOP, key: str = "item_id", text: str = "text", pairs: int = QUERY_PAIRS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best rows of the index for every item, equal scores by ascending id, null ids first.

    ``index`` is a stored index. Items without terms, or whose terms no
    document holds, have no rows; repeated items count once, and items of
    equal id but other text are ranked apart. Items go to the tasks in blocks
    of about ``pairs`` terms, so what a task is given has a fixed size.
    """
    spark = index.sparkSession
    asked = materialize(query_terms(items, key, text), "search-terms")
    blocks = 1 + asked.count() // pairs
    size = index.where(F.col("term").isNull()).agg(F.sum("held").alias("docs"), F.sum("words").alias("words")).first()
    docs, words = size["docs"] or 0, size["words"] or 0
    kind = asked.schema["id"].dataType
    found = spark.createDataFrame([], f"item string, id {kind.simpleString()}, doc_id bigint, score bigint")
    for block in range(blocks if docs else 0):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        terms = F.broadcast(own.select("term").distinct())  # at most about ``pairs`` short rows
        frequency = index.join(terms, "term").groupBy("term").agg(F.sum("held").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2 * docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
        weighted = own.join(frequency, "term").select("item", "term", weight.alias("weight")).collect()
        if not weighted:
            continue
        wanted = index.join(terms, "term", "left_semi").unionByName(index.where(F.col("term").isNull()))
        hits = wanted.groupBy("shard").applyInArrow(_searcher(weighted, docs, words, k), "item string, doc_id bigint, score bigint")
        found = found.unionByName(hits.join(F.broadcast(own.select("item", "id").distinct()), "item"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias(key), "rank", "doc_id", "score")


def _searcher(weighted: list, docs: int, words: int, k: int):
    """The function that searches one shard for all items of a block."""
    queries: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for r in weighted:
        queries[r["item"]].append((r["term"], r["weight"]))
    queries = dict(queries)

    def run(table: pa.Table) -> pa.Table:
        alone = table.filter(pc.is_null(table.column("term")))
        ids = alone.column("ids")[0].as_py()
        norm_of = lambda n: 50 + (50 * n * docs) // words
        norms = norm_of(np.frombuffer(alone.column("data")[0].as_py(), dtype=np.int64))
        rows = table.filter(pc.is_valid(table.column("term"))).select(["term", "heads", "data", "held"]).to_pydict()
        lists = {t: _List(h, d, n, norms, norm_of) for t, h, d, n in zip(*rows.values(), strict=True)}
        out: tuple[list, list, list] = ([], [], [])
        for item, terms in queries.items():
            own = [(w, lists[t]) for t, w in terms if t in lists]
            if own:
                places, scores = best(own, len(ids), k)
                out[0].extend([item] * len(places))
                out[1].extend(ids[p] for p in places)
                out[2].extend(scores.tolist())
        return pa.table({"item": pa.array(out[0], pa.string()), "doc_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    return run
