"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages. The TF-IDF matrix of the passages is
factored by a randomised SVD whose products are computed where the rows are;
the inverse document frequencies come from all documents. Windows of every
document are projected to the latent space, and a window whose cosine to a
passage comes near the cosine it would have if it contained the passage is a
candidate. A term brings a passage no nearer than the passage that it brings
nearest, so windows whose terms fall short by these bounds are left before
they are projected; no candidate is lost. Beside it stands an exact gate: a passage that shares the longest
common subsequence that is enough alone must share a counted number of its
rarest words, so windows with that many are candidates whatever their cosine.
Candidates are verified on the words: by the longest common subsequence with
the passage, and for looser ones also by its answer, the last words of the
passage.

The benchmark is the query set. It is read in groups of at most ``GROUP``
passages, whole items each; a group is what the driver holds and what is
broadcast, so both have a fixed bound, and it costs two scans of the
documents: one for the frequencies of its words, one for the search. Inside a
group every block of ``BLOCK`` passages has a factorisation of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.license_scan import words_of
from threadloom.llm.text import per_batch, release, small_batches, trimmed
from threadloom.storage import materialize

BLOCK, GROUP, OVERSAMPLE = 512, 4096, 10
#: Share of the squared singular values that the latent space keeps; a fixed low rank loses passages of unlike words.
ENERGY = 0.99
PASSAGE = 96
#: Window lengths by passage length: (longest passage, window); windows begin every quarter of a window.
SCALES = ((24, 32), (48, 64), (96, 128))
#: Share of the cosine of an exact inclusion that makes a candidate.
NEAR = 0.4
#: Common subsequence over passage length: enough alone, and enough if the answer is there too.
SAME, LOOSE = 0.8, 0.6
#: Terms in more than this share of documents carry no weight, except in passages of few other terms.
COMMON, AT_LEAST = 0.02, 8
#: Passages of fewer words have no terms to tell them by; they are sought word by word.
FEW = 8
#: Share of a passage's words, the rarest, that the exact gate looks for.
RAREST = 0.4
_STEP, _PIECES = 16_384, 8
#: Rows of the term table that are summed at a time, and what the bounds of windows may lack to rounding.
_ROWS, _SLACK = 8192, 1e-3


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence of two word lists, bit-parallel."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if m := masks.get(w):
            hit = row & m
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def judge(passage: list[bytes], region: list[bytes]) -> tuple[float, float]:
    """Common subsequence shares of a passage and of its answer with a region of words."""
    answer = passage[-max(3, len(passage) // 5) :]
    return lcs(passage, region) / len(passage), lcs(answer, region) / len(answer)


def passages_of(items: list[tuple[int, str | None]]) -> list[tuple[int, list[bytes]]]:
    """``(item_id, words)`` of pieces of at most ``PASSAGE`` words; the last piece of a longer item reaches back to full length."""
    out = []
    for item, text in items:
        words = words_of(text)
        for i in range(0, len(words), PASSAGE):
            i = max(0, min(i, len(words) - PASSAGE))
            out.append((item, words[i : i + PASSAGE]))
    return out


def _document_frequencies(docs: DataFrame, terms: dict[bytes, int]) -> tuple[int, np.ndarray]:
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches):
        import pyarrow as pa

        wanted, sums, n = shared.value, {}, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                for w in wanted.intersection(words_of(text)):
                    sums[w] = sums.get(w, 0) + 1
        keys = list(sums)
        yield pa.RecordBatch.from_pydict({"w": pa.array([None, *keys], pa.binary()), "n": pa.array([n, *(sums[k] for k in keys)], pa.int64())})

    df, total = np.zeros(len(terms)), 0
    small_batches(docs.sparkSession)
    for w, n in docs.select("text").mapInArrow(trimmed(run), "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect():
        if w is None:
            total = n
        else:
            df[terms[bytes(w)]] = n
    return total, df


def _weights(block: list[tuple[int, list[bytes]]], terms: dict[bytes, int], n: int, df: np.ndarray) -> np.ndarray:
    idf = np.log1p(n / (1 + df))
    keep = df <= COMMON * n
    for _, words in block:
        own = sorted({terms[w] for w in words}, key=lambda t: (df[t], t))
        keep[own[:AT_LEAST]] = True
    return np.where(keep, idf, 0.0)


def randomised_svd(rows: DataFrame, terms: int, rank: int, energy: float = 1.0, seed: int = 3, rounds: int = 2) -> np.ndarray:
    """Right singular vectors of a sparse matrix, rows given as ``(at array<int>, value array<double>)``: the fewest, up to ``rank``, that hold the share ``energy`` of its squares.

    A task multiplies its rows and sends one partial product of terms x rank
    numbers in pieces; the rows stay where they are (Halko, Martinsson and Tropp, 2011).
    """
    width = min(rank + OVERSAMPLE, terms)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]

    def product(basis: np.ndarray, last: bool) -> np.ndarray:
        shared = rows.sparkSession.sparkContext.broadcast(basis)

        def run(batches):
            import pyarrow as pa

            q = shared.value
            out = np.zeros((q.shape[1] if last else q.shape[0], q.shape[1]))
            for batch in batches:
                for at, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    y = np.asarray(value) @ q[at]
                    if last:
                        out += np.outer(y, y)
                    else:
                        np.add.at(out, at, np.outer(value, y))
            pieces = np.array_split(out, _PIECES)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(range(_PIECES), pa.int32()), "m": pa.array([p.tobytes() for p in pieces], pa.binary())})

        def add(batches):
            import pyarrow as pa

            sums: dict = {}
            for batch in batches:
                for piece, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sums[piece] = sums.get(piece, 0) + np.frombuffer(m)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(list(sums), pa.int32()), "m": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

        # pieces of the partial products are added in tasks: the driver gets the product once
        parts = rows.mapInArrow(trimmed(run), "piece int, m binary").repartition(_PIECES, "piece").mapInArrow(trimmed(add), "piece int, m binary").collect()
        size = basis.shape[1] if last else terms
        return np.concatenate([np.frombuffer(bytes(p["m"])).reshape(-1, basis.shape[1]) for p in sorted(parts, key=lambda p: p["piece"])])[:size] if parts else np.zeros((size, basis.shape[1]))

    for _ in range(rounds):
        basis = np.linalg.qr(product(basis, False))[0]
    values, turn = np.linalg.eigh(product(basis, True))
    order = np.argsort(values)[::-1][:rank]
    order = order[values[order] > 1e-9 * max(1e-30, values.max())]
    held = np.cumsum(values[order])
    order = order[: int(np.searchsorted(held, energy * held[-1] - 1e-9)) + 1] if len(order) else order
    return basis @ turn[:, order]


def _model(spark, block: list[tuple[int, list[bytes]]], terms: dict[bytes, int], n: int, df: np.ndarray, partitions: int = 8) -> dict:
    """Latent space, passages and terms of one block; the rows of its matrix are made, and multiplied, in tasks."""
    own = sorted({w for _, words in block for w in words})
    weight = _weights(block, {w: i for i, w in enumerate(own)}, n, df[[terms[w] for w in own]])
    place = {w: i for i, w in enumerate(own)}
    shared = spark.sparkContext.broadcast((block, place, weight))

    def vector(words, place, weight):
        at, tf = np.unique([place[w] for w in words], return_counts=True)
        return at, tf * weight[at]

    def rows_of(batches):
        import pyarrow as pa

        block, place, weight = shared.value
        for batch in batches:
            made = [vector(block[i][1], place, weight) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"at": pa.array([a.tolist() for a, _ in made], pa.list_(pa.int32())), "value": pa.array([v.tolist() for _, v in made], pa.list_(pa.float64()))})

    # written once: two Python steps in one task take two workers a core, which stay for all later stages
    rows = materialize(spark.range(0, len(block), 1, partitions).mapInArrow(trimmed(rows_of), "at array<int>, value array<double>"), "passages")
    vectors = randomised_svd(rows, len(own), len(block), ENERGY)
    latent = np.stack([v @ vectors[a] for a, v in (vector(words, place, weight) for _, words in block)])
    table = (vectors * weight[:, None]).astype(np.float32)
    # latent passages over their squared length: times a window's latent vector, the cosine over that of an exact inclusion
    queries = (latent / np.maximum((latent**2).sum(axis=1, keepdims=True), 1e-12)).astype(np.float32)
    scale = np.array([next(i for i, (most, _) in enumerate(SCALES) if len(words) <= most) for _, words in block])
    return {
        "passages": block,
        "terms": {w: t for w, t in place.items() if weight[t] > 0},
        "table": table,
        "queries": queries,
        "scale": scale,
        "nearest": nearest_of(table, queries, scale),
    }


def nearest_of(table: np.ndarray, queries: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """What a term adds to the nearness of the passage that it brings nearest, by scale and term; 0 at least."""
    out = np.zeros((len(SCALES), len(table)))
    for i in range(len(SCALES)):
        if len(own := queries[scale == i]):
            for first in range(0, len(table), _ROWS):
                out[i, first : first + _ROWS] = np.maximum((table[first : first + _ROWS] @ own.T).max(axis=1), 0)
    return out


def _places(local: np.ndarray, known: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A part's own numbers of a text's words, and where they stand."""
    ids = local[known]
    own = np.flatnonzero(ids >= 0)
    return ids[own], at[own]


class Search:
    """Finds the leaks of one block of passages in a text.

    ``number`` has the words of the group; a text comes as its words, the
    numbers of those that the group has, and their places.
    """

    def __init__(self, model: dict, number: dict[bytes, int]):
        self.model = model
        self.by_scale = [(window, np.flatnonzero(model["scale"] == i), model["nearest"][i]) for i, (_, window) in enumerate(SCALES)]
        self.local = np.full(len(number), -1, dtype=np.int64)
        self.local[[number[w] for w in model["terms"]]] = list(model["terms"].values())

    def _candidates(self, count: int, ids: np.ndarray, hits: np.ndarray):
        """``(passage, window start, window, nearness)`` of all windows near a passage, in a text of ``count`` words."""
        m = self.model
        if len(hits) < 2:
            return
        for first in range(0, count, _STEP):
            lo, hi = np.searchsorted(hits, [first, first + _STEP + SCALES[-1][1]])
            at, terms = hits[lo:hi], ids[lo:hi]
            if len(at) < 2:
                continue
            for window, passages, nearest in self.by_scale:
                if not len(passages):
                    continue
                starts = np.arange(first, min(first + _STEP, count), window // 4)
                a, b = np.searchsorted(at, starts), np.searchsorted(at, starts + window)
                reached = np.zeros(len(at) + 1)
                np.cumsum(nearest[terms], out=reached[1:])
                some = np.flatnonzero((b - a >= 2) & (reached[b] - reached[a] >= NEAR - _SLACK))
                if not len(some):
                    continue
                starts, a, b, queries = starts[some], a[some], b[some], m["queries"][passages]
                most = _ROWS // window
                for k in range(0, len(starts), most):
                    size = (b - a)[k : k + most]
                    begins = np.cumsum(size) - size
                    rows = np.repeat(a[k : k + most] - begins, size) + np.arange(int(size.sum()))
                    sums = np.add.reduceat(m["table"][terms[rows]], begins, axis=0, dtype=np.float64)
                    near = sums.astype(np.float32) @ queries.T
                    for i, j in np.argwhere(near >= NEAR).tolist():
                        yield int(passages[j]), int(starts[k + i]), window, float(near[i, j])

    def leaks(self, words: list[bytes], known: np.ndarray, at: np.ndarray) -> list[tuple[int, float, float, bool]]:
        """``(item_id, nearness, common share, answer found)`` of each item that the text leaks, its best passage."""
        best, tried = {}, set()
        for p, start, window, near in self._candidates(len(words), *_places(self.local, known, at)):
            item, passage = self.model["passages"][p]
            place = (p, start // window)
            if place in tried and best.get(item, (0, 0))[1] >= SAME:
                continue
            tried.add(place)
            reach = len(passage) // 2
            share, answer = judge(passage, words[max(0, start - reach) : start + window + reach])
            if (share >= SAME or share >= LOOSE and answer >= SAME) and share > best.get(item, (0, 0.0))[1]:
                best[item] = (near, share, answer >= SAME)
        return [(item, *found) for item, found in best.items()]


def rarest_places(words: list[bytes], df: dict[bytes, int]) -> tuple[list[int], int]:
    """Places of a passage's rarest words, and how many of them any text holds that shares ``SAME`` of it.

    At most ``n - SAME * n`` words of the passage are missing then, so of any
    ``m`` places all but as many are met.
    """
    n = len(words)
    missing = n - int(np.ceil(SAME * n - 1e-9))
    most = min(n, max(int(np.ceil(RAREST * n)), missing + 3))
    places = sorted(sorted(range(n), key=lambda k: (df[words[k]], words[k], k))[:most])
    return places, most - missing


class OverlapSearch:
    """Finds the passages of which a text shares ``SAME``, by counts of their rarest words; no likeness decides."""

    def __init__(self, passages: list[tuple[int, list[bytes]]], chosen: list[tuple[list[int], int]], number: dict[bytes, int]):
        self.passages, postings = passages, {}
        for p, ((_, words), (places, _)) in enumerate(zip(passages, chosen, strict=True)):
            for k in places:
                postings.setdefault(words[k], []).append((p, k))
        self.local = np.full(len(number), -1, dtype=np.int64)
        self.local[[number[w] for w in postings]] = np.arange(len(postings))
        self.starts = np.cumsum([0, *map(len, postings.values())])
        flat = np.array([x for held in postings.values() for x in held], dtype=np.int64).reshape(-1, 2)
        self.owner, self.place = flat[:, 0], flat[:, 1]
        self.need = np.array([need for _, need in chosen], dtype=np.int64)
        self.reach = np.array([len(w) // 2 * 2 + next(window for most, window in SCALES if len(w) <= most) for _, w in passages], dtype=np.int64)

    def _candidates(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages, and where in the text each would begin."""
        first, size = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(size)
        flat = np.repeat(first - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
        owner, held = self.owner[flat], np.repeat(at, size)
        order = np.argsort(owner, kind="stable")
        owner, held, place = owner[order], held[order], self.place[flat[order]]
        last = np.arange(len(owner)) + self.need[owner] - 1
        inside = last < len(owner)
        last = np.minimum(last, max(0, len(owner) - 1))
        found = np.flatnonzero(inside & (owner[last] == owner) & (held[last] - held < self.reach[owner])) if len(owner) else np.zeros(0, dtype=np.int64)
        return owner[found], held[found] - place[found]

    def leaks(self, words: list[bytes], known: np.ndarray, at: np.ndarray) -> list[tuple[int, float, float, bool]]:
        """As ``Search.leaks``; nearness is the common share."""
        best, tried = {}, set()
        for p, begin in zip(*(x.tolist() for x in self._candidates(*_places(self.local, known, at))), strict=True):
            item, passage = self.passages[p]
            slack = max(1, len(passage) // 4)
            if (p, begin // slack) in tried or best.get(item, (0, 0.0))[1] == 1:
                continue
            tried.add((p, begin // slack))
            start = max(0, begin // slack * slack - slack)
            share, answer = judge(passage, words[start : start + int(self.reach[p]) + slack])
            if share >= SAME and share > best.get(item, (0, 0.0))[1]:
                best[item] = (share, share, answer >= SAME)
        return [(item, *found) for item, found in best.items()]


class ShortSearch:
    """Finds the leaks of passages of fewer than ``FEW`` words in a text.

    The common subsequence must reach ``SAME`` inside a window of the
    passage's length and a fifth of it, so up to four words must stand
    together as they are, and of five to seven one may be changed.
    """

    def __init__(self, passages: list[tuple[int, list[bytes]]], number: dict[bytes, int]):
        self.passages, self.by_word = passages, {}
        for p, (_, words) in enumerate(passages):
            for w in set(words):
                self.by_word.setdefault(number[w], []).append(p)

    def leaks(self, words: list[bytes], known: np.ndarray, at: np.ndarray) -> list[tuple[int, float, float, bool]]:
        """As ``Search.leaks``; nearness is the common share."""
        places, best = {}, {}
        for k, w in zip(at.tolist(), known.tolist(), strict=True):
            for p in self.by_word.get(w, ()):
                places.setdefault(p, []).append(k)
        for p, held in places.items():
            item, passage = self.passages[p]
            need, window = int(np.ceil(SAME * len(passage) - 1e-9)), len(passage) + len(passage) // 5
            for i in range(len(held) - need + 1):
                if held[i + need - 1] - held[i] < window:
                    share, answer = judge(passage, words[held[i] : held[i] + window])
                    if share >= SAME and share > best.get(item, (0, 0.0))[1]:
                        best[item] = (share, share, answer >= SAME)
                        if share == 1:
                            break
        return [(item, *found) for item, found in best.items()]


class GroupSearch:
    """Finds the leaks of a group: blocks of long passages by likeness and by counts, and the short ones."""

    def __init__(self, models: list[dict], chosen: list[tuple[list[int], int]], short: list[tuple[int, list[bytes]]]):
        long = [p for m in models for p in m["passages"]]
        self.number = {w: i for i, w in enumerate({w for _, words in [*long, *short] for w in words})}
        self.parts = [*(Search(m, self.number) for m in models), *([OverlapSearch(long, chosen, self.number)] if long else []), *([ShortSearch(short, self.number)] if short else [])]

    def leaks(self, text: str | None) -> list[tuple[int, float, float, bool]]:
        """As ``Search.leaks``; of an item's passages in several parts the best counts. Words are made and looked up once for all parts."""
        words, best = words_of(text), {}
        known = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        at = np.flatnonzero(known >= 0)
        known = known[at]
        for part in self.parts:
            for item, *found in part.leaks(words, known, at):
                if item not in best or found[1] > best[item][1]:
                    best[item] = found
        return [(item, *found) for item, found in best.items()]


def _groups(benchmark: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Passages in groups of whole items, ``GROUP`` at most unless one item has more; the driver holds one group at a time."""
    held: list = []
    last = None
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        made = passages_of([(row["item_id"], row["text"])])
        if held and row["item_id"] != last and len(held) + len(made) > GROUP:
            yield held
            held = []
        held, last = held + made, row["item_id"]
    if held:
        yield held


def _search_of(docs: DataFrame, passages: list[tuple[int, list[bytes]]]):
    """The broadcast models of a group; the inverse document frequencies come from one scan of all documents."""
    spark = docs.sparkSession
    long, short = [p for p in passages if len(p[1]) >= FEW], [p for p in passages if len(p[1]) < FEW]
    models, chosen = [], []
    if long:
        terms = {w: i for i, w in enumerate(sorted({w for _, words in long for w in words}))}
        n, df = _document_frequencies(docs, terms)
        models = [_model(spark, long[start : start + BLOCK], terms, n, df) for start in range(0, len(long), BLOCK)]
        held = {w: int(df[i]) for w, i in terms.items()}
        chosen = [rarest_places(words, held) for _, words in long]
    shared = spark.sparkContext.broadcast((models, chosen, short))
    del models
    release()
    return shared


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text leaks an item; a map for each group, no shuffle, all columns kept."""
    names, schema = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out, first = docs, True
    for passages in _groups(benchmark):
        out = out if first else materialize(out, "without-leaks")  # so that a task holds one group
        first = False

        def make(shared=_search_of(docs, passages)):
            search = GroupSearch(*shared.value)

            def work(batch):
                clean = [i for i, t in enumerate(batch["text"]) if not search.leaks(t)]
                return {n: [batch[n][i] for i in clean] for n in names}

            return work

        out = per_batch(out, make, schema)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, nearness, common, answer_found)``: one row for each document row and item that it leaks.

    Null and empty texts leak nothing, and items without words can't be
    leaked. Repeated documents give repeated rows; repeated items of one id
    count once. Copies of a passage in a very long text are found wherever
    they stand. An empty benchmark or an empty table gives no rows. The
    benchmark is the stated query set; the driver holds, and a task gets, one
    group of ``GROUP`` passages at a time.
    """
    schema = "doc_id bigint, item_id bigint, nearness double, common double, answer_found boolean"
    found = []
    for passages in _groups(benchmark):

        def make(shared=_search_of(docs, passages)):
            search = GroupSearch(*shared.value)

            def work(batch):
                out = {"doc_id": [], "item_id": [], "nearness": [], "common": [], "answer_found": []}
                for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                    for row in search.leaks(text):
                        for name, value in zip(out, (key, *row), strict=True):
                            out[name].append(value)
                return out

            return work

        found.append(per_batch(docs.select("doc_id", "text"), make, schema))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)
