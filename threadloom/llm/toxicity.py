"""Toxicity by noisy-channel deobfuscation.

A character language model is counted over the words of all documents. A
token that looks written to hide (digits or signs among letters, stretched
letters) and a run of single characters set apart become a lattice of what
each character may stand for; in a run, each space may be nothing or the edge
of a word. The Viterbi path of the lowest cost under channel and language
model gives the restored words, in time linear in the token or run, however
long. Texts are scored on restored words by a logistic regression over words
and word beginnings.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.quality_rules import labelled_sample
from threadloom.llm.text import crc_fold, per_batch, release, small_batches, trimmed

#: Labelled rows that weights are fitted on, about; the language model covers all documents.
TRAIN_ROWS = 20_000
#: Features kept, and the least number of toxic rows that hold one.
FEATURES, LEAST = 4_000, 6
THRESHOLD = 0.3
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëíîïñóôöùúûü"
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}  # 0 is the edge of a word, the last code any other letter
_OTHER = len(_LETTERS) + 1
_SIZE = _OTHER + 1
#: What signs stand for in obfuscated writing.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e"}
_DROPPED = "*.-_~'`^"
_EDGE = "\"'()[]{}<>,.;:?!#*%&|$~`_-…"
_SOFT = "".join(c for c in _EDGE if c not in SIGNS)  # ends of a token that stand for no letter
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_SHAPE = str.maketrans({c: "a" for c in _LETTERS} | {c: "1" for c in [*SIGNS, *_DROPPED]})
#: Costs of a word's edge between characters set apart, one for each reading.
EDGES = (0.0, -2.0)
_MEMO = 100_000
#: Length of tokens that may be parts of a word with a space inside.
_SHORT = 5


def _codes(text: str) -> np.ndarray:
    """Codes of a lower-cased text; whatever is no letter is an edge."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return _POINT[np.minimum(points, len(_POINT) - 1)]


_POINT = np.array([_CODE.get(chr(i), _OTHER if chr(i).isalpha() else 0) for i in range(0x250)] + [_OTHER], dtype=np.int64)


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Character trigram counts over all texts, edges included; a task sends sums, never texts."""

    def run(batches):
        import pyarrow as pa

        sums = np.zeros(_SIZE**3, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    c = np.concatenate([[0], _codes(text.lower()), [0]])
                    c = c[(c != 0) | (np.roll(c, 1) != 0)]  # one edge between words
                    c = np.repeat(c, np.where(c == 0, 2, 1))  # two edges: the first letters have contexts too
                    sums += np.bincount((c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:], minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(at, pa.int32()), "n": pa.array(sums[at], pa.int64())})

    out = np.zeros(_SIZE**3)
    small_batches(docs.sparkSession)
    for gram, n in docs.select("text").mapInArrow(trimmed(run), "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[gram] = n
    return out


def language_model(counts: np.ndarray, words: dict[str, int], share: float = 0.2) -> np.ndarray:
    """Cost (negative log probability) of each character after each two; words of toxic rows make up ``share`` of the mass."""
    extra = np.zeros(_SIZE**3)
    for word, n in words.items():
        c = [0, 0, *_codes(word).tolist(), 0]
        for i in range(len(c) - 2):
            extra[(c[i] * _SIZE + c[i + 1]) * _SIZE + c[i + 2]] += n
    if extra.sum():
        counts = counts + extra * (share / (1 - share) * max(1.0, counts.sum()) / extra.sum())
    cube = counts.reshape(_SIZE, _SIZE, _SIZE)
    pairs = cube.sum(axis=0)
    unigram = (pairs.sum(axis=0) + 1) / (pairs.sum() + _SIZE)
    bigram = (pairs + 2 * unigram) / (pairs.sum(axis=1, keepdims=True) + 2)
    return -np.log((cube + 4 * bigram[None]) / (cube.sum(axis=2, keepdims=True) + 4)).reshape(-1)


#: What stands neither for a letter nor for nothing; it parts a token and ends a run.
_FOREIGN = re.compile("[^" + re.escape("".join(SIGNS) + _DROPPED) + r"\w]+|_{2,}")
# Letters of other scripts by the Latin ones they look like; characters without width; marks set on letters.
_LOOK = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
_NO_WIDTH = ["\u00ad", "\u180e", *map(chr, range(0x200B, 0x2010)), *map(chr, range(0x2060, 0x2065)), "\ufeff", *map(chr, range(0x300, 0x370))]
_ALIKE = str.maketrans(_LOOK | dict.fromkeys(_NO_WIDTH))
_ODD = re.compile("[" + "".join(_LOOK) + "\u00ad\u180e\u200b-\u200f\u2060-\u2064\ufeff\u0300-\u036f\uff01-\uff5e]")


def _mixed(token: str) -> bool:
    """Letters and signs, nothing else, and not too few letters."""
    shape = token.translate(_SHAPE)
    letters, signs = shape.count("a"), shape.count("1")
    return letters > 0 and letters + signs == len(token) and letters * 2 >= signs


def looks_hidden(token: str) -> bool:
    """A token worth decoding: letters mixed with signs, or a letter three times in a row."""
    if len(token) < 3 or token.isdigit():
        return False
    return not token.isalpha() and _mixed(token) or _STRETCHED.search(token) is not None


@lru_cache(maxsize=4096)
def _options(c: str, n: int) -> tuple[tuple[str, float], ...]:
    """What ``n`` (three for more) equal characters may stand for, with the channel's costs."""
    out: list[tuple[str, float]] = []
    if c in _CODE or c.isalpha():
        out = [(c, 0.0)] if n == 1 else [(c, 0.7), (c + c, 0.0 if n == 2 else 0.7)]
    for s in SIGNS.get(c, ""):
        out += [(s, 0.5)] if n == 1 else [(s, 1.0), (s + s, 0.5 if n == 2 else 1.0)]
    if c in _DROPPED:
        out.append(("", 0.2))
    if c in "!|":
        out.append(("", 2.0))
    return tuple(out) or (("", 1.0),)


def lattice(token: str, spaced: bool = False, edge: float = 0.0) -> list[tuple[tuple[str, float], ...]]:
    """Options of each place of a token, or of a run of characters set apart (``spaced``), where a space in an option is the edge of a word, at the cost ``edge``."""
    if not spaced:
        return [_options(c, min(3, sum(1 for _ in same))) for c, same in groupby(token)]
    out = []
    for i, c in enumerate(token):
        here = _options(c, 1)
        if i and c == token[i - 1]:
            here += (("", 0.7),)
        if i + 1 < len(token):
            here += tuple((o + " ", p + edge) for o, p in here if o)
        out.append(here)
    return out


def path_cost(text: str, cost) -> float:
    """Cost of restored words under the language model; a space is an edge, which counts twice."""
    x = y = 0
    total = 0.0
    for o in text.replace(" ", "  ") + " ":
        z = 0 if o == " " else _CODE.get(o, _OTHER)
        total += cost[(x * _SIZE + y) * _SIZE + z]
        x, y = y, z
    return total


def restore(token: str, cost, spaced: bool = False, edge: float = 0.0) -> str:
    """The likeliest words behind a token or a spaced run, by Viterbi over its character lattice; words are parted by spaces."""
    states: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}
    for options in lattice(token, spaced, edge):
        nxt: dict[tuple[int, int], tuple] = {}
        for (a, b), here in states.items():
            for out, channel in options:
                x, y, total = a, b, here[0] + channel
                for o in out:
                    z = _CODE.get(o, _OTHER) if o != " " else 0
                    total += cost[(x * _SIZE + y) * _SIZE + z]
                    x, y = y, z
                    if o == " ":
                        total += cost[(x * _SIZE + y) * _SIZE]
                        x, y = y, 0
                known = nxt.get((x, y))
                if known is None or total < known[0]:
                    nxt[x, y] = (total, (out, here[1]))
        states = nxt
    ends = [(total + cost[(a * _SIZE + b) * _SIZE], (a, b)) for (a, b), (total, _) in states.items()]
    link = states[min(ends)[1]][1]
    out = []
    while link:
        out.append(link[0])
        link = link[1]
    return "".join(reversed(out))


def fold_alikes(text: str) -> str:
    """Letters of other scripts that look like Latin ones, wide forms, marks set on letters and characters of no width, put right; most texts have none."""
    return unicodedata.normalize("NFKC", text.translate(_ALIKE)) if _ODD.search(text) else text


def tokens_of(text: str) -> tuple[list[str], list[str]]:
    """Lower-cased tokens, and runs of three or more single characters, each run as one string.

    A character that stands for no letter cuts a run; signs that may be dropped
    are taken off its ends.
    """
    tokens = fold_alikes(text.lower()).split()
    single = [i for i, t in enumerate(tokens) if len(t) == 1]
    runs, taken, first = [], [], 0
    for k in range(1, len(single) + 1):
        if k == len(single) or single[k] != single[k - 1] + 1:
            if k - first >= 3:
                found = [r for part in _FOREIGN.split("".join([tokens[i] for i in single[first:k]])) if len(r := part.strip(_DROPPED + "!|")) >= 3 and _mixed(r)]
                if found:
                    runs += found
                    taken.append((single[first], single[k - 1] + 1))
            first = k
    for a, b in reversed(taken):
        del tokens[a:b]
    return tokens, runs


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6, 7) if len(word) > k)]


class Reader:
    """Turns texts into features, restored words included; a bounded memo of tokens lives in the reader."""

    def __init__(self, cost: np.ndarray | None, wanted: dict[str, int] | None = None):
        self.cost, self.wanted, self.memo = None if cost is None else cost.tolist(), wanted, {}

    def _features(self, words: set[str]) -> tuple:
        found = (f for w in words if w for f in word_features(w))
        return tuple(found) if self.wanted is None else tuple({self.wanted[f] for f in found if f in self.wanted})

    def token(self, token: str) -> tuple:
        """Features of a token, of what it may hide, and of its parts between signs that stand for no letter."""
        parts = [token, *_FOREIGN.split(token)] if _FOREIGN.search(token) else [token]
        forms = set()
        for part in parts:
            plain = part.strip(_EDGE)
            forms.add(plain)
            if self.cost is not None:
                core = part.strip(_SOFT)
                for t in (plain,) if core == plain else (core, plain):
                    if looks_hidden(t):
                        forms.add(restore(t, self.cost))
        return self._features(forms)

    def pair(self, a: str, b: str) -> tuple:
        """Features of two short tokens as one word, where that is a known one and likelier than two: the space between them is nothing or an edge."""
        word = a.strip(_EDGE) + b.strip(_EDGE)
        if word not in self.wanted or not word.isalpha() or path_cost(word, self.cost) > path_cost(f"{a} {b}", self.cost):
            return ()
        return self._features({word})

    def run(self, run: str) -> tuple:
        """A run is read twice, with edges free and with edges favoured, for words of one letter; the words of both readings count."""
        return self._features({run} if self.cost is None else {w for edge in EDGES for w in restore(run, self.cost, True, edge).split(" ")})

    def text(self, text: str | None) -> set:
        memo, out = self.memo, set()
        if len(memo) > _MEMO:
            memo.clear()
        tokens, runs = tokens_of(text or "")
        if self.cost is not None and self.wanted is not None:
            short = [len(t) <= _SHORT for t in tokens]
            for a, b in {(tokens[i], tokens[i + 1]) for i in range(len(tokens) - 1) if short[i] and short[i + 1]}:
                out.update(self.pair(a, b))
        for t in set(tokens):
            found = memo.get(t)
            if found is None:
                found = memo[t] = self.token(t)
            if found:
                out.update(found)
        for r in runs:
            out.update(self.run(r))
        return out


def _feature_counts(rows: DataFrame, cost: np.ndarray | None, wanted: set[str] | None) -> DataFrame:
    """``(feature, y, n)``: rows that hold a feature; toxic rows only, unless features are named."""

    def run(batches):
        import pyarrow as pa

        reader, sums = Reader(cost), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = reader.text(text)
                sums.update((f, y) for f in (found if wanted is None else found & wanted))
        keys = list(sums)
        yield pa.RecordBatch.from_pydict({"feature": pa.array([k[0] for k in keys], pa.string()), "y": pa.array([k[1] for k in keys], pa.int32()), "n": pa.array([sums[k] for k in keys], pa.int64())})

    small_batches(rows.sparkSession)
    return rows.select("text", "y").mapInArrow(trimmed(run), "feature string, y int, n bigint").groupBy("feature", "y").agg(F.sum("n").alias("n"))


def _regress(rows: list[list[int]], y: np.ndarray, size: int, steps: int = 400, ridge: float = 2e-4) -> np.ndarray:
    """Weights of a logistic regression, the bias last."""
    lengths = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), lengths)
    col = np.fromiter((c for r in rows for c in r), dtype=np.int64, count=int(lengths.sum()))
    w, speed = np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(rows)) + w[-1], -30, 30)))
        error = p - y
        grad = np.append(np.bincount(col, error[row], size), error.sum()) / len(rows) + ridge * np.append(w[:-1], 0)
        speed = 0.9 * speed - 6.0 * grad
        w = w + speed
    return w


def fit(docs: DataFrame, labels: DataFrame, folds: int | None = 4, held: int | None = 2, rows: int = TRAIN_ROWS) -> dict:
    """A model from all texts (language model) and labelled rows outside the held-out fold (weights).

    To the driver come trigram sums, at most ``FEATURES`` features, and the
    numbers of the features that each of about ``rows`` labelled rows holds.
    Without labels of both classes every score is the share of toxic labels.
    """
    good = labels.where(F.col("doc_id").isNotNull())
    if folds is not None:
        good = good.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) != held)
    chosen = F.broadcast(labelled_sample(good, "toxic", rows))  # bounded by `rows` keys
    known = docs.select("doc_id", "text").join(chosen, "doc_id")
    size = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    counts = count_trigrams(docs)
    share = toxic / max(1, toxic + clean)
    if not toxic or not clean:
        return {"cost": language_model(counts, {}), "features": {}, "weights": np.array([math.log((share + 1e-3) / (1 - share + 1e-3))])}

    def best(frame: DataFrame, most: int) -> list:
        return frame.orderBy(F.desc("n"), "feature").limit(most).collect()

    def select(cost: np.ndarray | None) -> dict[str, tuple[int, int]]:
        frequent = _feature_counts(known.where("y = 1"), cost, None).where(F.col("n") >= LEAST)
        positive = {r["feature"]: r["n"] for r in best(frequent, 10 * FEATURES)}
        negative = {r["feature"]: r["n"] for r in _feature_counts(known.where("y = 0"), cost, set(positive)).collect()}
        held_by = {f: (p, negative.get(f, 0)) for f, p in positive.items()}
        lift = {f: math.log(((p + 0.5) / toxic) / ((n + 0.5) / clean)) for f, (p, n) in held_by.items()}
        order = sorted((f for f in held_by if lift[f] > 1.2), key=lambda f: (-lift[f] * math.sqrt(held_by[f][0]), f))
        return {f: held_by[f] for f in order[:FEATURES]}

    plain = select(None)
    lexicon = {f: p for f, (p, n) in plain.items() if not f.endswith("*") and p >= 8 * max(n, 1)}
    cost = language_model(counts, lexicon)
    features = {f: i for i, f in enumerate(plain)}

    def make():
        reader = Reader(cost, features)

        def work(batch):
            return {"doc_id": batch["doc_id"], "y": batch["y"], "held": [sorted(reader.text(t)) for t in batch["text"]]}

        return work

    table = sorted(per_batch(known, make, "doc_id bigint, y int, held array<int>").collect(), key=lambda r: (r["doc_id"], r["y"], r["held"]))
    weights = _regress([r["held"] for r in table], np.array([r["y"] for r in table], dtype=float), len(features))
    return {"cost": cost, "features": features, "weights": weights}


class Scorer:
    def __init__(self, model: dict):
        self.reader, self.weights = Reader(model["cost"], model["features"]), model["weights"]

    def score(self, text: str | None) -> float:
        found = list(self.reader.text(text))
        logit = float(self.weights[-1]) + (float(self.weights[found].sum()) if found else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def without_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; one map, all columns kept."""
    names, schema = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    release()  # what fitting held on the driver

    def make():
        scorer = Scorer(model)

        def work(batch):
            clean = [i for i, t in enumerate(batch["text"]) if scorer.score(t) < threshold]
            return {n: [batch[n][i] for i in clean] for n in names}

        return work

    return per_batch(docs, make, schema)


def score(docs: DataFrame, model: dict, folds: int = 4, held: int = 2) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row.

    Null and empty texts get the score of a text without features. Repeated
    rows get equal scores, whatever repeated or contrary labels they have (in
    ``fit`` a doc_id counts once for each distinct label); a null doc_id is
    not held out. An empty table gives no rows.
    """

    def make():
        scorer = Scorer(model)

        def work(batch):
            scores = [scorer.score(t) for t in batch["text"]]
            return {
                "doc_id": batch["doc_id"],
                "held_out": [crc_fold(k, folds) == held for k in batch["doc_id"]],
                "score": scores,
                "predicted": [int(s >= THRESHOLD) for s in scores],
            }

        return work

    return per_batch(docs.select("doc_id", "text"), make, "doc_id bigint, held_out boolean, score double, predicted int")
