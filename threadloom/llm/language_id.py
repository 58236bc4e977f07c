"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its hashed byte trigrams inside
words. Each language has several centroids, found by spherical k-means on its
learning texts, and a text takes the language of the centroid of the highest
cosine. A text farther from it than nearly all learning texts is marked as
rejected.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.text import crc_fold, per_batch, picked, small_batches

BINS = 4096
#: Learning rows that centroids are clustered from, about, dealt evenly to the languages, and the least share of one language.
TRAIN_ROWS, LEAST_ROWS = 4_000, 20
CENTROIDS = 4
#: Share of a language's learning texts that its distance limit lets in.
WITHIN = 0.995
_LETTER = regex.compile(r"\p{L}")
_LETTERS_ONLY = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed trigrams of ``" word "`` for all words of a text."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS_ONLY).split()) + b" "
    a = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(BINS)
    mixed = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA6B)) ^ (a[2:] * np.uint32(0xC2B2AE35))
    return np.bincount((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(20), minlength=BINS).astype(float)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and rows that hold each bin; a task sends at most ``BINS`` sums."""

    def run(batches):
        import pyarrow as pa

        held, n = np.zeros(BINS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                held += trigram_counts(text or "") > 0
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"bin": pa.array([-1, *at.tolist()], pa.int32()), "n": pa.array([n, *held[at].tolist()], pa.int64())})

    small_batches(docs.sparkSession)
    sums = docs.select("text").mapInArrow(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    held, rows = np.zeros(BINS), 0
    for b, n in sums:
        if b < 0:
            rows = n
        else:
            held[b] = n
    return rows, held


def _cluster(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; fewer rows than k give fewer centroids."""
    start = [int(rng.integers(len(rows)))]
    while len(start) < min(k, len(rows)):
        near = (rows @ rows[start].T).max(axis=1)
        start.append(int(np.argmin(near)))
    centres = rows[start]
    for _ in range(15):
        own = (rows @ centres.T).argmax(axis=1)
        centres = _unit(np.stack([rows[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))]))
    return centres


def fit(docs: DataFrame, folds: int = 5, held: int = 0, rows: int = TRAIN_ROWS, centroids: int = CENTROIDS, seed: int = 1) -> dict:
    """A model from text and non-null lang of rows outside the held-out fold of crc32(doc_id).

    Document frequencies come from all these rows, centroids from about
    ``rows`` of them, picked by hash and dealt evenly to the languages: a
    language of few rows is learned from all of them. Rows without doc_id
    aren't learned from; repeated rows count as often as they stand there.
    Without learning rows, an empty table among them, no language is learned.
    """
    own = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (own != held)).select("doc_id", "text", "lang")
    n, df = document_frequencies(known)
    if not n:
        return {"langs": [], "centres": np.zeros((0, BINS)), "owner": np.zeros(0, dtype=int), "limits": np.zeros(0), "idf": np.zeros(BINS)}
    idf = np.log((1 + n) / (1 + df))

    def make():
        def work(batch):
            vectors = [_unit(trigram_counts(t) * idf).astype(np.float32).tobytes() for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "lang": batch["lang"], "v": vectors}

        return work

    held_by = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = max(LEAST_ROWS, rows // len(held_by))
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in held_by.items() for x in (lang, min(1.0, each / n)))), F.col("lang"))
    table = per_batch(known.where(picked(F.col("doc_id"), "language", share)), make, "doc_id bigint, lang string, v binary").toPandas().sort_values(["doc_id", "lang"], kind="stable")
    rng, langs, centres, owner, limits = np.random.default_rng(seed), sorted(table["lang"].unique()), [], [], []
    for i, lang in enumerate(langs):
        own_rows = np.stack([np.frombuffer(v, dtype=np.float32) for v in table["v"][table["lang"] == lang]])
        found = _cluster(own_rows, centroids, rng)
        limits.append(float(np.quantile(1 - (own_rows @ found.T).max(axis=1), WITHIN)))
        centres.append(found)
        owner += [i] * len(found)
    return {"langs": langs, "centres": np.concatenate(centres).astype(np.float32), "owner": np.array(owner), "limits": np.array(limits), "idf": idf.astype(np.float32)}


def predict(docs: DataFrame, model: dict, folds: int = 5, held: int = 0) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, distance, rejected)`` of every row.

    ``lang_pred`` is a learned language, or ``und`` for a null text, a text
    without a letter (Unicode category L), and when nothing was learned. ``score`` is the cosine to
    the nearest centroid; ``rejected`` says that the text is farther from its
    language than nearly all learning texts. A null doc_id is not held out;
    repeated rows get equal results, an empty table none.
    """
    names = ["held_out", "lang_pred", "score", "distance", "rejected"]

    def make():
        centres, owner, limits, idf = (model[k] for k in ("centres", "owner", "limits", "idf"))

        def one(key, text):
            out = crc_fold(key, folds) == held
            if not text or not len(owner) or not _LETTER.search(text):
                return out, "und", 0.0, 1.0, True
            cosines = centres @ _unit(trigram_counts(text) * idf).astype(np.float32)
            best = int(cosines.argmax())
            cosine = min(1.0, max(0.0, float(cosines[best])))
            lang = int(owner[best])
            return out, model["langs"][lang], cosine, 1 - cosine, bool(1 - cosine > limits[lang])

        def work(batch):
            rows = [one(k, t) for k, t in zip(batch["doc_id"], batch["text"], strict=True)]
            return {"doc_id": batch["doc_id"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return work

    schema = "doc_id bigint, held_out boolean, lang_pred string, score double, distance double, rejected boolean"
    return per_batch(docs.select("doc_id", "text"), make, schema)
