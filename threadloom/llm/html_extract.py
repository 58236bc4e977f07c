"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

Each block is article or furniture. Its features are the tags, class words,
ids and roles of all elements around it and plain facts of its text (length,
share of links, punctuation, a few words of furniture). Two neighbours are
bound by a weight that depends on both labels and on whether they are siblings.
Weights are fitted by gradient on the exact likelihood (forward and backward
sums over both labels), and a page is labelled by Viterbi.

Learning pages are of two kinds, both bounded in number. Rows of ``pages``
whose address ends in the number of a document: a block is article if it is a
line of that document (or begins one). And layouts of common sites (``layouts``)
filled with the lines of these documents, labelled as they are made. Addresses
are no input of a prediction.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import layouts
from threadloom.llm.dom import Block, blocks
from threadloom.llm.text import per_batch, picked

#: Rows of ``pages`` that the model learns from, about. Layouts are twice as many; where pages are few, up to ``MOST_LAYOUTS`` for each.
LEARN_PAGES = 1_200
MOST_LAYOUTS = 12
#: Blocks of a learning page that count: one window of it.
WINDOW = 200
ROUNDS = 150
_DOC = r"/([0-9]+)(?:[?#].*)?$"
_WORD = re.compile(r"[^\W\d_]+")


def features(row: list[Block]) -> list[list[str]]:
    """Features of each block of a page."""
    out = []
    for i, b in enumerate(row):
        words = b.text.count(" ") + 1
        share = b.linked / len(b.text)
        own = [
            "bias",
            f"tag:{b.tag}",
            f"words:{min(8, words.bit_length())}",
            f"links:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.9 else 3}",
            f"end:{b.text[-1] in '.!?:;…。»”'}",
            f"commas:{min(3, b.text.count(','))}",
            f"digits:{sum(c.isdigit() for c in b.text[:200]) * 5 > min(200, len(b.text))}",
            *b.path,
        ]
        if "©" in b.text[:200]:
            own.append("sign:copyright")
        if i == 0:
            own.append("first")
        if i == len(row) - 1:
            own.append("last")
        if words <= 30:
            own += sorted({f"w:{w}" for w in _WORD.findall(b.text.lower())} & _FURNITURE)
        out.append(own)
    return out


_FURNITURE = frozenset(f"w:{w}" for w in layouts.WORDS)


def siblings(row: list[Block]) -> list[int]:
    """1 where a block has the same parent as the one before it."""
    return [int(i > 0 and b.place == row[i - 1].place) for i, b in enumerate(row)]


def _window(n: int, rng: random.Random) -> slice:
    start = rng.randrange(max(1, n - WINDOW + 1))
    return slice(start, start + WINDOW)


def _aligned(row: list[Block], text: str) -> list[int]:
    """1 for blocks that are a line of the text, or the first words of one."""
    lines = {" ".join(line.split()) for line in text.split("\n")}
    begins = {line[:40] for line in lines}
    return [int(b.text in lines or (len(b.text) >= 20 and b.text[:40] in begins)) for b in row]


def learning_rows(docs: DataFrame, pages: DataFrame, rows: int = LEARN_PAGES, seed: int = 3) -> DataFrame:
    """``(feats, same, labels)`` of at most about three times ``rows`` pages: real ones that tell their document, and layouts."""
    known = pages.select("page_id", "html", F.expr(rf"try_cast(regexp_extract(url, '{_DOC}', 1) as bigint)").alias("doc")).where("doc is not null and html is not null")
    n = max(1, known.count())
    sample = known.where(picked(F.col("page_id"), "html", min(1.0, rows / n)))
    each = min(MOST_LAYOUTS, max(2, 2 * rows // n))
    ids = F.broadcast(sample.select("doc").distinct())  # about ``rows`` numbers
    texts = docs.join(ids, docs["doc_id"] == ids["doc"]).select("doc", docs["text"].alias("said")).where("said is not null")
    met = sample.join(F.broadcast(texts.groupBy("doc").agg(F.min("said").alias("said"))), "doc")  # as many texts

    def make():
        rng = random.Random(seed)
        others: list[str] = []

        def one(html: str, said: str) -> list[tuple]:
            row = blocks(html)
            made = [(row, _aligned(row, said))]
            lines = [w for w in said.split("\n") if w.strip()][:40]
            others.extend(lines[:3])
            for _ in range(each if lines else 0):
                shown = blocks(layouts.page(lines[: rng.randrange(1, 12)] if rng.random() < 0.8 else lines, others[-60:], rng))
                made.append((shown, [int(layouts.MARK in b.marks) for b in shown]))
            found = []
            for shown, labels in made:
                if 0 < sum(labels):
                    part = _window(len(shown), rng)
                    found.append((features(shown)[part], siblings(shown)[part], labels[part]))
            return found

        def work(batch):
            found = [x for html, said in zip(batch["html"], batch["said"], strict=True) for x in one(html, said)]
            return {"feats": [f for f, _, _ in found], "same": [s for _, s, _ in found], "labels": [y for _, _, y in found]}

        return work

    ordered = met.select("page_id", "html", "said").repartition(4, "page_id").sortWithinPartitions("page_id")
    return per_batch(ordered.select("html", "said"), make, "feats array<array<string>>, same array<int>, labels array<int>")


class Chain:
    """The random field: ``weights`` of features for the label article, ``bonds[same][before][label]`` between neighbours."""

    def __init__(self, weights: dict[str, float] | None = None, bonds: np.ndarray | None = None):
        self.weights, self.bonds = weights if weights is not None else {"bias": 1.0}, bonds if bonds is not None else np.zeros((2, 2, 2))

    def viterbi(self, feats: list[list[str]], same: list[int]) -> list[int]:
        """The likeliest labels of a page."""
        weights, bonds, off, on, back = self.weights, self.bonds.tolist(), 0.0, 0.0, []
        for i, (names, s) in enumerate(zip(feats, same, strict=True)):
            own = sum(map(weights.get, names, [0.0] * len(names)))
            if i == 0:
                off, on = 0.0, own
                continue
            (oo, on_), (no, nn) = bonds[s]
            back.append((oo + off < no + on, on_ + off < nn + on))
            off, on = max(oo + off, no + on), own + max(on_ + off, nn + on)
        labels = [int(on > off)] if feats else []
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]

    def likelihood(self, score: np.ndarray, same: np.ndarray, labels: np.ndarray, length: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of padded pages (page x block), and its gradients by score and by bonds."""
        pages, most = score.shape
        emit = np.stack([np.zeros_like(score), score], axis=2)
        inside = np.arange(most) < length[:, None]
        ahead, behind = np.zeros((pages, most, 2)), np.zeros((pages, most, 2))
        ahead[:, 0] = emit[:, 0]
        step = self.bonds[same]  # page x block x before x label
        for t in range(1, most):
            moved = np.logaddexp(ahead[:, t - 1, 0, None] + step[:, t, 0], ahead[:, t - 1, 1, None] + step[:, t, 1]) + emit[:, t]
            ahead[:, t] = np.where(inside[:, t, None], moved, ahead[:, t - 1])
        for t in range(most - 2, -1, -1):
            moved = step[:, t + 1] + (emit[:, t + 1] + behind[:, t + 1])[:, None, :]
            behind[:, t] = np.where(inside[:, t + 1, None], np.logaddexp(moved[:, :, 0], moved[:, :, 1]), 0.0)
        whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        share = np.exp(ahead + behind - whole[:, None, None])[:, :, 1]
        by_score = np.where(inside, labels - share, 0.0)
        by_bond = np.zeros((2, 2, 2))
        linked = inside[:, 1:]
        true = np.zeros(pages)
        for before in (0, 1):
            for label in (0, 1):
                both = np.exp(ahead[:, :-1, before] + step[:, 1:, before, label] + emit[:, 1:, label] + behind[:, 1:, label] - whole[:, None])
                real = (labels[:, :-1] == before) & (labels[:, 1:] == label)
                for s in (0, 1):
                    here = linked & (same[:, 1:] == s)
                    by_bond[s, before, label] = (real & here).sum() - both[here].sum()
                    true += (real & here).sum(axis=1) * self.bonds[s, before, label]
        true += np.where(inside, labels * score, 0.0).sum(axis=1)
        return float((true - whole).sum()), by_score, by_bond


def fit(docs: DataFrame, pages: DataFrame, rows: int = LEARN_PAGES, rounds: int = ROUNDS) -> Chain:
    """A chain learned from a bounded sample (see ``learning_rows``).

    Without a page that tells its document, an empty table among them, the
    chain knows nothing and takes every block for article.
    """
    data = sorted((r["feats"], r["same"], r["labels"]) for r in learning_rows(docs, pages, rows).collect())
    if not data:
        return Chain()
    seen = Counter(f for feats, _, _ in data for names in feats for f in names)
    number = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
    length = np.array([len(y) for _, _, y in data])
    most = int(length.max())
    labels, same = np.zeros((len(data), most), dtype=int), np.zeros((len(data), most), dtype=int)
    cell, column = [], []
    for i, (feats, bound, y) in enumerate(data):
        labels[i, : len(y)], same[i, : len(y)] = y, bound
        for t, names in enumerate(feats):
            own = [number[f] for f in names if f in number]
            cell += [i * most + t] * len(own)
            column += own
    cell, column = np.array(cell), np.array(column)
    weights, chain = np.zeros(len(number)), Chain()
    first, second = [np.zeros(len(number)), np.zeros((2, 2, 2))], [np.zeros(len(number)), np.zeros((2, 2, 2))]
    blocks_in = length.sum()
    for k in range(1, rounds + 1):
        score = np.bincount(cell, weights=weights[column], minlength=labels.size).reshape(labels.shape)
        _, by_score, by_bond = chain.likelihood(score, same, labels, length)
        by_weight = np.bincount(column, weights=by_score.reshape(-1)[cell], minlength=len(number))
        for j, (value, grad) in enumerate(((weights, by_weight), (chain.bonds, by_bond))):
            grad = grad / blocks_in - 1e-5 * value
            first[j] = 0.9 * first[j] + 0.1 * grad
            second[j] = 0.99 * second[j] + 0.01 * grad * grad
            value += 0.1 * (first[j] / (1 - 0.9**k)) / (np.sqrt(second[j] / (1 - 0.99**k)) + 1e-8)
    return Chain(dict(zip(number, weights.tolist(), strict=True)), chain.bonds)


def main_text(html: str | None, chain: Chain) -> str:
    """Text of the article: its blocks in page order, joined by one space; empty if there is none."""
    row = blocks(html or "")
    labels = chain.viterbi(features(row), siblings(row))
    return " ".join(b.text for b, y in zip(row, labels, strict=True) if y)


def extract(pages: DataFrame, chain: Chain) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page; a null html is empty, repeated rows stay, an empty table gives none.

    Nothing is cut: texts of any length are whole. Other columns aren't read.
    """

    def make():
        def work(batch):
            texts = [main_text(h, chain) for h in batch["html"]]
            return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return per_batch(pages.select("page_id", "url", "html"), make, "page_id bigint, url string, text string, n_chars bigint")
