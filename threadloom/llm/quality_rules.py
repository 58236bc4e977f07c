"""Quality rules: decision lists learned by sequential covering.

Statistics of every text are taken in one pass. From labelled statistics a
list of rules is grown: each rule is a conjunction of thresholds, grown on
two thirds of the rows by information gain, pruned on the other third, and
kept while it is precise there; the rows it covers leave the pool, and the
next rule is grown on the rest. The list becomes one ordered Spark
conditional expression, first match wins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.text import per_batch, picked

#: Labelled rows that rules are learned from, about; a larger table is sampled by hash of its key.
TRAIN_ROWS = 20_000
_SPACE = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_upper bigint, n_digits bigint, n_marks bigint, n_distinct bigint"
#: Statistics that rules may test, as expressions over the counts.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def repeated_words(ids: np.ndarray, span: int = 5) -> int:
    """Positions inside windows of ``span`` words that are found twice or more, the first included."""
    n = len(ids) - span + 1
    if n < 2:
        return 0
    size = int(ids.max()) + 1
    keys = ids[:n].astype(np.int64)
    top = size
    for k in range(1, span):
        if top > (1 << 62) // size:
            keys = np.unique(keys, return_inverse=True)[1]
            top = int(keys.max()) + 1
        keys = keys * size + ids[k : n + k]
        top *= size
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not twice.size:
        return 0
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    starts = np.flatnonzero(twice[at] == keys)
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + span, -1)
    return int((np.cumsum(cover) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of ``STATS`` for one whole text; a null text has no words and no lines."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    names: dict[bytes, int] = dict(zip(dict.fromkeys(words), range(len(words)), strict=False))
    ids = np.fromiter(map(names.__getitem__, words), dtype=np.int64, count=len(words))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    marks = len(raw) - len(raw.translate(None, b"!?"))
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)),
        len(raw) - len(raw.translate(None, _SYMBOLS.encode())),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        upper,
        digits,
        marks,
        len(names),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the columns of ``STATS`` for every row; null texts count as empty, repeated rows give repeated counts, an empty table none."""
    names = [x.split()[0] for x in STATS.split(", ")]

    def make():
        def work(batch):
            rows = [text_stats(t) for t in batch["text"]]
            return {"doc_id": batch["doc_id"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return work

    return per_batch(docs.select("doc_id", "text"), make, f"doc_id bigint, {STATS}")


def with_features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({f"f_{n}": F.expr(e) for n, e in FEATURES.items()})


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


def _cuts(values: np.ndarray, most: int = 48) -> np.ndarray:
    found = np.unique(values)
    if len(found) > most + 1:
        found = np.unique(np.quantile(values, np.linspace(0, 1, most + 2)))
    return (found[:-1] + found[1:]) / 2


def _grow(x: dict[str, np.ndarray], y: np.ndarray, longest: int) -> list[Test]:
    rule, inside = [], np.ones(len(y), dtype=bool)
    while len(rule) < longest:
        p, n = int(y[inside].sum()), int((~y[inside]).sum())
        if not p or not n:
            break
        base, best, gain = math.log2(p / (p + n)), None, 1e-9
        for name, values in x.items():
            own, label = values[inside], y[inside]
            for cut in _cuts(own):
                over = own > cut
                for above, part in ((True, over), (False, ~over)):
                    q = int(label[part].sum())
                    if q < 3:
                        continue
                    g = q * (math.log2(q / int(part.sum())) - base)
                    if g > gain:
                        best, gain = Test(name, above, float(cut)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return rule


def _covered(rule: list[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    inside = np.ones(n, dtype=bool)
    for test in rule:
        inside &= test.holds(x)
    return inside


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, most: int = 12, longest: int = 4, precision: float = 0.8) -> list[list[Test]]:
    """Ordered conjunctions that name bad rows; ``prune`` marks the rows that rules are pruned and judged on.

    A rule is dropped, and the list ends, when fewer than ``precision`` of the
    held-back rows it covers are bad, or when it covers fewer than three.
    """
    rules, alive = [], np.ones(len(bad), dtype=bool)
    for _ in range(most):
        grow, check = alive & ~prune, alive & prune
        if bad[grow].sum() < 3 or not check.any():
            break
        rule = _grow({n: v[grow] for n, v in x.items()}, bad[grow], longest)
        held = {n: v[check] for n, v in x.items()}

        def worth(r, held=held, check=check):
            c = _covered(r, held, int(check.sum()))
            p, n = int((bad[check] & c).sum()), int((~bad[check] & c).sum())
            return (p - n) / (p + n) if p + n else -1.0

        if not rule:
            break
        rule = max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (worth(r), -len(r)))
        c = _covered(rule, held, int(check.sum()))
        hits = int((bad[check] & c).sum())
        if c.sum() < 3 or hits < precision * c.sum():
            break
        rules.append(rule)
        alive &= ~_covered(rule, x, len(bad))
    return rules


def rules_column(rules: list[list[Test]]) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    if not rules:
        return F.lit(None).cast("int")
    out = None
    for i, rule in enumerate(rules, 1):
        both = rule[0].column()
        for test in rule[1:]:
            both = both & test.column()
        out = F.when(both, F.lit(i)) if out is None else out.when(both, F.lit(i))
    return out


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``(doc_id, y)`` of about ``rows`` rows with a label, picked by hash of the key; one row a key."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = good.count()
    if n > rows:
        good = good.where(picked(F.col("doc_id"), "sample", rows / n))
    return good


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> list[list[Test]]:
    """Rules for documents labelled 0, from at most about ``rows`` labelled rows.

    Only their statistics (ten numbers a row) come to the driver. Unlabelled
    rows, null labels and labels without a document are not used; with no row
    of either class the list is empty.
    """
    # bounded by `rows` keys, so it may be broadcast
    chosen = docs.select("doc_id", "text").join(F.broadcast(labelled_sample(labels, label, rows)), "doc_id")
    stats = with_features(statistics(chosen)).join(F.broadcast(labelled_sample(labels, label, rows)), "doc_id")
    table = stats.select("doc_id", "y", *(f"f_{n}" for n in FEATURES)).toPandas().sort_values("doc_id", kind="stable")
    if not len(table):
        return []
    x = {n: table[f"f_{n}"].to_numpy(dtype=float) for n in FEATURES}
    prune = (np.arange(len(table)) % 3) == 2
    return learn_rules(x, (table["y"] == 0).to_numpy(), prune)


def apply_rules(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """Counts of every text, ``base_failed``, ``rule`` (number of the first that holds) and ``kept``.

    Null and empty texts have no words and fail the base rules. Repeated rows
    are judged alike; other columns are ignored.
    """
    judged = statistics(docs).withColumns(
        {"base_failed": F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"), "rule": rules_column(rules)}
    )
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
