"""Source divergence audit: hash-consed segment trees over term ids.

Within a language every (lang, source) group is a vector of counts over the
kept terms, and two groups differ by the sum over terms of |p - q|, p and q
being smoothed shares in billionths, exact to the unit.

The terms of a language are dealt to blocks by hash. A task holds one block:
the subtrees of all groups over its terms. Trees are hash-consed level by
level: two nodes with the same children are one node, wherever they stand and
whichever group they belong to, so the long runs of zeros and of small counts
are stored once. Two groups are compared by walking their trees together from
the roots; a pair of nodes that is met again on a level, at another place, is
priced once (the price of a pair depends on the counts below and on the two
groups' totals, not on the place). The upper levels of the trees, above the
blocks, are one sum over blocks, which Spark adds up.

A block holds about ``BLOCK_ROWS`` counts at any size of the corpus; the number
of blocks grows. The result itself holds a row for every ordered pair of
sources of a language, as the audit asks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.terms import LETTERS, raw, term_runs
from threadloom.llm.text import ROWS, collector_off
from threadloom.storage import materialize

#: Documents of a language that must hold a term.
LEAST_DOCS = 30
BILLION = 1_000_000_000
SMOOTH = 5
TOP_TERMS = 50
#: Counts that a block of terms holds on average.
BLOCK_ROWS = 1 << 17
#: Distinct (group, term) entries that a counting task holds before it hands them on.
HELD = 400_000
#: Nodes of two trees that a walk looks at together, at most, unless one pair alone has more.
WALK = 1 << 20


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and holding rows of each group's terms; a null term stands for the group's rows.

    Null text, lang and source are read as ''. Every row is a document,
    repeated rows too. Counting is by task first, then by group and term.
    """
    schema = "lang string, source string, term string, n bigint, docs bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter, list[int]]] = {}

        def entries() -> pa.RecordBatch:
            rows = [(lang, source, t.decode("utf-8", "replace"), n, held[t]) for (lang, source), (counts, held, _) in found.items() for t, n in counts.items()]
            rows += [(lang, source, None, 0, seen[0]) for (lang, source), (_, _, seen) in found.items()]
            found.clear()
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["lang", "source", "term", "n", "docs"])

        with collector_off():
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    part = batch.slice(start, ROWS)
                    for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                        counts, held, seen = found.setdefault((lang, source), (Counter(), Counter(), [0]))
                        met: set[bytes] = set()
                        for words in term_runs(text, LETTERS):
                            counts.update(words)
                            met.update(words)
                        held.update(met)
                        seen[0] += 1
                    if sum(len(c) for c, _, _ in found.values()) > HELD:
                        yield entries()
            yield entries()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), raw("text").alias("text"))
    return rows.mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Forest:
    """Hash-consed segment trees of several sparse count vectors over the same ``width`` terms.

    ``group``, ``term`` and ``count`` are the non-zero entries, each pair of
    group and term once. ``levels[k]`` holds the left and right child of every
    node of height k + 1; ``values`` the counts of the leaves, -1 where there
    is no term. ``roots`` names the node of each group on the last level.
    """

    def __init__(self, groups: int, width: int, group: np.ndarray, term: np.ndarray, count: np.ndarray):
        self.values, leaf = np.unique(np.concatenate([np.array([-1, 0], dtype=np.int64), count]), return_inverse=True)
        size = 1 << max(0, (width - 1).bit_length())
        empty = np.zeros(size, dtype=np.int64)  # the tree of a group without entries; node 0 is no term, node 1 no count
        empty[:width] = 1
        order = np.lexsort((term, group))
        group, place, node = group[order], term[order].astype(np.int64), leaf[2:][order].astype(np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while size > 1:
            parent = place >> 1
            first = np.ones(len(place), dtype=bool)
            first[1:] = (group[1:] != group[:-1]) | (parent[1:] != parent[:-1])
            at = np.cumsum(first) - 1
            group, above = group[first], parent[first]
            pair = np.stack([empty[above * 2], empty[above * 2 + 1]], axis=1)
            pair[at, place & 1] = node
            children = np.concatenate([empty.reshape(-1, 2), pair])
            nodes = int(children.max()) + 1
            both, consed = np.unique(children[:, 0] * nodes + children[:, 1], return_inverse=True)
            size //= 2
            empty, node, place = consed[:size], consed[size:], above
            self.levels.append(np.divmod(both, nodes))
        self.roots = np.full(groups, empty[0], dtype=np.int64)
        self.roots[group] = node

    def prices(self, left: np.ndarray, right: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
        """Sum of |p - q| over the terms for each pair of groups; ``totals`` are the groups' counts over all ``terms`` kept terms."""
        pair = np.arange(len(left))
        a, b = self.roots[left], self.roots[right]
        back: list[np.ndarray] = []
        for lower, upper in reversed(self.levels):
            n = len(pair)
            pair, a, b = np.tile(pair, 2), np.concatenate([lower[a], upper[a]]), np.concatenate([lower[b], upper[b]])
            nodes = int(max(a.max(), b.max())) + 1
            codes, code = np.unique(a * nodes + b, return_inverse=True)
            met, again = np.unique(pair * len(codes) + code.reshape(-1), return_inverse=True)
            pair, code = np.divmod(met, len(codes))
            a, b = np.divmod(codes[code], nodes)
            back.append(again.reshape(-1).reshape(2, n))
        price = np.abs(self._share(a, totals[left][pair], terms) - self._share(b, totals[right][pair], terms))
        for lower, upper in reversed(back):
            price = price[lower] + price[upper]
        return price

    def _share(self, leaf: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
        count = self.values[leaf]
        if len(count) and int(self.values[-1]) + SMOOTH > (1 << 62) // BILLION:  # beyond 64 bits: exact integers of Python
            count, total = count.astype(object), total.astype(object)
        return np.where(count < 0, 0, 1 + BILLION * (count + SMOOTH) // np.maximum(total + SMOOTH * terms, 1))


def _price_block(table: pa.Table) -> pa.Table:
    """``(lang, a, b, value)`` of one block for every two of the language's groups, a before b by name."""
    term = table.column("term")
    roster = table.filter(pc.is_null(term)).sort_by("source")
    names, totals = roster.column("source").to_pylist(), roster.column("total").to_numpy().astype(np.int64)
    rows = table.filter(pc.is_valid(term))
    coded = rows.column("term").combine_chunks().dictionary_encode()
    width = len(coded.dictionary)
    count, own = rows.column("n").to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64)
    # frequent terms first: the rare ones, zero in most groups, stand side by side and share nodes
    rank = np.empty(width, dtype=np.int64)
    rank[np.argsort(-np.bincount(own, weights=count, minlength=width), kind="stable")] = np.arange(width)
    group = pc.index_in(rows.column("source").combine_chunks(), value_set=pa.array(names, pa.string())).to_numpy().astype(np.int64)
    terms = int(roster.column("terms")[0].as_py())
    forest = Forest(len(names), width, group, rank[own], count) if width else None
    entries = np.bincount(group, minlength=len(names)) + 1
    lang = roster.column("lang")[0].as_py()
    found = []
    step = max(1, WALK // max(1, int(entries.max())))
    for i in range(len(names) - 1):
        for start in range(i + 1, len(names), step):
            right = np.arange(start, min(start + step, len(names)))
            left = np.full(len(right), i)
            found.append((left, right, forest.prices(left, right, totals, terms) if forest else np.zeros(len(right), dtype=np.int64)))
    left, right, value = (np.concatenate([f[k] for f in found]) for k in range(3)) if found else (np.zeros(0, dtype=np.int64),) * 3
    spelled = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "a": spelled.take(pa.array(left)), "b": spelled.take(pa.array(right)), "value": pa.array(value.astype(np.int64))})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: the divergence of sources (`pair`) and the terms a source favours (`term`).

    Null text, lang and source count as ''. Empty texts make a group without
    terms; a language without kept terms has values of 0. Ties of value are
    ordered by item, as UTF-8. An empty table gives no rows. Extra columns of
    any name are not read.
    """
    counts = materialize(term_counts(docs), "divergence-counts")
    groups = counts.where(F.col("term").isNull()).select("lang", "source")
    words = counts.where(F.col("term").isNotNull())
    vocabulary = words.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("held")).where(F.col("held") >= least_docs)
    kept = materialize(words.select("lang", "source", "term", "n").join(vocabulary.drop("held"), ["lang", "term"]), "divergence-kept")

    # one row a language, one a group: sizes of vocabularies and totals
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("entries"))
    langs = kept.groupBy("lang", "term").agg(F.first("in_lang").alias("in_lang"), F.count("*").alias("entries")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"), F.sum("entries").alias("lang_entries"))
    sized = groups.join(totals.drop("entries"), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total", "lang_entries"])
    roster = materialize(sized.withColumn("blocks", F.expr(f"1 + lang_entries div {block_rows}")), "divergence-groups")

    by_block = kept.join(roster.groupBy("lang").agg(F.first("blocks").alias("blocks")), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "n", F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("terms")
    )
    seats = roster.select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n"), "total", "terms")
    priced = by_block.unionByName(seats).groupBy("lang", "block").applyInArrow(_price_block, "lang string, a string, b string, value bigint")
    summed = priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = summed.select("lang", "value", F.explode(both).alias("way")).select("lang", F.col("way.source").alias("source"), F.lit("pair").alias("part"), F.col("way.item").alias("item"), "value")

    share = lambda n, total: F.expr(f"1 + ((cast({BILLION} as decimal(10,0)) * cast({n} + {SMOOTH} as decimal(20,0))) div ({total} + {SMOOTH} * terms))")
    favoured = kept.join(roster, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (share("n", "total") - share("in_lang", "lang_total")).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    return pairs.withColumn("rank", rank).unionByName(favoured.withColumn("rank", rank).where(F.col("rank") <= top))
