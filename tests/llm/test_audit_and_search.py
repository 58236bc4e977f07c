"""Divergence audit and ranked search against brute force."""

import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from threadloom.llm import divergence, ranked_search
from threadloom.llm.terms import LETTERS, LETTERS_DIGITS, term_runs
from threadloom.storage import materialize

LETTER = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LETTER_DIGIT = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text, pattern):
    return pattern.findall((text or "").translate(UPPER))


def test_terms_are_the_matches(odd_texts):
    for t in [*odd_texts, "ÀB ÉCOLE Straße x1y2 _a-b 日本語。テスト", "a" * 50 + " " + "b c " * 40]:
        for pattern, table in ((LETTER, LETTERS), (LETTER_DIGIT, LETTERS_DIGITS)):
            got = [w.decode() for run in term_runs((t or "").encode(), table, size=16) for w in run]
            assert got == words(t, pattern)


def brute_audit(rows, least, top=50):
    rows = [(lang or "", source or "", Counter(words(text, LETTER))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        held = Counter(t for r in own for t in r[2])
        kept = [t for t in held if held[t] >= least]
        groups = {s: sum((r[2] for r in own if r[1] == s), Counter()) for s in {r[1] for r in own}}
        whole = sum(groups.values(), Counter())

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, i) for part, ranked in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def audited(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, total long, block int"


def rows_table(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1, 2, 3) for i, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("block_rows", [1 << 17, 16])
def test_audit_equals_brute_force(spark, odd_texts, block_rows):
    rng = random.Random(7)
    terms = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["é", "É", "ß", "日本"]
    rows = [(" ".join(rng.choices(terms, k=rng.randrange(40))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])) for _ in range(120)]
    rows += rows[:5] + [(t, "en", "odd") for t in odd_texts] + [("only here", "zz", "one"), (None, "zz", "two"), ("", "lonely", None)]
    got = audited(divergence.audit(rows_table(spark, rows), least_docs=4, block_rows=block_rows))
    assert got == brute_audit(rows, 4)
    assert ("zz", "one", "pair", "two", 0, 1) in got and not [r for r in got if r[0] == "lonely"]


def test_audit_of_nothing(spark):
    assert divergence.audit(rows_table(spark, [])).count() == 0


def test_forest_shares_nodes_and_prices_exactly():
    rng = np.random.default_rng(3)
    counts = (rng.random((5, 300)) < 0.1) * rng.integers(1, 4, (5, 300))
    counts[4] = counts[3]
    group, term = np.nonzero(counts)
    forest = divergence.Forest(5, 300, group, term, counts[group, term].astype(np.int64))
    assert forest.roots[3] == forest.roots[4]
    assert sum(len(lower) for lower, _ in forest.levels) < 5 * 300  # fewer nodes than five trees have
    totals = counts.sum(axis=1)
    share = [[1 + 10**9 * (int(c) + 5) // (int(n) + 5 * 300) for c in row] for row, n in zip(counts, totals, strict=True)]
    left, right = map(np.array, zip(*combinations(range(5), 2), strict=True))
    want = [sum(abs(x - y) for x, y in zip(share[a], share[b], strict=True)) for a, b in zip(left, right, strict=True)]
    assert forest.prices(left, right, totals, 300).tolist() == want
    big = divergence.Forest(2, 3, np.array([0, 1]), np.array([0, 2]), np.array([10**11, 7]))
    totals = np.array([10**11, 7])
    p, q = ([1 + 10**9 * (c + 5) // (int(n) + 15) for c in row] for row, n in zip([[10**11, 0, 0], [0, 0, 7]], totals, strict=True))
    assert big.prices(np.array([0]), np.array([1]), totals, 3).tolist() == [sum(abs(x - y) for x, y in zip(p, q, strict=True))]


def brute_search(docs, items, k=50):
    held = [(i, Counter(words(t, LETTER_DIGIT))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(words(text, LETTER_DIGIT)) if t in c)
            if s:
                scored.append((-s, doc is not None, doc or 0))
        out += [(item, r, (d if known else None), -s) for r, (s, known, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def searched(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("most", "pairs", "k"), [(ranked_search.SHARD_POSTINGS, ranked_search.QUERY_PAIRS, 50), (60, 12, 3), (600, 200_000, 1)])
def test_search_equals_brute_force(spark, make, odd_texts, most, pairs, k):
    rng = random.Random(11)
    terms = [f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(900)]
    texts = [" ".join(rng.choices(terms, k=rng.randrange(1, 60))) for _ in range(700)]
    texts += texts[:20] + odd_texts + ["t1 " * 5000, "Word WORD é😀 É"]
    ids = [*rng.sample(range(10_000), len(texts) - 2), None, None]
    items = [(i, " ".join(rng.choices(terms, k=rng.randrange(1, 12)))) for i in range(25)] + [(90, None), (91, ""), (92, "nowhere at_all"), (93, "word word É"), (94, "t1"), (94, "t1"), (94, "t2 t3"), (95, texts[3])]
    index = materialize(ranked_search.build_index(make(texts, ids), most=most), "test-index")
    found = ranked_search.search(index, spark.createDataFrame(items, "item_id long, text string"), k=k, pairs=pairs)
    assert searched(found) == brute_search(list(zip(ids, texts, strict=True)), [i for i in items if i[1]], k)


def test_search_skips_blocks():
    """With a rare term and a frequent one, most blocks of the frequent list stay packed."""
    texts = [f"common {'rare ' * 3 if i % 1000 == 7 else ''}{'filler ' * (i % 7 if i % 1000 != 7 else 0)}" for i in range(20_000)]
    shard = ranked_search._Shard()
    for i, t in enumerate(texts):
        shard.add(i, t.encode())
    shard.count()
    head, *tables = shard.rows(0)
    rows = {r["term"]: r for t in tables for r in t.to_pylist()}
    n = np.frombuffer(head.to_pylist()[0]["data"], dtype=np.int64)
    norm_of = lambda x: 50 + 50 * x * len(n) // int(n.sum())
    lists = {t: ranked_search._List(r["heads"], r["data"], r["held"], norm_of(n), norm_of) for t, r in rows.items()}
    places, _ = ranked_search.best([(9000, lists["rare"]), (1, lists["common"])], len(texts), 10)
    assert (places % 1000 == 7).all()
    assert 0 < lists["common"].open.sum() < len(lists["common"].open) / 2


def test_packing_round_trip():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**31 - 1, 5])
    data, ends = ranked_search.pack(values)
    assert ranked_search.unpack(data).tolist() == values.tolist() and len(data) == ends[-1]


def test_search_of_nothing(spark, make):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for texts in ([], [None, "", " - "]):
        index = materialize(ranked_search.build_index(make(texts)), "test-index")
        assert ranked_search.search(index, items).count() == 0
    index = materialize(ranked_search.build_index(make(["a b", "c"])), "test-index")
    assert ranked_search.search(index, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search.search(index, items.limit(0)).count() == 0
