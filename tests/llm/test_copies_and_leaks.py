"""SimHash groups, near copies, decontamination: brute force on small tables."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from threadloom.llm import decontaminate as D
from threadloom.llm import simhash_dedup as S
from threadloom.operators.graph import connected_components
from threadloom.storage import materialize


def brute_fp(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def _texts():
    rng = random.Random(6)
    words = [f"word{i}" for i in range(300)]
    out = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(120)]
        out.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(120)] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def test_fingerprint_equals_brute_force(odd_texts):
    for t in [x for x in odd_texts if x is None or len(x) < 5000] + ["Ünder ÜBER a B", "one", "one two"]:
        assert S.fingerprint_text(t) % (1 << 64) == brute_fp(t), t


def test_spark_hash_is_the_same(spark):
    df = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t").alias("h"))
    assert df.first()["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", seed=42)


def test_groups_equal_brute_force(make, odd_texts):
    texts = [*_texts(), *odd_texts[:4], *odd_texts[6:]]
    want = brute_components({i: brute_fp(t) for i, t in enumerate(texts)})
    for crowded in (512, 0):  # with every bucket through points, the components are the same
        got = S.near_duplicate_groups(make(texts), crowded=crowded).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_crowded_buckets_equal_pairs(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:
        fps.add(rng.choice(list(fps)[:40]) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from threadloom.operators.graph import connected_components

    one = {r["node"]: r["root"] for r in connected_components(S.hamming_links(df, 512)).collect()}
    two = {r["node"]: r["root"] for r in connected_components(S.hamming_links(df, 1)).collect()}
    assert one == two and len(one) > 300


def test_groups_with_null_and_repeated_ids(make):
    got = S.near_duplicate_groups(make(["a b c d", "a b c d", "q r s t u", "q r s t u"], [None, 7, 3, 3])).collect()
    assert sorted(r["component_id"] for r in got) == [3, 3, 7, 7]
    assert S.near_duplicate_groups(make([])).count() == 0


def jaccard(a, b, k=5):
    s = lambda t: {tuple(t.lower().split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))}
    return len(s(a) & s(b)) / len(s(a) | s(b))


def test_one_of_each_keeps_one_and_leaves_others(make):
    texts = _texts()
    texts += [texts[0], None, "", "short", "short"]
    kept = S.one_of_each(make(texts))
    rows = kept.collect()
    left = {r["doc_id"] for r in rows}
    assert {0, 5, 10}.issubset(left) and kept.columns[-1] == "ids" and all(r["base"] == 2 for r in rows)
    groups = [range(i, i + 5) for i in range(0, 60, 5)]
    # each copy differs from its base in one word of 120; a rare one has no fingerprint within three bits of any other
    assert all(len(left & set(g)) >= 1 for g in groups) and sum(len(left & set(g)) - 1 for g in groups) <= 2
    assert 60 not in left and len(left & {61, 62}) == 1 and len(left & {63, 64}) == 1


def brute_kept(texts, similar=0.8, k=5):
    """Smallest number of each component of pairs with a Jaccard similarity of ``similar`` or more."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            if jaccard(a, texts[j], k) >= similar:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i for i in range(len(texts)) if find(i) == i}


def _isolated_pairs():
    rng = random.Random(21)
    texts = []
    for n in range(60):  # pairs just above and just below 0.8
        base = [f"v{rng.randrange(4000)}" for _ in range(130)]
        copy = list(base)
        for at in rng.sample(range(5, 125), 2 + n % 3):
            copy[at] = "changed"
        texts += [" ".join(base), " ".join(copy)]
    return texts


def test_one_of_each_finds_every_isolated_pair(make):
    texts = _isolated_pairs()
    assert {r["doc_id"] for r in S.one_of_each(make(texts)).collect()} == brute_kept(texts)


def test_one_of_each_in_crowded_families_equals_brute_force(make):
    rng = random.Random(22)
    texts = []
    for _ in range(4):  # chains: neighbours are near copies, far ones are not, nor are most to any one centre
        text = [f"u{rng.randrange(4000)}" for _ in range(100)]
        for _ in range(30):
            text = list(text)
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(100)] = f"u{rng.randrange(4000)}"
            texts.append(" ".join(text))
    rng.shuffle(texts)
    want = brute_kept(texts)
    for crowded in (0, 512):
        classes, links = S.near_copy_links(make(texts), crowded=crowded)
        ids = {r["key"]: r["first_id"] for r in classes.collect()}
        root = {r["node"]: r["root"] for r in connected_components(links).collect()}
        lowest = {}
        for key, i in ids.items():
            lowest[root.get(key, key)] = min(i, lowest.get(root.get(key, key), i))
        assert set(lowest.values()) == want


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**64, 900, dtype=np.uint64)
    for _ in range(300):
        x, y = (set(rng.choice(pool, rng.integers(0, 300), replace=False).tolist()) for _ in range(2))
        y |= set(list(x)[: int(len(x) * rng.random())])
        bits = sum((int(p) ^ int(q)).bit_count() for p, q in zip(*(np.array(S.sketch_of(np.array(sorted(z), dtype=np.uint64)), dtype=np.int64).view(np.uint64) for z in (x, y)), strict=True))
        assert bits <= len(x ^ y)


def test_one_of_each_keeps_unlike_texts(make):
    rng = random.Random(1)
    texts = [" ".join(str(rng.randrange(10_000)) for _ in range(80)) for _ in range(60)]
    half = [" ".join(t.split()[:40] + [str(rng.randrange(10_000)) for _ in range(40)]) for t in texts]
    assert S.one_of_each(make(texts + half)).count() == 120


def test_one_of_each_repeated_rows(make):
    rows = S.one_of_each(make(["a b c d e f", "a b c d e f", "z y x"], [4, 4, None])).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["4", "None"]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
    return row[-1]


def test_lcs_equals_dynamic_programme():
    rng = random.Random(3)
    for _ in range(200):
        a = [bytes([rng.randrange(97, 102)]) for _ in range(rng.randrange(1, 70))]
        b = [bytes([rng.randrange(97, 102)]) for _ in range(rng.randrange(70))]
        assert D.lcs(a, b) == brute_lcs(a, b)


def _corpus(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    common = ["the", "of", "and", "to"]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.3 else rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(15, 60))) for i in range(40)]
    docs, leaks = [], set()
    for d in range(300):
        body = text(rng.randrange(50, 400)).split()
        if d % 5 == 0:
            item, q = items[d // 5 % 40]
            q = q.split()
            if d % 10 == 0:  # a paraphrase: one word in ten replaced
                q = [rng.choice(words) if k % 10 == 4 else w for k, w in enumerate(q)]
            at = rng.randrange(len(body))
            body[at:at] = q
            leaks.add((d, item))
        docs.append((d, " ".join(body)))
    schema = "id long, text string"
    return spark.createDataFrame(docs, "doc_" + schema), spark.createDataFrame(items, "item_" + schema), leaks, docs, items


def _by_force(rows, items):
    """Documents and items: the best common subsequence of a passage and any stretch of the document half as long again."""
    out = {}
    for d, t in rows:
        words = D.words_of(t)
        for i, q in items:
            passage = D.words_of(q)
            n = len(passage)
            best = (0.0, 0.0)
            for start in range(0, max(1, len(words) - n // 2), max(1, n // 4)):
                best = max(best, D.judge(passage, words[max(0, start - n // 4) : start + n + n // 2]))
            out[d, i] = best
    return out


def test_leaks_equal_planted(spark):
    docs, items, leaks, rows, texts = _corpus(spark)
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, items).collect()}
    assert got == leaks
    force = _by_force(rows, texts)
    assert {k for k, (share, _) in force.items() if share >= D.SAME} == leaks
    clean = {r["doc_id"] for r in D.without_leaks(docs, items).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in got}


def test_blocks_and_groups_give_the_same(spark, monkeypatch):
    docs, items, _, _, _ = _corpus(spark)
    docs = docs.where("doc_id < 120")
    twice = docs.unionByName(docs)  # repeated rows give repeated rows, however the passages are dealt
    rows = lambda: sorted((r["doc_id"], r["item_id"]) for r in D.find_leaks(twice, items).collect())
    whole = rows()
    assert len(whole) == 2 * len(set(whole))
    monkeypatch.setattr(D, "BLOCK", 8)
    assert rows() == whole
    monkeypatch.setattr(D, "GROUP", 16)
    assert rows() == whole
    left = D.without_leaks(twice, items)
    assert left.count() == 240 - 2 * len({d for d, _ in whole})


def test_bounds_leave_all_windows_that_are_near(spark, monkeypatch):
    """Windows left before they are projected are far from all passages; a text's words are made once for all blocks."""
    docs, items, _, rows, _ = _corpus(spark)
    monkeypatch.setattr(D, "BLOCK", 15)
    passages = [p for group in D._groups(items) for p in group]
    models, chosen, short = D._search_of(docs, passages).value
    group = D.GroupSearch(models, chosen, short)
    texts = [t for _, t in rows[:60]] + [" ".join(t for _, t in rows[:80]), "", "w1", None]
    windows = kept = found = 0
    for model, search in zip(models, group.parts, strict=False):
        for text in texts:
            words, want = D.words_of(text), {}
            for window, own in ((w, np.flatnonzero(model["scale"] == i)) for i, (_, w) in enumerate(D.SCALES)):
                for start in range(0, len(words), window // 4):
                    at = [model["terms"][w] for w in words[start : start + window] if w in model["terms"]]
                    if len(at) >= 2 and len(own):
                        near = model["table"][at].sum(axis=0, dtype=np.float64).astype(np.float32) @ model["queries"][own].T
                        bound = model["nearest"][D.SCALES.index(next(s for s in D.SCALES if s[1] == window))][at].sum()
                        assert near.max() <= bound + D._SLACK
                        windows, kept = windows + 1, kept + (bound >= D.NEAR - D._SLACK)
                        want |= {(int(own[j]), start, window): float(near[j]) for j in np.flatnonzero(near >= D.NEAR)}
            known = np.array([group.number.get(w, -1) for w in words], dtype=np.int64)
            at = np.flatnonzero(known >= 0)
            got = {c[:3]: c[3] for c in search._candidates(len(words), *D._places(search.local, known[at], at))}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)
            found += len(got)
    assert len(models) > 1 and found and kept < windows / 2
    calls, words_of = [], D.words_of
    monkeypatch.setattr(D, "words_of", lambda t: calls.append(t) or words_of(t))
    for text in texts:
        group.leaks(text)
    assert len(calls) == len(texts)


def test_svd_is_that_of_the_matrix(spark):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((40, 6)) @ rng.standard_normal((6, 90))  # rank 6
    rows = spark.createDataFrame([(list(range(90)), x.tolist()) for x in m], "at array<int>, value array<double>")
    full = D.randomised_svd(rows, 90, 40)
    assert full.shape == (90, 6) and np.allclose(m @ full @ full.T, m)
    values = np.linalg.svd(m, compute_uv=False) ** 2
    few = D.randomised_svd(rows, 90, 40, energy=0.8)
    assert few.shape[1] == int(np.searchsorted(np.cumsum(values), 0.8 * values.sum())) + 1


def test_factoring_takes_one_python_worker_a_task(spark, monkeypatch):
    docs, items, _, _, _ = _corpus(spark)
    plans, svd = [], D.randomised_svd

    def seen(rows, *rest):
        plans.append(rows._jdf.queryExecution().toString())
        return svd(rows, *rest)

    monkeypatch.setattr(D, "randomised_svd", seen)
    D.without_leaks(docs.limit(5), items)
    assert plans and not any("MapInArrow" in p for p in plans)


def test_leaks_of_odd_rows(spark, make, odd_texts):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, ""), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    long = "filler words " * 40_000 + "alpha beta gamma delta epsilon zeta eta theta iota kappa " + "more words " * 1000
    docs = make([*odd_texts, long], [None, *range(1, len(odd_texts) + 1)])
    got = D.find_leaks(docs, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(len(odd_texts), 1)]
    assert D.without_leaks(docs, items).count() == len(odd_texts)
    assert D.find_leaks(docs, items.where("false")).count() == 0 and D.find_leaks(make([]), items).count() == 0


def test_tails_and_short_items(spark, make):
    rng = random.Random(31)
    words = [f"w{i}" for i in range(3000)]
    long = [rng.choice(words) for _ in range(96)] + ["common"]
    rows = [(1, " ".join(long)), (2, "common"), (3, "red common green"), (4, "sole"), (5, "one two common four five six")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    filler = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [
        " ".join([*filler(40), "common", *filler(40)]),  # the tail's word alone is no leak of item 1
        " ".join([*filler(20), *long, *filler(20)]),
        " ".join([*filler(10), "red", "x", "common", "green", *filler(10)]),
        " ".join([*filler(10), "red", "common", "green", *filler(10)]),
        " ".join([*filler(30), "sole"]),
        " ".join([*filler(9), "one two changed four five six", *filler(9)]),
        " ".join(["one", *filler(3), "two", *filler(3), "common four", *filler(3), "five", *filler(3), "six"]),
        " ".join(filler(60)),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(make(texts), items).collect()}
    assert got == {(0, 2), (1, 1), (1, 2), (2, 2), (3, 2), (3, 3), (4, 4), (5, 5), (6, 2)}
    assert {r["doc_id"] for r in D.without_leaks(make(texts), items).collect()} == {7}
    assert [len(w) for _, w in D.passages_of(rows[:1])] == [96, 96]


@pytest.mark.parametrize(("share", "inserted"), [(0.15, 0.0), (0.18, 0.0), (0.19, 0.1)])
def test_passages_without_their_rarest_words_are_found(spark, share, inserted):
    """Every item of the benchmark, its rarest words replaced (what is left still reaches ``SAME``), words set in between, inside a real document."""
    sf = "/root/testdata/sf0.01"
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) between 300 and 3000").orderBy("doc_id").limit(200).collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items = [(i, t) for i, t in items if D.FEW <= len(D.words_of(t)) <= D.PASSAGE]
    df = Counter(w for t in texts for w in set(D.words_of(t)))
    rng = random.Random(6)
    planted = []
    for d, (_, t) in enumerate(items):
        words = D.words_of(t)
        places = sorted(range(len(words)), key=lambda k: (df[words[k]], words[k], k))[: int(share * len(words))]
        told = [f"zz{k}".encode() if k in places else w for k, w in enumerate(words)]
        told = [x for w in told for x in ([w, b"zzin"] if rng.random() < inserted else [w])]
        assert D.judge(words, told)[0] >= D.SAME
        host = D.words_of(texts[d % len(texts)])
        at = rng.randrange(len(host) + 1)
        planted.append((d, b" ".join([*host[:at], *told, *host[at:]]).decode()))
    schema = "id long, text string"
    docs, bench = spark.createDataFrame(planted, "doc_" + schema), spark.createDataFrame(items, "item_" + schema)
    found = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()}
    assert {(d, i) for d, (i, _) in enumerate(items)} <= found


def test_exploded_rows_are_not_broadcast(make, spark, monkeypatch):
    """Spark tells exploded rows by the size of what they were made of; 400,000 fingerprints of a few MB would be broadcast as eight million rows."""
    plans = {}

    def kept(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return materialize(df, tag)

    monkeypatch.setattr(S, "materialize", kept)
    rng = random.Random(7)
    fps = [rng.getrandbits(62) for _ in range(40)]
    pairs = S.hamming_links(spark.createDataFrame([(x,) for f in fps for x in (f, f ^ 5)], "fp bigint"))
    assert {tuple(r) for r in pairs.collect()} >= {(min(f, f ^ 5), max(f, f ^ 5)) for f in fps}
    plans["few"] = pairs._jdf.queryExecution().executedPlan().toString()
    words = [f"w{i}" for i in range(60)]
    classes, links = S.near_copy_links(make([" ".join(words), " ".join([*words[:59], "x"]), "other text of a few words"]))
    assert links.count() == 1
    for tag in ("blocks", "few", "open", "stars", "pairs"):
        joins = [x for x in plans[tag].splitlines() if "Join" in x]
        assert any("SortMergeJoin" in x for x in joins), tag
    assert "BroadcastHashJoin" not in plans["blocks"] and "BroadcastHashJoin" not in plans["few"]
    assert "LeftSemi" in plans["entries"] and "Inner" not in plans["entries"]
