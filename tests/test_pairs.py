"""Similar sets and partners equal comparing everything with everything."""

import random
from collections import Counter
from itertools import combinations

import pytest

from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators.pairs import all_partners, near_duplicate_bullets, partners, probable_duplicates, scored_pairs, similar_classes, similar_pairs, similar_sets, together
from threadloom.plans.registry import QUERIES

SETS = "id long, place string, words array<string>, keys array<string>"


def brute_sets(rows, threshold):
    classes = {}
    for i, place, words, keys in rows:
        if keys:
            classes.setdefault((place, frozenset(words or ()), frozenset(keys)), []).append(i)
    out = {(min(v), i): 1.0 for v in classes.values() for i in v if i != min(v)}
    for ((p, w, k), v), ((q, x, m), u) in combinations(classes.items(), 2):
        score = len(w & x) / len(w | x) if w | x else 1.0
        if p == q and k & m and score >= threshold:
            out[min(min(v), min(u)), max(min(v), min(u))] = score
    return out


@pytest.mark.parametrize(("threshold", "hot"), [(0.6, 256), (0.6, 3), (0.34, 5), (1.0, 2)])
def test_similar_sets(spark, threshold, hot):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(14)]
    rows = [(i, rng.choice(["a", "b", None]), rng.choices(vocabulary, k=rng.randrange(7)), rng.sample(["r", "s", "t"], rng.randrange(3))) for i in range(160)]
    rows += [(200 + i, "hot", ["same", "two", f"v{i % 6}", "x"], ["r"]) for i in range(60)] + [(300, "a", None, ["r"]), (301, "a", ["w1"], None), (302, "a", [], ["r", "s"])]
    got = similar_sets(spark.createDataFrame(rows, SETS), threshold, ["place"], hot).collect()
    want = brute_sets(rows, threshold)
    assert len(got) == len(want) and {(r["a"], r["b"]): pytest.approx(r["score"]) for r in got} == want


def test_bullets_that_meet_nobody_leave_first(spark):
    rng = random.Random(5)
    rows = [(i, f"t{i % 4}", rng.choice(["d", "e", None]), rng.choice([rng.sample(["r", "s", f"own{i}"], rng.randrange(3)), ["r", "r"], [f"own{i}"], None]), rng.choices(["x", "y", "z"], k=rng.randrange(4))) for i in range(120)]
    bullets = spark.createDataFrame([*rows, rows[7]], "id long, target string, date string, refs array<string>, words array<string>")
    asked = []

    def worded(left):
        asked.extend(left.collect())
        return left.join(bullets.select("id", "words").distinct(), "id")

    every = similar_sets(bullets.withColumnRenamed("refs", "keys"), 0.6, ["target", "date"])
    shown = lambda df: sorted((r["a"], r["b"], r["score"]) for r in df.collect())
    assert shown(near_duplicate_bullets(bullets)) == shown(every) != []
    assert shown(near_duplicate_bullets(bullets.drop("words"), worded=worded)) == shown(every)
    met = Counter((target, date, k) for _, target, date, refs, _ in [*rows, rows[7]] for k in set(refs or ()))
    assert sorted(r["id"] for r in asked) == sorted(i for i, target, date, refs, _ in [*rows, rows[7]] if any(met[target, date, k] > 1 for k in refs or ()))
    assert len(asked) < len(rows)


def test_similar_sets_of_nothing(spark):
    assert similar_sets(spark.createDataFrame([], SETS), 0.6, ["place"]).count() == 0


def brute_partners(rows, k):
    groups, shared = {}, Counter()
    for c, p in set(rows):
        if c is not None and p is not None:
            groups.setdefault(c, set()).add(p)
    for people in groups.values():
        shared.update((a, b) for a in people for b in people if a != b)
    by = {}
    for (a, b), n in shared.items():
        by.setdefault(a, []).append((-n, b))
    return sorted((a, b, -n, r) for a, v in by.items() for r, (n, b) in enumerate(sorted(v)[:k], 1))


@pytest.mark.parametrize(("large", "k"), [(200, 5), (4, 5), (4, 1), (0, 3)])
def test_partners(spark, large, k):
    rng = random.Random(9)
    rows = [(c, p) for c in range(40) for p in rng.sample(range(50), rng.choice([1, 2, 3, 9, 30]))]
    rows += rows[:9] + [(None, 1), (1, None)] + [(99, p) for p in range(45)]
    got = sorted((r["a"], r["b"], r["shared"], r["rank"]) for r in partners(spark.createDataFrame(rows, "container int, person int"), k, large).collect())
    assert got == brute_partners(rows, k)
    pairs = spark.createDataFrame([(1, 2), (1, 2), (3, 999), (7, 8)], "a int, b int")
    members = {}
    for c, p in rows:
        members.setdefault(c, set()).add(p)
    want = {(a, b): n for a, b in [(1, 2), (7, 8)] if (n := sum(a in m and b in m for c, m in members.items() if c is not None))}
    assert {(r["a"], r["b"]): r["shared"] for r in together(pairs, spark.createDataFrame(rows, "container int, person int")).collect()} == want


def test_a_crowd_is_not_paired(spark):
    """Twenty thousand people in one container, and in a second one, cost k rows each."""
    crowd = spark.range(20_000).selectExpr("explode(array('all', 'also')) container", "id person")
    got = partners(crowd, 3)
    assert got.count() == 60_000 and got.where("shared <> 2").count() == 0


@pytest.mark.parametrize("slab", [4096, 4])
def test_all_partners_equal_brute_force(spark, monkeypatch, slab):
    """Every partner is there, those after the twentieth too."""
    monkeypatch.setattr("threadloom.operators.pairs.SLAB", slab)
    rng = random.Random(11)
    rows = [(c, p) for c in range(30) for p in rng.sample(range(50), rng.choice([1, 2, 3, 9, 30]))] + [(None, 1), (1, None), (0, 0), (0, 0)]
    got = sorted((r["a"], r["b"], r["shared"], r["rank"]) for r in all_partners(spark.createDataFrame(rows, "container int, person int")).collect())
    assert got == brute_partners(rows, None) and max(r[3] for r in got) > 20


ROWS = "id long, place string, words array<string>"


def some_rows():
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), sorted(set(rng.choices("uvwxyz", k=rng.randrange(5))))) for i in range(300)]
    return rows + [(1000 + i, "hot", ["u", "v", "w"] if i % 7 else ["u", "v"]) for i in range(1300)] + [(5000, "a", None), (None, "a", ["u"])]


def likeness(x, y):
    return len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0


def alike(rows):
    """Pairs of rows of one place; nulls leave."""
    whole = [r for r in rows if None not in r]
    return [(*sorted((i, j)), likeness(v, w)) for (i, p, v), (j, q, w) in combinations(whole, 2) if p == q]


def test_similar_classes_and_pairs_equal_brute_force(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, ROWS)
    want = {(a, b) for a, b, s in alike(rows) if s >= 0.6}
    got = [(r["a"], r["b"]) for r in similar_pairs(df, 0.6, ["place"]).collect()]
    assert len(got) == len(want) and set(got) == want
    classed, near = similar_classes(df, 0.6, ["place"])
    assert {(r["id"], r["class"]) for r in classed.collect()} and near.where("score < 0.6").count() == 0
    assert classed.select("class").distinct().count() == near.where("class = other").count()


@pytest.mark.parametrize("most", [None, 0.5])
def test_scored_pairs_equal_brute_force(spark, most):
    rows = some_rows()
    df = spark.createDataFrame(rows, ROWS).where("words is not null").withColumnRenamed("words", "value")
    got = [(r["a"], r["b"], round(r["score"], 6)) for r in scored_pairs(df, ["place"], T.jaccard, most).collect()]
    want = [(a, b, round(s, 6)) for a, b, s in alike(rows) if most is None or s <= most]
    assert sorted(got) == sorted(want)


def test_a_value_that_is_null_is_scored_null(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "a", None)], "id long, place string, value string")
    assert sorted((r["a"], r["b"], r["score"]) for r in scored_pairs(df, ["place"], F.levenshtein).collect()) == [(1, 2, None), (1, 3, None), (2, 3, None)]


@pytest.mark.parametrize("name", ["merge_decisions", "merge_ideas", "merge_knowledge", "merge_opportunities", "similar_fact_join"])
def test_a_title_of_many_copies_is_not_paired(spark, tmp_path, name):
    """A hundred thousand projects of one title and kind would make ten thousand million comparisons."""
    spark.range(100_000).selectExpr("id p_partkey", "if(id % 2 = 0, 'red bolt', 'new red bolt') p_name", "'b' p_brand", "'t' p_type", "1 p_size").write.parquet(str(tmp_path / "part.parquet"))
    got = {r[0]: r[1] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert len(got) == 100_000
    if name == "similar_fact_join":
        assert [got[i] for i in range(5)] == [2, 3, 0, 1, 0]
    else:
        near = {"merge_decisions": 0, "merge_opportunities": 0}.get(name, 1)
        assert set(got.values()) == {0, near}


@pytest.mark.parametrize("name", ["edit_distance", "jaccard", "probable_duplicate_people", "probable_duplicate_projects"])
def test_pairs_of_a_large_group_are_scored_by_lists(spark, tmp_path, name):
    """Copies of a title are compared once a list; the pairs of 6,000 copies are still all there."""
    spark.range(6_000).selectExpr("id p_partkey", "'red bolt' p_name", "'b' p_brand", "'t' p_type", "1 p_size").write.parquet(str(tmp_path / "part.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    assert df.agg(F.count("*")).first()[0] == df.where("a < b").count() == 6_000 * 5_999 // 2
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") >= 2


def one_person(v, w):
    """The rule of similar names, written out."""
    if len(v) < 2 or len(w) < 2:
        return False
    if len(v) <= len(w) and set(v) <= set(w) or len(w) <= len(v) and set(w) <= set(v):
        return True
    f, g = v[0], w[0]
    begins = min(len(f), len(g)) >= 3 and (f.startswith(g) or g.startswith(f))
    edits = f == g or any(f[:i] + f[i + 1 :] in (g, g[:i] + g[i + 1 :]) or f[:i] == g[:i] and f[i:] == g[i + 1 :] for i in range(max(len(f), len(g)) + 1))
    return v[-1] == w[-1] and (begins or edits)


def test_probable_duplicates_equal_brute_force(spark):
    """Tokens of one name in the other, beginnings and single edits of first names; the same company, or someone else whom both meet."""
    rng = random.Random(4)
    names = ["ana ruiz", "ana ruiz gomez", "ruiz ana", "ben cole", "benjamin cole", "bo cole", "jon park", "john park", "jo park", "ann", "ann ann", "ann lee", "lee ann may"]
    people = [(i, (n := rng.choice(names)), n.split(), rng.choice(["x", "y", "z", None])) for i in range(80)] + [(80, None, None, "x"), (81, "", [], "x")]
    members = [(c, p) for c in range(25) for p in rng.sample(range(80), rng.choice([1, 2, 2, 3, 4]))] + [(None, 1), (1, None)]
    meets = {}
    for c, p in members:
        for d, q in members:
            if c == d and c is not None and None not in (p, q) and p != q:
                meets.setdefault(p, set()).add(q)
    similar = [(a, b) for a, b in combinations(people[:80], 2) if one_person(a[2], b[2])]
    same = {(a[0], b[0]) for a, b in similar if a[3] and a[3] == b[3]}
    through = {(a[0], b[0]) for a, b in similar if meets.get(a[0], set()) & meets.get(b[0], set())}
    got = [(r["a"], r["b"]) for r in probable_duplicates(spark.createDataFrame(people, "id long, name string, tokens array<string>, company string"), spark.createDataFrame(members, "container int, person long")).collect()]
    assert len(got) == len(set(got)) and set(got) == same | through and through - same and same - through
