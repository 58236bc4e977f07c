import random

from pyspark.sql import functions as F

from threadloom.operators import privacy as P
from threadloom.operators import records as R
from threadloom.operators.graph import connected_components
from threadloom.operators.identity import stable_ids


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = union_find([(a, b) for a, b in edges if a != b])
    assert got == want


def test_components_of_nothing(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")
    assert connected_components(df).count() == 0


def test_pack_respects_budget_and_loses_nothing(spark):
    rows = [("g", i, 10 + i % 7) for i in range(50)] + [("h", 1, 1000), ("h", 2, 5)]
    got = R.pack_batches(spark.createDataFrame(rows, "g string, i int, tok long"), "g", ["i"], "tok", 60, 4).collect()
    assert len(got) == len(rows)
    sums = {}
    for r in got:
        sums.setdefault((r["g"], r["batch"]), []).append(r["tok"])
    assert all((sum(v) <= 60 or len(v) == 1) and len(v) <= 4 for v in sums.values())


def test_pack_equals_greedy_packing(spark):
    rng = random.Random(8)
    rows = [(g, i, rng.choice([None, 0, 5, 30, 90])) for g in ("a", "b", None) for i in range(40)] + [("c", 1, 500)]
    df = spark.createDataFrame(rows, "g string, i int, tok long")
    want = {}
    for group in ("a", "b", "c", None):
        batch, spent, n = 1, 0, 0
        for _, i, tok in sorted((r for r in rows if r[0] == group), key=lambda r: r[1]):
            if n and (spent + (tok or 0) > 60 or n >= 4):
                batch, spent, n = batch + 1, 0, 0
            spent, n = spent + (tok or 0), n + 1
            want[group, i] = (tok, batch)
    got = R.pack_batches(df.orderBy(F.rand(1)), "g", ["i"], "tok", 60, 4)
    assert got.columns == ["g", "i", "tok", "batch"]
    assert {(r["g"], r["i"]): (r["tok"], r["batch"]) for r in got.collect()} == want
    assert R.pack_batches(df.limit(0), "g", ["i"], "tok", 60, 4).count() == 0


def test_upsert_twice_changes_nothing(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    old = spark.createDataFrame([], "id string, v string").withColumn("ingested_at", at).withColumn("changed_at", at)
    new = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", None, 1)], "id string, v string, seq int")
    first = R.upsert_records(old, new, at, ["v"])
    assert {(r["id"], r["v"], r["action"]) for r in first.collect()} == {("a", "2", "inserted"), ("b", None, "inserted")}
    again = R.upsert_records(first.drop("action"), new, at, ["v"])
    assert {r["action"] for r in again.collect()} == {"unchanged"}


def test_thread_exclusion_is_independent_of_order(spark):
    rows = [("1", "x", True, None), ("2", "x", False, "thread"), ("3", "y", True, None), ("4", "y", False, "record")]
    df = spark.createDataFrame(rows, "id string, thread string, keep boolean, scope string")
    for d in (df, df.orderBy(F.desc("id"))):
        assert [r["id"] for r in P.purge_excluded(d).collect()] == ["3"]


def test_lifecycle_same_day_close_wins(spark):
    rows = [(1, "open", "2024-01-02", 5), (1, "done", "2024-01-02", 1), (2, "done", "2024-01-01", 1), (2, "open", "2024-01-03", 2)]
    df = spark.createDataFrame(rows, "id int, status string, date string, seq int")
    assert {r["id"]: r["status"] for r in R.status_lifecycle(df, "id").collect()} == {1: "done", 2: "open"}


def test_stable_ids_use_each_id_once(spark):
    clusters = spark.createDataFrame([("a", "r1"), ("b", "r1"), ("c", "r2"), ("d", "r3")], "handle string, root string")
    prior = spark.createDataFrame([("a", "p1"), ("b", "p1"), ("c", "p1")], "handle string, person_id string")
    got = {r["root"]: r["person_id"] for r in stable_ids(clusters, prior).collect()}
    assert got["r1"] == "p1" and got["r2"] != "p1" and len(set(got.values())) == 3


def test_nearest_within(spark):
    a = spark.createDataFrame([(1, 1000), (2, 5000)], "id int, at long")
    b = spark.createDataFrame([(7, 1100), (8, 950), (9, 5300)], "rid int, rat long")
    assert [tuple(r) for r in R.nearest_within(a, b).collect()] == [(1, 8, 50)]


def test_mentions_of_texts_with_equal_grams(spark):
    """The last words of a text are one n-gram each, whatever the longest length; repeated texts count once."""
    from threadloom.operators.mentions import entity_mentions

    texts = spark.createDataFrame([(1, "about red bolt and new red bolt"), (1, "about red bolt and new red bolt"), (2, "bolt"), (3, None), (4, "")], "id long, text string")
    names = spark.createDataFrame([("red bolt",), ("new red bolt",), ("bolt",)], "name string")
    assert sorted(tuple(r) for r in entity_mentions(texts, names).collect()) == [(1, "new red bolt", 4), (1, "red bolt", 1), (2, "bolt", 0)]


def test_texts_are_dealt_out_before_they_are_cut(spark):
    from threadloom.operators.mentions import entity_mentions

    texts = spark.createDataFrame([(1, "red bolt")], "id long, text string")
    plan = entity_mentions(texts, spark.createDataFrame([("red bolt",)], "name string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [id") == 2 and "Generate posexplode" in plan


def test_an_address_is_looked_for_once_in_each_of_many_tasks(spark, sf_dir):
    from threadloom.operators.pairs import TASKS
    from threadloom.plans.registry import QUERIES

    df = QUERIES["norm_email"](spark, sf_dir)
    assert df.rdd.getNumPartitions() == TASKS
    assert df._jdf.queryExecution().optimizedPlan().toString().count("@[^") == 1
