"""Parallel packing equals greedy packing, however the rows are sliced."""

import random

import pytest

from threadloom.operators import records as R
from threadloom.operators.packing import pack_batches, placed


def greedy(rows, budget, most):
    out, state = {}, {}
    for group, order, tokens in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2] if r[2] is not None else -1)):
        batch, spent, n = state.get(group, (0, 0, 0))
        size = max(tokens or 0, 0)
        if batch == 0 or spent + size > budget or n >= most:
            batch, spent, n = batch + 1, 0, 0
        state[group] = batch, spent + size, n + 1
        out.setdefault((group, order, tokens), []).append(batch)
    return {k: sorted(v) for k, v in out.items()}


def packed(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["g"], r["o"], r["t"]), []).append(r["batch"])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(("size", "most", "budget"), [(1 << 16, 25, 300), (7, 5, 60), (1, 3, 50), (40, 40, 10_000), (16, 1, 10)])
def test_pack_equals_greedy(spark, size, most, budget):
    rng = random.Random(size)
    rows = [("hot", i, rng.choice([0, 1, 5, 20, 90, None, -3])) for i in range(400)] + [(rng.choice(["a", "b", "c", None]), rng.randrange(60), rng.randrange(80)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, o int, t long")
    assert packed(pack_batches(df, "g", ["o"], "t", budget, most, size)) == greedy(rows, budget, most)


def test_pack_of_nothing_and_one(spark):
    df = spark.createDataFrame([("a", 1, 500)], "g string, o int, t long")
    assert pack_batches(df.limit(0), "g", ["o"], "t", 10, 3).count() == 0 and [r["batch"] for r in pack_batches(df, "g", ["o"], "t", 10, 3).collect()] == [1]


def test_places(spark):
    values = random.Random(1).sample(range(10_000), 3000)
    got = placed(spark.createDataFrame([(v,) for v in values], "v int").repartition(5), ["v"]).collect()
    assert [r["v"] for r in sorted(got, key=lambda r: r["_place"])] == sorted(values) and {r["_place"] for r in got} == set(range(3000))


def test_chunks_are_cut(spark):
    rows = [(k, i, "x" * (i % 50)) for k in (1, 2) for i in range(300)]
    got = R.chunk_lines(spark.createDataFrame(rows, "k int, i int, text string"), "k", "i", 200, 3000).collect()
    by = {}
    for r in got:
        by.setdefault((r["k"], r["chunk"]), []).append((r["i"], r["length"]))
    for k in (1, 2):
        lengths = [i % 50 + 1 for i in range(300)]
        total, want, chunk, spent = 0, {}, 0, 0
        for i, n in enumerate(lengths):
            total += n
            if total > 3000:
                break
            if chunk == 0 or spent + n > 200:
                chunk, spent = chunk + 1, 0
            spent += n
            want.setdefault(chunk, []).append((i, n))
        assert {c: sorted(v) for (kk, c), v in by.items() if kk == k} == want
