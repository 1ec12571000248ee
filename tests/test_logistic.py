"""The regression against a plain Newton fit; places, likeness and passages on odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from weftline.operators import likeness, logistic, passages, select


def plain_fit(x, y, balanced=True, penalty=1.0):
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-12, x.std(0), 1)
    z = np.c_[z, np.ones(len(z))]
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum())) if balanced else np.ones(len(y))
    ridge, beta = np.diag([penalty] * x.shape[1] + [0.0]), np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ beta))
        step = np.linalg.solve((z.T * (w * p * (1 - p))) @ z + ridge, z.T @ (w * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-12:
            break
    return beta, 1 / (1 + np.exp(-z @ beta))


def test_coefficients_and_scores(spark):
    rng = np.random.default_rng(2)
    n = 400
    x, kind = rng.normal(size=(n, 3)) * [1, 10, 0.1], rng.integers(0, 3, n)
    y = (x @ [0.5, 0.05, -3] + (kind == 2) + rng.logistic(size=n) > 0.8).astype(int)
    rows = [(i, *map(float, x[i]), "abc"[kind[i]], int(y[i])) for i in range(n)] + [(n, None, 1.0, 2.0, None, None)]
    table = spark.createDataFrame(rows, "id long, p double, q double, r double, kind string, y int").repartition(3)
    data, names = logistic.ready(table, ["p", "q", "r"], "kind", F.col("id") % 4, "y", "id")
    assert names == ["p", "q", "r", "b", "c"]
    beta, mean, spread = logistic.fitted(data, 5, 4)
    whole = np.c_[x, kind == 1, kind == 2].astype(float)
    got = {r["key"]: r["score"] for r in logistic.out_of_fold(data, beta, mean, spread).collect()}
    for fold in range(5):
        own = np.arange(n) % 4 != fold
        want, _ = plain_fit(whole[own], y[own])
        assert np.abs(beta[fold] - want).max() < 1e-6
    raw = beta[1][:-1] / spread[1]
    assert np.isclose(got[5], 1 / (1 + np.exp(-(whole[5] @ raw + beta[1][-1] - raw @ mean[1]))), atol=1e-12) and len(got) == n + 1
    one = logistic.fitted(data.where("y = 1"), 5, 4)[0]
    assert (one == 0).all() and (logistic.fitted(data.limit(0), 5, 4)[0] == 0).all()


def test_places_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a"] * 9 + ["b", None, "c"]), i, rng.choice((0, 1, 5, None))) for i in range(3000)]
    table = spark.createDataFrame(rows, "g string, i long, w long").repartition(5)
    for weight in (None, "w"):
        seen, want = {}, {}
        for g, i, w in sorted(rows, key=lambda r: r[1]):
            want[i] = seen.get(g, 0)
            seen[g] = want[i] + (1 if weight is None else w or 0)
        assert {r["i"]: r["before"] for r in select.before(table, "g", ["i"], weight).collect()} == want
    assert select.before(table.limit(0), "g", ["i"]).count() == 0


def test_likeness_in_blocks(spark):
    rng = np.random.default_rng(4)
    x, group = np.round(rng.normal(size=(300, 4)), 1), rng.integers(0, 3, 300)
    rows = [(i, int(group[i]), x[i].tolist()) for i in range(300)] + [(900, None, [1.0] * 4), (901, 0, None), (None, 0, [1.0] * 4), (902, 7, [1.0] * 4)]
    table = spark.createDataFrame(rows, "id long, g int, v array<double>").repartition(4)
    for block_rows in (7, 2048):
        for earlier in (False, True):
            found = likeness.blocked(table, 3, group="g", key="id", vector="v", asked="id % 4 = 0", earlier=earlier, block_rows=block_rows)
            got = sorted((r["key"], r["rank"], r["other"], r["seen"]) for r in found.collect())
            want = []
            for i in range(0, 300, 4):
                others = [j for j in range(300) if group[j] == group[i] and (j < i if earlier else j != i)]
                best = sorted(others, key=lambda j: (-round(float(x[i] @ x[j]), 6), j))[:3]
                want += [(i, k + 1, j, len(others)) for k, j in enumerate(best)]
            assert got == want


def test_passages_in_documents(spark):
    docs = [(1, "Say: the quick brown fox jumps over it"), (2, "xthe quick brown fox jumpsy"), (3, "the quick red fox jumps"), (4, None), (5, ""), (2, "xthe quick brown fox jumpsy"), (6, "The quick brown fox jumps"), (7, "a b c d")]
    asked = [(1, "the quick brown fox jumps"), (2, None), (3, "two words"), (4, "a b c"), (5, "nowhere to be found"), (6, "")]
    found = passages.holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string"))
    assert sorted(map(tuple, found.distinct().collect())) == sorted((i, d) for i, t in asked for d, x in set(docs) if t and x and t in x and len(t.split()) > 2)
    assert passages.holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string").limit(0)).count() == 0
