"""Functions and operators on rows whose results are known."""

import uuid
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import permutation, stats
from weftline.functions import text as tx
from weftline.operators import select
from weftline.plans import QUERIES


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("column", "value", "want"),
    [
        (lambda: tx.tokens(F.col("v")), "Él 2nd-hand CO2", ["l", "2nd", "hand", "co2"]),
        (lambda: tx.content_words(F.col("v"), ("with",)), "Été with été words, and naïve", ["words", "naïve"]),
        (lambda: tx.surname(F.col("v")), "Smith, Jr.", "Smith"),
        (lambda: tx.surname(F.col("v")), "Ann B. LEE III", "LEE"),
        (lambda: tx.surname(F.col("v")), "", None),
        (lambda: tx.title_case(F.col("v")), "the CITY of  los-angeles", "The City of Los-angeles"),
        (lambda: tx.citation(F.col("v")), "Ed. Code  §  44955 (a), x", "ed. code § 44955"),
        (lambda: tx.citation(F.col("v")), "Ed. Code, § 44955", "ed. code"),
        (lambda: tx.letters_only(F.col("v")), "José 2", "jos"),
        (lambda: tx.digits_only(F.col("v")), "N-1999 05", "199905"),
        (lambda: tx.without_lines(F.col("v"), "APPLICATION"), "a\napplication: b\nc", "a\nc"),
        (lambda: tx.capital_spans(F.col("v"), ("The",)), "The end. Ann Lee met Bob", ["Ann Lee", "Bob"]),
    ],
)
def test_text_functions(spark, column, value, want):
    got = one(spark, column(), v=value)
    assert (sorted(got) if isinstance(want, list) and "naïve" in want else got) == (sorted(want) if isinstance(want, list) and "naïve" in want else want)


def test_own_name_and_near_names(spark):
    assert one(spark, tx.names_itself(F.col("t"), F.col("n")), t="by Lee (ALJ)", n="Lee") and not one(spark, tx.names_itself(F.col("t"), F.col("n")), t="Leeds", n="Lee")
    assert one(spark, tx.near_equal(F.col("a"), F.col("b")), a="smith", b="smyth") and not one(spark, tx.near_equal(F.col("a"), F.col("b")), a="smith", b="smythe")


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "k long, n long")
    got = [tuple(r) for r in df.select(*stats.wilson(F.col("k"), F.col("n"))).collect()]
    assert got[0] == (0, 1) and got[2][1] == pytest.approx(1) and got[1] == (pytest.approx(0.2366, abs=1e-4), pytest.approx(0.7634, abs=1e-4))


def test_binomial_against_the_definition(spark):
    cases = [(k, n, p) for n in (0, 1, 9, 60) for k in {0, n // 3, n} for p in (0.1, 0.5)]
    got = {(r["k"], r["n"], r["p0"]): r["p"] for r in stats.binomial_p(spark.createDataFrame(cases, "k long, n long, p0 double"), "k", "n", "p0").collect()}
    for k, n, p in cases:
        pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        assert got[k, n, p] == pytest.approx(min(1, sum(x for x in pmf if x <= pmf[k] * (1 + 1e-9))), abs=1e-9)


def test_step_up_by_hand(spark):
    df = spark.createDataFrame([*enumerate([0.001, 0.04, 0.03, 0.9])], "i long, p double")
    got = {r["i"]: (round(r["q_value"], 6), r["reject"]) for r in stats.step_up(df, "p").collect()}
    assert got == {0: (0.004, True), 1: (0.053333, False), 2: (0.053333, False), 3: (0.9, False)}


def test_shuffles_keep_each_stratum(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(60)], "id long, s long, won long")
    got = stats.shuffled_labels(df, "id", "won", "s", 4).groupBy("turn", "s").agg(F.sum("won").alias("k"), F.count("*").alias("n")).collect()
    assert {(r["k"], r["n"]) for r in got} == {(10, 20)} and len(got) == 12


def test_greedy_choice_against_one_pass(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    order = sorted(e, key=lambda r: (-(r["vec_id"] * 7919 % 1000), r["vec_id"]))
    chosen = []
    for r in order:
        x = np.array(r["embedding"], float)
        if all(c["label"] != r["label"] or np.dot(c["embedding"], x) < 0.4 * np.linalg.norm(c["embedding"]) * np.linalg.norm(x) for c in chosen):
            chosen.append(r)
    got = {r["vec_id"] for r in QUERIES["r11_distinct_greedy"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {r["vec_id"] for r in chosen[:100]}


def test_greedy_choice_of_odd_rows(spark):
    rows = [(1, None, 0.9, [1.0, 0.0]), (2, None, 0.8, [1.0, 0.0]), (3, "a", 0.7, None), (4, "a", 0.6, [0.0, 0.0]), (5, "a", 0.5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, c string, s double, v array<double>")
    assert [r["id"] for r in select.distinct_greedy(df, "id", "c", "s", "v", 0.9, 3).collect()] == [1, 3, 4]
    assert select.distinct_greedy(df.limit(0), "id", "c", "s", "v", 0.9, 3).count() == 0


def test_step_up_over_many_ranges(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(3000) ** 3, 4)
    order = np.argsort(p, kind="stable")
    ratio = p[order] * len(p) / np.arange(1, len(p) + 1)
    want = np.empty(len(p))
    want[order] = np.minimum(1, np.minimum.accumulate(ratio[::-1])[::-1])
    last = max((x for x, r in zip(p[order], ratio, strict=True) if r <= 0.05), default=-1)
    df = spark.createDataFrame([*enumerate(p.tolist()), (-1, None)], "i long, p double")
    got = {r["i"]: (r["q_value"], r["reject"]) for r in stats.step_up(df, "p", ranges=7).collect()}
    assert got.pop(-1) == (None, None) and len(got) == len(p)
    assert np.allclose([got[i][0] for i in range(len(p))], want) and [got[i][1] for i in range(len(p))] == (p <= last).tolist()


def test_binomial_at_sure_rates(spark):
    df = spark.createDataFrame([(3, 3, 1.0), (0, 4, 0.0), (2, 2, 0.5)], "k long, n long, p0 double")
    assert [r["p"] for r in stats.binomial_p(df, "k", "n", "p0").orderBy("p0").collect()] == [1.0, 0.5, 1.0]


@pytest.mark.parametrize("blocks", [1, 5])
def test_permutation_against_shuffles(spark, blocks):
    rng = np.random.default_rng(2)
    entity, stratum, label = rng.choice(12, 400, p=[0.4, *[0.6 / 11] * 11]), rng.integers(0, 3, 400), rng.integers(0, 3, 400)
    cells = pd.DataFrame({"e": entity, "s": stratum, "l": label}).value_counts().reset_index(name="n")

    def chi2(labels):
        seen = np.histogram2d(entity, labels, (12, 3))[0]
        expected = seen.sum(1, keepdims=True) * seen.sum(0) / seen.sum()
        return ((seen - expected) ** 2 / expected).sum()

    plain = []
    for _ in range(1500):
        dealt = label.copy()
        for s in range(3):
            dealt[stratum == s] = rng.permutation(dealt[stratum == s])
        plain.append(chi2(dealt))
    drawn = {r["turn"]: r["chi2"] for r in permutation.shuffled_chi2(spark.createDataFrame(cells), "e", "s", "l", "n", turns=1500, blocks=blocks).collect()}
    assert len(drawn) == 1501 and abs(drawn.pop(0) - chi2(label)) < 1e-9
    assert abs(np.mean([*drawn.values()]) - np.mean(plain)) < 5 * np.std(plain) * (2 / 1500) ** 0.5
    assert abs(np.std([*drawn.values()]) / np.std(plain) - 1) < 0.15
    assert permutation.shuffled_chi2(spark.createDataFrame(cells).limit(0), "e", "s", "l", "n").count() == 0


def test_few_cases_are_dealt_as_shuffles_deal_them(monkeypatch):
    rng = np.random.default_rng(4)
    sizes, labels = np.array([[3, 2, 1, 300], [0, 1, 2, 2]]), [np.tile([200, 100, 6], (4000, 1)), np.tile([3, 1, 1], (4000, 1))]
    drawn = np.concatenate([*permutation.shuffles(rng, sizes, labels)], axis=1)
    assert drawn.min() >= 0 and (drawn.sum(0) == sizes.sum(0)).all() and (drawn.sum(2).T == labels[0][0] + labels[1][0]).all()
    # means and variances are those of hypergeometric counts, summed over strata
    for c in range(3):
        mean = var = 0
        for n, own in zip(sizes, labels, strict=True):
            total, p = n.sum(), own[0][c] / n.sum()
            mean, var = mean + n * p, var + n * p * (1 - p) * (total - n) / (total - 1)
        assert (abs(drawn[c].mean(0) - mean) < 5 * np.sqrt(var / 4000)).all() and (abs(drawn[c].var(0) / var - 1) < 0.25).all()
    # arrangements of four cases are as likely as each other
    found = permutation.dealt(rng, np.array([2, 1, 1]), np.tile([2, 2], (12000, 1)))[0]
    _, seen = np.unique(found, axis=0, return_counts=True)
    assert sorted(seen) == pytest.approx([2000, 2000, 4000, 4000], rel=0.1)

    def drawn_alone(*args):
        raise AssertionError("a draw for one entity of few cases")

    monkeypatch.setattr(permutation, "split", drawn_alone)
    assert sum(x.shape[1] for x in permutation.shuffles(rng, sizes[:, :3], [np.tile([4, 2], (25, 1)), np.tile([1, 2], (25, 1))])) == 25


def test_tested_makes_shuffles_once(spark, tmp_path):
    def run(batches):
        for b in batches:
            (tmp_path / str(uuid.uuid4())).touch()
            yield b

    drawn = spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 3.0), (3, 2.0)], "turn int, chi2 double").coalesce(1).mapInPandas(run, "turn int, chi2 double")
    assert tuple(permutation.tested(drawn).first()) == (2.0, 2.0, 3, 0.75)
    assert len([*tmp_path.iterdir()]) == 1
    assert tuple(permutation.tested(drawn.limit(0)).first()) == (None, None, 0, 1.0)
