import importlib.util

import numpy as np
import pytest

from pyspark.sql import functions as F
from tests.llm.plain import TABLES, base_spans, check_packed, shingle_groups
from weftline.llm import ann, queries


def brute(ids, x, k, is_query):
    for q in ids[is_query]:
        s = (x * x[ids == q][0]).sum(1)
        s[ids == q] = -np.inf
        order = np.lexsort((ids, -s))[:k]
        yield q, ids[order], s[order]


@pytest.mark.parametrize("tables", [TABLES, TABLES.replace("0.001", "0.1")])
def test_recall_and_scores(spark, tables):
    e = spark.read.parquet(f"{tables}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in e]), np.array([r["embedding"] for r in e], float)
    got: dict = {}
    for r in queries.op2_posting_list_search(spark, tables).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q, near, _ in brute(ids, x, 20, ids % 20 == 0):
        own = sorted(got[q])
        assert [r for r, *_ in own] == [*range(1, len(near) + 1)]
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        assert np.allclose([s for *_, s in own], [(x[ids == v][0] * x[ids == q][0]).sum() for _, v, _ in own], rtol=0, atol=1e-12)
        hits += len({v for _, v, _ in own} & {*near.tolist()})
        total += len(near)
    assert hits / total >= 0.9


def of_tables(spark, tables, **how):
    """Recall of a search of a given table, with these parameters."""
    e = spark.read.parquet(f"{tables}/embeddings.parquet")
    rows = e.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(e, F.col("vec_id") % 20 == 0, k=20, **how).collect()}
    want = {(q, v) for q, near, _ in brute(ids, x, 20, ids % 20 == 0) for v in near.tolist()}
    return len(got & want) / len(want), len(got) / len(want)


@pytest.mark.parametrize("floor", [0, 8 << 20])
def test_lists_alone_give_the_answers(spark, monkeypatch, floor):
    """The sample is a quarter of the table; without lists nothing is found."""
    tables = TABLES.replace("0.001", "0.1")
    monkeypatch.setattr(ann, "FLOOR_BYTES", floor)
    recall, share = of_tables(spark, tables, sample_rows=500, list_rows=40)
    assert recall >= 0.9 and share == 1
    monkeypatch.setattr(ann, "matched", lambda dealt, *_: dealt.sparkSession.createDataFrame([], ann.FOUND))
    assert of_tables(spark, tables, sample_rows=500, list_rows=40) == (0, 0)


def test_queries_that_find_too_few_read_all_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "bounds", lambda *_: (1, 1.0))
    monkeypatch.setattr(ann, "least_probes", lambda *_: 1)
    recall, share = of_tables(spark, TABLES, sample_rows=500, list_rows=10)
    assert share == 1 and recall > 0.3


def test_partial_answers_are_merged(spark, monkeypatch):
    monkeypatch.setattr(ann, "MERGED", 2)
    rng = np.random.default_rng(3)
    assert recall(spark, rng.normal(size=(1500, 16)), 50, parts=7) >= 0.9


def test_odd_vectors(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], "a") for i in range(60)]
    rows += [(100, None, "b"), (120, [0.0, 0.0, 0.0], "c"), (140, [1.0, None, 2.0], "d"), (160, [1.0, float("nan"), 0.0], "e"), (180, [float("inf"), 0.0, 0.0], "f"), (200, [1.0, 2.0], "g"), (None, [1.0, 1.0, 1.0], "h"), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string").repartition(3)
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=20).collect()
    ids, x = np.arange(60), np.array([r[1] for r in rows[:60]])
    want = {(q, k + 1, v, s) for q, near, scores in brute(ids, x, 20, ids % 20 == 0) for k, (v, s) in enumerate(zip(near.tolist(), scores.tolist(), strict=True))}
    assert {tuple(r) for r in got} == want
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(df.where("vec_id < 5"), F.col("vec_id") == 0, k=20)
    assert few.count() == 4


def test_dense_lists_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    rows = [(i, [1.0, float(i % 5) / 10]) for i in range(800)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=20, list_rows=10_000)
    per = got.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("d")).collect()
    assert len(per) == 40 and {(r["n"], r["d"]) for r in per} == {(20, 20)}


def recall(spark, x, list_rows, parts=3):
    """The share of true neighbours that a search of each 20th row finds."""
    ids = np.arange(len(x))
    df = spark.createDataFrame([(i, v) for i, v in zip(ids.tolist(), x.tolist(), strict=True)], "vec_id long, embedding array<double>").repartition(parts)
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 20 == 0, k=20, list_rows=list_rows).collect()}
    want = {(q, v) for q, near, _ in brute(ids, x, 20, ids % 20 == 0) for v in near.tolist()}
    return len(got & want) / len(want)


def varied(n, dim, spread, seed=1):
    """Directions without any order, lengths of log-normal ``spread``."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * rng.lognormal(0, spread, (n, 1))


def test_recall_with_varied_lengths(spark):
    assert recall(spark, varied(4000, 16, 0.5), 40) >= 0.9  # 128 lists, at most 48 of them read


def test_recall_with_far_more_lists_than_probes(spark):
    assert recall(spark, varied(4000, 16, 0), 20) >= 0.93  # 256 lists; within the first ratio lie about 13


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline
    from weftline.llm import langid, quality
    from weftline.llm.common import table

    docs = table(spark, TABLES, "documents")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], TABLES).cache())
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in seen[:-1]]
    trees = quality.train(docs, table(spark, TABLES, "labels"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {i for i in ids[0] if trees.score(np.array([quality.statistics(text[i])]))[0] >= quality.THRESHOLD}
    assert ids[1] == good and len(good) < len(text)
    model = langid.train(seen[1])
    words = langid.WordScores(model)
    known = set()
    for i in good:
        ((found, label),) = langid.labelled([text[i]], model, words, langid.SWITCH)
        shares = np.bincount(label, [*map(len, found)]) if found else np.zeros(1)
        known |= {i} if shares.sum() and shares.max() >= 0.3 * shares.sum() else set()
    assert ids[2] == known
    rows = sorted((i, text[i]) for i in known)
    least: dict = {}
    for (i, _), g in zip(rows, shingle_groups(rows), strict=True):
        least[g] = min(least.get(g, i), i)
    assert ids[3] == {*least.values()} == ids[4]
    clean = {r["doc_id"]: r for r in seen[4].collect()}
    for i in ids[4]:
        assert base_spans(clean[i]["text"]) == [] and clean[i]["n_chars"] == len(clean[i]["text"])
        assert clean[i]["text"] == text[i] or base_spans(text[i])
    check_packed([(i, r["text"]) for i, r in clean.items()], seen[5].collect())
    last = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    total = lambda df: sum(r["length"] for r in df.collect())
    again = corpus_pipeline.run(spark, TABLES)
    assert total(again) == total(seen[5]) and {r[0] for r in last(again)} == ids[4]
