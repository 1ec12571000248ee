"""The kept index: results of a plain scoring, versions, and what is read."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import index, search
from weftline.sources import shared


def corpus(spark, seed=3, n=400):
    rng = random.Random(seed)
    words = [f"w{int(rng.expovariate(0.02))}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 80)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (None, "w1 w2 w3"), (5, "w1 w1 w4")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def asked(spark):
    return spark.createDataFrame([(1, "w1 w2 w2 w40"), (2, "w3 nowhere"), (3, None), (4, "nowhere"), (None, "w10 w11 w12 w13"), (6, " ".join(f"w{i}" for i in range(60)))], "query_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("range_rows", [1, 128])
def test_best_and_scores_are_those_of_plain_scoring(spark, tmp_path, monkeypatch, range_rows):
    monkeypatch.setattr(index, "RANGE_ROWS", range_rows)
    docs, queries = corpus(spark), asked(spark)
    made = index.build_or_open(docs, str(tmp_path / "index"))
    want = search.bm25(docs, queries)
    got = {(r["query_id"], r["id"]): r["score"] for r in made.scores(queries).collect()}
    assert got == pytest.approx({(r["query_id"], r["id"]): r["score"] for r in want.collect()}, abs=2e-6)
    for k in (3, 1000):
        everything = search.best(made.scores(queries), ["query_id"], [F.desc("score"), F.col("id")], k).select("query_id", "rank", "id", "score")
        assert rows(made.top(queries, k)) == rows(everything)


def test_versions_are_kept_until_content_changes(spark, tmp_path):
    docs, path = corpus(spark), str(tmp_path / "index")
    one = index.build_or_open(docs, path)
    assert index.build_or_open(docs.repartition(7), path) == one
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 9, F.lit("w1 changed")).otherwise(F.col("text")))
    two = index.build_or_open(changed, path)
    assert two.path != one.path and index.build_or_open(changed, path) == two
    queries = spark.createDataFrame([(1, "changed")], "query_id long, text string")
    assert [r["id"] for r in two.top(queries).collect()] == [9] and one.top(queries).count() == 0
    three = index.build_or_open(docs, path)
    assert not shared.exists(spark, one.path) and shared.exists(spark, two.path) and three.n_docs == one.n_docs
    assert index.build_or_open(docs, path, force=True).path != three.path


def test_only_asked_buckets_are_read(spark, tmp_path):
    made = index.build_or_open(corpus(spark), str(tmp_path / "index"))
    weights = made.weights(spark.createDataFrame([(1, "w1 w2")], "query_id long, text string"))
    wanted = {r["bucket"] for r in weights.collect()}
    part = made.part("blocks", weights)
    assert {r["bucket"] for r in part.select("bucket").distinct().collect()} == wanted and len(wanted) <= 2
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") and "FileScan" in plan


def test_blocks_that_cannot_count_are_left_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "RANGE_ROWS", 4)
    made = index.build_or_open(corpus(spark, n=1500), str(tmp_path / "index"))
    seen = []
    summed = index.Index.summed
    monkeypatch.setattr(index.Index, "summed", lambda self, blocks: seen.append(blocks.count()) or summed(self, blocks))
    queries = spark.createDataFrame([(1, "w1 w30 w77")], "query_id long, text string")
    made.top(queries, 3).collect()
    looked = sum(seen)
    made.scores(queries).collect()
    assert looked < seen[-1] / 2


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    made = index.build_or_open(docs, str(tmp_path / "index"))
    assert made.top(asked(spark)).count() == 0 and made.scores(asked(spark)).count() == 0
    full = index.build_or_open(corpus(spark), str(tmp_path / "other"))
    assert full.top(asked(spark).limit(0)).count() == 0


def test_terms_are_counted_in_the_row(spark):
    r = spark.createDataFrame([("b a B! c2 a a",), (None,), ("",)], "t string").select(index.counted_terms(F.col("t")).alias("x")).collect()
    assert [(x["term"], x["tf"]) for x in r[0]["x"]] == [("a", 3), ("b", 2), ("c2", 1)] and r[1]["x"] == [] and r[2]["x"] == []
