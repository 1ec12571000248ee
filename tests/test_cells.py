"""Scores in cells: results of plain scoring, whatever the blocks, and no row of pairs."""

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_index import asked, corpus, rows
from weftline.operators import cells, index, search
from weftline.plans import ORACLES, QUERIES
from weftline.sources import shared


@pytest.mark.parametrize("terms", [300, 10**6])
def test_best_and_ranks_are_those_of_plain_scoring(spark, tmp_path, monkeypatch, terms):
    monkeypatch.setattr(cells, "DOC_TERMS", terms)
    monkeypatch.setattr(cells, "QUERY_TERMS", terms // 10)
    docs = corpus(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    docs = docs.unionByName(docs.where("doc_id % 9 = 0").withColumn("doc_id", F.col("doc_id") + 1000)).localCheckpoint()  # copies tie
    queries = asked(spark).where("query_id IS NOT NULL")
    made = index.build_or_open(docs, str(tmp_path / "index"))
    everything = search.bm25(docs, queries).localCheckpoint()
    want = lambda found, k: rows(search.best(found, ["query_id"], [F.desc("score"), F.col("id")], k).select("query_id", "rank", "id", "score"))
    assert rows(made.best(queries, 3)) == want(everything, 3) and rows(made.best(queries, 10**6)) == want(everything, 10**6)
    among = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    assert rows(made.best(queries, 5, among)) == want(everything.where("id % 2 = 0"), 5)
    held = spark.createDataFrame([(1, 17), (1, 18), (1, 1018), (2, 400), (6, 9), (6, 1009), (6, 77)], "query_id long, id long")
    placed = {(r["query_id"], r["id"]): r["rank"] for r in search.best(everything, ["query_id"], [F.desc("score"), F.col("id")], 10**6).collect()}
    first = {}
    for r in held.collect():
        if (r["query_id"], r["id"]) in placed:
            first[r["query_id"]] = min(first.get(r["query_id"], 10**9), placed[r["query_id"], r["id"]])
    assert {r["query_id"]: r["rank"] for r in made.ranks(queries, held).collect()} == first and first


def test_no_postings_are_written_and_no_pairs_are_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index.Index, "scores", lambda *a: pytest.fail("a row for each pair of query and document"))
    docs = corpus(spark)
    made = index.build_or_open(docs, str(tmp_path / "index"))
    queries = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "text")
    made.best(queries, 3).collect()
    ranks = made.ranks(queries, queries.select("query_id", F.col("query_id").alias("id")))
    assert ranks.count() and not shared.exists(spark, f"{made.path}/blocks")
    beaten = cells.folded(made.documents(), made.asked(queries).withColumn("own_score", F.lit(0.0)).withColumn("own_id", F.lit(0).cast("long")), index.saturated, cells.beaten, cells.BEATEN)
    seen = beaten.count()
    assert seen <= queries.count()  # a row a query and block of documents


def test_blocks_come_when_they_are_asked_for_and_stay(spark, tmp_path):
    made = index.build_or_open(corpus(spark), str(tmp_path / "index"))
    found = rows(made.top(asked(spark), 3))
    assert shared.exists(spark, f"{made.path}/blocks") and rows(made.top(asked(spark), 3)) == found
    made.make_blocks()  # another reader's come too late
    assert rows(made.top(asked(spark), 3)) == found


def test_weights_of_nothing_and_below_it(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a b"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b"), (2, "b"), (3, "none"), (4, None)], "query_id long, text string")
    made = index.build_or_open(docs, str(tmp_path / "index"))
    want = search.best(search.bm25(docs, queries), ["query_id"], [F.desc("score"), F.col("id")], 9).select("query_id", "rank", "id", "score")
    assert rows(made.best(queries, 9)) == rows(want)
    empty = index.build_or_open(docs.limit(0), str(tmp_path / "empty"))
    assert empty.best(queries).count() == 0 and empty.ranks(queries, queries.select("query_id", F.lit(1).cast("long").alias("id"))).count() == 0


@pytest.mark.parametrize("terms", [400, 10**6])
def test_cosines_of_a_category_are_those_of_a_plain_pass(spark, monkeypatch, terms):
    monkeypatch.setattr(cells, "DOC_TERMS", terms)
    monkeypatch.setattr(cells, "QUERY_TERMS", terms // 4)
    rng, words = random.Random(5), [a + b + "words" for a in "abcdefgh" for b in "stuvwxyz"]
    texts = [(i, rng.choice(["en", "fr"]), " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(120)]
    texts += [(i + 1000, lang, text) for i, lang, text in texts[::5]] + [(5000, "en", None), (5001, None, "aswords")]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    asked = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("category"), F.col("doc_id").alias("exclude"), "text")
    sets = {i: (lang, set((text or "").split())) for i, lang, text in texts}
    df = {lang: Counter(w for other, s in sets.values() if other == lang for w in s) for lang in ("en", "fr")}
    n = Counter(lang for lang, _ in sets.values())
    want = {}
    for i, (lang, own) in sets.items():
        if i % 3 == 0 and lang:
            q = {w: math.log((n[lang] - 1) / (df[lang][w] - 1)) ** 2 for w in own if df[lang][w] > 1}
            for j, (other, s) in sets.items():
                dot = sum(q.get(w, 0) for w in s) if other == lang and j != i else 0
                if dot > 0:
                    want[i, j] = dot / (math.sqrt(sum(q.values())) * math.sqrt(sum(math.log(n[lang] / df[lang][w]) ** 2 for w in s)))
    got = {(r["query_id"], r["id"]): r["score"] for r in search.tfidf(docs, asked, 10**6).collect()}
    assert got == pytest.approx(want, abs=2e-6) and len(want) > 1000
    best = search.best(search.tfidf(docs, asked, 4), ["query_id"], [F.desc("score"), F.col("id")], 4)
    everything = search.best(search.tfidf(docs, asked, 10**6), ["query_id"], [F.desc("score"), F.col("id")], 4)
    assert rows(best) == rows(everything)
    sides = docs.where("doc_id % 4 <> 1").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2 == 0).alias("side"))
    of_sides = search.tfidf(docs, asked, 10**6, sides=sides).collect()
    assert {(r["query_id"], r["id"]): r["side"] for r in of_sides} == {(i, j): j % 2 == 0 for i, j in got if j % 4 != 1}


def shuffled(spark) -> int:
    """Bytes that the session's stages have written for shuffles."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))


def test_words_of_cosines_are_not_shuffled_one_by_one(spark, tmp_path):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(2000)]
    texts = [(i, rng.choice(["en", "fr"]), " ".join(rng.sample(words, 300))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string").repartition(4)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("category"), F.col("doc_id").alias("exclude"), "text")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # no table is small
    try:
        before = shuffled(spark)
        assert search.best(search.tfidf(docs, asked, 4), ["query_id"], [F.desc("score"), F.col("id")], 4).count() == 4 * 8
        made = shuffled(spark) - before
        assert made < 20 * 400 * 300, made  # a hash a word of a document is 8, words one by one would be 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("terms", [200, 10**6])
def test_cosines_of_odd_ids_are_those_of_sql(spark, tmp_path, monkeypatch, terms):
    """Ids that stand twice, in one category or in two, null ids, texts and categories, words of all documents or of one."""
    monkeypatch.setattr(cells, "DOC_TERMS", terms)
    monkeypatch.setattr(cells, "QUERY_TERMS", terms // 4)
    monkeypatch.setattr(cells, "PART_WORDS", max(terms // 20, 4))
    monkeypatch.setattr(cells, "BATCH", 3)
    rng, words = random.Random(11), [a + b + "words" for a in "abcdefghij" for b in "stuvwxyz"]
    texts = [(i, rng.choice(["en", "fr", "es"]), "everywhere " + " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(50, 450)]
    texts += [(i, rng.choice(["en", "fr"]), " ".join(rng.choices(words, k=20))) for i in range(52, 90) if i % 50]
    texts += [(None, "en", "aswords bswords"), (None, "fr", None), (901, "en", None), (902, None, "aswords"), (1000, "de", "aswords"), (1100, "en", "onlyhere"), (1200, "es", "")]
    spark.createDataFrame(texts, "doc_id long, lang string, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, rng.choice([0, 1]), 0) for i in range(50, 400) if i % 7] + [(None, 1, 0), (2000, 0, 0), (901, 1, 0), (55, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("r06_tfidf_in_category", "r07_balanced_topk"):
        with duckdb.connect() as db:
            for t in ("documents", "labels"):
                db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
            want = db.execute(ORACLES[name]).fetchall()
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want) and want


def test_fusion_in_cells_is_that_of_all_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "DOC_TERMS", 1500)
    docs = corpus(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).localCheckpoint()
    queries = asked(spark).where("query_id IS NOT NULL")
    made = index.build_or_open(docs, str(tmp_path / "index"))
    allowed = docs.where("doc_id % 3 > 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 7 % 50).alias("b"))
    pairs = queries.select("query_id").crossJoin(allowed).join(search.bm25(docs, queries), ["query_id", "id"], "left").fillna(0.0, ["score"])
    want = search.fused(pairs.withColumn("b", -F.col("b")), "score", "b", 10)
    assert rows(made.fused(queries, allowed, "b", 10)) == rows(want) and not shared.exists(spark, f"{made.path}/blocks")
