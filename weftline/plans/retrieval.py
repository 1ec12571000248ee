"""Ranked retrieval: benchmark passages, or documents' own beginnings, as queries.

The latter (w02, a13) are tokens 5 to 16 of the documents whose id is divisible by 50.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import content_words, tokens
from weftline.operators import index, likeness, passages, search
from weftline.registry import query, table
from weftline.sources.shared import kept

BM25_SQL = """
tok AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
dl AS (SELECT id, len(w) AS dl FROM tok), totals AS (SELECT count(*) AS n, avg(dl) AS mean_dl FROM dl),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM tok) GROUP BY 1, 2),
idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY 1), totals),
mean AS (SELECT avg(raw) AS m FROM idf),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM q) GROUP BY 1, 2),
weights AS (SELECT query_id, term, times * CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS weight FROM asked JOIN idf USING (term), mean),
bm AS (SELECT query_id, id, round(sum(weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean_dl))), 6) AS score
  FROM weights JOIN post USING (term) JOIN dl USING (id), totals GROUP BY 1, 2)"""
ITEMS_SQL = "q AS (SELECT item_id AS query_id, text FROM benchmark)"
TOPK_SQL = "SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM {}) WHERE rank <= {}"
CONTENT_SQL = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ]{4,}'))"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {ITEMS_SQL}, {BM25_SQL} {TOPK_SQL.format('bm', 10)}")
def r01_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept index answers all queries by one pass over its documents' terms, in cells."""
    return index.table_index(spark, sf_dir).best(items(spark, sf_dir), 10)


FILTERED_SQL = "(SELECT bm.* FROM bm JOIN documents ON id = doc_id WHERE lang = 'fr' AND contains(lower(source), '1'))"


@query(f"WITH {ITEMS_SQL}, {BM25_SQL} {TOPK_SQL.format(FILTERED_SQL, 10)}")
def p03_filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters (an equality and a case-insensitive part of a name) choose candidates; statistics stay those of all documents."""
    docs = table(spark, sf_dir, "documents")
    allowed = docs.where((F.col("lang") == "fr") & F.lower("source").contains("1")).select(F.col("doc_id").alias("id"))
    return index.table_index(spark, sf_dir).best(items(spark, sf_dir), 10, allowed)


KNOWN_SQL = "q AS (SELECT doc_id AS query_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')[5:16], ' ') AS text FROM documents WHERE doc_id % 50 = 0)"


def known_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and the rank of the document that each query was taken from; null if it wasn't found.

    Documents that beat the target are counted in cells; no pair of query and document is ever a row.
    """
    docs = table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(tokens(F.col("text")), 5, 12), " ").alias("text"))
    ranked = index.table_index(spark, sf_dir).ranks(asked, asked.select("query_id", F.col("query_id").alias("id")))
    return asked.select("query_id").join(ranked, "query_id", "left")


RANKS_SQL = f"""WITH {KNOWN_SQL}, {BM25_SQL},
ranks AS (SELECT q.query_id, r.rank FROM q LEFT JOIN (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm) r
  ON r.query_id = q.query_id AND r.id = q.query_id)"""


@query(RANKS_SQL + " SELECT query_id, rank FROM ranks")
def w02_rank_of_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_ranks(spark, sf_dir)


@query(RANKS_SQL + """ SELECT count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5,
  round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM ranks""")
def a13_known_item_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    within = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)
    return known_ranks(spark, sf_dir).agg(F.count("*").alias("n"), within(5).alias("recall_5"), within(10).alias("recall_10"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


@query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) """ + TOPK_SQL.format("p", 5))
def r02_dense_in_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of the query's category, by dot product; only they are candidates. Pairs are matrix products in blocks."""
    found = likeness.blocked(table(spark, sf_dir, "embeddings"), 5, group="label", key="vec_id", vector="embedding", asked="vec_id % 20 = 0")
    return found.select(F.col("key").alias("query_id"), "rank", F.col("other").alias("id"), "score")


@query(f"""WITH {ITEMS_SQL}, {BM25_SQL}, c AS (SELECT doc_id AS id, n_chars FROM documents WHERE lang = 'es'),
s AS (SELECT q.query_id, c.id, coalesce(bm.score, 0) AS a, -abs(c.n_chars - 400) AS b FROM q CROSS JOIN c LEFT JOIN bm ON bm.id = c.id AND bm.query_id = q.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, id) - 1 AS r1, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, id) - 1 AS r2 FROM s),
f AS (SELECT *, round(1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2), 9) AS score FROM r)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r1) AS rank, id, score FROM f) WHERE rank <= 10""")
def r03_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 fused with closeness to a length; every document of the language is a candidate of every query, whatever its scores."""
    docs, asked = table(spark, sf_dir, "documents"), items(spark, sf_dir)
    allowed = docs.where("lang = 'es'").select(F.col("doc_id").alias("id"), F.abs(F.col("n_chars") - 400).alias("b"))
    return index.table_index(spark, sf_dir).fused(asked, allowed, "b", 10)


TFIDF_SQL = f"""words AS (SELECT doc_id AS id, lang AS category, unnest({CONTENT_SQL}) AS word FROM documents),
sizes AS (SELECT lang AS category, count(*) AS n FROM documents GROUP BY 1), df AS (SELECT category, word, count(*) AS df FROM words GROUP BY 1, 2),
qw AS (SELECT d.doc_id AS query_id, d.lang AS category, n - 1 AS n, w.word, df - 1 AS df FROM documents d JOIN words w ON w.id = d.doc_id JOIN sizes s ON s.category = d.lang
  JOIN df ON df.category = d.lang AND df.word = w.word WHERE d.doc_id % 100 = 0 AND df > 1),
dots AS (SELECT query_id, w.id, sum(ln(n / df) * ln(n / df)) AS dot FROM qw JOIN words w USING (category, word) WHERE w.id <> query_id GROUP BY 1, 2),
own AS (SELECT query_id, sqrt(sum(ln(n / df) ** 2)) AS qn FROM qw GROUP BY 1),
norms AS (SELECT id, sqrt(sum(ln(n / df) ** 2)) AS norm FROM words JOIN df USING (category, word) JOIN sizes USING (category) GROUP BY 1),
tf AS (SELECT query_id, id, round(dot / (qn * norm), 6) AS score FROM dots JOIN own USING (query_id) JOIN norms USING (id) WHERE dot > 0)"""


def tfidf_scores(spark: SparkSession, sf_dir: str, k: int, sides: DataFrame | None = None) -> DataFrame:
    """Candidates of every hundredth document's ``k`` most alike; with ``sides`` (id, side) those of either side."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("category"), F.col("doc_id").alias("exclude"), "text")
    return search.tfidf(docs, asked, k, sides=sides)


@query(f"WITH {TFIDF_SQL} {TOPK_SQL.format('tf', 8)}")
def r06_tfidf_in_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best(tfidf_scores(spark, sf_dir, 8), ["query_id"], [F.desc("score"), F.col("id")], 8).select("query_id", "rank", "id", "score")


@query(f"""WITH {TFIDF_SQL}, s AS (SELECT tf.*, quality = 1 AS good FROM tf JOIN labels ON id = doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, good ORDER BY score DESC, id) AS r FROM s),
p AS (SELECT *, CASE WHEN r > 3 THEN 2 WHEN good THEN 0 ELSE 1 END AS part FROM r)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY part, score DESC, id) AS rank, id, good, score FROM p) WHERE rank <= 6""")
def r07_balanced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"))
    return search.balanced(tfidf_scores(spark, sf_dir, 6, labels.withColumnRenamed("good", "side")).withColumnRenamed("side", "good").join(labels, ["id", "good"]), "good", 6).select("query_id", "rank", "id", "good", "score")


PROFILES_SQL = f"""c AS (SELECT category, word, count(*) AS c FROM (SELECT lang AS category, unnest({CONTENT_SQL}) AS word FROM documents) GROUP BY 1, 2),
sz AS (SELECT category, sum(c) AS total, count(*) OVER () AS n FROM c GROUP BY 1), sp AS (SELECT word, count(*) AS df FROM c GROUP BY 1),
wt AS (SELECT category, word, round(c / total * ln(n / df), 9) AS weight FROM c JOIN sz USING (category) JOIN sp USING (word)),
prof AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY weight DESC, word) AS rank FROM wt WHERE weight > 0) WHERE rank <= 40)"""


@query(f"WITH {PROFILES_SQL} SELECT category, word, weight, rank FROM prof")
def r09_category_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.profiles(table(spark, sf_dir, "documents"))


@query(f"""WITH {PROFILES_SQL}, w AS (SELECT item_id, unnest({CONTENT_SQL}) AS word FROM benchmark),
s AS (SELECT item_id, category, round(sum(weight), 6) AS score FROM w JOIN prof USING (word) GROUP BY 1, 2)
SELECT * FROM (SELECT item_id, category, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, category) AS rank FROM s WHERE score > 0) WHERE rank <= 3""")
def r09_keyword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(content_words(F.col("text"))).alias("word"))
    scored = words.join(search.profiles(table(spark, sf_dir, "documents")), "word").groupBy("item_id", "category").agg(F.round(F.sum("weight"), 6).alias("score"))
    return search.best(scored.where("score > 0"), ["item_id"], [F.desc("score"), F.col("category")], 3).select("item_id", "category", "score", "rank")


POOL_SQL = """WITH hits AS (SELECT doc_id, 'short' AS found_by, -n_chars AS score FROM documents UNION ALL SELECT doc_id, source, n_chars - 2000 FROM documents WHERE lang <> 'en')
SELECT doc_id, max(score) AS score, arg_max(found_by, (score, found_by)) AS found_by FROM hits GROUP BY 1"""


@query(POOL_SQL)
def u07_pooled_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of several searches: each row once, with its best score and the search that gave it."""
    docs = table(spark, sf_dir, "documents")
    hits = docs.select("doc_id", F.lit("short").alias("found_by"), (-F.col("n_chars")).alias("score")).unionByName(docs.where("lang <> 'en'").select("doc_id", F.col("source").alias("found_by"), (F.col("n_chars") - 2000).alias("score")))
    return hits.groupBy("doc_id").agg(F.max("score").alias("score"), F.max_by("found_by", F.struct("score", "found_by")).alias("found_by"))


@query("""WITH p AS (SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id)
SELECT vec_id, max(s) AS most_alike, count(*) AS before, max(CASE WHEN r <= 5 THEN r END) AS neighbours FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) AS r FROM p) GROUP BY 1""")
def r12_likeness_to_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest likeness of each vector to earlier ones of its category, from the five nearest; pairs are matrix products in blocks, never rows."""
    found = likeness.blocked(table(spark, sf_dir, "embeddings"), 5, group="label", key="vec_id", vector="embedding", earlier=True)
    return found.groupBy(F.col("key").alias("vec_id")).agg(F.max("score").alias("most_alike"), F.max("seen").alias("before"), F.max("rank").alias("neighbours"))


#: Passages of fewer than three tokens are sought nowhere (they have no token that must be whole in a document).
KNOWN_PASSAGES_SQL = f"""{ITEMS_SQL}, {BM25_SQL},
held AS (SELECT query_id, doc_id AS id FROM q JOIN documents d ON contains(d.text, q.text) WHERE len(regexp_extract_all(lower(q.text), '[a-z0-9]+')) >= 3),
own AS (SELECT h.query_id, bm.id, bm.score FROM held h JOIN bm ON bm.query_id = h.query_id AND bm.id = h.id),
first AS (SELECT query_id, max(score) AS s FROM own GROUP BY 1), target AS (SELECT query_id, s, min(id) AS id FROM own JOIN first USING (query_id) WHERE score = s GROUP BY 1, 2),
ranks AS (SELECT q.query_id, (SELECT count(*) FROM held h WHERE h.query_id = q.query_id) AS holders, r.rank FROM q LEFT JOIN
  (SELECT t.query_id, 1 + count(*) FILTER (WHERE bm.score > t.s OR bm.score = t.s AND bm.id < t.id) AS rank FROM target t JOIN bm ON bm.query_id = t.query_id GROUP BY 1) r USING (query_id))"""


def passage_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, holders, rank: of each benchmark passage, how many documents hold it, and where the first of them ranks; null if none does."""
    docs, asked = table(spark, sf_dir, "documents"), items(spark, sf_dir)
    held = kept(passages.holding(docs, asked, passage_id="query_id").select(F.col("passage").alias("query_id"), "id"), "held")
    ranks = index.table_index(spark, sf_dir).ranks(asked, held)
    holders = held.groupBy("query_id").agg(F.count("*").alias("holders"))
    return asked.select("query_id").join(holders, "query_id", "left").join(ranks, "query_id", "left").select("query_id", F.coalesce("holders", F.lit(0)).alias("holders"), "rank")


@query(f"WITH {KNOWN_PASSAGES_SQL} SELECT query_id, holders, rank FROM ranks")
def r05_known_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage is asked for; its targets are the documents that contain it."""
    return passage_ranks(spark, sf_dir)


@query(f"""WITH {KNOWN_PASSAGES_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE holders = 0) AS nowhere, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5,
  round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM ranks""")
def a13_passage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and mean reciprocal rank over all passages; one that no document holds, or that isn't found, is a miss."""
    within = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)
    nowhere = F.count_if(F.col("holders") == 0).alias("nowhere")
    return passage_ranks(spark, sf_dir).agg(F.count("*").alias("n"), nowhere, within(5).alias("recall_5"), within(10).alias("recall_10"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
