"""Ranked retrieval of documents for tables of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import content_words, tokens
from weftline.operators import cells
from weftline.operators.select import before
from weftline.sources.shared import kept

K1, B, EPSILON, RRF = 1.5, 0.75, 0.25, 60


def best(scored: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank, from 1."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, dl, term, tf."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    return words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, id, score (6 digits) of the documents that share a term with a query (query_id, text).

    Statistics are of all documents, whatever is filtered later. A term in over half of them weighs a
    quarter of the mean weight. A query's repeated terms count each time.
    """
    terms = postings(docs, id_col, text_col)
    totals = docs.select(F.size(tokens(F.col(text_col))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("mean_dl"))
    idf = terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(totals))  # one row
    idf = idf.select("term", "mean_dl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = idf.agg(F.avg("raw").alias("mean_idf"))
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weights = asked.join(idf, "term").crossJoin(F.broadcast(mean))  # one row
    weights = weights.select("query_id", F.col("term").alias("t"), "mean_dl", (F.col("times") * F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))).alias("weight"))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean_dl")))
    return terms.join(weights, F.col("term") == F.col("t")).groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, **columns: str) -> DataFrame:
    """query_id, rank, id, score; ties go to the smaller id."""
    return best(bm25(docs, queries, **columns), ["query_id"], [F.desc("score"), F.col("id")], k).select("query_id", "rank", "id", "score")


def fused(signals: DataFrame, first: str, second: str, k: int) -> DataFrame:
    """Reciprocal-rank fusion of two scores over each query's candidates (query_id, id): every candidate is ranked from 0 by either."""
    by = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), F.col("id"))) - 1
    both = signals.withColumn("r1", by(first)).withColumn("r2", by(second))
    both = both.withColumn("score", F.round(1 / (RRF + F.col("r1")) + 1 / (RRF + F.col("r2")), 9))
    return best(both, ["query_id"], [F.desc("score"), F.col("r1")], k).select("query_id", "rank", "id", "score")


def fused_with_order(queries: DataFrame, scored: DataFrame, allowed: DataFrame, order: str, k: int) -> DataFrame:
    """Reciprocal-rank fusion of each query's scores (query_id, id, score) with an order that all queries share (allowed: id and ``order``, ascending).

    All allowed rows are candidates of each query; those without a positive score follow by id. They needn't be
    paired: beyond the first 60 + 2k by either order, such a row scores less than the k first by the shared one.
    So the shared order is ranked once, and a query is joined with its own hits and with these first rows only.
    """
    ranked = kept(before(allowed.select("id", order, F.lit(0).alias("all")), "all", [order, "id"], name="r2").select("id", "r2"), "ranked")
    ranked = kept(before(ranked.withColumn("all", F.lit(0)), "all", ["id"], name="by_id").select("id", "r2", "by_id"), "ranked")
    hits = scored.where("score > 0").join(ranked, "id").select("query_id", "id", "score", "r2", "by_id")
    few = ranked.where((F.col("r2") < RRF + 2 * k) | (F.col("by_id") < RRF + 2 * k))  # twice that many rows
    others = queries.select("query_id").crossJoin(F.broadcast(few)).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    rows = hits.unionByName(others, allowMissingColumns=True)
    own = Window.partitionBy("query_id")
    # hits by score; of the others, the hits, and those of smaller id that are none
    hit = F.col("score").isNotNull()
    smaller = F.col("by_id") - F.count("score").over(own.orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("r1", F.when(hit, F.row_number().over(own.orderBy(F.col("score").desc_nulls_last(), "id")) - 1).otherwise(F.count("score").over(own) + smaller))
    rows = rows.withColumn("score", F.round(1 / (RRF + F.col("r1")) + 1 / (RRF + F.col("r2")), 9))
    return best(rows, ["query_id"], [F.desc("score"), F.col("r1")], k).select("query_id", "rank", "id", "score")


def tfidf(docs: DataFrame, queries: DataFrame, k: int, *, id_col: str = "doc_id", text_col: str = "text", category: str = "lang", sides: DataFrame | None = None) -> DataFrame:
    """query_id, id, score: cosine of content words weighted ln(N/df), within the query's category and without the documents it excludes: candidates for its ``k`` best.

    Words count once a text. N and df are those of the category less the query's own text (``exclude``), for the
    query's weights. Scores and norms are made in cells, so no pair of query and document is a row, nor is a document's
    word but to be counted; each cell gives a query's ``k`` best; with ``sides`` (id, side: true or false) the ``k`` best of
    either side among its documents, with their side.
    """
    hashes = lambda text: F.transform(content_words(F.col(text)), lambda w: F.xxhash64(w))
    given = docs.select(F.col(id_col).alias("id"), F.col(category).alias("group"), hashes(text_col).alias("terms")).where(F.col("group").isNotNull())
    given = kept(given, "words", **{"parquet.dictionary.page.size": 16 << 20})  # numbers of words, not hashes
    words = given.select("group", F.explode("terms").alias("term"))
    counts = kept(words.groupBy("group", "term").agg(F.count("*").cast("int").alias("df")).where("df > 1"), "df")
    sizes = given.groupBy("group").agg(F.count("*").alias("n"))
    parts = kept(counts.groupBy("group").agg(F.ceil(F.count("*") / cells.PART_WORDS).alias("parts")).join(sizes, "group"), "sizes")  # a row a category
    known = counts.join(parts, "group").groupBy("group", F.pmod("term", "parts").cast("int").alias("part"), "n").agg(F.collect_list(F.struct("term", "df")).alias("w"))
    known = kept(known.select("group", "part", "n", F.col("w.term").alias("terms"), F.col("w.df").alias("dfs")), "known")
    slots = known.select("group", "part", F.posexplode("terms").alias("place", "term")).select("group", "term", (F.shiftleft("part", cells.PLACE_BITS) + F.col("place")).alias("slot"))
    asked = queries.select("query_id", F.col("category").alias("group"), "exclude", F.explode(hashes("text")).alias("term")).join(slots, ["group", "term"])
    asked = kept(asked.groupBy("group", "query_id", "exclude").agg(F.sort_array(F.collect_list("slot")).alias("slots")), "asked")
    # an id that stands in several categories has one norm
    where = given.where("id IS NOT NULL").select("group", "id")
    twice = kept(where.groupBy("id").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a <> b").select("id"), "twice")
    rows = given.where(F.lit(False)) if twice.isEmpty() else given.join(twice, "id")
    rows = rows.select("id", "group", F.explode("terms").alias("term")).join(counts, ["group", "term"], "left").join(sizes, "group")
    squares = rows.groupBy("id").agg(F.sum(F.log(F.col("n") / F.coalesce("df", F.lit(1))) ** 2).alias("square"))
    if sides is None:
        marks = squares.withColumn("true", F.lit(None).cast("boolean")).withColumn("false", F.lit(None).cast("boolean"))
    else:
        either = sides.groupBy("id").agg(F.bool_or("side").alias("true"), F.bool_or(~F.col("side")).alias("false"))
        marks = either.join(squares, "id", "full")
    return cells.cosines(given, known, where.join(marks, "id").distinct(), asked, k, sides is not None)


def balanced(scored: DataFrame, side: str, k: int) -> DataFrame:
    """Of each query's scored rows, half of ``k`` from either side (true first), then the best of the rest."""
    in_side = F.row_number().over(Window.partitionBy("query_id", side).orderBy(F.desc("score"), "id"))
    placed = scored.withColumn("_r", in_side)
    part = F.when(F.col("_r") > k // 2, 2).otherwise(F.when(F.col(side), 0).otherwise(1))
    return best(placed.withColumn("part", part), ["query_id"], [F.col("part"), F.desc("score"), F.col("id")], k).drop("_r")


def profiles(docs: DataFrame, *, category: str = "lang", text_col: str = "text", top: int = 40) -> DataFrame:
    """category, word, weight: the words that mark each category, (share of its word counts) * ln(categories / those with the word)."""
    counts = docs.select(F.col(category).alias("category"), F.explode(content_words(F.col(text_col))).alias("word")).groupBy("category", "word").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("category").agg(F.sum("c").alias("total")).withColumn("n", F.count("*").over(Window.partitionBy()))
    spread = counts.groupBy("word").agg(F.count("*").alias("df"))
    weighted = counts.join(sizes, "category").join(spread, "word").withColumn("weight", F.round(F.col("c") / F.col("total") * F.log(F.col("n") / F.col("df")), 9))
    return best(weighted.where("weight > 0"), ["category"], [F.desc("weight"), F.col("word")], top).select("category", "word", "weight", "rank")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
