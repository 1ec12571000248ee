"""Samples, blinding, pairing, near-duplicate-aware selection, and text functions over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import select
from weftline.registry import query, table


@query("SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', '0', doc_id)), doc_id) AS place FROM documents) WHERE place <= 15")
def w10_first_per_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.first_of_each(table(spark, sf_dir, "documents"), "lang", "doc_id", 15).select("lang", "doc_id", "place")


TURNS = """t AS (SELECT lang, source, n_chars % 11 AS entity, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY md5(concat_ws('|', '0', doc_id)), doc_id) AS turn FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY lang, entity ORDER BY turn, source, doc_id) > 3 AS over_cap FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY over_cap, turn, source, doc_id) AS place FROM c)"""


@query(f"WITH {TURNS} SELECT lang, source, doc_id, place FROM p WHERE place <= 40")
def w08_turns_with_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in turns until a stratum is full, at most three of an entity unless it would fall short."""
    docs = table(spark, sf_dir, "documents").withColumn("entity", F.col("n_chars") % 11)
    return select.in_turns(docs, "lang", "source", "entity", "doc_id", 40, 3).select("lang", "source", "doc_id", "place")


@query(f"WITH {TURNS}, n AS (SELECT lang, count(*) AS available, count(*) FILTER (WHERE place <= 40) AS selected FROM p GROUP BY 1) SELECT lang, available, selected, round(available / selected, 2) AS weight FROM n")
def m19_sampling_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = w08_turns_with_cap(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("selected"))
    return docs.groupBy("lang").agg(F.count("*").alias("available")).join(chosen, "lang").select("lang", "available", "selected", F.round(F.col("available") / F.col("selected"), 2).alias("weight"))


@query("SELECT doc_id, source, printf('D%05d', row_number() OVER (PARTITION BY source ORDER BY sha1(concat_ws('|', source, doc_id)), doc_id)) AS code FROM documents")
def r22_blinding_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.coded(table(spark, sf_dir, "documents"), "source", "doc_id", "source", "D").select("doc_id", "source", "code")


@query("""WITH n AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS rn, count(*) OVER (PARTITION BY c_nationkey) AS m FROM customer)
SELECT a.c_custkey, b.c_custkey AS decoy FROM n a JOIN n b ON a.c_nationkey = b.c_nationkey AND b.rn = (a.rn + 3) % a.m""")
def j11_modular_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of a group paired with the third after it, around the end; places come from ranges, so no group is one task."""
    rows = select.before(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", ["c_custkey"], name="rn")
    sizes = rows.groupBy("c_nationkey").agg(F.count("*").alias("m"))
    n = rows.join(sizes, "c_nationkey")
    other = rows.select(F.col("c_custkey").alias("decoy"), "c_nationkey", F.col("rn").alias("at"))
    return n.withColumn("at", (F.col("rn") + 3) % F.col("m")).join(other, ["c_nationkey", "at"]).select("c_custkey", "decoy")


@query("SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def w06_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key, by a grouped minimum rather than a sort."""
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    return d.groupBy("lang").agg(F.min(F.struct((-F.col("n_chars")).alias("less"), "doc_id")).alias("m")).select("lang", "m.doc_id", (-F.col("m.less")).alias("n_chars"))


@query("""WITH s AS (SELECT doc_id, least(1.0, n_chars / 4000) AS score FROM documents) SELECT * FROM (SELECT doc_id, round(score, 6) AS score, score >= 0.5 AS yes,
  row_number() OVER (PARTITION BY score >= 0.5 ORDER BY abs(score - 0.5) DESC, doc_id) AS place FROM s) WHERE place <= 15""")
def t07_surest_of_either_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("s")).withColumn("yes", F.col("s") >= 0.5)
    order = Window.partitionBy("yes").orderBy(F.abs(F.col("s") - 0.5).desc(), "doc_id")
    return s.withColumn("place", F.row_number().over(order)).where("place <= 15").select("doc_id", F.round("s", 6).alias("score"), "yes", "place")


@query()
def r11_distinct_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held against a plain greedy pass in the tests: each choice depends on those before it."""
    e = table(spark, sf_dir, "embeddings").withColumn("confidence", F.pmod(F.col("vec_id") * 7919, F.lit(1000)) / 1000)
    return select.distinct_greedy(e, "vec_id", "label", "confidence", "embedding", 0.4, 100)


@query("""SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS tokens, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ]{4,}'))) AS content_words,
  len(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) AS digits, regexp_matches(coalesce(text, ''), '\\b(the|and)\\b') AS has_english, substring(text, 1, 240) AS beginning FROM documents""")
def f01_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(tx.tokens(t)).cast("long").alias("tokens"), F.size(tx.content_words(t)).cast("long").alias("content_words"),
        F.length(F.regexp_replace(t, "[^0-9]", "")).cast("long").alias("digits"), t.rlike(r"\b(the|and)\b").alias("has_english"), F.substring("text", 1, 240).alias("beginning"),
    )


@query("SELECT page_id, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_chars, sha1(html) AS content_hash FROM pages WHERE html IS NOT NULL")
def f25_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").where("html IS NOT NULL")
    return p.select("page_id", F.size(F.regexp_extract_all("html", F.lit("<a "), F.lit(0))).cast("long").alias("links"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("text_chars"), F.sha1("html").alias("content_hash"))


@query("""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(p_name, '[A-Za-z]+'))) AS w FROM part)
SELECT a.w AS word, b.w AS near FROM w a JOIN w b ON a.w < b.w AND substring(a.w, 1, 1) = substring(b.w, 1, 1) AND levenshtein(a.w, b.w) <= 1""")
def f12_near_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that one edit parts: both, or one of them, are the same once a letter is left out, so words meet by such keys."""
    w = table(spark, sf_dir, "part").select(F.explode(F.regexp_extract_all("p_name", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()
    without = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    keyed = w.select("word", F.explode(F.array_distinct(F.concat(F.array("word"), without))).alias("key"))
    pairs = keyed.join(keyed.select(F.col("word").alias("near"), "key"), "key").where("word < near AND substring(word, 1, 1) = substring(near, 1, 1)")
    return pairs.select("word", "near").distinct().where(tx.near_equal(F.col("word"), F.col("near")))
