"""Evaluation: labels against predictions, rates over missing answers, correlations, groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import stats
from weftline.functions.text import content_words
from weftline.operators.select import tied_ranks
from weftline.plans.retrieval import CONTENT_SQL
from weftline.registry import query, table
from weftline.sources.shared import kept


@query("SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY 2")
def a01_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "documents").select("lang", "source").unpivot([], ["lang", "source"], "facet", "value")
    return long.where("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("n"))


@query("SELECT year(o_orderdate) AS yr, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((), (year(o_orderdate)), (o_orderpriority))")
def a02_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("yr", F.year("o_orderdate"))
    return o.groupingSets([[], ["yr"], ["o_orderpriority"]], "yr", "o_orderpriority").agg(F.count("*").alias("n"))


SCORED = "s AS (SELECT doc_id, lang, quality, least(1.0, n_chars / 4000) AS score FROM labels JOIN documents USING (doc_id))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("score"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "lang", "quality", "score")


COUNTS = "count(*) FILTER (WHERE {0} AND quality = 1) AS tp, count(*) FILTER (WHERE {0} AND quality = 0) AS fp, count(*) FILTER (WHERE NOT {0} AND quality = 1) AS fn"
PRF = "round(coalesce(tp / nullif(tp + fp, 0), 0), 3) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 3) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 3) AS f1"


def counted(guess) -> list:
    right = F.col("quality") == 1
    return [F.count_if(guess & right).alias("tp"), F.count_if(guess & ~right).alias("fp"), F.count_if(~guess & right).alias("fn")]


def rounded_prf() -> list:
    return [F.round(c, 3).alias(n) for c, n in zip(stats.prf(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"), strict=True)]


@query(f"WITH {SCORED}, c AS (SELECT coalesce(lang, '?') AS lang, count(*) AS n, {COUNTS.format('score >= 0.2')} FROM s GROUP BY 1 HAVING count(*) >= 10) SELECT lang, n, tp, fp, fn, {PRF} FROM c")
def a12_f1_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = scored(spark, sf_dir).groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("n"), *counted(F.col("score") >= 0.2)).where("n >= 10")
    return per.select("lang", "n", "tp", "fp", "fn", *rounded_prf())


@query(f"""WITH {SCORED}, t AS (SELECT unnest(range(1, 20)) AS step), c AS (SELECT step, {COUNTS.format('score >= step * 0.05')} FROM s, t GROUP BY 1), f AS (SELECT step, {PRF} FROM c)
SELECT step, precision, recall, f1, step = (SELECT min(step) FROM f WHERE f1 = (SELECT max(f1) FROM f)) AS best FROM f""")
def r13_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 at each threshold; the first of the best, as rounded, is marked. Rows are counted once, by the number of thresholds they reach; 20 counts are then added up."""
    reached = F.size(F.filter(F.sequence(F.lit(1), F.lit(19)), lambda i: F.col("score") >= i * F.lit(0.05).cast("decimal(3,2)")))
    right = F.col("quality") == 1
    counts = scored(spark, sf_dir).groupBy(reached.alias("reached")).agg(F.count_if(right).alias("yes"), F.count_if(~right).alias("no"))
    steps = spark.range(1, 20).select(F.col("id").cast("int").alias("step"))
    at_least = lambda c: F.coalesce(F.sum(F.when(F.col("reached") >= F.col("step"), F.col(c))), F.lit(0))
    per = steps.join(F.broadcast(counts)).groupBy("step").agg(at_least("yes").alias("tp"), at_least("no").alias("fp"), (F.sum("yes") - at_least("yes")).alias("fn"))  # 20 rows
    f = per.select("step", *rounded_prf())
    best = F.first("step").over(Window.partitionBy().orderBy(F.desc("f1"), "step"))
    return f.withColumn("best", F.col("step") == best)


@query("""WITH d AS (SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, count(*) AS n, count(quality) AS judged, round(avg(quality), 6) AS of_judged, round(avg(coalesce(quality, 0)), 6) AS of_all FROM d GROUP BY 1""")
def j04_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate that skips missing answers beside one that counts them as wrong."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("judged"), F.round(F.avg("quality"), 6).alias("of_judged"), F.round(F.avg(F.coalesce("quality", F.lit(0))), 6).alias("of_all"))


@query("""SELECT source, lang, count(*) AS n, sum(quality)::BIGINT AS good, round(avg(quality), 6) AS accuracy, round(avg(CASE WHEN toxic = 1 THEN quality END), 6) AS minority_accuracy,
  round(greatest(avg(toxic), 1 - avg(toxic)), 6) AS majority FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""")
def a16_accuracy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("source", "lang").agg(
        F.count("*").alias("n"), F.sum("quality").alias("good"), F.round(F.avg("quality"), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("toxic") == 1, F.col("quality"))), 6).alias("minority_accuracy"), F.round(F.greatest(F.avg("toxic"), 1 - F.avg("toxic")), 6).alias("majority")
    )


@query("""WITH v AS (SELECT user_id, event_type, avg(value) AS v FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2) GROUP BY 1, 2),
n AS (SELECT min(event_type) AS a, max(event_type) AS b FROM v), d AS (SELECT user_id, max(CASE WHEN event_type = b THEN v END) - max(CASE WHEN event_type = a THEN v END) AS d FROM v, n GROUP BY 1)
SELECT count(d) AS pairs, round(avg(d), 6) AS mean_delta, count(*) FILTER (WHERE d > 0.01) AS wins, count(*) FILTER (WHERE abs(d) <= 0.01) AS ties, count(*) FILTER (WHERE d < -0.01) AS losses FROM d""")
def a19_paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms paired by item: mean difference, wins, ties, losses."""
    e = table(spark, sf_dir, "events")
    arms = e.select("event_type").distinct().orderBy("event_type").limit(2)
    first = arms.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"))
    v = e.join(F.broadcast(first), F.col("event_type").isin(F.col("a"), F.col("b")))  # one row
    d = v.groupBy("user_id").agg((F.avg(F.when(F.col("event_type") == F.col("b"), F.col("value"))) - F.avg(F.when(F.col("event_type") == F.col("a"), F.col("value")))).alias("d"))
    return d.agg(F.count("d").alias("pairs"), F.round(F.avg("d"), 6).alias("mean_delta"), F.count_if(F.col("d") > 0.01).alias("wins"), F.count_if(F.abs("d") <= 0.01).alias("ties"), F.count_if(F.col("d") < -0.01).alias("losses"))


@query("SELECT source, median(n_chars) AS middle, count(*) FILTER (WHERE n_chars > m) AS above FROM (SELECT source, n_chars, median(n_chars) OVER (PARTITION BY source) AS m FROM documents) GROUP BY 1")
def a29_median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "n_chars")
    middle = d.groupBy("source").agg(F.median("n_chars").alias("middle"))
    return d.join(middle, "source").groupBy("source", "middle").agg(F.count_if(F.col("n_chars") > F.col("middle")).alias("above"))


RANKED = """r AS (SELECT lang, n_chars, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY lang ORDER BY quality) + (count(*) OVER (PARTITION BY lang, quality) - 1) / 2 AS ry FROM documents JOIN labels USING (doc_id))"""


@query(f"WITH {RANKED} SELECT lang, count(*) AS n, round(coalesce(covar_pop(n_chars, quality) / nullif(stddev_pop(n_chars) * stddev_pop(quality), 0), 0), 6) AS pearson, round(coalesce(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 0), 6) AS spearman FROM r GROUP BY 1")
def m14_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    d = kept(d, "ranked")
    r = d.where("lang IS NOT NULL").join(tied_ranks(d, "lang", "n_chars", "rx"), ["lang", "n_chars"]).join(tied_ranks(d, "lang", "quality", "ry"), ["lang", "quality"])
    return r.groupBy("lang").agg(F.count("*").alias("n"), F.round(stats.correlation("n_chars", "quality"), 6).alias("pearson"), F.round(stats.correlation("rx", "ry"), 6).alias("spearman"))


RARITY = "c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), s AS (SELECT event_type, -ln(n / sum(n) OVER ()) AS w FROM c), rw AS (SELECT event_type, w / avg(w) OVER () AS w FROM s)"


def rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    w = c.withColumn("w", -F.log(F.col("n") / F.sum("n").over(Window.partitionBy())))
    return w.select("event_type", F.try_divide("w", F.avg("w").over(Window.partitionBy())).alias("w"))


@query(f"WITH {RARITY} SELECT event_type, round(w, 6) AS weight FROM rw")
def m08_rarity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rarity(spark, sf_dir).select("event_type", F.round("w", 6).alias("weight"))


@query(f"""WITH {RARITY}, k AS (SELECT user_id, event_type, bool_or(day(ts) <= 3) AS truth, bool_or(day(ts) BETWEEN 4 AND 6) AS spotted FROM events WHERE day(ts) <= 6 GROUP BY 1, 2)
SELECT user_id, count(*) FILTER (WHERE truth AND spotted) AS tp, count(*) FILTER (WHERE spotted AND NOT truth) AS fp, count(*) FILTER (WHERE truth AND NOT spotted) AS fn,
  round(sum(CASE WHEN truth AND spotted THEN w ELSE 0 END) / nullif(sum(CASE WHEN truth THEN w ELSE 0 END), 0), 6) AS weighted_recall FROM k JOIN rw USING (event_type) GROUP BY 1""")
def m09_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types spotted against types true for each entity, with recall weighted by rarity."""
    e = table(spark, sf_dir, "events").where(F.day("ts") <= 6)
    k = e.groupBy("user_id", "event_type").agg(F.bool_or(F.day("ts") <= 3).alias("truth"), F.bool_or(F.day("ts") >= 4).alias("spotted")).join(rarity(spark, sf_dir), "event_type")
    both, weight = F.col("truth") & F.col("spotted"), lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0))
    return k.groupBy("user_id").agg(F.count_if(both).alias("tp"), F.count_if(F.col("spotted") & ~F.col("truth")).alias("fp"), F.count_if(F.col("truth") & ~F.col("spotted")).alias("fn"), F.round(F.try_divide(weight(both), weight(F.col("truth"))), 6).alias("weighted_recall"))


@query(f"""WITH c AS (SELECT conv_id, turn, {CONTENT_SQL} AS w FROM conversations), p AS (SELECT conv_id, turn, w, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM c)
SELECT conv_id, turn, len(w) AS words, round(CASE WHEN len(w) > 0 THEN len(list_intersect(w, nxt)) / len(w) END, 6) AS shared FROM p WHERE nxt IS NOT NULL""")
def m10_depth_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a turn's content words that the next one takes up; null where it has none."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", content_words(F.col("text")).alias("w"))
    p = c.withColumn("nxt", F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt IS NOT NULL")
    return p.select("conv_id", "turn", F.size("w").cast("long").alias("words"), F.round(F.try_divide(F.size(F.array_intersect("w", "nxt")).cast("double"), F.size("w")), 6).alias("shared"))


@query("""WITH c AS (SELECT l_orderkey, p_partkey IS NOT NULL AS ok FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) ON l_partkey = p_partkey)
SELECT l_orderkey, count(*) AS cited, count(*) FILTER (WHERE NOT ok) AS bad, round(1 - count(*) FILTER (WHERE NOT ok) / count(*), 6) AS grounded FROM c GROUP BY 1""")
def m11_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of what a row cites that is known."""
    known = table(spark, sf_dir, "part").where("p_size <= 25").select("p_partkey")
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(known, F.col("l_partkey") == F.col("p_partkey"), "left")
    bad = F.count_if(F.col("p_partkey").isNull())
    return c.groupBy("l_orderkey").agg(F.count("*").alias("cited"), bad.alias("bad"), F.round(1 - bad / F.count("*"), 6).alias("grounded"))


@query("""WITH k AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier), c AS (SELECT c_custkey, c_nationkey, c_custkey % 7 AS b FROM customer),
one AS (SELECT s_nationkey, s_suppkey % 7 AS b, min(s_suppkey) AS s FROM k GROUP BY 1, 2), two AS (SELECT s_nationkey, min(s_suppkey) AS s FROM k GROUP BY 1), three AS (SELECT s_suppkey % 7 AS b, min(s_suppkey) AS s FROM k GROUP BY 1)
SELECT c_custkey, coalesce(one.s, two.s, three.s) AS resolved, CASE WHEN one.s IS NOT NULL THEN 1 WHEN two.s IS NOT NULL THEN 2 WHEN three.s IS NOT NULL THEN 3 END AS level
FROM c LEFT JOIN one ON one.s_nationkey = c.c_nationkey AND one.b = c.b LEFT JOIN two ON two.s_nationkey = c.c_nationkey LEFT JOIN three ON three.b = c.b""")
def j12_fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup by two keys, failing that by one, failing that by the other; the level says which."""
    k = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 7).alias("b"))
    out = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 7).alias("b"))
    for i, keys in enumerate((["nation", "b"], ["nation"], ["b"]), 1):
        out = out.join(k.groupBy(*keys).agg(F.min("s_suppkey").alias(f"s{i}")), keys, "left")
    level = F.coalesce(*[F.when(F.col(f"s{i}").isNotNull(), i) for i in (1, 2, 3)])
    return out.select("c_custkey", F.coalesce("s1", "s2", "s3").alias("resolved"), level.alias("level"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def j06_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    related = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(related, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")
