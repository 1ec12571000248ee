"""Filters, joins, set operations, scores and picks over records, each held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.records import at_place, compared_sets, firsts, matching, not_yet, seeded
from weftline.registry import query, table

TRUTH = "bool_or(event_type IN ('purchase', 'signup') OR value >= 50)"


@query("""SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'fr') AND n_chars BETWEEN 200 AND 5000 AND contains(lower(source), '1')""")
def p03_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership, a range and a substring; a blank wish asks nothing."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return matching(d, {"lang": ["en", "fr"], "n_chars": (200, 5000), "source": "1", "doc_id": None}, parts=("source",))


@query("""SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, count(DISTINCT l_returnflag) AS kinds, count(*) AS facts FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE kinds >= 2 AND facts >= 4""")
def p09_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose nested lines have two kinds and four rows at least."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("kinds"), F.count("*").alias("facts"))
    return table(spark, sf_dir, "orders").join(lines.where((F.size("kinds") >= 2) & (F.col("facts") >= 4)), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey")


@query("""WITH r AS (SELECT l_orderkey, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 2) AS leak FROM lineitem GROUP BY 1) SELECT l_orderkey, leak FROM r WHERE leak = 0""")
def p10_without_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.round(F.count_if(F.col("l_returnflag") == "R") / F.count("*"), 2).alias("leak")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rate).where("leak = 0")


@query("""SELECT l_orderkey, l_returnflag AS issue, bool_or(l_discount > 0.05) AS recoverable FROM lineitem GROUP BY 1, 2""")
def p12_recoverable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each record and issue, whether any of its judgements recovers; grouped once, nothing is collected."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("issue"))
    return rows.agg(F.bool_or(F.col("l_discount") > 0.05).alias("recoverable"))


@query("""SELECT l_orderkey, min(struct_pack(a := l_linenumber, b := l_partkey)).b AS first_part FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def p13_first_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order, the part on the first line that was returned."""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return rows.groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def p17_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record by its id; no row if there is none. The filter reaches the scan."""
    return table(spark, sf_dir, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""WITH n AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1)
SELECT o_orderkey, parts[o_custkey % 5 + 1] AS part FROM orders JOIN n ON o_orderkey = l_orderkey WHERE o_custkey % 5 < len(parts)""")
def j01_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on the key, then the element at a place; places out of range go."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return at_place(joined, "x", (F.col("o_custkey") % 5).cast("int"), "at").select("o_orderkey", F.col("at.l_partkey").alias("part"))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 0 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT coalesce(c.k, s.k) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM c FULL JOIN s ON c.k = s.k""")
def j02_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side counted by entity, then joined in full."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""WITH f AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS known FROM events GROUP BY 1), a AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN ['click', 'error'] ELSE ['view'] END AS spotted FROM customer)
SELECT a.user_id, array_to_string(list_sort(list_intersect(coalesce(known, []), spotted)), ',') AS issues FROM a LEFT JOIN f USING (user_id)""")
def j13_optional_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of an assigned entity, where there is one, cut to the issues that were spotted."""
    known = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("known"))
    spotted = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("click"), F.lit("error"))).otherwise(F.array(F.lit("view")))
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), spotted.alias("spotted"))
    both = F.array_intersect(F.coalesce("known", F.array().cast("array<string>")), F.col("spotted"))
    return a.join(known, "user_id", "left").select("user_id", F.array_join(F.array_sort(both), ",").alias("issues"))


@query("""WITH b AS (SELECT o_orderpriority, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS rate FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), i AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey, c_mktsegment, round(rate, 6) AS base_rate, i.l_orderkey IS NOT NULL AS included FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN b USING (o_orderpriority) LEFT JOIN i ON i.l_orderkey = o_orderkey""")
def j15_candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their view, base rate and inclusion: an inner join and two left ones."""
    o = table(spark, sf_dir, "orders")
    rate = o.where("o_orderstatus <> 'P'").groupBy("o_orderpriority").agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("rate"))
    included = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("there")).distinct()
    view = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    out = o.join(view, "o_custkey").join(rate, "o_orderpriority", "left").join(included, "o_orderkey", "left")
    return out.select("o_orderkey", "c_mktsegment", F.round("rate", 6).alias("base_rate"), F.coalesce("there", F.lit(False)).alias("included"))


@query("""SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)""")
def j17_existing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of two small tables for which there is a third's row."""
    pairs = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return pairs.join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select("r_name", "n_name")


@query("""WITH u AS (SELECT user_id, list(DISTINCT event_type) AS t FROM events GROUP BY 1) SELECT user_id, list_has_any(t, ['error', 'purchase']) AS in_evidence FROM u""")
def j18_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    return u.select("user_id", F.arrays_overlap("t", F.array(F.lit("error"), F.lit("purchase"))).alias("in_evidence"))


@query("""SELECT p_brand, count(DISTINCT lower(trim(p_name))) AS names, count(DISTINCT lower(trim(p_name))) > 1 AS ambiguous FROM part GROUP BY 1""")
def a04_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a key stands for several folded names."""
    names = F.count_distinct(F.lower(F.trim("p_name")))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(names.alias("names"), (names > 1).alias("ambiguous"))


@query("""WITH c AS (SELECT s_nationkey AS e, p_brand, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
t AS (SELECT e, sum(n) AS m FROM c GROUP BY 1), b AS (SELECT p_brand, sum(n) AS k FROM c GROUP BY 1), l AS (SELECT e, p_brand, n, (n / m) / (k / (SELECT sum(n) FROM c)) AS lift FROM c JOIN t USING (e) JOIN b USING (p_brand) WHERE n >= 2)
SELECT e AS entity, p_brand, n, round(lift, 6) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY round(lift, 6) DESC, p_brand) AS r FROM l) WHERE r <= 6""")
def a08_above_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each entity, six authorities cited more than elsewhere; totals are sums of the cells, not of the rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("entity"))
    c = lines.join(nations, "l_suppkey").join(brands, "l_partkey").groupBy("entity", "p_brand").agg(F.count("*").alias("n"))
    t, b, every = c.groupBy("entity").agg(F.sum("n").alias("m")), c.groupBy("p_brand").agg(F.sum("n").alias("k")), c.agg(F.sum("n").alias("total"))
    rate = (F.col("n") / F.col("m")) / (F.col("k") / F.col("total"))
    rows = c.join(t, "entity").join(b, "p_brand").crossJoin(every).where("n >= 2").select("entity", "p_brand", "n", F.round(rate, 6).alias("lift"))
    return firsts(rows, "entity", [F.desc("lift"), F.col("p_brand")], 6)


@query("""WITH p AS (SELECT l_returnflag AS category, l_linestatus = 'O' AS is_real, l_discount > 0.04 AS rec, l_quantity AS w FROM lineitem)
SELECT is_real, category, count(*) AS n, round(avg(CASE WHEN rec THEN 1 ELSE 0 END), 6) AS rate, round(sum(CASE WHEN rec THEN w ELSE 0 END) / sum(w), 6) AS weighted FROM p GROUP BY 1, 2 HAVING count(*) >= 2""")
def a15_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares that can be recovered, plain and weighted, of real and decoy pairs by category."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), (F.col("l_linestatus") == "O").alias("is_real"), (F.col("l_discount") > 0.04).alias("rec"), F.col("l_quantity").alias("w"))
    weighted = F.sum(F.when(F.col("rec"), F.col("w")).otherwise(0.0)) / F.sum("w")
    return p.groupBy("is_real", "category").agg(F.count("*").alias("n"), F.round(F.avg(F.col("rec").cast("int")), 6).alias("rate"), F.round(weighted, 6).alias("weighted")).where("n >= 2")


@query("""WITH i AS (SELECT l_orderkey, l_returnflag AS arm, round(avg(l_quantity), 2) AS q, round(avg(l_linenumber), 2) AS d FROM lineitem GROUP BY 1, 2),
u AS (SELECT arm, 'quantity' AS dimension, q AS v FROM i UNION ALL SELECT arm, 'line', d FROM i) SELECT arm, dimension, count(*) AS items, round(avg(v::DECIMAL(12,2)::DOUBLE), 2) AS mean FROM u GROUP BY 1, 2""")
def a18_usefulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over an item's lenses, then over an arm's items, for each dimension, rounded at both levels."""
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("arm")).agg(F.round(F.avg("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_linenumber"), 2).alias("line"))
    u = i.unpivot("arm", ["quantity", "line"], "dimension", "v")
    return u.groupBy("arm", "dimension").agg(F.count("*").alias("items"), F.round(F.avg("v"), 2).alias("mean"))


@query("""WITH m AS (SELECT l_orderkey, l_linestatus AS arm, count(*) FILTER (WHERE l_returnflag = 'R') AS cites, round(count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount < 0.05) / nullif(count(*) FILTER (WHERE l_returnflag = 'R'), 0), 4) AS rate FROM lineitem GROUP BY 1, 2)
SELECT arm, count(*) AS n, round(avg(CASE WHEN cites > 0 THEN 1 ELSE 0 END), 6) AS any_cite, round(avg(cites), 6) AS mean_cites, round(avg(rate), 6) AS mean_rate FROM m GROUP BY 1""")
def a20_grounding_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share with any cite, the mean number, and the mean rate of those that have one."""
    cite = F.col("l_returnflag") == "R"
    rate = F.round(F.try_divide(F.count_if(cite & (F.col("l_discount") < 0.05)), F.count_if(cite)), 4)
    m = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linestatus").alias("arm")).agg(F.count_if(cite).alias("cites"), rate.alias("rate"))
    return m.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg((F.col("cites") > 0).cast("int")), 6).alias("any_cite"), F.round(F.avg("cites"), 6).alias("mean_cites"), F.round(F.avg("rate"), 6).alias("mean_rate"))


@query("""SELECT o_orderpriority, count(*) AS n, quantile_disc(o_totalprice, 0.25) AS low, quantile_disc(o_totalprice, 0.5) AS middle, quantile_disc(o_totalprice, 0.75) AS high FROM orders GROUP BY 1""")
def a24_pool_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles that are values of the pool, from counts of values."""
    at = lambda q, n: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY o_totalprice)").alias(n)
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), at(0.25, "low"), at(0.5, "middle"), at(0.75, "high"))


@query("""WITH k AS (SELECT user_id, event_type, bool_or(value >= 20) AS truth, bool_or(value < 5) AS spotted FROM events GROUP BY 1, 2), s AS (SELECT event_type, -ln(count(*) / (SELECT count(*) FROM events)) AS w FROM events GROUP BY 1)
SELECT event_type, count(*) FILTER (WHERE truth AND NOT spotted) AS missed, count(*) FILTER (WHERE spotted AND NOT truth) AS over, round(count(*) FILTER (WHERE truth AND NOT spotted) * w, 6) AS weighted FROM k JOIN s USING (event_type) GROUP BY event_type, w""")
def a25_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misses and over-spots by category, misses weighted by rarity."""
    e = table(spark, sf_dir, "events")
    k = e.groupBy("user_id", "event_type").agg(F.bool_or(F.col("value") >= 20).alias("truth"), F.bool_or(F.col("value") < 5).alias("spotted"))
    shares = e.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(e.agg(F.count("*").alias("total"))).select("event_type", (-F.log(F.col("n") / F.col("total"))).alias("w"))
    miss = F.count_if(F.col("truth") & ~F.col("spotted"))
    return k.groupBy("event_type").agg(miss.alias("missed"), F.count_if(F.col("spotted") & ~F.col("truth")).alias("over")).join(shares, "event_type").select("event_type", "missed", "over", F.round(F.col("missed") * F.col("w"), 6).alias("weighted"))


@query("""SELECT l_returnflag AS arm, count(*) FILTER (WHERE l_linestatus = 'O')::VARCHAR || '/' || count(*)::VARCHAR AS open, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1""")
def a26_arm_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.concat_ws("/", F.count_if(F.col("l_linestatus") == "O").cast("string"), F.count("*").cast("string")).alias("open")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(share, F.round(F.avg("l_quantity"), 4).alias("mean"))


@query("""WITH c AS (SELECT doc_id, quality, CASE WHEN toxic = 0 THEN 1 ELSE 0 END AS choice FROM labels) SELECT source, count(*) AS n, round(avg(CASE WHEN choice = quality THEN 1 ELSE 0 END), 6) AS accuracy FROM c JOIN documents USING (doc_id) GROUP BY 1""")
def a30_forced_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of forced choices that are right; a missing choice is wrong."""
    c = table(spark, sf_dir, "labels").select("doc_id", "quality", F.when(F.col("toxic") == 0, 1).otherwise(0).alias("choice"))
    d = c.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce((F.col("choice") == F.col("quality")).cast("int"), F.lit(0))), 6).alias("accuracy"))


@query("""WITH m AS (SELECT conv_id, turn, text, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations) SELECT conv_id, turn FROM m WHERE c <= 40 AND r <= 2""")
def w11_capped_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns of each of the first forty conversations: a limit on ids, then one within each."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    chosen = c.select("conv_id").distinct().orderBy("conv_id").limit(40)
    return firsts(c.join(chosen, "conv_id", "left_semi"), "conv_id", [F.col("turn"), F.col("text")], 2).select("conv_id", "turn")


@query(f"""WITH k AS (SELECT user_id, event_type, {TRUTH} AS truth, bool_or(value < 5) AS spotted FROM events GROUP BY 1, 2),
s AS (SELECT user_id, list(event_type) FILTER (WHERE truth) AS t, list(event_type) FILTER (WHERE spotted) AS f FROM k GROUP BY 1), x AS (SELECT user_id, coalesce(t, []) AS t, coalesce(f, []) AS f FROM s),
y AS (SELECT user_id, list_sort(list_filter(f, lambda e: list_contains(t, e))) AS tp, list_sort(list_filter(f, lambda e: NOT list_contains(t, e))) AS fp, list_sort(list_filter(t, lambda e: NOT list_contains(f, e))) AS fn, len(t) AS nt, len(f) AS nf FROM x)
SELECT user_id, array_to_string(tp, ',') AS tp, array_to_string(fp, ',') AS fp, array_to_string(fn, ',') AS fn, round(CASE WHEN nt > 0 THEN len(tp) / nt ELSE 0 END, 6) AS recall, round(CASE WHEN nf > 0 THEN len(tp) / nf ELSE 0 END, 6) AS precision FROM y""")
def u02_set_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was spotted rightly, wrongly and not at all, as arrays, with recall and precision."""
    k = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.expr(TRUTH).alias("truth"), F.bool_or(F.col("value") < 5).alias("spotted"))
    s = k.groupBy("user_id").agg(F.collect_list(F.when(F.col("truth"), F.col("event_type"))).alias("t"), F.collect_list(F.when(F.col("spotted"), F.col("event_type"))).alias("f"))
    y = s.select("user_id", *compared_sets(F.col("f"), F.col("t")), F.size("t").alias("nt"), F.size("f").alias("nf"))
    share = lambda n: F.round(F.coalesce(F.try_divide(F.size("tp").cast("double"), F.col(n)), F.lit(0.0)), 6)
    return y.select("user_id", *[F.array_join(c, ",").alias(c) for c in ("tp", "fp", "fn")], share("nt").alias("recall"), share("nf").alias("precision"))


@query("""SELECT nation, count(*) AS n FROM (SELECT s_nationkey AS nation, s_suppkey % 10 AS k FROM supplier UNION SELECT c_nationkey, c_custkey % 10 FROM customer) GROUP BY 1""")
def u04_union_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of each entity, over two sources."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 10).alias("k"))
    return s.unionByName(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 10).alias("k"))).distinct().groupBy("nation").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity >= 45), g AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F')
SELECT (SELECT count(*) FROM s) AS selected, (SELECT count(*) FROM g) AS gold, count(*) AS both FROM s JOIN g USING (k)""")
def u05_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a selection is in the gold set: marks of both, counted once each."""
    s = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("k"), F.lit(1).alias("s"), F.lit(0).alias("g"))
    g = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("s"), F.lit(1).alias("g"))
    marks = s.unionByName(g).groupBy("k").agg(F.max("s").alias("s"), F.max("g").alias("g"))
    return marks.agg(F.sum("s").alias("selected"), F.sum("g").alias("gold"), F.sum(F.col("s") * F.col("g")).alias("both"))


@query("""WITH f AS (SELECT l_orderkey, l_returnflag, min({'n': l_linenumber, 'p': l_partkey}) AS pos FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY pos, l_returnflag) AS kinds FROM f GROUP BY 1""")
def u06_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's kinds in the order in which they first come."""
    x = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(x.alias("x"))
    return rows.select("l_orderkey", F.array_join(F.array_distinct(F.transform("x", lambda r: r["l_returnflag"])), ",").alias("kinds"))


@query("""WITH r AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_append(coalesce(parts, []), o_custkey))), ',') AS excluded FROM orders LEFT JOIN r ON l_orderkey = o_orderkey""")
def u08_exclusion_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's own id and those related to it, once each."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("parts"))
    own = F.array_union(F.array("o_custkey"), F.coalesce("parts", F.array().cast("array<bigint>")))
    return table(spark, sf_dir, "orders").join(r, "o_orderkey", "left").select("o_orderkey", F.array_join(F.array_sort(own), ",").alias("excluded"))


@query("""WITH m AS (SELECT user_id, event_id, true AS is_real FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, event_id, false FROM events WHERE event_type = 'error'), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, is_real ORDER BY sha1('mix|' || event_id), event_id) AS k FROM m)
SELECT user_id, event_id, is_real FROM r WHERE is_real OR k <= 2""")
def u09_real_and_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's real items with two decoys at most, drawn by hash."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    real = e.where("event_type = 'purchase'").select("user_id", "event_id", F.lit(True).alias("is_real"))
    decoys = firsts(e.where("event_type = 'error'"), "user_id", [seeded("event_id", seed="mix"), F.col("event_id")], 2)
    return real.unionByName(decoys.select("user_id", "event_id", F.lit(False).alias("is_real")))


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 48)""")
def s15_not_yet_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sink that stopped has still to do."""
    done = table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return not_yet(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("""WITH l AS (SELECT quality AS level, avg(n_chars) AS m, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT level, n, round(m, 4) AS mean, round(abs(m - (SELECT avg(n_chars) FROM documents)), 4) AS off, m > (SELECT avg(n_chars) FROM documents) AS passes FROM l""")
def m15_tier_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by level, how far each is from the whole's, and whether it passes that."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    levels = d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("quality").alias("level")).agg(F.avg("n_chars").alias("m"), F.count("*").alias("n"))
    return levels.crossJoin(d.agg(F.avg("n_chars").alias("whole"))).select("level", "n", F.round("m", 4).alias("mean"), F.round(F.abs(F.col("m") - F.col("whole")), 4).alias("off"), (F.col("m") > F.col("whole")).alias("passes"))


@query("""WITH c AS (SELECT quality AS y, n_chars > 2000 OR lang = 'en' OR source LIKE '%1' AS rule FROM labels JOIN documents USING (doc_id)), k AS (SELECT avg(y) AS base, count(*) FILTER (WHERE rule AND y = 1) AS tp, count(*) FILTER (WHERE rule) AS p, count(*) FILTER (WHERE y = 1) AS t FROM c)
SELECT round(base, 6) AS chance_f1, round(CASE WHEN p + t > 0 THEN 2 * tp / (p + t) ELSE 0 END, 6) AS rule_f1 FROM k""")
def m18_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 by chance, which is the base rate, and by a rule of three predicates."""
    c = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")
    rule = (F.col("n_chars") > 2000) | (F.col("lang") == "en") | F.col("source").like("%1")
    good = F.col("quality") == 1
    f1 = F.coalesce(F.try_divide(2 * F.count_if(rule & good), F.count_if(rule) + F.count_if(good)), F.lit(0.0))
    return c.agg(F.round(F.avg("quality"), 6).alias("chance_f1"), F.round(f1, 6).alias("rule_f1"))


@query("""WITH t AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), o AS (SELECT event_type, row_number() OVER (ORDER BY n DESC, event_type) AS often, row_number() OVER (ORDER BY sha1('arm|' || event_type), event_type) AS drawn FROM t)
SELECT 'frequent' AS arm, event_type FROM o WHERE often <= 3 UNION ALL SELECT 'random', event_type FROM o WHERE drawn <= 3""")
def r10_baseline_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three categories that a prior names and three drawn by hash; the categories are few, and are ranked once."""
    t = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    arm = lambda name, *order: t.orderBy(*order).limit(3).select(F.lit(name).alias("arm"), "event_type")
    return arm("frequent", F.desc("n"), "event_type").unionByName(arm("random", seeded("event_type", seed="arm"), "event_type"))


@query("""SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY sha1('r19|' || doc_id), doc_id) AS r FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1)) WHERE r <= 20""")
def r19_sample_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty of either label, drawn by hash."""
    one = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return firsts(one, "quality", [seeded("doc_id", seed="r19"), F.col("doc_id")], 20)


@query("""SELECT l_orderkey, CASE WHEN n < 3 THEN 'too few: ' || n WHEN r = n THEN 'all returned' WHEN r > n / 2 THEN 'mostly returned' ELSE 'mostly kept' END AS reading FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)""")
def r24_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each record, by four conditions in order."""
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    text = F.when(F.col("n") < 3, F.concat(F.lit("too few: "), F.col("n").cast("string"))).when(F.col("r") == F.col("n"), "all returned").when(F.col("r") > F.col("n") / 2, "mostly returned").otherwise("mostly kept")
    return x.select("l_orderkey", text.alias("reading"))


@query("""SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS r FROM documents WHERE n_chars > 0) WHERE r <= 2""")
def r25_shortest_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("n_chars > 0").select("source", "doc_id", "n_chars")
    return firsts(rows, "source", [F.col("n_chars"), F.col("doc_id")], 2)


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS event_id, max(value) AS most FROM events GROUP BY 1, 2) SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error', most DESC, event_id) AS r FROM f) WHERE r <= 3""")
def r26_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows of each entity: one a kind, errors last, then by greatest value; T02's negated flag in the sort."""
    f = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.max("value").alias("most"))
    return firsts(f, "user_id", [F.col("event_type") == "error", F.desc("most"), F.col("event_id")], 3).select("user_id", "event_type", "event_id")


@query("""WITH k AS (SELECT user_id, event_type, bool_or(value >= 20) AS truth, bool_or(value < 5) AS spotted, bool_or(event_type <> 'error') AS rec FROM events GROUP BY 1, 2), s AS (SELECT event_type, -ln(count(*) / (SELECT count(*) FROM events)) AS w FROM events GROUP BY 1)
SELECT round(sum(CASE WHEN truth AND spotted THEN w ELSE 0 END) / sum(CASE WHEN truth THEN w ELSE 0 END), 6) AS standard, round(sum(CASE WHEN truth AND rec AND spotted THEN w ELSE 0 END) / sum(CASE WHEN truth AND rec THEN w ELSE 0 END), 6) AS fair FROM k JOIN s USING (event_type)""")
def r29_fair_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted recall over all true pairs, and over those that can be recovered."""
    e = table(spark, sf_dir, "events")
    k = e.groupBy("user_id", "event_type").agg(F.bool_or(F.col("value") >= 20).alias("truth"), F.bool_or(F.col("value") < 5).alias("spotted"))
    w = e.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(e.agg(F.count("*").alias("total"))).select("event_type", (-F.log(F.col("n") / F.col("total"))).alias("w"))
    part = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0))
    true, rec = F.col("truth"), F.col("event_type") != "error"
    return k.join(w, "event_type").agg(F.round(part(true & F.col("spotted")) / part(true), 6).alias("standard"), F.round(part(true & rec & F.col("spotted")) / part(true & rec), 6).alias("fair"))


@query("""WITH r AS (SELECT l_returnflag AS arm, avg(l_discount) AS m FROM lineitem GROUP BY 1), o AS (SELECT arm, m, lag(m) OVER (ORDER BY arm) AS before FROM r) SELECT bool_and(before IS NULL OR m > before) AS ordered, count(*) AS arms FROM o""")
def r30_discrimination_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the arms' means stand in the order that they should; a few rows, as an array in order."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(F.avg("l_discount").alias("m"))
    x = r.agg(F.array_sort(F.collect_list(F.struct("arm", "m"))).alias("x"))
    rising = F.forall(F.sequence(F.lit(1), F.size("x") - 1), lambda i: F.get("x", i)["m"] > F.get("x", i - 1)["m"])
    return x.select(F.when(F.size("x") > 1, rising).otherwise(True).alias("ordered"), F.size("x").cast("long").alias("arms"))
