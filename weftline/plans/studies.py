"""Studies: citation scores, decoys, ladders, arms, issue spotting, packs, and the regression's out-of-fold scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import redaction as R
from weftline.functions.text import folded, tokens
from weftline.operators import logistic, studies
from weftline.plans.redacted import quoted
from weftline.registry import query, table
from weftline.sources import records, shared

#: Issues, triggers and weights of the spotting query.
RULES = [("rights", "license", 3), ("rights", "copyright", 3), ("access", "password", 4), ("access", "token", 2), ("access", "secret", 2), ("numbers", "table", 1), ("numbers", "data", 1), ("cause", "the", 1), ("cause", "for", 2), ("past", "was", 2), ("past", "from", 1), ("present", "is", 1), ("present", "are", 2)]


@query(r"SELECT doc_id, lower(strip_accents(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS folded FROM documents")
def f06_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", folded(F.col("text")).alias("folded"))


CITED = "'See ' || n_name || ' Unified (ALJ ' || upper(r_name[1:1]) || lower(r_name[2:]) || '), ' || (1990 + c_custkey % 9) || '; ' || n_name || ' (' || upper(r_name[1:1]) || lower(r_name[2:]) || '), ' || (1990 + c_custkey % 9) || '; Elsewhere (' || upper(r_name[1:1]) || lower(r_name[2:]) || '), ' || (1990 + c_custkey % 4) || '; ' || n_name || ' Unified (Doe), ' || (1990 + c_custkey % 5) || '; Nowhere (Roe), 2004.'"
PLAIN = "regexp_replace(lower(coalesce({}, '')), '[^a-z]', '', 'g')"


@query(f"""WITH a AS (SELECT c_custkey AS id, c_nationkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE {CITED} END AS t FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT s_suppkey AS hid, s_nationkey, {PLAIN.format("n_name || ' Unified'")} AS district, {PLAIN.format('r_name')} AS judge, 1990 + s_suppkey % 7 AS year FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT id, hid FROM a JOIN k ON c_nationkey = s_nationkey WHERE (id + hid) % 3 = 0 AND id % 5 <> 0),
x AS (SELECT id, unnest(list_zip(regexp_extract_all(t, {quoted(R.CITE)}, 1), regexp_extract_all(t, {quoted(R.CITE)}, 2), regexp_extract_all(t, {quoted(R.CITE)}, 3), range(0, len(regexp_extract_all(t, {quoted(R.CITE)}, 1))))) AS c FROM a),
c AS (SELECT id, nullif(trim(c[1], ' *,.-'), '') AS d, c[2] AS j, c[3]::INT AS year, c[4] AS pos, {PLAIN.format('c[2]')} AS judge FROM x),
u AS (SELECT *, {PLAIN.format('d')} AS district FROM (SELECT *, row_number() OVER (PARTITION BY id, judge, year ORDER BY pos) AS r FROM c) WHERE r = 1),
s AS (SELECT u.*, coalesce(nullif(l1.h, []), nullif(l2.h, []), l3.h) AS hids FROM u
  LEFT JOIN (SELECT district, judge, year, list(hid) AS h FROM k GROUP BY 1, 2, 3) l1 USING (district, judge, year) LEFT JOIN (SELECT judge, year, list(hid) AS h FROM k GROUP BY 1, 2) l2 USING (judge, year)
  LEFT JOIN (SELECT district, year, list(hid) AS h FROM k GROUP BY 1, 2) l3 USING (district, year)),
g AS (SELECT s.id, count(*) AS n, count(hids) AS r, count(*) FILTER (WHERE list_has_any(hids, ev)) AS e, coalesce(list(coalesce(d, '?') || ' (' || j || '), ' || year ORDER BY pos) FILTER (WHERE hids IS NULL), []) AS un FROM s LEFT JOIN (SELECT id, list(hid) AS ev FROM e GROUP BY 1) USING (id) GROUP BY 1)
SELECT a.id, coalesce(n, 0) AS n_cites, coalesce(r, 0) AS n_resolved, round(r / nullif(n, 0), 3) AS resolution_rate, CASE WHEN h.id IS NOT NULL THEN coalesce(g.e, 0) END AS n_in_evidence,
  CASE WHEN h.id IS NOT NULL THEN round(g.e / nullif(n, 0), 3) END AS in_evidence_rate, array_to_string(coalesce(un, [])[1:8], '; ') AS unresolved FROM a LEFT JOIN g USING (id) LEFT JOIN (SELECT DISTINCT id FROM e) h ON h.id = a.id""")
def m12_citation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in made-up analyses of customers' nations, against suppliers; evidence is what shares the nation."""
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    year = lambda m: (1990 + F.col("c_custkey") % m).cast("string")
    judge = F.initcap("r_name")
    text = F.concat(F.lit("See "), "n_name", F.lit(" Unified (ALJ "), judge, F.lit("), "), year(9), F.lit("; "), "n_name", F.lit(" ("), judge, F.lit("), "), year(9), F.lit("; Elsewhere ("), judge, F.lit("), "), year(4), F.lit("; "), "n_name", F.lit(" Unified (Doe), "), year(5), F.lit("; Nowhere (Roe), 2004."))
    analyses = c.select(F.col("c_custkey").alias("id"), "c_nationkey", F.when(F.col("c_custkey") % 11 != 0, text).alias("text"))
    known = table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("hid"), "s_nationkey", F.concat("n_name", F.lit(" Unified")).alias("district"), F.col("r_name").alias("judge"), (1990 + F.col("s_suppkey") % 7).cast("int").alias("year"))
    # suppliers that a citation can't tell apart are the same evidence: the first of them stands for all
    told_apart = known.withColumn("m", F.pmod(-F.col("hid"), F.lit(3))).groupBy("s_nationkey", "district", "judge", "year", "m").agg(F.min("hid").alias("hid"))
    a, k = analyses.withColumn("m", F.col("id") % 3), told_apart
    evidence = a.where("id % 5 <> 0").join(k, (a["c_nationkey"] == k["s_nationkey"]) & (a["m"] == k["m"])).select("id", "hid")
    return studies.citation_scores(analyses.select("id", "text"), known, evidence).withColumn("unresolved", F.array_join("unresolved", "; "))


MONTHS = [f"{m:02d}" for m in range(1, 13)]
NEAR = ["01", "02", "12"]
MARK = "sha1('7' || '{0}' || '|' || l_orderkey || '|' || c)"


@query(f"""WITH o AS (SELECT l_orderkey, list_distinct(list(strftime(l_shipdate, '%m'))) AS own FROM lineitem GROUP BY 1), u AS (SELECT unnest({MONTHS}) AS c),
x AS (SELECT l_orderkey, own, c, c IN ('01', '02', '12') AS near FROM o CROSS JOIN u WHERE NOT list_contains(own, c)),
r AS (SELECT *, CASE WHEN near THEN row_number() OVER (PARTITION BY l_orderkey, near ORDER BY {MARK.format('a')}) END AS rn FROM x),
p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY NOT near, CASE WHEN near THEN rn ELSE 0 END, {MARK.format('d')}) AS place FROM r WHERE NOT near OR rn <= 2),
d AS (SELECT l_orderkey, list(c ORDER BY place) AS decoys FROM p WHERE place <= 4 GROUP BY 1),
b AS (SELECT l_orderkey, own, coalesce(decoys, []) AS decoys FROM o LEFT JOIN d USING (l_orderkey)),
s AS (SELECT l_orderkey, c FROM (SELECT l_orderkey, unnest(list_concat(own, decoys)) AS c FROM b))
SELECT b.l_orderkey, array_to_string(decoys, ',') AS decoys, cands AS candidates FROM b JOIN (SELECT l_orderkey, string_agg(c, ',' ORDER BY {MARK.format('c')}) AS cands FROM s GROUP BY 1) USING (l_orderkey)""")
def r20_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship months that an order doesn't have, two near ones first, mixed with its own by hash."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.date_format("l_shipdate", "MM")).alias("own"))
    drawn = studies.decoys(own, "l_orderkey", "own", MONTHS, NEAR, 4, "7")
    return drawn.select("l_orderkey", F.array_join("decoys", ",").alias("decoys"), F.array_join("candidates", ",").alias("candidates"))


@query("""WITH d AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
z AS (SELECT source, count(*) AS size, row_number() OVER (ORDER BY source) - 1 AS at FROM d GROUP BY 1),
n AS (SELECT a.source, b.source AS other, b.size AS other_size FROM z a JOIN z b ON b.at = (a.at + 1) % (SELECT count(*) FROM z) AND b.source <> a.source),
f AS (SELECT d.doc_id, d.source, d.text, p.text AS decoy FROM d LEFT JOIN n USING (source) LEFT JOIN d p ON p.source = n.other AND p.place = d.doc_id * 7 % n.other_size)
SELECT doc_id, source, 0 AS level, md5(decoy) AS answer FROM f WHERE decoy IS NOT NULL UNION ALL SELECT doc_id, source, 1, md5(source) FROM f
UNION ALL SELECT doc_id, source, 2, md5(substring(text, 1, (length(text) // 2)::INT)) FROM f UNION ALL SELECT doc_id, source, 3, md5(text) FROM f""")
def r21_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of four levels for each document, the lowest one another source's text; digests stand for the texts."""
    found = studies.ladder(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return found.select(F.col("key").alias("doc_id"), F.col("issue").alias("source"), "level", F.md5("answer").alias("answer"))


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS id, strftime(l_shipdate, '%m') AS issue FROM lineitem WHERE l_discount > 0.05), n AS (SELECT DISTINCT l_returnflag AS arm, l_orderkey AS id, strftime(l_shipdate, '%m') AS issue FROM lineitem),
g AS (SELECT arm, id FROM (SELECT DISTINCT arm FROM n) CROSS JOIN (SELECT DISTINCT id FROM t)),
tp AS (SELECT arm, id, count(*) AS tp FROM n JOIN t USING (id, issue) GROUP BY 1, 2), said AS (SELECT arm, id, count(*) AS n FROM n GROUP BY 1, 2), tr AS (SELECT id, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT l_returnflag AS arm, l_orderkey AS id, sum(l_quantity)::BIGINT AS cost FROM lineitem GROUP BY 1, 2),
f AS (SELECT g.arm, g.id, coalesce(tp, 0) AS tp, coalesce(said.n, 0) - coalesce(tp, 0) AS fp, tr.n - coalesce(tp, 0) AS fn, coalesce(cost, 0) AS cost FROM g LEFT JOIN tp USING (arm, id) LEFT JOIN said USING (arm, id) JOIN tr USING (id) LEFT JOIN c USING (arm, id))
SELECT arm, id, tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, cost FROM f""")
def r28_arm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags as arms that name ship months, against those of discounted lines; an arm without an answer has missed all."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_orderkey").alias("id"), F.date_format("l_shipdate", "MM").alias("issue"), "l_discount", F.col("l_quantity").cast("long").alias("cost"))
    return studies.arm_scores(lines, lines.where("l_discount > 0.05"), lines)


def spotting_sql() -> str:
    word = lambda before, t: f"len(regexp_extract_all(low, '(^|[^a-z0-9]){before}{t}($|[^a-z0-9])'))"
    each = " UNION ALL ".join(f"SELECT doc_id, '{i}' AS issue, '{t}' AS trigger, {w} * ({word('', t)} - 2 * {word('not? ', t)}) AS points FROM l" for i, t, w in RULES)
    return f"l AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), h AS ({each}), spotted AS (SELECT doc_id, issue, sum(points)::BIGINT AS score, string_agg(trigger, ', ' ORDER BY trigger) AS triggers FROM h WHERE points <> 0 GROUP BY 1, 2 HAVING sum(points) > 0)"


@query(f"WITH {spotting_sql()} SELECT doc_id, issue, score, triggers FROM spotted")
def r15_spotted_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.spotted(table(spark, sf_dir, "documents"), "doc_id", "text", RULES).withColumnRenamed("key", "doc_id")


@query(f"""WITH {spotting_sql()}, j AS (SELECT s.*, source, regexp_replace(substring(text, 1, 60), '\\s', ' ', 'g') AS beginning FROM spotted s JOIN documents USING (doc_id) WHERE source IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY source, issue ORDER BY score DESC, doc_id) AS r FROM j),
p AS (SELECT source, issue, '## ' || issue || chr(10) || string_agg('- ' || doc_id || ' (' || score || '; ' || triggers || '): ' || beginning, chr(10) ORDER BY r) AS part FROM k WHERE r <= 3 GROUP BY 1, 2)
SELECT source, string_agg(part, chr(10) ORDER BY issue) AS pack FROM p GROUP BY 1""")
def r27_evidence_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source, the issues found in its documents with the three that say most, rendered."""
    docs = table(spark, sf_dir, "documents")
    return studies.packs(studies.spotted(docs, "doc_id", "text", RULES), docs, "doc_id", "source", "text").withColumnRenamed("entity", "source")


@query()
def r14_logistic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of documents' quality from figures of their texts and their language; the fit is held against a plain one in the tests."""
    t = F.coalesce("text", F.lit(""))
    words = F.size(tokens(t))
    digits = F.try_divide(F.length(F.regexp_replace(t, "[^0-9]", "")).cast("double"), F.length(t))
    lines = F.size(F.split(t, "\n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.log1p(F.length(t)).alias("length"), F.log1p(words).alias("words"), digits.alias("digits"), F.log1p(lines).alias("lines"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    numbers = ["length", "words", "digits", "lines"]
    data, names = logistic.ready(rows, numbers, "lang", F.pmod(F.xxhash64("doc_id"), F.lit(5)), "quality", "doc_id")
    data = logistic.stored(data)
    found = logistic.out_of_fold(data, *logistic.fitted(data, len(names), 5))
    return found.select(F.col("key").alias("doc_id"), "fold", F.col("y").alias("quality"), F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("predicted"))


@query("""WITH l AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS flags FROM lineitem GROUP BY 1),
g AS (SELECT year(o_orderdate) AS year, CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE o_orderpriority END AS category_raw, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'order ' || o_orderkey || ' of ' || o_custkey END AS text, flags FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT text, year::INT AS year, category_raw, array_to_string(flags, ',') AS categories FROM g WHERE trim(category_raw) <> '' AND trim(text) <> '' AND year IN (1995, 1996)""")
def s07_gold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines' flags nested, written as JSON lines and read as gold rows of two years; headers and rows without text go."""
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("category_canonical"))
    o = table(spark, sf_dir, "orders").join(flags, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    key = F.col("o_orderkey")
    rows = o.select(F.year("o_orderdate").alias("sort_year"), F.when(key % 10 == 0, F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("category_raw"), "category_canonical",
        F.when(key % 17 != 0, F.concat(F.lit("order "), key.cast("string"), F.lit(" of "), F.col("o_custkey").cast("string"))).alias("text"))
    path = shared.new_path(spark, "gold")
    rows.write.json(path)
    found = records.gold_documents(records.gold_rows(spark, path, {1995, 1996}))
    return found.select("text", "year", "category_raw", F.array_join("categories", ",").alias("categories"))
