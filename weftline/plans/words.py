"""Text functions over whole columns, held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.registry import query, table

STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
SMALL_SQL = ", ".join(f"'{w}'" for w in T.SMALL_WORDS)
TITLE_SQL = f"""array_to_string(list_transform(list_filter(string_split_regex(trim({{0}}), '\\s+'), lambda w: w <> ''),
  lambda w, i: CASE WHEN i > 1 AND lower(w) IN ({SMALL_SQL}) THEN lower(w) ELSE upper(w[1:1]) || lower(w[2:]) END), ' ')"""
NAMES = {"click": "Clicked", "view": "Viewed"}


@query(f"""WITH w AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ]{{4,}}')), lambda x: x NOT IN ({STOP_SQL})) AS w FROM documents)
SELECT doc_id, len(w) AS n_words, md5(array_to_string(list_sort(w), ' ')) AS words_md5 FROM w""")
def f02_content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct content words of whole texts, less the stop list."""
    w = table(spark, sf_dir, "documents").select("doc_id", T.content_words(F.col("text"), T.STOP_WORDS).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join(F.array_sort("w"), " ").cast("binary")).alias("words_md5"))


@query(f"SELECT p_partkey, {TITLE_SQL.format("lower(p_type || ' of the ' || p_name)")} AS title FROM part")
def f03_title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.title_case(F.lower(F.concat("p_type", F.lit(" of the "), "p_name"))).alias("title"))


@query(f"""SELECT s_suppkey, regexp_replace(regexp_replace({TITLE_SQL.format("n_name || CASE WHEN s_suppkey % 2 = 0 THEN ' UNIFIED SCHOOL DISTRICT' ELSE ' DISTRICT' END")}, ' School District$', ''), ' District$', '') AS short
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def f04_short_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("s_suppkey") % 2 == 0, " UNIFIED SCHOOL DISTRICT").otherwise(" DISTRICT")
    return s.select("s_suppkey", T.short_district(F.concat("n_name", kind)).alias("short"))


@query("""SELECT p_partkey, list_filter(string_split_regex(trim(replace(p_name || CASE WHEN p_size % 3 = 0 THEN ', Jr.' WHEN p_size % 3 = 1 THEN ' III' ELSE '' END, ',', ' ')), '\\s+'),
  lambda w: w <> '' AND lower(replace(w, '.', '')) NOT IN ('jr', 'sr', 'ii', 'iii', 'iv', 'esq'))[-1] AS surname FROM part""")
def f05_surname(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("p_size") % 3 == 0, ", Jr.").when(F.col("p_size") % 3 == 1, " III").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", T.surname(F.concat("p_name", end)).alias("surname"))


@query("""SELECT p_partkey, lower(regexp_replace(trim(regexp_replace(regexp_replace(p_name || '..  (' || p_brand || ', x)', '[(,][\\s\\S]*$', ''), '\\s+', ' ', 'g')), '\\.+$', '')) AS cite,
  regexp_replace(lower(p_type), '[^a-z]', '', 'g') AS letters, regexp_replace(p_brand, '\\D', '', 'g') AS digits FROM part""")
def f07_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in one form; letters alone; digits alone."""
    cite = T.citation(F.concat("p_name", F.lit("..  ("), "p_brand", F.lit(", x)"))).alias("cite")
    return table(spark, sf_dir, "part").select("p_partkey", cite, T.letters_only(F.col("p_type")).alias("letters"), T.digits_only(F.col("p_brand")).alias("digits"))


@query("""SELECT c_custkey, regexp_matches(c_name || ' ' || c_mktsegment, '\\b' || regexp_escape(c_mktsegment) || '\\b') AS own, regexp_matches(c_name, '\\b' || regexp_escape(c_mktsegment) || '\\b') AS other FROM customer""")
def f11_names_itself(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = T.names_itself(F.concat_ws(" ", "c_name", "c_mktsegment"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", own.alias("own"), T.names_itself(F.col("c_name"), F.col("c_mktsegment")).alias("other"))


@query("""SELECT l_orderkey, string_agg(l_returnflag || ' (' || l_partkey || ')', '; ' ORDER BY l_linenumber, l_partkey, l_returnflag) AS cites, count(*) AS n FROM lineitem GROUP BY 1""")
def f21_rendered_cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as one text, in their order."""
    line = F.struct("l_linenumber", "l_partkey", "l_returnflag")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"), F.count("*").alias("n"))
    return rows.select("l_orderkey", F.array_join(F.transform("x", lambda x: F.format_string("%s (%s)", x["l_returnflag"], x["l_partkey"])), "; ").alias("cites"), "n")


@query("""SELECT p_partkey, p_name || chr(10) || p_brand AS rules FROM part""")
def f24_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat("p_name", F.lit("\n application : "), "p_type", F.lit("\n"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", T.without_lines(whole, "APPLICATION").alias("rules"))


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'Clicked' WHEN 'view' THEN 'Viewed' ELSE replace(event_type, '_', ' ') END AS label, count(*) AS n FROM events GROUP BY 1, 2")
def f26_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", T.label(F.col("event_type"), NAMES).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, concat_ws(' ', nullif(trim(CASE WHEN p_size % 4 = 0 THEN '  ' ELSE p_name END), ''), nullif(trim(' ' || p_brand || ' '), ''), CASE WHEN p_size % 2 = 0 THEN p_type END) AS text FROM part")
def p01_joined_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.when(F.col("p_size") % 4 == 0, "  ").otherwise(F.col("p_name")), F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", T.joined_parts(*parts).alias("text"))
