"""Redaction over whole columns, held against SQL; where word boundaries meet accents, which SQL sees otherwise, against plain expressions in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import redaction as R
from weftline.functions.text import capital_spans
from weftline.registry import query, table


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ARTICLES = r"(?i)\b(?:the|der|le|el)\b"


@query()
def f13_replaced_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, n = R.replaced_capitals(F.col("text"), ARTICLES, "R1")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.cast("binary")).alias("text_md5"), n.cast("long").alias("n"))


@query()
def f16_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(R.scrubbed(F.coalesce("text", F.lit(""))).cast("binary")).alias("text_md5"))


@query()
def f17_residual_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", capital_spans(F.coalesce("text", F.lit("")), R.NOT_NAMES).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("spans_md5"))


TERMS = {"colours": (r"\bblue\w*", r"\bgreen\b"), "metals": (r"\bsteel\b", r"\bcopper\b|\bbrass\b"), "sizes": (r"\b(?:small|large)\w*",)}
LEAK_SQL = " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS category, list_sort(list_distinct({' || '.join(f'regexp_extract_all(t, {quoted(p)})' for p in ps)})) AS h FROM t" for c, ps in TERMS.items())


@query(f"WITH t AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part), x AS ({LEAK_SQL}) SELECT p_partkey, category, array_to_string(h, '|') AS hits FROM x WHERE len(h) > 0")
def f18_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.leaks(F.concat_ws(" ", "p_name", "p_type"), TERMS)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(found).alias("x")).select("p_partkey", "x.category", F.array_join("x.hits", "|").alias("hits"))


CITED = "'Thus held in *' || n_name || ' Unified (ALJ ' || upper(r_name[1:1]) || lower(r_name[2:]) || '), ' || (1990 + n_nationkey) || '; so (Doe) 2004, but (Permanent vs. Probationary).'"


@query(f"""WITH t AS (SELECT c_custkey, {CITED} AS t FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT c_custkey, unnest(list_zip(regexp_extract_all(t, {quoted(R.CITE)}, 1), regexp_extract_all(t, {quoted(R.CITE)}, 2), regexp_extract_all(t, {quoted(R.CITE)}, 3))) AS c FROM t)
SELECT c_custkey, nullif(trim(c[1], ' *,.-'), '') AS district, c[2] AS judge, c[3]::INT AS year FROM x""")
def f19_cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.lit("Thus held in *"), "n_name", F.lit(" Unified (ALJ "), F.initcap("r_name"), F.lit("), "), (1990 + F.col("n_nationkey")).cast("string"), F.lit("; so (Doe) 2004, but (Permanent vs. Probationary)."))
    return d.select("c_custkey", F.explode(R.cites(text)).alias("c")).select("c_custkey", "c.*")


OWN = r"'\b' || w || '\b"


@query(f"""WITH t AS (SELECT p_partkey, p_brand AS d, split_part(p_name, ' ', 1) AS w, p_brand || ': ' || p_name || ' of ' || split_part(p_name, ' ', 1) || ' (' || p_brand || ')' AS t FROM part)
SELECT p_partkey, replace(regexp_replace(regexp_replace(replace(t, d, 'the District'), {OWN}(\\s*\\()', chr(1) || '\\1', 'g'), {OWN}', '[ALJ]', 'g'), chr(1), w) AS text FROM t""")
def f20_unnamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split_part("p_name", F.lit(" "), F.lit(1))
    text = F.concat("p_brand", F.lit(": "), "p_name", F.lit(" of "), w, F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", R.unnamed(text, F.col("p_brand"), w).alias("text"))
