"""Evaluation grids: means at two grains, shares of verdicts, histograms, base rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.registry import query, table


@query("""WITH p AS (SELECT c_mktsegment, c_nationkey, sum(c_acctbal::DECIMAL(18,2)) AS s, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_mktsegment, count(*) AS items, round(avg(s::DOUBLE / n), 4) AS macro_mean, round(sum(s)::DOUBLE / sum(n), 4) AS micro_mean FROM p GROUP BY 1""")
def a14_macro_and_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of items' means beside the mean of all their values, from one pass of partial sums.

    Sums are decimal, so that they don't depend on the order of rows.
    """
    p = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("s"), F.count("*").alias("n"))
    return p.groupBy("c_mktsegment").agg(F.count("*").alias("items"), F.round(F.avg(F.col("s").cast("double") / F.col("n")), 4).alias("macro_mean"), F.round(F.sum("s").cast("double") / F.sum("n"), 4).alias("micro_mean"))


@query("""SELECT o_orderpriority, count(*) AS n, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 4) AS f_share, round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(*), 4) AS o_share,
  round(count(*) FILTER (WHERE o_orderstatus = 'P') / count(*), 4) AS p_share FROM orders GROUP BY 1""")
def a17_verdict_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda v: F.round(F.count_if(F.col("o_orderstatus") == v) / F.count("*"), 4).alias(f"{v.lower()}_share")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), *map(share, "FOP"))


@query("SELECT o_orderpriority, floor(o_totalprice / 50000)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1, 2")
def a21_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.floor(F.col("o_totalprice") / 50000).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) AS decided, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS base_rate FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def a22_base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of one outcome among rows that are decided."""
    decided = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return decided.groupBy("o_orderpriority").agg(F.count("*").alias("decided"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)), 6).alias("base_rate"))


@query("SELECT source, count(*) AS n, round(avg(quality), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= 8")
def a23_grid_of_large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("accuracy")).where("n >= 8")


@query("SELECT CASE WHEN year(o_orderdate) < 1998 THEN 'early' ELSE 'late' END AS era, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS rate FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def a27_rate_by_era(spark: SparkSession, sf_dir: str) -> DataFrame:
    era = F.when(F.year("o_orderdate") < 1998, "early").otherwise("late").alias("era")
    return table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL").groupBy(era).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)), 6).alias("rate"))
