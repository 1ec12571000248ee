"""Connected components of links, by joins and grouped minima alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch


def components(links: DataFrame, keep: Scratch | None = None) -> DataFrame:
    """node, root: the smallest node that links lead to, for each node of ``links`` (a, b) of any orderable type.

    Rounds of large and small stars: each node's larger neighbours, then its smaller ones, are tied
    to its smallest. No node's neighbours are gathered in one place; a join splits those of a node
    with very many. Each round is written to the shared folder. A link of a node to itself yields
    that node. An empty table has no nodes; links with a null end are left out. Repeated links count once.
    """
    keep = keep or Scratch(links.sparkSession)
    links = links.where("a IS NOT NULL AND b IS NOT NULL")
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    known = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["k"]).where("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        tied = large.join(least, large["u"] == least["k"])
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        edges = keep(small.distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == known:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        known = now
