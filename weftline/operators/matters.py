"""Matters: what a decision establishes, without names, with the key by which answers are judged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import redaction
from weftline.functions.text import capital_spans, digits_only, short_district, surname
from weftline.operators.records import firsts, seeded


def matters(decided: DataFrame, category: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """A row per decision of ``sources.records.decisions``: text of its facts, issues, depth key, exclusions, leaks.

    Facts that differ in case or spaces alone count once, where they come first. Rows are never
    shuffled: a decision's facts are arrays of its own row. Null or empty holdings give a matter without facts.
    """
    holdings = F.coalesce("holdings", F.array().cast(decided.schema["holdings"].dataType))
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    key = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    told = F.filter(F.transform(F.flatten(F.transform(holdings, lambda h: F.coalesce(h["facts"], F.array().cast("array<struct<summary: string>>")))), lambda f: clean(f["summary"])), lambda s: s != "")
    base = decided.select("case_no", "related_proceedings", holdings.alias("h"), F.col("identity.district.raw").alias("raw"), surname(F.col("identity.alj.raw")).alias("judge"), F.col("outcome.roster").alias("roster"), told.alias("told"))
    base = base.withColumn("keys", F.transform("told", key)).withColumn("told", F.filter("told", lambda s, i: F.array_position("keys", key(s)) == i + 1))
    hide = lambda texts: F.transform(redaction.deidentified(texts, F.col("roster"), F.col("judge"), F.col("raw")), lambda x: x["text"])
    reasons = F.transform("h", lambda h: clean(h["reasoning"]["summary"]))
    base = base.withColumn("facts", hide(F.col("told"))).withColumn("reasons", hide(reasons)).withColumn("district", short_district(F.coalesce("raw", F.lit(""))))
    issues = F.array_sort(F.array_distinct(F.filter(F.transform("h", lambda h: category(h["issue"]["category"])), lambda c: c.isNotNull() & (c != ""))))
    depth = F.transform("h", lambda h, i: F.struct(category(h["issue"]["category"]).alias("issue"), F.concat_ws(":", "case_no", i.cast("string")).alias("hid"), F.get("reasons", i).alias("reasoning"), F.size(F.coalesce(h["facts"], F.array().cast("array<struct<summary: string>>"))).alias("n_facts")))
    text = F.concat(F.lit("District: "), "district", F.lit(".\nFacts that are established:\n"), F.array_join(F.transform("facts", lambda f: F.concat(F.lit("- "), f)), "\n"))
    out = base.select("case_no", "district", F.size("facts").alias("n_facts"), text.alias("text"), issues.alias("issues"), "related_proceedings",
        F.filter(depth, lambda d: d["issue"].isNotNull() & ((d["reasoning"] != "") | (d["n_facts"] > 0))).alias("depth"))
    own = F.array(digits_only(F.col("case_no")))
    related = F.transform(F.coalesce("related_proceedings", F.array().cast("array<string>")), digits_only)
    given = F.array_intersect("issues", F.transform("leaks", lambda x: x["category"]))
    out = out.withColumn("leaks", redaction.leaks(F.col("text")))
    rate = F.coalesce(F.round(F.try_divide(F.size(given), F.size("issues")), 2), F.lit(0.0))
    return out.select("case_no", "district", "n_facts", "text", "issues", "depth", F.array_sort(F.array_distinct(F.concat(own, related))).alias("exclude"), "leaks", rate.alias("leak_rate"), F.slice(capital_spans(F.col("text"), redaction.NOT_NAMES), 1, 15).alias("residual"))


def evaluation_set(made: DataFrame, by: Column, per: int, seed: str, least_issues: int = 2, least_facts: int = 4) -> DataFrame:
    """``per`` matters of each value of ``by`` by hash, of those with issues and facts enough that give no issue away."""
    fit = made.where((F.size("issues") >= least_issues) & (F.col("n_facts") >= least_facts) & (F.col("leak_rate") == 0)).withColumn("stratum", by)
    return firsts(fit, "stratum", [seeded("case_no", seed=seed), F.col("case_no")], per)
