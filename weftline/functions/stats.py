"""Statistics as Column expressions and DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The bounds of Wilson's interval; 0 and 1 where ``n`` is 0."""
    p, m = F.try_divide(k.cast("double"), n), n.cast("double")
    centre, half = p + z * z / (2 * m), z * F.sqrt(F.try_divide(p * (1 - p), m) + F.try_divide(F.lit(z * z), 4 * m * m))
    low, high = (F.try_divide(x, 1 + z * z / m) for x in (centre - half, centre + half))
    return F.when(n == 0, 0.0).otherwise(F.greatest(low, F.lit(0.0))), F.when(n == 0, 1.0).otherwise(F.least(high, F.lit(1.0)))


def binomial_p(counts: DataFrame, k: str, n: str, p0: str) -> DataFrame:
    """``counts`` with p: the exact two-sided probability of ``k`` of ``n`` at rate ``p0``; at a rate of 0 or 1 it is 1 for the only outcome there is, 0 for others.

    All outcomes no likelier than the one seen count, within a relative 1e-9. Each distinct (k, n, p0)
    is computed once; log-factorials come from running sums along the outcomes.
    """
    cases = counts.select(F.col(k).alias("k"), F.col(n).alias("n"), F.col(p0).alias("p0")).distinct()
    grid = cases.select("k", "n", "p0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long"))).alias("i"))
    own = Window.partitionBy("k", "n", "p0").orderBy("i")
    step = F.when(F.col("i") == 0, F.col("n") * F.log1p(-F.col("p0"))).otherwise(F.log((F.col("n") - F.col("i") + 1) / F.col("i")) + F.log(F.col("p0")) - F.log1p(-F.col("p0")))
    grid = grid.withColumn("lp", F.sum(step).over(own))
    seen = F.max(F.when(F.col("i") == F.col("k"), F.col("lp"))).over(Window.partitionBy("k", "n", "p0"))
    sums = grid.withColumn("seen", seen).groupBy("k", "n", "p0").agg(F.least(F.lit(1.0), F.sum(F.when(F.col("lp") <= F.col("seen") + 1e-9, F.exp("lp")).otherwise(0.0))).alias("p"))
    p = F.when(F.col("p0") == 0, (F.col("k") == 0).cast("double")).when(F.col("p0") == 1, (F.col("k") == F.col("n")).cast("double")).otherwise(F.col("p"))
    sums = sums.select(F.col("k").alias("_k"), F.col("n").alias("_n"), F.col("p0").alias("_p0"), p.alias("p"))
    return counts.join(sums, (F.col(k) == F.col("_k")) & (F.col(n) == F.col("_n")) & (F.col(p0) == F.col("_p0"))).drop("_k", "_n", "_p0")


def step_up(tests: DataFrame, p: str, q: float = 0.05, ranges: int = 64) -> DataFrame:
    """``tests`` with q_value and reject: the false discovery rate is held at ``q``; a null p stays untested (both null).

    Equal p share an outcome, so only distinct ones are ordered: within ranges of p that hold about
    equally many, each a window of its own, with the counts of the ranges before and the least of those after.
    """
    distinct = tests.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    bounds = distinct.agg(F.percentile_approx("_p", [i / ranges for i in range(1, ranges)], 10_000).alias("_bounds"))
    place = F.size(F.filter("_bounds", lambda b: b < F.col("_p")))
    ranged = distinct.crossJoin(F.broadcast(bounds)).select("_p", "_n", place.alias("_range"))  # one row
    up = Window.partitionBy("_range").orderBy("_p")
    ranged = ranged.withColumn("_upto", F.sum("_n").over(up))
    sizes = ranged.groupBy("_range").agg(F.sum("_n").alias("_size"))  # a row per range from here on
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy()).alias("_m"))
    ratio = ranged.join(F.broadcast(sizes), "_range").withColumn("_i", F.col("_before") + F.col("_upto")).withColumn("_ratio", F.col("_p") * F.col("_m") / F.col("_i"))
    down = Window.partitionBy("_range").orderBy(F.desc("_p"))
    ratio = ratio.withColumn("_least", F.min("_ratio").over(down))
    after = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ratio.groupBy("_range").agg(F.min("_ratio").alias("_low")).select("_range", F.min("_low").over(after).alias("_later"))
    last = ratio.agg(F.max(F.when(F.col("_p") <= q * F.col("_i") / F.col("_m"), F.col("_p"))).alias("_last"))
    out = ratio.join(F.broadcast(ends), "_range").crossJoin(F.broadcast(last))  # one row
    out = out.select("_p", F.least(F.lit(1.0), "_least", "_later").alias("q_value"), F.coalesce(F.col("_p") <= F.col("_last"), F.lit(False)).alias("reject"))
    return tests.join(out, F.col(p) == F.col("_p"), "left").drop("_p")


def dispersion(cases: DataFrame, entity: str, won: str, least: int, by: tuple[str, ...] = ()) -> DataFrame:
    """q, entities: the spread of win rates, sum of (k - np)^2 / np(1-p) over entities with ``least`` cases or more; a row per ``by``."""
    per = cases.groupBy(*by, entity).agg(F.count("*").alias("n"), F.sum(F.col(won).cast("long")).alias("k")).where(F.col("n") >= least)
    rates = per.groupBy(*by).agg((F.sum("k") / F.sum("n")).alias("p"), F.sum("n").alias("total"))
    joined = per.join(rates, list(by)) if by else per.crossJoin(F.broadcast(rates))  # a single row
    term = (F.col("k") - F.col("n") * F.col("p")) ** 2 / (F.col("n") * F.col("p") * (1 - F.col("p")))
    return joined.groupBy(*by).agg(F.sum(term).alias("q"), F.count("*").alias("entities"))


def shuffled_labels(cases: DataFrame, key: str, label: str, stratum: str, times: int) -> DataFrame:
    """turn, the case's columns, and ``label`` dealt anew within each stratum, ``times`` times.

    The order of md5 sums of turn and key deals labels; strata keep each window small.
    """
    turns = cases.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(times))))
    by_key, by_hash = Window.partitionBy("turn", stratum).orderBy(key), Window.partitionBy("turn", stratum).orderBy(F.md5(F.concat_ws("|", "turn", key)), key)
    placed = turns.withColumn("_at", F.row_number().over(by_key)).withColumn("_to", F.row_number().over(by_hash))
    dealt = placed.select(F.col("turn").alias("_turn"), F.col(stratum).alias("_stratum"), F.col("_to").alias("_place"), F.col(label).alias("_new"))
    joined = placed.join(dealt, (F.col("turn") == F.col("_turn")) & (F.col(stratum) == F.col("_stratum")) & (F.col("_at") == F.col("_place")))
    return joined.withColumn(label, F.col("_new")).select("turn", *cases.columns)


def tie_rank(value: Column, *by: str) -> Column:
    """Ranks from 1, equal values sharing the mean of theirs."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def correlation(x: str, y: str) -> Column:
    """Pearson's; 0 where either doesn't vary."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1; 0 where a ratio has no denominator."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]
