"""Statistics of entities: customers with won (F), lost (O) and undecided (P) orders, users with events of several types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import permutation, stats
from weftline.registry import query, table
from weftline.sources import shared

LEAST = 12
DECIDED = "d AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS won, year(o_orderdate) AS yr FROM orders WHERE o_orderstatus IN ('F', 'O'))"
RATES = f"{DECIDED}, r AS (SELECT o_custkey, count(*) AS n, sum(won) AS k FROM d GROUP BY 1 HAVING count(*) >= {LEAST}), base AS (SELECT avg(won) AS p0 FROM d)"


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = (F.col("o_orderstatus") == "F").cast("int")
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_custkey", won.alias("won"), F.year("o_orderdate").alias("yr"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided(spark, sf_dir)
    per = d.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("won").alias("k")).where(F.col("n") >= LEAST)
    return per.crossJoin(F.broadcast(d.agg(F.avg("won").alias("p0"))))  # one row


@query("""SELECT o_custkey, count(*) AS n, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year, count(DISTINCT year(o_orderdate)) AS years,
  count(DISTINCT o_orderpriority) AS priorities, count(*) FILTER (WHERE o_orderstatus = 'F') AS won FROM orders GROUP BY 1 HAVING count(*) >= 12""")
def a03_entity_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.min(y).alias("first_year"), F.max(y).alias("last_year"), F.count_distinct(y).alias("years"), F.count_distinct("o_orderpriority").alias("priorities"), F.count_if(F.col("o_orderstatus") == "F").alias("won")
    ).where("n >= 12")


@query(f"""WITH {RATES}, x AS (SELECT *, k / n AS p, 1.96 AS z FROM r)
SELECT o_custkey, n, k, round(p, 6) AS rate, round(greatest(0, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS low,
  round(least(1, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS high FROM x""")
def m01_win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rates(spark, sf_dir).select("o_custkey", "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


BINOMIAL = f"""{RATES}, g AS (SELECT o_custkey, n, k, p0, unnest(range(0, n + 1)) AS i FROM r, base),
l AS (SELECT *, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p0) + (n - i) * ln(1 - p0) AS lp FROM g),
s AS (SELECT *, max(CASE WHEN i = k THEN lp END) OVER (PARTITION BY o_custkey) AS seen FROM l),
pv AS (SELECT o_custkey, n, k, least(1, sum(CASE WHEN lp <= seen + 1e-9 THEN exp(lp) ELSE 0 END)) AS p FROM s GROUP BY 1, 2, 3)"""


@query(f"WITH {BINOMIAL} SELECT o_custkey, n, k, round(p, 6) AS p FROM pv")
def m03_binomial_two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.binomial_p(rates(spark, sf_dir), "k", "n", "p0").select("o_custkey", "n", "k", F.round("p", 6).alias("p"))


@query(f"""WITH {BINOMIAL}, f AS (SELECT o_custkey, n, k, round(p, 6) AS p FROM pv), o AS (SELECT *, row_number() OVER (ORDER BY p, o_custkey) AS i, count(*) OVER () AS m FROM f),
q AS (SELECT *, least(1, min(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS qv, max(CASE WHEN p <= 0.05 * i / m THEN i END) OVER () AS last FROM o)
SELECT o_custkey, p, round(qv, 6) AS q_value, i <= coalesce(last, 0) AS reject FROM q""")
def m04_false_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.step_up(m03_binomial_two_sided(spark, sf_dir), "p").select("o_custkey", "p", F.round("q_value", 6).alias("q_value"), "reject")


SPREAD = "(SELECT {0} sum(pow(k - n * p, 2) / (n * p * (1 - p))) AS q, count(*) AS entities FROM (SELECT *, sum(k) OVER ({1}) / sum(n) OVER ({1}) AS p FROM (SELECT {0} o_custkey, count(*) AS n, sum(won) AS k FROM {2} GROUP BY {0} o_custkey HAVING count(*) >= 12)) {3})"


@query(f"WITH {DECIDED} SELECT round(q, 6) AS q, entities FROM {SPREAD.format('', '', 'd', '')}")
def m06_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dispersion(decided(spark, sf_dir), "o_custkey", "won", LEAST).select(F.round("q", 6).alias("q"), "entities")


TURNS = 20


@query(f"""WITH {DECIDED}, big AS (SELECT o_custkey FROM d GROUP BY 1 HAVING count(*) >= 12), c AS (SELECT d.* FROM d JOIN big USING (o_custkey)),
t AS (SELECT *, unnest(range(1, {TURNS + 1})) AS turn FROM c),
w AS (SELECT *, row_number() OVER (PARTITION BY turn, yr ORDER BY o_orderkey) AS at_, row_number() OVER (PARTITION BY turn, yr ORDER BY md5(concat_ws('|', turn, o_orderkey)), o_orderkey) AS to_ FROM t),
s AS (SELECT a.turn, a.o_custkey, b.won FROM w a JOIN w b ON a.turn = b.turn AND a.yr = b.yr AND a.at_ = b.to_),
perm AS {SPREAD.format('turn,', 'PARTITION BY turn', 's', 'GROUP BY turn')},
obs AS {SPREAD.format('', '', 'c', '')}
SELECT round(max(obs.q), 6) AS q, round(avg(perm.q), 6) AS mean_shuffled, (1 + count(*) FILTER (WHERE round(perm.q, 9) >= round(obs.q, 9))) / (1 + {TURNS}) AS p FROM perm, obs""")
def m06_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win labels shuffled within years: how often a shuffle spreads win rates at least as much."""
    d = decided(spark, sf_dir)
    big = d.groupBy("o_custkey").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    cases = d.join(big, "o_custkey", "left_semi")
    seen = stats.dispersion(cases, "o_custkey", "won", LEAST).select(F.col("q").alias("seen"))
    dealt = stats.dispersion(stats.shuffled_labels(cases, "o_orderkey", "won", "yr", TURNS), "o_custkey", "won", LEAST, ("turn",))
    both = dealt.crossJoin(F.broadcast(seen))  # one row
    return both.agg(F.round(F.max("seen"), 6).alias("q"), F.round(F.avg("q"), 6).alias("mean_shuffled"), ((1 + F.count_if(F.round("q", 9) >= F.round("seen", 9))) / (1 + TURNS)).alias("p"))


def large(cases: DataFrame, entity: str, least: int) -> DataFrame:
    """The cases of entities with ``least`` of them or more."""
    return cases.join(cases.groupBy(entity).agg(F.count("*").alias("_n")).where(F.col("_n") >= least), entity, "left_semi")


@query()
def m06_permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win rates of entities with 12 cases or more against 5,000 shuffles: of all cases, and within years. Draws are random, by a fixed seed."""
    cases = large(decided(spark, sf_dir), "o_custkey", LEAST)
    cells = shared.kept(cases.groupBy("o_custkey", "yr", "won").agg(F.count("*").alias("n")), "cells")
    of_all = cells.groupBy("o_custkey", "won").agg(F.sum("n").alias("n")).withColumn("all", F.lit(""))
    both = [("all", of_all, "all"), ("within years", cells, "yr")]
    parts = [permutation.tested(permutation.shuffled_chi2(c, "o_custkey", s, "won", "n")).select(F.lit(name).alias("shuffled"), "*") for name, c, s in both]
    return parts[0].unionByName(parts[1])


@query()
def m07_permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of events by user against 5,000 shuffles of types among all events."""
    cells = table(spark, sf_dir, "events").na.drop(subset=["user_id", "event_type"]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    cells = shared.kept(cells, "cells").withColumn("all", F.lit(""))
    return permutation.tested(permutation.shuffled_chi2(cells, "user_id", "all", "event_type", "n"))


CELLS = """c AS (SELECT user_id, event_type, count(*) AS obs FROM events GROUP BY 1, 2),
x AS (SELECT *, sum(obs) OVER (PARTITION BY user_id) * sum(obs) OVER (PARTITION BY event_type) / sum(obs) OVER () AS exp FROM
  (SELECT u.user_id, t.event_type, coalesce(c.obs, 0) AS obs FROM (SELECT DISTINCT user_id FROM c) u CROSS JOIN (SELECT DISTINCT event_type FROM c) t LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = t.event_type))"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type, obs, exp of all cells; types are few, and summed over without one task for all rows."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("obs"))
    types = c.groupBy("event_type").agg(F.sum("obs").alias("of_type"))
    users = c.groupBy("user_id").agg(F.sum("obs").alias("of_user"))
    total = c.agg(F.sum("obs").alias("total"))
    grid = users.crossJoin(F.broadcast(types)).crossJoin(F.broadcast(total))  # five types; one row
    return grid.join(c, ["user_id", "event_type"], "left").select("user_id", "event_type", F.coalesce("obs", F.lit(0)).alias("obs"), (F.col("of_user") * F.col("of_type") / F.col("total")).alias("exp"))


@query(f"WITH {CELLS} SELECT round(sum(pow(obs - exp, 2) / exp), 6) AS chi2, (count(DISTINCT user_id) - 1) * (count(DISTINCT event_type) - 1) AS df FROM x")
def m07_issue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).agg(F.round(F.sum((F.col("obs") - F.col("exp")) ** 2 / F.col("exp")), 6).alias("chi2"), ((F.count_distinct("user_id") - 1) * (F.count_distinct("event_type") - 1)).alias("df"))


@query(f"WITH {CELLS} SELECT user_id, event_type, obs, round((obs - exp) / sqrt(exp), 6) AS residual FROM x WHERE exp >= 3 AND obs >= 3 ORDER BY residual DESC, user_id, event_type LIMIT 12")
def t06_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells(spark, sf_dir).where("exp >= 3 AND obs >= 3").select("user_id", "event_type", "obs", F.round((F.col("obs") - F.col("exp")) / F.sqrt("exp"), 6).alias("residual"))
    return found.orderBy(F.desc("residual"), "user_id", "event_type").limit(12)


FOOTPRINT = """c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT event_type, sum(n) AS nt FROM c GROUP BY 1),
l AS (SELECT user_id, event_type, n, round(n / sum(n) OVER (PARTITION BY user_id) - nt / (SELECT sum(nt) FROM t), 3) AS lift FROM c JOIN t USING (event_type))"""


@query(f"WITH {FOOTPRINT} SELECT user_id, event_type, n, lift, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lift DESC, event_type) AS rank FROM l WHERE lift > 0) WHERE rank <= 4")
def a07_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types that an entity has more of than all have, by shares; lift is rounded before it is compared."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    shares = c.groupBy("event_type").agg(F.sum("n").alias("nt")).withColumn("share", F.col("nt") / F.sum("nt").over(Window.partitionBy()))
    own = F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))
    lifted = c.join(shares, "event_type").withColumn("lift", F.round(own - F.col("share"), 3)).where("lift > 0")
    ranked = lifted.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("lift"), "event_type")))
    return ranked.where("rank <= 4").select("user_id", "event_type", "n", "lift", "rank")


@query("""WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS r FROM conversations)
SELECT conv_id, role, count(*) AS turns, sum(CASE WHEN contains(text, '?') THEN 1 ELSE 0 END)::BIGINT AS asks,
  string_agg(substring(text, 1, 80), ' | ' ORDER BY r) FILTER (WHERE r <= 2) AS examples FROM c GROUP BY 1, 2""")
def a09_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each group, with its first two examples; those behind the second are never gathered."""
    c = table(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text")))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 2, F.struct("r", F.substring("text", 1, 80).alias("t"))))), lambda x: x["t"])
    return c.groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.sum(F.col("text").contains("?").cast("long")).alias("asks"), F.nullif(F.array_join(first, " | "), F.lit("")).alias("examples"))


@query("""WITH d AS (SELECT c_nationkey, o_orderstatus = 'F' AS won, CASE WHEN year(o_orderdate) < 1998 THEN 'early' ELSE 'late' END AS era FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O')),
b AS (SELECT avg(won::INT) AS base FROM d), p AS (SELECT c_nationkey, count(*) FILTER (WHERE era = 'early') AS n_early, count(*) FILTER (WHERE era = 'late') AS n_late,
  avg(won::INT) FILTER (WHERE era = 'early') AS early, avg(won::INT) FILTER (WHERE era = 'late') AS late FROM d GROUP BY 1)
SELECT c_nationkey, n_early, n_late, round(early, 6) AS early, round(late, 6) AS late, (early > base) = (late > base) AS stable, least(n_early, n_late) >= 30 AS powered FROM p, b""")
def a28_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an entity's win rate lies on the same side of the base in both eras, and whether both have cases enough."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    d = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", (F.col("o_orderstatus") == "F").cast("int").alias("won"), (F.year("o_orderdate") < 1998).alias("first"))
    side = lambda e: F.avg(F.when(e, F.col("won")))
    p = d.groupBy("c_nationkey").agg(F.count_if("first").alias("n_early"), F.count_if(~F.col("first")).alias("n_late"), side(F.col("first")).alias("e"), side(~F.col("first")).alias("l"))
    p = p.crossJoin(F.broadcast(d.agg(F.avg("won").alias("base"))))  # one row
    return p.select("c_nationkey", "n_early", "n_late", F.round("e", 6).alias("early"), F.round("l", 6).alias("late"), ((F.col("e") > F.col("base")) == (F.col("l") > F.col("base"))).alias("stable"), (F.least("n_early", "n_late") >= 30).alias("powered"))
