"""Dossiers of entities with what goes into them, nested matters rendered, blinded items with their key, and readers of nested files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import redaction
from weftline.functions import text as tx
from weftline.operators import studies
from weftline.operators.records import facets, firsts, seeded
from weftline.operators.select import blinded
from weftline.plans import entities, selection
from weftline.registry import ORACLES, query, table
from weftline.sources import records, shared


def sides_sql(entity: str) -> str:
    """The tables m and u of the categories above and below, from cells c (entity, cat, n)."""
    ranked = lambda order, which: f"(SELECT *, row_number() OVER (PARTITION BY {entity} ORDER BY {order}) AS r FROM l WHERE {which})"
    return f"""s AS (SELECT cat, sum(n) / (SELECT sum(n) FROM c) AS share FROM c GROUP BY 1), l AS (SELECT {entity}, cat, n, round(n / sum(n) OVER (PARTITION BY {entity}) - share, 3) AS lift FROM c JOIN s USING (cat)),
m AS (SELECT {entity}, string_agg(cat || ' ' || n, ', ' ORDER BY r) AS more FROM {ranked('lift DESC, cat', 'n >= 3 AND lift > 0.03')} WHERE r <= 4 GROUP BY 1),
u AS (SELECT {entity}, string_agg(cat || ' ' || n, ', ' ORDER BY r DESC) AS less FROM {ranked('lift, cat DESC', 'lift < -0.03')} WHERE r <= 3 GROUP BY 1)"""


def shown(side: str, category: str):
    return F.nullif(F.array_join(F.transform(side, lambda x: F.concat_ws(" ", x[category], x["n"].cast("string"))), ", "), F.lit(""))


@query(f"WITH c AS (SELECT user_id, event_type AS cat, count(*) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2), {sides_sql('user_id')} SELECT user_id, more, less FROM m FULL JOIN u USING (user_id)")
def t03_over_and_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that a user has more of, or fewer of, than all users by shares: the first four and the last three."""
    cells = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    found = studies.over_and_under(cells, "user_id", "event_type", "n")
    return found.select("user_id", shown("more", "event_type").alias("more"), shown("less", "event_type").alias("less"))


@query(f"""WITH e AS ({ORACLES['a03_entity_density']}), w AS ({ORACLES['m01_win_rates']}), t AS ({ORACLES['m04_false_discovery']}),
c AS (SELECT o_custkey, o_orderpriority AS cat, count(*) AS n FROM orders GROUP BY 1, 2), {sides_sql('o_custkey')},
g AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') || '/' || count(*) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'O') GROUP BY 1),
x AS (SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY r) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 3 GROUP BY 1)
SELECT o_custkey, e.n AS orders, e.years, rate, low, high, p, q_value, coalesce(reject, false) AS significant, more, less, coalesce(urgent, '0/0') AS urgent, latest
FROM e LEFT JOIN w USING (o_custkey) LEFT JOIN t USING (o_custkey) LEFT JOIN m USING (o_custkey) LEFT JOIN u USING (o_custkey) LEFT JOIN g USING (o_custkey) LEFT JOIN x USING (o_custkey)""")
def r23_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested document of each customer with 12 orders or more, from five grouped tables; only buckets that changed are written again, and what is read back is shown."""
    key, o = "o_custkey", table(spark, sf_dir, "orders")
    density = entities.a03_entity_density(spark, sf_dir)
    outcome = entities.m01_win_rates(spark, sf_dir).join(entities.m04_false_discovery(spark, sf_dir), key).select(key, "rate", "low", "high", "p", "q_value", "reject")
    footprint = studies.over_and_under(o.groupBy(key, "o_orderpriority").agg(F.count("*").alias("n")), key, "o_orderpriority", "n")
    urgent = o.where("o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'O')").groupBy(key).agg(F.count_if(F.col("o_orderstatus") == "F").alias("won"), F.count("*").alias("decided"))
    last = firsts(o, key, [F.desc("o_orderdate"), F.col("o_orderkey")], 3).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("less"), "o_orderkey"))), lambda s: s["o_orderkey"]).alias("latest"))
    whole = studies.dossiers(density.select(key), key, density=density, outcome=outcome, footprint=footprint, urgent=urgent, samples=last)
    path = shared.place_for(spark, "dossiers", sf_dir)
    studies.write_changed(whole, path, key)
    back = spark.read.schema(whole.schema).parquet(f"{path}/rows")
    wins = F.concat_ws("/", F.col("urgent.won").cast("string"), F.col("urgent.decided").cast("string"))
    return back.select(
        key, F.col("density.n").alias("orders"), "density.years", "outcome.rate", "outcome.low", "outcome.high", "outcome.p", "outcome.q_value", F.coalesce("outcome.reject", F.lit(False)).alias("significant"),
        shown("footprint.more", "o_orderpriority").alias("more"), shown("footprint.less", "o_orderpriority").alias("less"), F.when(F.col("urgent").isNull(), "0/0").otherwise(wins).alias("urgent"), F.array_join(F.col("samples.latest").cast("array<string>"), ",").alias("latest"),
    )


@query("""WITH a AS (SELECT 'category' AS kind, v AS value, count(*) AS n FROM (SELECT DISTINCT l_orderkey, strftime(l_shipdate, '%m') AS v FROM lineitem) GROUP BY 2),
b AS (SELECT 'authority' AS kind, lower(p_brand) AS value, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY kind)::BIGINT AS total FROM (SELECT * FROM a UNION ALL SELECT * FROM b) UNION ALL SELECT 'won', 'all', count(*) FILTER (WHERE o_orderstatus = 'F'), count(*) FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT kind, value, n, total, round(n / total, 6) AS rate FROM c""")
def a05_base_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship months of orders, wins of decided orders, and brands cited with what stands behind a comma."""
    lines = table(spark, sf_dir, "lineitem")
    units = lines.select("l_orderkey", F.date_format("l_shipdate", "MM").alias("category")).distinct()
    cited = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.concat("p_brand", F.lit(", "), "p_type").alias("cite"))
    return studies.base_figures(units, entities.decided(spark, sf_dir), cited)


@query("""WITH l AS (SELECT l_orderkey, unnest(list_distinct(list(strftime(l_shipdate, '%m')))) AS v FROM lineitem GROUP BY 1), x AS (SELECT 'status' AS facet, o_orderstatus AS value FROM orders
UNION ALL SELECT 'month', strftime(o_orderdate, '%m') FROM orders UNION ALL SELECT 'month', v FROM l JOIN orders ON o_orderkey = l_orderkey)
SELECT facet, value, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY 1, 2""")
def a01_list_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of orders: a value, and a value and a list that count as one facet."""
    months = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.date_format("l_shipdate", "MM")).alias("months"))
    o = table(spark, sf_dir, "orders").join(months, "o_orderkey", "left").withColumn("month", F.date_format("o_orderdate", "MM"))
    return facets(o, {"o_orderstatus": "status", "month": "month", "months": "month"})


@query("""WITH l AS (SELECT l_orderkey, string_agg('Skip junior ' || l_linenumber || ' for ' || l_partkey || ' (in resolution: ' || (l_returnflag = 'R') || ')', ' | ' ORDER BY l_linenumber, l_partkey, l_returnflag = 'R') AS skips, bool_or(l_linestatus = 'O') AS lottery FROM lineitem GROUP BY 1)
SELECT o_orderkey, concat_ws(' | ', 'Basis: ' || coalesce(o_orderpriority, ''), skips, CASE WHEN lottery THEN 'Tie-break lottery: ' || o_orderstatus END) AS fingerprint FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def f22_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as matters: lines are what is passed over, an open line means a lottery."""
    line = tx.filled("Skip junior {role} for {skill} (in resolution: {said})", role=F.col("l_linenumber"), skill=F.col("l_partkey"), said=F.col("l_returnflag") == "R")
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("line")))), lambda s: s["line"]).alias("skips"), F.bool_or(F.col("l_linestatus") == "O").alias("lottery"))
    o = table(spark, sf_dir, "orders").join(nested, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    lottery = F.when(F.col("lottery"), F.array(F.concat(F.lit("Tie-break lottery: "), "o_orderstatus")))
    return o.select("o_orderkey", tx.fingerprint(F.col("o_orderpriority"), F.col("skips"), lottery).alias("fingerprint"))


PROMPT = "Matter {key}, status {status}.\nEvidence:\n{evidence}\nAnswer from the evidence alone."


@query("""WITH l AS (SELECT l_orderkey, string_agg(r || '. part ' || l_partkey || ' (' || l_returnflag || ')', chr(10) ORDER BY r) AS evidence FROM
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 3 GROUP BY 1)
SELECT o_orderkey, 'Matter ' || o_orderkey || ', status ' || coalesce(o_orderstatus, '-') || '.' || chr(10) || 'Evidence:' || chr(10) || coalesce(evidence, '-') || chr(10) || 'Answer from the evidence alone.' AS prompt FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def f23_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template over each order and its three dearest lines, numbered."""
    best = firsts(table(spark, sf_dir, "lineitem"), "l_orderkey", [F.desc("l_extendedprice"), F.col("l_linenumber")], 3)
    rows = best.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("less"), "l_linenumber", "l_partkey", "l_returnflag"))).alias("rows"))
    told = F.transform("rows", lambda r, i: tx.filled("{n}. part {part} ({flag})", n=i + 1, part=r["l_partkey"], flag=r["l_returnflag"]))
    o = table(spark, sf_dir, "orders").join(rows, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return o.select("o_orderkey", tx.filled(PROMPT, key=F.col("o_orderkey"), status=F.col("o_orderstatus"), evidence=F.array_join(told, "\n")).alias("prompt"))


@query("""WITH c AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE year(o_orderdate) + o_orderkey % 4 * 9 END AS year, CASE o_orderstatus WHEN 'F' THEN 'pks_allowed' WHEN 'O' THEN 'pks_not_allowed' ELSE o_orderpriority END AS cat FROM orders)
SELECT CASE WHEN year IS NULL THEN 'unknown' WHEN year <= 2001 THEN '1999-2001' WHEN year <= 2010 THEN '2004-2009' ELSE '2018-2025' END AS era, CASE WHEN cat LIKE 'pks%' THEN 'pks_reduction' ELSE cat END AS category, count(*) AS n, min(year)::INT AS first_year FROM c GROUP BY 1, 2""")
def p11_eras_and_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years out of case numbers, eras and categories in one spelling, counted."""
    key = F.col("o_orderkey")
    number = F.when(key % 13 != 0, F.concat(F.lit("N-"), (F.year("o_orderdate") + key % 4 * 9).cast("string"), F.lit("x"), key.cast("string")))
    code = F.when(F.col("o_orderstatus") == "F", "pks_allowed").when(F.col("o_orderstatus") == "O", "pks_not_allowed").otherwise(F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(tx.case_year(number).alias("year"), tx.one_category(code).alias("category"))
    return rows.groupBy(tx.era(F.col("year")).alias("era"), "category").agg(F.count("*").alias("n"), F.min("year").alias("first_year"))


CODES_SQL = f"SELECT code, d.doc_id, d.source, d.lang, d.n_chars FROM ({ORACLES[selection.r22_blinding_codes.__name__]}) c JOIN documents d ON d.doc_id = c.doc_id"


def blinded_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return blinded(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), "source", "doc_id", "source", "D", ["lang"])


@query(f"SELECT code, n_chars FROM ({CODES_SQL})")
def p14_judge_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge sees of documents: codes, and nothing that tells the answer."""
    return blinded_documents(spark, sf_dir)[0]


@query(f"SELECT code, doc_id, source, lang FROM ({CODES_SQL})")
def p14_key_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blinded_documents(spark, sf_dir)[1]


@query("""WITH l AS (SELECT l_orderkey, list('line ' || l_linenumber || ' of ' || c_name ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT o_orderkey, replace('sold to ' || c_name || ', who is no ' || c_name || '1', c_name || ',', 'R1,') AS note, replace(array_to_string(lines, '; '), c_name, 'R1') AS lines FROM orders JOIN customer ON c_custkey = o_custkey JOIN l ON l_orderkey = o_orderkey""")
def f15_nested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested records that tell the customer's name in a struct and in an array of structs; a longer name that begins alike stays."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")
    line = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" of "), "c_name").alias("text"))
    lines = line.groupBy("o_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "text"))), lambda s: F.struct(s["text"].alias("text"))).alias("lines"))
    note = F.concat(F.lit("sold to "), "c_name", F.lit(", who is no "), "c_name", F.lit("1"))
    whole = o.join(lines, "o_orderkey").select("o_orderkey", F.array(F.struct(F.col("c_name").alias("name"), F.lit("R1").alias("ref"))).alias("roster"), F.lit("").alias("judge"), F.lit("").alias("district"), F.struct(note.alias("note"), "lines").alias("record"))
    found = redaction.nested_deidentified(whole, "record", "roster", "judge", "district")
    return found.select("o_orderkey", "record.note", F.array_join(F.transform("record.lines", lambda x: x["text"]), "; ").alias("lines"))


@query("""WITH l AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1)
SELECT CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey END AS matter_id, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE coalesce(n, 0)::INT END AS issues, o_orderkey % 19 = 0 AS rejected FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def s11_checked_matters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as JSON lines, some of them cut off, and read as matters: what is broken becomes a reject, never a row of nulls."""
    flags = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("issues"))
    o = table(spark, sf_dir, "orders").join(flags, "o_orderkey", "left")
    told = F.to_json(F.struct(F.col("o_orderkey").alias("matter_id"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues")))
    path = shared.new_path(spark, "matters")
    o.select(F.when(F.col("o_orderkey") % 19 == 0, F.left(told, F.lit(14))).otherwise(told).alias("value")).write.text(path)
    good, bad = records.checked(spark, "matter_id long, issues array<string>", path, lines=True)
    rejects = bad.select(F.lit(None).cast("long").alias("matter_id"), F.lit(None).cast("int").alias("issues"), F.lit(True).alias("rejected"))
    return good.select("matter_id", F.size("issues").alias("issues"), F.lit(False).alias("rejected")).unionByName(rejects)


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha1('3|' || doc_id), doc_id) AS r FROM documents WHERE lang IS NOT NULL), c AS (SELECT lang, doc_id FROM r WHERE r <= 20)
SELECT lang, doc_id, count(*) OVER (PARTITION BY lang) AS selected FROM c""")
def s16_evaluation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents of each language by hash, written as an evaluation set with its index, and read back with it."""
    chosen = firsts(table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "lang"), "lang", [seeded("doc_id", seed="3"), F.col("doc_id")], 20)
    path = shared.new_path(spark, "evaluation")
    records.write_evaluation_set(chosen, path, "lang")
    matters, index = records.evaluation_set(spark, path)
    return matters.join(index, "lang").select("lang", "doc_id", "selected")
