"""Parts of a study: citations scored against sets, decoys, ladders of answers, arms against one truth, issue spotting, packs, dossiers."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import redaction
from weftline.functions.text import citation, letters_only
from weftline.operators.records import firsts, seeded
from weftline.operators.select import before
from weftline.sources import shared

#: Keys by which a citation is resolved, the most exact first.
LEVELS = (("district", "judge", "year"), ("judge", "year"), ("district", "year"))


def citation_scores(analyses: DataFrame, known: DataFrame, evidence: DataFrame, shown: int = 8) -> DataFrame:
    """id, n_cites, n_resolved, resolution_rate, n_in_evidence, in_evidence_rate, unresolved of each analysis (id, text).

    A citation counts once by judge and year. It is resolved to all of ``known`` (hid, district, judge, year) that
    share the keys of the first level that anything shares; it is in evidence if any of these is among the
    analysis's ``evidence`` (id, hid). No such set is ever gathered: that one of them is in evidence means that a row of evidence
    has the same keys. Without citations rates are null, without evidence both its figures are.
    """
    plain = lambda c: letters_only(F.coalesce(c, F.lit("")))
    found = analyses.select("id", F.posexplode(redaction.cites(F.col("text"))).alias("at", "c"))
    first = found.groupBy("id", plain(F.col("c.judge")).alias("judge"), F.col("c.year").alias("year")).agg(F.min(F.struct("at", "c")).alias("m"))
    rows = first.select("id", "judge", "year", plain(F.col("m.c.district")).alias("district"), F.col("m.at").alias("at"), F.format_string("%s (%s), %d", F.coalesce("m.c.district", F.lit("?")), F.col("m.c.judge"), F.col("year")).alias("shown"))
    base = known.select("hid", plain(F.col("district")).alias("district"), plain(F.col("judge")).alias("judge"), "year")
    held = evidence.select("id", "hid").join(base, "hid")
    for i, keys in enumerate(LEVELS):
        there = base.select(*keys).distinct().withColumn(f"there{i}", F.lit(True))
        own = held.select("id", *keys).distinct().withColumn(f"own{i}", F.lit(True))
        rows = rows.join(there, [*keys], "left").join(own, ["id", *keys], "left")
    at_level = F.coalesce(*[F.when(F.col(f"there{i}"), F.coalesce(f"own{i}", F.lit(False))) for i in range(len(LEVELS))])
    rows = rows.withColumn("in_evidence", at_level).withColumn("resolved", F.col("in_evidence").isNotNull())
    missing = F.slice(F.array_sort(F.collect_list(F.when(~F.col("resolved"), F.struct("at", "shown")))), 1, shown)
    sums = rows.groupBy("id").agg(F.count("*").alias("n"), F.count_if("resolved").alias("r"), F.count_if("in_evidence").alias("e"), F.transform(missing, lambda m: m["shown"]).alias("u"))
    out = analyses.select("id").join(sums, "id", "left").join(evidence.select("id").distinct().withColumn("has", F.lit(True)), "id", "left")
    n = F.coalesce("n", F.lit(0))
    in_evidence = F.when(F.col("has"), F.coalesce("e", F.lit(0)))
    rate = lambda c: F.round(F.try_divide(c, n), 3)
    return out.select("id", n.alias("n_cites"), F.coalesce("r", F.lit(0)).alias("n_resolved"), rate(F.coalesce("r", F.lit(0))).alias("resolution_rate"), in_evidence.alias("n_in_evidence"), rate(in_evidence).alias("in_evidence_rate"), F.coalesce("u", F.array().cast("array<string>")).alias("unresolved"))


def decoys(rows: DataFrame, key: str, own: str, universe: list[str], adjacent: list[str], n: int, seed: str, most_adjacent: int = 2) -> DataFrame:
    """``rows`` with decoys (``n`` of the universe that aren't the row's own, up to ``most_adjacent`` adjacent ones first) and candidates (own and decoys, shuffled).

    Drawn without replacement in the order of seeded hashes, within the row: nothing is joined. A null
    array owns nothing; a universe without enough left gives fewer.
    """
    mark = lambda c, salt: F.sha1(F.concat_ws("|", F.lit(seed + salt), F.col(key).cast("string"), c).cast("binary"))
    in_order = lambda names, salt: F.transform(F.array_sort(F.transform(names, lambda c: F.struct(mark(c, salt).alias("h"), c.alias("c")))), lambda s: s["c"])
    mine = F.array_distinct(F.coalesce(F.col(own), F.array().cast("array<string>")))
    names = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    near = F.slice(in_order(F.array_except(names(adjacent), mine), "a"), 1, most_adjacent)
    far = in_order(F.array_except(names([u for u in universe if u not in adjacent]), mine), "d")
    drawn = rows.withColumn("decoys", F.slice(F.concat(near, far), 1, n))
    return drawn.withColumn("candidates", in_order(F.concat(mine, F.col("decoys")), "c"))


def ladder(rows: DataFrame, key: str, issue: str, text: str, step: int = 7) -> DataFrame:
    """Four synthetic answers a row: level 0 is another issue's text, 1 the issue's name, 2 the first half of the row's own text, 3 all of it.

    The other issue is the next one in order, around the end; of its rows that at place ``step`` * key, counted around.
    Places come from ranges, so that the pick is an equi-join. A single issue has no level 0. Rows of null issue or text are left out.
    """
    rows = rows.where(F.col(issue).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(issue).alias("issue"), F.col(text).alias("text"))
    placed = before(rows, "issue", ["key"], name="place")
    sizes = shared.kept(placed.groupBy("issue").agg(F.count("*").alias("size")), "sizes")
    ring = before(sizes.withColumn("one", F.lit(0)), "one", ["issue"], name="at").select("issue", "size", "at")
    issues = ring.count()
    after = ring.select(((F.col("at") - 1 + issues) % issues).alias("at"), F.col("issue").alias("other"), F.col("size").alias("other_size"))
    asked = placed.join(ring.select("issue", "at").join(after, "at").where("issue <> other"), "issue", "left").withColumn("pick", F.pmod(F.col("key") * step, "other_size"))
    pool = placed.select(F.col("issue").alias("other"), F.col("place").alias("pick"), F.col("text").alias("decoy"))
    full = asked.join(pool, ["other", "pick"], "left")
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    levels = F.array(*[F.struct(F.lit(i).alias("level"), c.alias("answer")) for i, c in enumerate((F.col("decoy"), F.col("issue"), half, F.col("text")))])
    return full.select("key", "issue", F.explode(levels).alias("l")).where("l.answer IS NOT NULL").select("key", "issue", "l.level", "l.answer")


def arm_scores(answers: DataFrame, truth: DataFrame, costs: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """arm, id, tp, fp, fn, f1, cost for every arm and every id of ``truth``: any number of arms in one pass over long tables.

    answers: arm, id, issue; truth: id, issue (ids without issues as a null one); costs: arm, id, cost. What an arm doesn't
    answer it has missed; repeated answers count once. Arms are few: their names, counted first, are sent to all tasks.
    The three tables are shuffled once, by ids, to tasks of some ``rows`` rows; there an id is one row of what is true, said and spent.
    """
    arms = shared.kept(answers.select("arm").where("arm IS NOT NULL").distinct(), "arms")
    if arms.count() > 1000:
        raise ValueError("more than 1000 arms")
    total = costs.agg(F.sum("cost").alias("cost")).schema["cost"].dataType
    whole = truth.select("id", F.lit(0).cast("byte").alias("kind"), F.lit(None).alias("arm"), "issue", F.lit(None).alias("cost"))
    for table, kind, issue, cost in ((answers, 1, F.col("issue"), F.lit(None)), (costs, 2, F.lit(None), F.col("cost"))):
        whole = whole.unionByName(table.where("arm IS NOT NULL AND id IS NOT NULL").select("id", F.lit(kind).cast("byte").alias("kind"), "arm", issue.alias("issue"), cost.alias("cost")))
    # each task holds as many rows however large the tables are; a number that is asked for isn't changed by size
    tasks = max(1, -(-sum(t.count() for t in (answers, truth, costs)) // rows))
    once = whole.repartition(tasks, "id").groupBy("id", "kind", "arm", "issue").agg(F.sum("cost").alias("cost"))
    of = lambda kind, value: F.collect_list(F.when(F.col("kind") == kind, value))
    by_id = once.groupBy("id").agg(
        F.count_if(F.col("kind") == 0).alias("asked"), of(0, F.col("issue")).alias("true"),
        F.collect_list(F.when((F.col("kind") == 1) & F.col("issue").isNotNull(), F.struct("arm", "issue"))).alias("said"), of(2, F.struct("arm", "cost")).alias("spent"),
    ).where("asked > 0")
    own = lambda rows, value: F.transform(F.filter(rows, lambda x: x["arm"] == F.col("name")), lambda x: x[value])
    each = by_id.crossJoin(F.broadcast(arms.withColumnRenamed("arm", "name"))).withColumn("own", own("said", "issue")).withColumn("tp", F.size(F.array_intersect("own", "true")).cast("long"))
    fp, fn = F.size("own") - F.col("tp"), F.size("true") - F.col("tp")
    scored = each.select(F.col("name").alias("arm"), "id", "tp", fp.alias("fp"), fn.alias("fn"), F.coalesce(F.get(own("spent", "cost"), F.lit(0)), F.lit(0).cast(total)).alias("cost"))
    f1 = F.round(F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 6)
    return scored.select("arm", "id", "tp", "fp", "fn", f1.alias("f1"), "cost")


def spotted(rows: DataFrame, key: str, text: str, rules: list[tuple[str, str, int]]) -> DataFrame:
    """key, issue, score, triggers: of each text, issues whose triggers' weights sum to more than 0.

    rules: issue, trigger, weight. A trigger counts at each whole word in lower case; each one after ``no`` or ``not`` counts
    against it, once for itself and once more. All rules are looked at in one pass over the texts, which go nowhere.
    """
    rows = rows.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))

    def net(trigger: str) -> Column:
        # what a pattern can't do without is looked for first, as plain text
        count = lambda p, *needs: F.when(functools.reduce(operator.or_, [F.contains("low", F.lit(n)) for n in needs]), F.size(F.regexp_extract_all("low", F.lit(p), F.lit(0)))).otherwise(0)
        word = rf"(^|[^a-z0-9]){trigger}($|[^a-z0-9])"
        return count(word, trigger) - 2 * count(rf"(^|[^a-z0-9])not? {trigger}($|[^a-z0-9])", f"no {trigger}", f"not {trigger}")

    hits = F.array(*[F.struct(F.lit(i).alias("issue"), F.lit(t).alias("trigger"), (w * net(t)).cast("long").alias("points")) for i, t, w in rules])
    told = rows.select("key", F.explode(F.filter(hits, lambda h: h["points"] != 0)).alias("h"))
    sums = told.groupBy("key", "h.issue").agg(F.sum("h.points").alias("score"), F.array_join(F.array_sort(F.collect_set("h.trigger")), ", ").alias("triggers"))
    return sums.where("score > 0")


def packs(found: DataFrame, rows: DataFrame, key: str, entity: str, text: str, k: int = 3, beginning: int = 60) -> DataFrame:
    """entity, pack: of each entity, its issues in order, each with its ``k`` best supporting rows, as text.

    Only the ``k`` best of each entity and issue are ever gathered, and only of these are texts cut out. Ties go to the smaller key; rows of null entity are left out.
    """
    own = rows.select(F.col(key).alias("key"), F.col(entity).alias("entity"), F.regexp_replace(F.substring(text, 1, beginning), r"\s", " ").alias("beginning")).where("entity IS NOT NULL")
    joined = found.join(own, "key").withColumn("both", F.struct("entity", "issue"))
    best = firsts(joined, "both", [F.desc("score"), F.col("key")], k)
    line = F.concat(F.lit("- "), F.col("key").cast("string"), F.lit(" ("), F.col("score").cast("string"), F.lit("; "), "triggers", F.lit("): "), "beginning")
    per = best.groupBy("entity", "issue").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "key", line.alias("line")))).alias("lines"))
    part = per.select("entity", F.struct("issue", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("lines")).alias("p"))
    return part.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.concat(F.lit("## "), p["issue"], F.lit("\n"), p["lines"])), "\n").alias("pack"))


def write_changed(dossiers: DataFrame, path: str, key: str, buckets: int = 64) -> int:
    """Writes nested rows, one a key, in buckets by key, and later only the buckets of keys that are new, gone or whose content has changed; returns how many buckets were written.

    Marks of what is written lie beside it, as a table of their own, replaced after the rows; a writer that stops
    before that writes the same buckets again. Readers of other buckets are never disturbed. Null keys are one key.
    """
    spark = dossiers.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    rows = dossiers.select("*", bucket)
    marks = shared.kept(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*dossiers.columns))).cast("decimal(38,0)")).alias("mark")), "marks")
    if shared.exists(spark, f"{path}/marks"):
        old = spark.read.parquet(f"{path}/marks").select(F.col("bucket").alias("b"), F.col("n").alias("m"), F.col("mark").alias("k"))
        both = marks.join(old, F.col("bucket") == F.col("b"), "full_outer")
        changed = sorted(r["c"] for r in both.where(~(F.col("n").eqNullSafe(F.col("m")) & F.col("mark").eqNullSafe(F.col("k")))).select(F.coalesce("bucket", "b").alias("c")).collect())
    else:
        changed = list(range(buckets))
    if changed:
        gone = set(changed) - {r["bucket"] for r in marks.select("bucket").collect()}
        rows.where(F.col("bucket").isin(changed)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
        for b in gone:
            shared.removed(spark, f"{path}/rows/bucket={b}")
        marks.write.mode("overwrite").parquet(f"{path}/marks")
    return len(changed)


def over_and_under(cells: DataFrame, entity: str, category: str, n: str, least: int = 3, gap: float = 0.03, most: int = 4, fewest: int = 3) -> DataFrame:
    """entity, more, less: categories (category, n, lift) whose share of the entity's units lies above their share of all units by over ``gap``, or as far below.

    Lift is rounded to 3 digits before it is compared. ``more`` holds the ``most`` greatest with ``least`` units or more, ``less`` the
    ``fewest`` smallest, both by falling lift, ties by name. No more than these are gathered of an entity. Cells with nulls are left
    out; an entity without any such category has no row.
    """
    cells = cells.select(entity, category, n).na.drop()
    shares = cells.groupBy(category).agg(F.sum(n).alias("_all")).withColumn("_share", F.col("_all") / F.sum("_all").over(Window.partitionBy()))  # a row a category
    own = cells.groupBy(entity).agg(F.sum(n).alias("_own"))
    lift = F.round(F.col(n) / F.col("_own") - F.col("_share"), 3)
    rows = cells.join(shares.select(category, "_share"), category).join(own, entity).select(entity, category, n, lift.alias("lift"))
    above = firsts(rows.where((F.col(n) >= least) & (F.col("lift") > gap)), entity, [F.desc("lift"), F.col(category)], most)
    below = firsts(rows.where(F.col("lift") < -gap), entity, [F.col("lift"), F.desc(category)], fewest)
    both = above.withColumn("_up", F.lit(True)).unionByName(below.withColumn("_up", F.lit(False)))
    placed = F.struct((-F.col("lift")).alias("down"), category, n, "lift")
    side = lambda up: F.transform(F.array_sort(F.collect_list(F.when(F.col("_up") == up, placed))), lambda x: x.dropFields("down"))
    return both.groupBy(entity).agg(side(True).alias("more"), side(False).alias("less"))


def dossiers(base: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """``base`` with a struct for each part, of its columns; null where the part has no row of the key. Parts have a row a key at most, so nothing is gathered."""
    for name, part in parts.items():
        base = base.join(part.select(key, F.struct(*[c for c in part.columns if c != key]).alias(name)), key, "left")
    return base


def base_figures(units: DataFrame, decided: DataFrame, cited: DataFrame) -> DataFrame:
    """kind, value, n, total, rate: what entities are measured against.

    ``units`` (category) gives the distribution of categories, ``decided`` (won, 0 or 1) one row with the rate of wins,
    ``cited`` (cite) counts of citations in one spelling each. Nulls and blank citations don't count; without any decided row that rate is null.
    """
    def shares(rows: DataFrame, kind: str) -> DataFrame:
        counts = rows.where("value IS NOT NULL AND value <> ''").groupBy("value").agg(F.count("*").alias("n"))
        return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(F.lit(kind).alias("kind"), "value", "n", "total")  # one row

    wins = decided.agg(F.coalesce(F.sum(F.col("won").cast("long")), F.lit(0)).alias("n"), F.count("won").alias("total")).select(F.lit("won").alias("kind"), F.lit("all").alias("value"), "n", "total")
    parts = shares(units.select(F.col("category").alias("value")), "category").unionByName(wins).unionByName(shares(cited.select(citation(F.col("cite")).alias("value")), "authority"))
    return parts.withColumn("rate", F.round(F.try_divide(F.col("n").cast("double"), F.col("total")), 6))
