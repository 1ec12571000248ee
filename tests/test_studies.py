"""Parts of studies on odd rows, and dossiers that are rewritten where they changed."""

from pathlib import Path

from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.functions.text import folded
from weftline.operators import studies
from weftline.operators.records import facets
from weftline.operators.select import blinded


def test_only_changed_dossiers_are_written(spark, tmp_path):
    path = str(tmp_path / "dossiers")
    lines = spark.createDataFrame([(e, i, f"line {i}") for e in range(40) for i in range(3)], "entity long, at int, text string")
    nested = lines.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("lines"))
    assert studies.write_changed(nested, path, "entity", buckets=8) == 8
    files = lambda: {f: f.stat().st_mtime_ns for f in Path(path, "rows").glob("bucket=*/*.parquet")}
    rows = lambda: sorted((r["entity"], tuple(x["text"] for x in r["lines"])) for r in spark.read.parquet(f"{path}/rows").collect())
    old = files()
    assert studies.write_changed(nested, path, "entity", buckets=8) == 0 and files() == old
    changed = nested.withColumn("lines", F.when(F.col("entity") == 5, F.slice("lines", 1, 1)).otherwise(F.col("lines")))
    assert studies.write_changed(changed, path, "entity", buckets=8) == 1
    new = files()
    assert len({f.parent.name for f in old.keys() ^ new.keys()} | {f.parent.name for f in old.keys() & new.keys() if old[f] != new[f]}) == 1
    assert rows() == sorted((e, tuple(f"line {i}" for i in range(1 if e == 5 else 3))) for e in range(40))
    fewer = changed.where("entity <> 7")
    assert studies.write_changed(fewer, path, "entity", buckets=8) == 1 and 7 not in dict(rows())
    one = changed.where("entity = 5")
    studies.write_changed(one, path, "entity", buckets=8)
    assert rows() == [(5, ("line 0",))]


def test_citation_levels_and_missing_evidence(spark):
    known = [(1, "North Unified", "Doe", 2001), (2, "North Unified", "Roe", 2001), (3, "South", "Doe", 2002), (4, None, None, 2003)]
    texts = [
        (1, "North Unified (Doe), 2001; North Unified (ALJ Doe), 2001; Elsewhere (Roe), 2001; South (Nobody), 2002; Void (Moe), 1990."),
        (2, None), (3, "Void (Moe), 1990."), (4, ""), (None, "South (Doe), 2002"),
    ]
    analyses = spark.createDataFrame(texts, "id long, text string")
    base = spark.createDataFrame(known, "hid long, district string, judge string, year int")
    evidence = spark.createDataFrame([(1, 2), (1, 99), (3, 1), (2, 1)], "id long, hid long")
    got = {r["id"]: tuple(r)[1:] for r in studies.citation_scores(analyses, base, evidence).collect()}
    assert got[1][:5] == (4, 3, 0.75, 1, 0.25) and got[1][5] == ["Void (Moe), 1990"]
    assert got[2][:5] == (0, 0, None, 0, None) and got[4][:5] == (0, 0, None, None, None)
    assert got[3] == (1, 0, 0.0, 0, 0.0, ["Void (Moe), 1990"])
    assert studies.citation_scores(analyses.limit(0), base, evidence).count() == 0


def test_decoys_are_never_true(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, list("abcdefg")), (4, ["a", "a"])], "id long, own array<string>")
    found = {r["id"]: r for r in studies.decoys(rows, "id", "own", list("abcdefg"), ["f", "g"], 3, "s").collect()}
    for r in found.values():
        assert not set(r["decoys"]) & set(r["own"] or []) and sorted(r["candidates"]) == sorted({*(r["own"] or []), *r["decoys"]})
    assert len(found[1]["decoys"]) == 3 and set(found[1]["decoys"][:2]) == {"f", "g"} and found[3]["decoys"] == [] and len(found[4]["candidates"]) == 4


def test_arms_ladder_and_packs(spark):
    answers = spark.createDataFrame([("x", 1, "a"), ("x", 1, "a"), ("x", 1, "b"), ("y", 9, "a"), (None, 1, "a")], "arm string, id long, issue string")
    truth = spark.createDataFrame([(1, "a"), (1, "c"), (2, None)], "id long, issue string")
    costs = spark.createDataFrame([("x", 1, 2), ("x", 1, 3)], "arm string, id long, cost int")
    got = sorted(map(tuple, studies.arm_scores(answers, truth, costs).collect()))
    assert got == [("x", 1, 1, 1, 1, 0.5, 5), ("x", 2, 0, 0, 0, 0.0, 0), ("y", 1, 0, 0, 2, 0.0, 0), ("y", 2, 0, 0, 0, 0.0, 0)]
    alone = spark.createDataFrame([(1, "one", "text")], "k long, i string, t string")
    assert sorted(r["level"] for r in studies.ladder(alone, "k", "i", "t").collect()) == [1, 2, 3]
    texts = spark.createDataFrame([(1, "e", "No fire here, fire"), (2, "e", None), (3, None, "fire fire"), (4, "e", "FIRE!")], "k long, e string, t string")
    found = studies.spotted(texts, "k", "t", [("heat", "fire", 2)])
    assert sorted((r["key"], r["score"]) for r in found.collect()) == [(3, 2), (4, 2)]
    assert [tuple(r) for r in studies.packs(found, texts, "k", "e", "t").collect()] == [("e", "## heat\n- 4 (2; fire): FIRE!")]


def test_tasks_of_arms_grow_with_rows(spark):
    answers = spark.range(4000).selectExpr("if(id % 3 = 0, 'x', 'y') AS arm", "nullif(id % 500, 0) AS id", "nullif(id % 7, 6) AS issue")
    truth, costs = answers.where("issue < 3").select("id", "issue"), answers.selectExpr("arm", "id", "cast(issue AS decimal(5, 2)) AS cost")
    few, many = (studies.arm_scores(answers, truth, costs, rows=n) for n in (10**6, 1000))
    found = sorted(map(tuple, few.collect()), key=repr)
    assert found == sorted(map(tuple, many.collect()), key=repr) and len(found) == 1000 and dict(few.dtypes)["cost"] == "decimal(15,2)"
    assert few.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() >= 9
    x, y = (next(r for r in found if r[:2] == (arm, 5)) for arm in "xy")
    rows = [(i, i % 7) for i in range(4000) if i % 500 == 5]
    true = {k for _, k in rows if k < 3}
    for arm, r in (("x", x), ("y", y)):
        own = {k for i, k in rows if (i % 3 == 0) == (arm == "x") and k < 6}
        assert r[2:5] == (len(own & true), len(own - true), len(true - own)) and r[6] == sum(k for i, k in rows if (i % 3 == 0) == (arm == "x") and k < 6)
    assert [r[2:5] for r in found if r[1] is None] == [(0, 0, 3)] * 2


def test_folding(spark):
    r = spark.createDataFrame([("  École  Ñandú É ß ø ",), (None,)], "t string").select(folded(F.col("t")).alias("x")).collect()
    assert [x["x"] for x in r] == ["ecole nandu e ß ø", None]


def test_categories_above_and_below(spark):
    rows = [(1, "a", 9), (1, "b", 1), (2, "a", 1), (2, "b", 9), (3, None, 4), (None, "a", 4), (4, "c", 2), (4, "a", 8)]
    cells = spark.createDataFrame(rows, "e long, c string, n long")
    got = {r["e"]: ([x["c"] for x in r["more"]], [x["c"] for x in r["less"]]) for r in studies.over_and_under(cells, "e", "c", "n").collect()}
    assert got == {1: (["a"], ["b"]), 2: (["b"], ["a"]), 4: (["a"], [])}  # c lies above, but with fewer than three units
    assert studies.over_and_under(cells.limit(0), "e", "c", "n").count() == 0


def test_dossiers_keep_entities_without_parts(spark):
    base = spark.createDataFrame([(1,), (2,)], "k long")
    part = spark.createDataFrame([(1, 5, "x"), (9, 6, "y")], "k long, n int, t string")
    got = {r["k"]: r["p"] for r in studies.dossiers(base, "k", p=part).collect()}
    assert got[2] is None and tuple(got[1]) == (5, "x")


def test_base_figures_of_nothing_and_blanks(spark):
    units = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "category string")
    decided = spark.createDataFrame([(1,), (0,), (None,)], "won int")
    cited = spark.createDataFrame([("Ed. Code  s. 1 (a)",), ("ed. code s. 1, b",), (None,), (" ",)], "cite string")
    got = {(r["kind"], r["value"]): (r["n"], r["total"], r["rate"]) for r in studies.base_figures(units, decided, cited).collect()}
    assert got == {("category", "a"): (2, 3, 0.666667), ("category", "b"): (1, 3, 0.333333), ("won", "all"): (1, 2, 0.5), ("authority", "ed. code s. 1"): (2, 2, 1.0)}
    none = studies.base_figures(units.limit(0), decided.limit(0), cited.limit(0)).collect()
    assert [tuple(r) for r in none] == [("won", "all", 0, 0, None)]


def test_facets_of_lists(spark):
    df = spark.createDataFrame([("x", ["x", "y", "x", None]), (None, None), ("z", [])], "one string, many array<string>")
    got = sorted(map(tuple, facets(df, {"one": "f", "many": "f"}).collect()))
    assert got == [("f", "x", 3), ("f", "y", 1), ("f", "z", 1)]


def test_codes_and_key_agree(spark):
    rows = spark.createDataFrame([(i, i % 2, "yes" if i % 3 else "no", f"text {i}") for i in range(20)], "k long, s int, answer string, text string")
    view, keys = blinded(rows, "s", "k", "s", "X", ["answer"])
    assert view.columns == ["code", "text"] and keys.columns == ["code", "k", "s", "answer"]
    both = keys.where("s = 1").alias("a").join(view.alias("b"), "code").where("text = concat('text ', k)")
    assert both.count() == 10


def test_matters_rendered(spark):
    df = spark.createDataFrame([(None, None, None), ("b", ["x", None], "1999x"), ("{a}", [], "no")], "basis string, lines array<string>, no string")
    F_ = df.select(tx.fingerprint(F.col("basis"), F.col("lines")).alias("f"), tx.filled("<{a}|{b}>", a=F.col("basis"), b=F.size("lines")).alias("p"), tx.era(tx.case_year(F.col("no"))).alias("era"), tx.one_category(F.col("basis"), {"b": "c"}).alias("c"))
    assert [tuple(r) for r in F_.collect()] == [("Basis: ", "<-|->", "unknown", None), ("Basis: b | x", "<b|2>", "1999-2001", "c"), ("Basis: {a}", "<{a}|0>", "unknown", "{a}")]


def test_evidence_of_citation_scores_holds_what_can_be_told_apart(spark, monkeypatch):
    from weftline.plans import studies as plans

    seen = {}
    monkeypatch.setattr(plans.studies, "citation_scores", lambda analyses, known, evidence: seen.update(known=known, evidence=evidence) or analyses.withColumn("unresolved", F.array(F.lit(""))))
    plans.m12_citation_scores(spark, "/root/testdata/sf0.1")
    keys = seen["evidence"].join(seen["known"], "hid").groupBy("id", "district", "judge", "year").agg(F.count("*").alias("n"))
    assert keys.agg(F.max("n")).first()[0] == 1


def test_patterns_run_only_where_their_words_stand(spark):
    rows = spark.createDataFrame([(1, "no token, token. not token Token"), (2, "tokens"), (3, "not token token token"), (4, None), (5, "the note token")], "k long, t string")
    found = studies.spotted(rows, "k", "t", [("x", "token", 2), ("y", "the", 1)])
    assert sorted(map(tuple, found.collect())) == [(5, "x", 2, "token"), (5, "y", 1, "the")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(low" in plan and "not token" in plan
