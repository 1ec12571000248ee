"""Readers of nested records, on made-up files."""

import json

from pyspark.sql import functions as F

from weftline.operators.records import matching
from weftline.sources import records


def holding(text, category="tiebreak", party="district"):
    return {"issue": {"category": category, "statement": " " + text}, "ruling": {"prevailing_party": party}, "summary_style_holding": text, "facts": [{"summary": "f"}]}


def written(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value))


def test_decisions_and_documents(spark, tmp_path):
    base = {"identity": {"district": {"raw": "RIVER UNIFIED"}, "alj": {"raw": "Doe, Jane"}}, "outcome": {"overall": "x", "roster": [{"name": "A B", "ref": "1"}]}, "full_text": "whole"}
    written(tmp_path / "a/2009010101.json", base | {"holdings": [holding("first"), holding(""), holding("third")], "related_proceedings": ["2009010102"]})
    written(tmp_path / "b/N-1999020202.json", base | {"identity": {"district": None, "alj": None}, "holdings": []})
    both = records.decisions(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert sorted(r["case_no"] for r in both.collect()) == ["2009010101", "N-1999020202"]
    assert [r["case_no"] for r in records.decisions(spark, str(tmp_path / "a"), year=2009).collect()] == ["2009010101"]
    docs = {r["doc_id"]: r for r in records.holding_documents(both).collect()}
    assert sorted(docs) == ["2009010101:0", "2009010101:2"] and docs["2009010101:2"]["text"] == "third third" and docs["2009010101:0"]["year"] == 2009
    assert {r["doc_id"]: r["n_holdings"] for r in records.decision_documents(both).collect()} == {"2009010101": 3, "N-1999020202": 0}
    view = records.public_view(both)
    assert "full_text" not in view.columns and view.schema["outcome"].dataType["roster"].dataType.elementType.names == ["ref"]


def test_gold_alignment_and_judgments(spark, tmp_path):
    rows = [{"sort_year": 2004, "category_raw": "A", "text": "t1"}, {"sort_year": 2009, "category_raw": None, "text": "header"}, {"sort_year": 2009, "category_raw": "B", "text": " "}, {"sort_year": None, "category_raw": "C", "text": "t4"}]
    (tmp_path / "gold.jsonl").write_text("\n".join(map(json.dumps, rows)))
    gold = records.gold_rows(spark, str(tmp_path / "gold.jsonl"))
    assert {r["text"] for r in records.gold_documents(gold).collect()} == {"t1", "t4"}
    assert records.gold_rows(spark, str(tmp_path / "gold.jsonl"), 2009).count() == 2 and records.gold_rows(spark, str(tmp_path / "gold.jsonl"), {2004, 2009}).count() == 3
    system = lambda idxs: {"system": [{"case_no": "7", "holding_idx": 0, "matched_gold_idxs": idxs}], "gold": []}
    written(tmp_path / "al/1.json", system([3]))
    written(tmp_path / "al/2.json", system([]))
    assert [tuple(r) for r in records.inclusion(spark, str(tmp_path / "al")).collect()] == [("7:0", False)]
    written(tmp_path / "j/2009/A/x.json", {"_id": "x", "include": True, "confidence": 0.7})
    assert [(r["year"], r["arm"], r["_id"]) for r in records.judgments(spark, str(tmp_path / "j")).collect()] == [(2009, "A", "x")]


def test_sinks(spark, tmp_path):
    df, path = spark.range(5).withColumn("v", F.col("id") * 2), str(tmp_path / "out")
    records.append_new(df.where("id < 3"), path, ["id"])
    records.append_new(df, path, ["id"])
    back = spark.read.parquet(path)
    assert sorted(r["id"] for r in back.collect()) == [0, 1, 2, 3, 4]
    assert records.content_mark(back).first() == records.content_mark(df).first() != records.content_mark(df.where("id > 0")).first()
    text = records.reports(df.withColumn("k", F.lit("a")), "k", "id", "Report", "concat('row ', id)").first()["text"]
    assert text.splitlines() == ["# Report a", "", *[f"- row {i}" for i in range(5)]]


def test_matching(spark):
    df = spark.createDataFrame([(1, "Oak Mesa", ["a", "b"], 2004), (2, None, ["c"], 2009), (3, "Riverton", None, None)], "id int, district string, cats array<string>, year int")
    ids = lambda **w: sorted(r["id"] for r in matching(df, w, parts=("district",), lists=("cats",)).collect())
    assert ids() == [1, 2, 3] and ids(district="MESA") == [1] and ids(cats="c") == [2] and ids(cats=["a", "z"]) == [1]
    assert ids(year=(2005, None)) == [2] and ids(year=[2004, 2009], district="") == [1, 2] and ids(year=(None, None)) == [1, 2]


def test_broken_files_are_rejects(spark, tmp_path):
    written(tmp_path / "m/1.json", {"matter_id": "one", "issues": ["a"]})
    (tmp_path / "m/2.json").write_text('{"matter_id": "two", ')
    written(tmp_path / "m/3.json", {"matter_id": "three", "issues": 7})
    good, bad = records.checked(spark, "matter_id string, issues array<string>", str(tmp_path / "m"))
    assert [r["matter_id"] for r in good.collect()] == ["one"] and sorted(r["file"][-6:] for r in bad.collect()) == ["2.json", "3.json"]
    (tmp_path / "index.jsonl").write_text('{"case_no": "7"}\nnot json\n{"case_no": "8"}\n')
    good, bad = records.checked(spark, "case_no string", str(tmp_path / "index.jsonl"), lines=True)
    assert sorted(r["case_no"] for r in good.collect()) == ["7", "8"] and [r["broken"] for r in bad.collect()] == ["not json"]
    written(tmp_path / "taxonomy.json", {"skipping": "passing over", "more": {"a": [1]}})
    assert {r["category"]: r["definition"] for r in records.taxonomy(spark, str(tmp_path / "taxonomy.json")).collect()} == {"skipping": "passing over", "more": '{"a":[1]}'}


def test_evaluation_set_is_read_back(spark, tmp_path):
    chosen = spark.createDataFrame([("m1", "early"), ("m2", "late"), ("m3", "late")], "matter_id string, era string")
    records.write_evaluation_set(chosen, str(tmp_path / "set"), "era")
    matters, index = records.evaluation_set(spark, str(tmp_path / "set"))
    assert sorted(map(tuple, matters.select("matter_id", "era").collect())) == [("m1", "early"), ("m2", "late"), ("m3", "late")]
    assert {r["era"]: r["selected"] for r in index.collect()} == {"early": 1, "late": 2}
