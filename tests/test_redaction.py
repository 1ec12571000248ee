"""Names out of texts and matters out of decisions, on rows whose results are known."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from tests.test_sources import written
from weftline.functions import redaction
from weftline.operators.matters import evaluation_set, matters
from weftline.plans import QUERIES, redacted
from weftline.sources import records

ROSTER = [{"name": "Myers, Vickie", "ref": "R1"}, {"name": "JOHN HOW", "ref": "R2"}, {"name": "Ann Oak", "ref": "R3"}, {"name": "Smith,", "ref": "R4"}, {"name": None, "ref": "R5"}]


@pytest.mark.parametrize(
    ("text", "want", "n"),
    [
        ("Vickie Myers and John How left. They ask how.", "R1 and R2 left. They ask how.", 2),
        ("Ms. Myers was Vickie Myers.", "Ms. R1 was R1.", 2),
        ("Myer taught; MYER did not", "R1 taught; MYER did not", 1),
        ("Vickie Myer and Oak Mesa", "R1 and Oak Mesa", 2),
        ("Smith-Jones met Doe", "R4-Jones met Doe", 1),
        ("", "", 0),
        (None, "", 0),
        ("x" * 200_000, "x" * 200_000, 0),
    ],
)
def test_deidentified(spark, text, want, n):
    df = spark.createDataFrame([([text], ROSTER, "Doe", "OAK MESA UNIFIED")], "t array<string>, r array<struct<name: string, ref: string>>, j string, d string")
    (got,) = df.select(redaction.deidentified("t", "r", "j", "d").alias("x")).first()["x"]
    assert (got["text"], got["n"]) == (want, n)


def test_deidentified_without_roster(spark):
    df = spark.createDataFrame([(["A B"], None, None, None), (None, None, None, None)], "t array<string>, r array<struct<name: string, ref: string>>, j string, d string")
    assert [[x["text"] for x in r["x"]] for r in df.select(redaction.deidentified("t", "r", "j", "d").alias("x")).collect()] == [["A B"], []]


@pytest.mark.parametrize(("a", "b", "want"), [("myer", "myers", True), ("abc", "abc", True), ("abc", "axc", True), ("abcd", "acbd", False), ("ab", "abcd", False), ("xabc", "abc", True)])
def test_one_edit(a, b, want):
    assert redaction.one_edit(a, b) == redaction.one_edit(b, a) == want


def test_scrubbed_and_cites(spark):
    df = spark.createDataFrame([("Mr. Lee Wong saw District John Smith and Anna Bell at Oak Mesa.", "Reef Unified (Walker), 2009 and (ALJ Cohn), 2004 (Permanent vs. Probationary)")], "t string, c string")
    r = df.select(redaction.scrubbed(F.col("t")).alias("t"), redaction.cites(F.col("c")).alias("c")).first()
    assert r["t"] == "[name] saw District John Smith and [name] at Oak Mesa."
    assert [tuple(c) for c in r["c"]] == [("Reef Unified", "Walker", 2009), (None, "Cohn", 2004)]


def test_matters(spark, tmp_path):
    def holding(category, *facts):
        return {"issue": {"category": category}, "facts": [{"summary": f} for f in facts], "reasoning": {"summary": "Myers was right"}}

    base = {"identity": {"district": {"raw": "RIVER UNIFIED SCHOOL DISTRICT"}, "alj": {"raw": "Jane Doe"}}, "outcome": {"roster": ROSTER[:2]}, "related_proceedings": ["N-2009-2"]}
    written(tmp_path / "2009010101.json", base | {"holdings": [holding("bumping", "Vickie Myers taught.", "vickie  myers TAUGHT."), holding("attrition", "She was bumped.", "third", "fourth", " ")]})
    written(tmp_path / "2009010102.json", base | {"holdings": [holding("bumping", "a", "b"), holding("attrition", "c", "d")]})
    written(tmp_path / "2009010103.json", base | {"holdings": None})
    made = matters(records.decisions(spark, str(tmp_path)))
    got = {r["case_no"]: r for r in made.collect()}
    first = got["2009010101"]
    assert first["text"].splitlines()[0] == "District: River Unified." and first["text"].splitlines()[2:] == ["- R1 taught.", "- She was bumped.", "- third", "- fourth"]
    assert first["issues"] == ["attrition", "bumping"] and first["leak_rate"] == 0.5 and first["exclude"] == ["2009010101", "20092"]
    assert [(d["issue"], d["hid"], d["reasoning"]) for d in first["depth"]] == [("bumping", "2009010101:0", "R1 was right"), ("attrition", "2009010101:1", "R1 was right")]
    assert (got["2009010103"]["n_facts"], got["2009010103"]["issues"], got["2009010103"]["leak_rate"]) == (0, [], 0.0)
    assert [r["case_no"] for r in evaluation_set(made, F.lit("all"), 5, "s").collect()] == ["2009010102"]
    assert json.dumps(first["residual"])


def test_queries_over_whole_texts(spark):
    tables = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    kept, name = {*redaction.NOT_NAMES, *redaction.BODIES}, redaction.NAME_WORD
    marked = lambda t: re.sub(redacted.ARTICLES, lambda m: m[0] if m[0].islower() else "R1", t)
    scrub = lambda t: re.sub(redaction.TWO_NAMES, lambda m: m[0] if kept & {*m[0].split()} else "[name]", re.sub(redaction.TITLED, "[name]", t))
    spans = lambda t: [m[0] for m in re.finditer(rf"\b{name}(?:\s+{name}){{0,2}}\b", t) if not {*m[0].split()} <= {*redaction.NOT_NAMES}]
    got = {q: {r["doc_id"]: r for r in QUERIES[q](spark, tables).collect()} for q in ("f13_replaced_capitals", "f16_scrubbed", "f17_residual_names")}
    for i, t in texts.items():
        assert got["f13_replaced_capitals"][i]["text_md5"] == md5(marked(t))
        assert got["f16_scrubbed"][i]["text_md5"] == md5(scrub(t))
        assert (got["f17_residual_names"][i]["n"], got["f17_residual_names"][i]["spans_md5"]) == (len(spans(t)), md5("|".join(spans(t))))


def test_nested_records_keep_their_shape(spark):
    schema = "id long, record struct<title: string, n: int, parts: array<struct<who: string, notes: array<string>>>, more: map<string, string>>, roster array<struct<name: string, ref: string>>, judge string, district string"
    roster = [{"name": "Ames, Alice", "ref": "R1"}]
    whole = {"title": "Alice Ames v. District", "n": 3, "parts": [{"who": "Ames", "notes": ["told Alice Ames", None, "none"]}, None, {"who": None, "notes": None}], "more": {"Ames": "by Ames", "k": None}}
    rows = [(1, whole, roster, "Doe", "River"), (2, whole, None, None, None), (3, None, roster, "Doe", "River"), (4, {"title": None, "n": None, "parts": [], "more": {}}, [], None, None), (5, whole, [{"name": "Told, Bob", "ref": "R9"}], None, None)]
    table = spark.createDataFrame(rows, schema).repartition(2)
    found = redaction.nested_deidentified(table, "record", "roster", "judge", "district")
    assert found.schema == table.schema
    got, had = ({r["id"]: r["record"] and r["record"].asDict(True) for r in df.collect()} for df in (found, table))
    assert got[2] == had[2] and got[3] is None and got[4] == had[4]
    marks, firsts = redaction.wanted_names(roster, "doe", "river")
    hide = lambda t: None if t is None else redaction.pseudonymous(t, marks, firsts, "doe", "river")[0]
    parts = [p and {"who": hide(p["who"]), "notes": p["notes"] and [hide(x) for x in p["notes"]]} for p in whole["parts"]]
    assert got[1] == {"title": hide(whole["title"]), "n": 3, "parts": parts, "more": {k: hide(v) for k, v in whole["more"].items()}}
    assert "Ames" not in str({**got[1], "more": list(got[1]["more"].values())}) and "R1" in got[1]["title"]
    assert redaction.nested_deidentified(table.limit(0), "record", "roster", "judge", "district").count() == 0


def test_names_of_latin_letters_take_no_pattern(monkeypatch):
    texts = ["", "AMES met Ámes, ames2 and Ames_", "Ames Ames (Ames)", "O'Neil-Ames, O'NEIL", "ſmith, ſMITH and Smith's", "kelly, Kelly and KELLY", "Smitth wrote to Müller, MÜLLER and Muller", "ΣAmes Ames"]
    found = lambda t, n: [m.span() for m in re.finditer(rf"\b{re.escape(n)}\b", t, re.IGNORECASE)]
    for name in ["Ames", "Ámes", "O'Neil", "(Ames)", "Müller"]:
        for t in filter(redaction.latin, texts):
            assert [*redaction.whole_words(t.lower(), name.lower())] == found(t, name)
    for name, mark in [("Smith", "R1"), ("Kelly", "R2")]:
        for t in texts:
            spans = [(a, b) for a, b in found(t, name) if not t[a:b].islower()]
            hidden = redaction.pseudonymous(t, {name: mark}, set(), "", "")[0]
            assert hidden.count(mark) >= len(spans)
    assert redaction.pseudonymous("Smitth of Smith", {"Smith": "R1"}, set(), "", "") == ("R1 of R1", 2)

    def pattern(*args):
        raise AssertionError("a pattern for one name")

    monkeypatch.setattr(redaction.re, "finditer", pattern)
    for i in range(3):
        assert redaction.pseudonymous(f"line of Customer#{i}, not Customer#{i}1", {f"Customer#{i}": "R1"}, {f"customer#{i}"}, "", "") == (f"line of R1, not Customer#{i}1", 1)
