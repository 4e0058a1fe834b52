"""Reports over a small fixture, held against what plain loops say."""

import json

from pyspark.sql import functions as F

from factloom.operators import compose as C
from factloom.operators import rules as R

RULES = [
    R.Rule("Z-1", "width", ">=", 10, units="feet", section="3.1", page=7, quote="at least 10, note b", remedy="Widen it.", severity="advisory"),
    R.Rule("A-1", "depth", "<=", 5, section="3.2", notes="may  be\nreduced"),
    R.Rule("B-1", "width", ">", 2, {"kind": ["bed"]}, section="Exhibit C"),
    R.Rule("B-2", "slope", "<", 3, {"kind": ["bed"]}),
    R.Rule("C-1", "owner_name", "present"),
    R.Rule("D-1", "depth", ">=", 1, verified=False),
]
NAMES = {"width": ("Width", "on the plan"), "kind": ("Kind of system", "on the form")}
FACTS = [
    ("fails", "width", "4", "form_field", "Width", 2, "4 ft", 97.4),
    ("fails", "width", "9", "text_pattern", None, 1, "9", None),
    ("fails", "depth", "8", "checkbox", "Depth", None, "8", None),
    ("fails", "kind", "drip", "derived", None, None, "k=1", None),
    ("fails", "owner_name", "Ann", "form_field", "Owner", 1, "Ann", 50.0),
    ("mail", "width", "12", "form_field", "Width", 1, "12", 80.0),
    ("mail", "note", "ask a@b.org or 302-555-1234", "form_field", "Note", 1, "x", 80.0),
]
READ = "subject string, name string, value string, source string, label string, page int, raw string, confidence double"


def reports(spark, rules=RULES, contexts=None):
    read = C.gathered(spark.createDataFrame(FACTS, READ))
    subjects = spark.createDataFrame([("fails",), ("mail",), ("empty",)], "subject string").join(read, "subject", "left")
    return C.compose(subjects, rules, NAMES, contexts)


def test_groups_of_findings(spark):
    got = {r.subject: r for r in reports(spark).collect()}
    ids = lambda s, p: [x.rule_id for x in got[s][p]]
    assert ids("fails", "deficiencies") == ["A-1", "Z-1"]  # those that return an application first
    assert ids("fails", "not_applicable") == ["B-1", "B-2"] and ids("fails", "satisfied") == ["C-1"] and ids("fails", "unresolved") == ["D-1"]
    assert got["fails"].verdict == "DEFICIENCIES FOUND" and got["mail"].verdict == "NO DEFICIENCIES FOUND" and got["empty"].verdict == "CANNOT VERIFY"
    for r in got.values():
        n = r.counts
        assert n.evaluated + n.not_applicable + n.unreadable == n.total == len(RULES)
        assert sum(len(r[p]) for p in ("deficiencies", "unresolved", "satisfied", "not_applicable")) == len(RULES)
    a, z = got["fails"].deficiencies
    assert (z.observed, z.requirement, z.citation, z.provenance, z.fact_page) == ("4", "Width must be at least 10 feet", "3.1, page 7", "form field 'Width', page 2, OCR confidence 97%", 2)
    assert (a.caveats, a.provenance) == ("may be reduced", "ticked box 'Depth'")
    out = got["fails"].not_applicable[0].excluded_by
    assert (out.parameter, out.value, out.where) == ("kind", "drip", "derived")
    assert [(g.blocked_by, g.described, g.location, g["count"], [f.rule_id for f in g.findings]) for g in got["mail"].unresolved_groups] == [("depth", "depth", "", 2, ["A-1", "D-1"]), ("kind", "Kind of system", "on the form", 2, ["B-1", "B-2"]), ("owner_name", "owner_name", "", 1, ["C-1"])]
    assert [(m.parameter, m.blocks_rules) for m in got["empty"].missing_information] == [("depth", ["A-1", "D-1"]), ("owner_name", ["C-1"]), ("slope", ["B-2"]), ("width", ["B-1", "Z-1"])]
    assert got["empty"].facts_read == [] and got["empty"].notices[0].startswith("1 of 6 rules")


def test_same_as_evaluations(spark):
    read = C.gathered(spark.createDataFrame(FACTS, READ))
    subjects = spark.createDataFrame([("fails",), ("mail",), ("empty",)], "subject string").join(read, "subject", "left")
    want = {tuple(r) for r in R.compile_rules(subjects, RULES).select("subject", "rule_id", "outcome", "applicability", "gate").collect()}
    found = C.findings(subjects, RULES, NAMES).select("subject", F.explode("findings").alias("f")).selectExpr("subject", "f.rule_id", "f.outcome", "f.applicability", "f.excluded_by.parameter")
    assert {tuple(r) for r in found.collect()} == want


def test_letter(spark):
    got = {r.subject: r.letter for r in reports(spark).select("subject", C.letter(F.col("subject")).alias("letter")).collect()}
    assert got["mail"] == got["empty"] == ""
    lines = got["fails"].split("\n")
    assert lines[1:3] == ["Re: fails", "Scope: 3 of 6 checked, 2 not applicable, 1 not readable."]
    assert lines[lines.index("PLEASE CORRECT") + 1 :] == [
        "1. depth must be at most 5", "   Found: 8", "   Required: 5", "   Citation: 3.2",
        "2. Width must be at least 10 feet", "   Found: 4 feet", "   Required: 10 feet", "   Citation: 3.1, page 7", "   Regulation: at least 10, note b", "   To correct: Widen it.",
        "", "PLEASE PROVIDE OR CLARIFY", "- depth", "   Needed by: depth must be at least 1 (0)",
    ]


def test_chat_has_nothing_personal(spark):
    got = {r.subject: r for r in C.chat(reports(spark)).collect()}
    assert [f.parameter for f in got["fails"].facts_read] == ["depth", "kind", "width"]
    note = next(f for f in got["mail"].facts_read if f.parameter == "note")
    assert "a@b.org" not in note.value and "555" not in note.value and "raw" not in note.asDict()
    assert [m.parameter for m in got["fails"].missing_information] == []  # slope is only wanted by a rule out of scope
    assert got["fails"].deficiencies[1].quote == "at least 10"
    text = json.dumps(got["fails"].asDict(True))
    assert "Widen it." not in text and "may be reduced" not in text


def test_no_rules_and_contexts(spark):
    none = reports(spark, []).collect()
    assert {(r.verdict, r.counts.total) for r in none} == {("CANNOT VERIFY", 0)} and len(none) == 3
    rules = spark.createDataFrame([(r.id, r.section) for r in RULES], "rule_id string, section string")
    nodes = spark.createDataFrame([("section:3.1", "Section", "3.1", "Width", "t" * 900), ("exhibit:C", "Exhibit", None, "Table", "x" * 900)], "id string, type string, number string, title string, text string")
    refs = [{"id": f"section:{i}", "type": "Section", "number": str(i), "title": "T", "text": "y" * 500} for i in range(6)]
    contexts = spark.createDataFrame(
        [("section:3.1", refs, [(f"t{i}", "2.1") for i in range(8)], [(str(i), "e", "z" * 300) for i in range(5)])],
        "id string, references array<struct<id: string, type: string, number: string, title: string, text: string>>, definitions array<struct<term: string, defined_in: string>>, exceptions array<struct<number: string, title: string, text: string>>",
    )
    got = next(r for r in reports(spark, contexts=C.rule_contexts(rules, nodes, contexts)).collect() if r.subject == "fails")
    z, b = got.deficiencies[1], got.not_applicable[0]
    assert (len(z.cross_references), len(z.cross_references[0].text), len(z.definitions), len(z.exceptions)) == (4, 400, 6, 3)
    assert [(r.label, len(r.text)) for r in b.cross_references] == [("Exhibit C", 600)] and b.definitions == [] == got.deficiencies[0].cross_references
