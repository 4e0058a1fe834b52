"""Rule evaluation: each operator, gates, verdicts, validation; compiled and tabular forms agree."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import rules as R

BASE = dict(id="T1", parameter="widgets", operator=">=", threshold=10)


def outcomes(spark, facts, **rule):
    r = R.Rule(**(BASE | rule))
    rows = [("s", k, v) for k, v in facts.items()] or [("s", "other", "1")]
    subjects = R.fact_map(spark.createDataFrame(rows, "subject string, name string, value string"))
    a = [tuple(x) for x in R.compile_rules(subjects, [r]).select("outcome", "applicability", "gate").collect()]
    b = [tuple(x) for x in R.evaluate(subjects, R.rules_frame(spark, [r])).select("outcome", "applicability", "gate").collect()]
    assert a == b
    return a[0]


@pytest.mark.parametrize(
    "facts, rule, want",
    [
        ({"widgets": "10"}, {}, ("PASS", "applies", None)),
        ({"widgets": "9.5 units"}, {}, ("FAIL", "applies", None)),
        ({"widgets": "illegible"}, {}, ("UNKNOWN", "applies", None)),
        ({}, {}, ("UNKNOWN", "applies", None)),
        ({"widgets": "10"}, {"operator": ">"}, ("FAIL", "applies", None)),
        ({"widgets": "20"}, {"verified": False}, ("UNKNOWN", "undetermined", None)),
        ({}, {"operator": "present", "threshold": None}, ("UNKNOWN", "applies", None)),
        ({"widgets": ""}, {"operator": "present", "threshold": None}, ("FAIL", "applies", None)),
        ({"widgets": "x"}, {"operator": "present", "threshold": None}, ("PASS", "applies", None)),
        ({}, {"operator": "absent", "threshold": None}, ("PASS", "applies", None)),
        ({"widgets": "x"}, {"operator": "absent", "threshold": None}, ("FAIL", "applies", None)),
        ({"widgets": " Bed "}, {"operator": "in", "threshold": ["bed", "drip"]}, ("PASS", "applies", None)),
        ({"widgets": "bed"}, {"operator": "in", "threshold": "bed"}, ("UNKNOWN", "applies", None)),
        ({"widgets": "BED"}, {"operator": "==", "threshold": "bed"}, ("PASS", "applies", None)),
        ({"widgets": "20", "gate": "large"}, {"applies_to": {"gate": "small"}}, ("PASS", "not_applicable", "gate")),
        ({"widgets": "20"}, {"applies_to": {"gate": "small"}}, ("UNKNOWN", "undetermined", "gate")),
        ({"widgets": "20", "gate": "", "b": "no"}, {"applies_to": {"gate": "small", "b": "yes"}}, ("UNKNOWN", "undetermined", "gate")),
        ({"widgets": "20", "gate": "x", "b": ""}, {"applies_to": {"gate": "small", "b": "yes"}}, ("PASS", "not_applicable", "gate")),
        ({"widgets": "20", "gate": "Small "}, {"applies_to": {"gate": ["small", "mid"]}}, ("PASS", "applies", None)),
    ],
)
def test_outcomes(spark, facts, rule, want):
    assert outcomes(spark, facts, **rule) == want


def test_validation():
    with pytest.raises(ValueError):
        R.Rule("x", "p", "~")
    with pytest.raises(ValueError):
        R.Rule("x", "p", ">=")
    with pytest.raises(ValueError):
        R.load_rules("- {id: a, parameter: p, operator: present}\n- {id: a, parameter: p, operator: present}")
    with pytest.raises(TypeError):
        R.load_rules("- {id: a, parameter: p, operator: present, colour: red}")


def test_verdicts(spark):
    rules = [R.Rule("A", "a", ">=", 1), R.Rule("B", "b", "present")]
    rows = [("fail", "a", "0"), ("ok", "a", "2"), ("none", "c", "1")]
    rep = R.report(R.compile_rules(R.fact_map(spark.createDataFrame(rows, "subject string, name string, value string")), rules))
    got = {r.subject: r.verdict for r in rep.collect()}
    assert got == {"fail": "DEFICIENCIES FOUND", "ok": "NO DEFICIENCIES FOUND", "none": "CANNOT VERIFY"}
    assert rep.where(F.col("evaluated") + F.col("not_applicable") + F.col("unreadable") != F.col("total")).count() == 0
