"""Extraction reads its rows once and computes an expression once, whatever is asked of it."""

from factloom.catalog import domain, reports
from factloom.functions import text as T
from factloom.operators import compose as C
from factloom.operators import extract as E

FIELDS = [(1, 1, "Design Flow:", "300", 90.0, 1), (1, 2, "Bed", "[X]", 80.0, 1), (2, 1, "# of Bedrooms", "barn", 70.0, 2)]
PAGES = [(1, 1, "A flow of 300 and 3 bedroom house"), (3, 1, "")]


def rows(spark):
    fields = spark.createDataFrame(FIELDS, "doc_id long, pos long, key string, value string, confidence double, page int")
    return fields, spark.createDataFrame(PAGES, "doc_id long, page int, text string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_pass(spark):
    numbers = sum(s.kind == "number" and bool(s.labels) for s in domain._SPECS)
    lead = T.MEASUREMENT[:30]
    for df in (*E.extract(*rows(spark), domain._SPECS), C.review(*rows(spark), domain._SPECS, reports.PACKET_RULES)):
        text = plan(df)
        assert text.count("RepartitionByExpression") == 1 and text.count("LogicalRDD") == 2
        assert text.count(lead) <= 3 * numbers  # matched, its number and what follows


def test_documents(spark):
    got = {r.doc_id: r for r in E.documents(*rows(spark), domain._SPECS).collect()}
    assert set(got) == {1, 2, 3}
    assert {f.name: f.value for f in got[1].facts} == {"design_flow": "300.0", "system_type": "bed", "bedrooms": "3.0", "system_scale": "small", "design_flow_per_bedroom": "100.0"}
    assert [(r.name, r.reason) for r in got[2].rejected] == [("bedrooms", "prose")] and not got[3].facts
    assert got[1].missing == ["use", "well_setback"] and len(got[3].missing) == 7
