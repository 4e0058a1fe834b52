"""Edges and contexts of findings come from all of a text, not only its beginning."""

from factloom.catalog import graphs, reports
from factloom.operators import graph as G

FAR = "x " * 1500  # what follows lies behind 2000 characters
SECTIONS = [("3", "Flow", ""), ("3.1", "Limits", f"{FAR}See Section 4.2. A lot line and Exhibit C count."), ("4", "Rooms", ""), ("4.2", "Beds", ""), ("2.1", "Terms", f'{FAR}"Lot line" means a line.'), ("4.1", "Odd", f"{FAR}Unless waived, Section 3.1 holds.")]


def small(spark):
    nodes = spark.createDataFrame([(f"section:{n}", "Section", n, t, x) for n, t, x in SECTIONS] + [("exhibit:C", "Exhibit", None, "Exhibit C", "")], "id string, type string, number string, title string, text string")
    return nodes, spark.createDataFrame([("A", "3.1")], "rule_id string, section string")


FOUND = {("section:3.1", "section:4.2", "REFERENCES"), ("section:3.1", "exhibit:C", "REFERENCES"), ("section:3.1", "term:lot_line", "USES_TERM"), ("section:2.1", "term:lot_line", "DEFINES"), ("section:4.1", "section:3.1", "EXCEPTION")}
BARE = {("section:3", "section:3.1", "CONTAINS"), ("section:4", "section:4.1", "CONTAINS"), ("section:4", "section:4.2", "CONTAINS"), ("section:2", "section:2.1", "CONTAINS"), ("rule:A", "section:3.1", "CITES")}


def test_edges_of_whole_texts(spark):
    nodes, rules = small(spark)
    edges = lambda *a: {(r.src, r.dst, r.type) for r in G.build_edges(nodes, rules, *a).collect()}
    assert edges() == FOUND | BARE
    assert edges(2000) == BARE  # as the SQL of the graph's own queries has it


def test_findings_know_the_ends_of_texts(spark, tmp_path, monkeypatch):
    nodes, rules = small(spark)
    monkeypatch.setattr(graphs, "tables", lambda *_: (nodes, rules))
    line = (1, 1, 1, 2, 0.1)
    spark.createDataFrame([line], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    one = reports.j14_findings(spark, str(tmp_path)).where("rule_id = 'F-1'").first()
    assert [r.label for r in one.cross_references] == ["Section 4.2", "Exhibit C"]
    assert [tuple(d) for d in one.definitions] == [("Lot line", "2.1")]
    assert [e.section for e in one.exceptions] == ["4.1"]
