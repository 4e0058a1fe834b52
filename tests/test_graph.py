"""The section graph against brute force on small tables."""

import functools
import re

import pytest

from factloom.catalog import graphs
from factloom.functions import text as T
from factloom.operators import graph as G
from factloom.queries import queries

SECTIONS = [
    ("1", "General", ""), ("1.1", "Scope of a Lot Line rule", "See Section 1.2 unless waived."), ("1.2", "Setback", "Wells are exempted from it."),
    ("1.3", "Odd", "A variance under Section 9.9 is possible near a lot  line."), ("1.4", "Self", "Unless Section 1.4 says so, any LOT LINE counts."),
    ("1.5", "Local", '"drain field" means a field. Exhibit C shows a well.'), ("2", "Definitions", ""),
    ("2.1", "Terms", '"Lot line" means a line. "Well" means a hole. A lot line is a line.'), ("3", "Notwithstanding the drain field", "Notwithstanding."),
    ("3.1", "Bare", ""), ("3.2", "See Section 1.1", "Refer to Section 3.1 and see 1.1 about wells. Exhibit C applies."),
]
RULES = [("A", "1.1"), ("B", "Exhibit C"), ("C", "TBD"), ("D", "7.7"), ("E", "3.2")]


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([(f"section:{n}", "Section", n, t, x) for n, t, x in SECTIONS] + [("exhibit:C", "Exhibit", None, "Exhibit C", "")], "id string, type string, number string, title string, text string")
    return nodes, spark.createDataFrame(RULES, "rule_id string, section string")


def brute_edges():
    """The edges as the reference adds them one by one: the last kind of a pair stays."""
    ids, out = {f"section:{n}" for n, _, _ in SECTIONS}, {}
    term_id = lambda t: "term:" + re.sub(r"\s+", "_", t.strip().lower())
    terms = [t for _, _, x in SECTIONS for t in re.findall(T.DEFINITION, x)]
    parent = lambda n: f"section:{n.rpartition('.')[0]}" if "." in n else None
    refs = lambda n, x: [f"section:{r}" for r in re.findall(T.XREF, x) if f"section:{r}" in ids and r != n]
    for n, _, _ in SECTIONS:
        if parent(n) in ids:
            out[parent(n), f"section:{n}"] = "CONTAINS"
    for n, _, x in SECTIONS:
        out |= {(f"section:{n}", d): "REFERENCES" for d in [*refs(n, x), *(["exhibit:C"] if "Exhibit C" in x else [])]}
    for n, _, x in SECTIONS:
        out |= {(f"section:{n}", term_id(t)): "DEFINES" for t in re.findall(T.DEFINITION, x)}
    for n, title, x in SECTIONS:
        if not n.startswith("2"):
            out |= {(f"section:{n}", term_id(t)): "USES_TERM" for t in terms if t.lower() in f"{title} {x}".lower()}
    for n, _, x in SECTIONS:
        if re.search(T.EXCEPTION, x, re.I):
            out |= {(f"section:{n}", d): "EXCEPTION" for d in refs(n, x) or [parent(n)] if d in ids}
    out |= {(f"rule:{r}", d): "CITES" for r, s in RULES if (d := "exhibit:C" if s == "Exhibit C" else f"section:{s}") in ids | {"exhibit:C"}}
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two regions, three nations, and customers on both sides of key 1000."""
    at = tmp_path_factory.mktemp("graph")
    spark.createDataFrame([(0, "AFRICA"), (1, "AMERICA")], "r_regionkey long, r_name string").write.parquet(f"{at}/region.parquet")
    spark.createDataFrame([(0, "A", 0), (1, "B", 1), (6, "C", 0)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{at}/nation.parquet")
    customers = [(k, f"Customer {k}", n, "BUILDING") for k, n in ((1, 0), (999, 1), (1000, 6), (1500, 0), (14999, 1))]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey long, c_mktsegment string").write.parquet(f"{at}/customer.parquet")
    return str(at)


def test_every_customer_is_a_node(spark, tables):
    nodes, _ = graphs.graph(spark, tables)
    want = {"1", "2", "1.0", "2.1", "1.6", "1.0.1", "2.1.999", "1.6.1000", "1.0.1500", "2.1.14999"}
    assert {r.number for r in nodes.where("type = 'Section'").collect()} == want
    up = {(r.src, r.dst) for r in queries()["r3_edges"](spark, tables).where("type = 'CONTAINS'").collect()}
    assert up == {(f"section:{n.rpartition('.')[0]}", f"section:{n}") for n in want if "." in n}


@pytest.mark.parametrize("most", [10**6, 1])
def test_edges_of_all_six_kinds(spark, small, monkeypatch, most):
    monkeypatch.setattr(G, "term_hits", functools.partial(G.term_hits, most=most))
    want = brute_edges()
    assert set(want.values()) == set(G.PRECEDENCE)
    assert {("section:1.2", "section:1"), ("section:1.3", "section:1"), ("section:1.4", "section:1")} < {k for k, v in want.items() if v == "EXCEPTION"}
    got = G.build_edges(*small).collect()
    assert len(got) == len(want) and {(r.src, r.dst): r.type for r in got} == want


def brute_reach(start, edges, bound=None):
    """Breadth first, nodes of one depth in order of id, and one discovery for each edge to a node not yet taken."""
    out, level, visited, k = {}, [start], set(), 0
    while level and (bound is None or k < bound):
        for at in level:
            visited.add(at)
            for s, d, kind in edges:
                if s == at and d not in visited:
                    hops, via, n = out.get(d, (k + 1, kind, 0))
                    out[d] = hops, via, n + 1
        level, k = sorted(d for d, (hops, _, _) in out.items() if hops == k + 1 and d not in visited), k + 1
    return out


def test_reach_has_no_cap(spark):
    chain = [("rule:A", "s00", "CITES")] + [(f"s{k:02}", f"s{k + 1:02}", "REFERENCES") for k in range(34)]
    edges = chain + [("rule:B", "s30", "CITES"), ("rule:B", "s31", "CITES"), ("s34", "s03", "REFERENCES"), ("s02", "s05", "REFERENCES"), ("s04", "s05", "EXCEPTION")]
    table = spark.createDataFrame(edges, "src string, dst string, type string")
    starts = spark.createDataFrame([("rule:A",), ("rule:B",), ("rule:C",)], "start string")
    walked = [e for e in edges if e[2] != "EXCEPTION"]
    for bound in (None, 5):
        got = {(r.start, r.node): (r.hops, r.reached_via, r.discoveries) for r in G.reach(starts, table, ["CITES", "REFERENCES"], *[bound][: bound is not None]).collect()}
        assert got == {(s, d): v for s in ("rule:A", "rule:B") for d, v in brute_reach(s, walked, bound).items()}
    assert max(v[0] for v in brute_reach("rule:A", walked).values()) > 20 and brute_reach("rule:B", walked)["s31"] == (1, "CITES", 2)


def brute_context(n):
    """As the reference collects it; terms by their first definition, the last one in a section of 2 counts."""
    own = {f"section:{a}": (a, b, c) for a, b, c in SECTIONS}
    edges, ups, at = brute_edges(), [], n
    while (at := at.rpartition(".")[0]) and f"section:{at}" in own:
        ups.insert(0, own[f"section:{at}"][:2])
    text = own[f"section:{n}"][2]
    refs = list(dict.fromkeys([f"section:{r}" for r in re.findall(T.XREF, text)] + [f"exhibit:{r}" for r in re.findall(T.EXHIBIT, text)]))
    refs = [r for r in refs if edges.get((f"section:{n}", r)) == "REFERENCES"]
    terms = {}
    for two in (True, False):
        for a, _, x in SECTIONS:
            for t in re.findall(T.DEFINITION, x) if a.startswith("2") == two else ():
                if two or t not in terms:
                    terms[t] = a
    used = [(t, a) for t, a in terms.items() if edges.get((f"section:{n}", "term:" + t.lower().replace(" ", "_"))) == "USES_TERM"]
    exceptions = [(a, b, c[:300]) for a, b, c in SECTIONS if edges.get((f"section:{a}", f"section:{n}")) == "EXCEPTION"]
    return ups, [(r, own[r][2][:500] if r in own else "") for r in refs], used, exceptions


def test_context(spark, small):
    nodes, rules = small
    edges = G.build_edges(nodes, rules)
    contexts = G.context(nodes, edges)
    got = {r.number: ([tuple(a) for a in r.ancestors], [(x.id, x.text) for x in r.references], [tuple(d) for d in r.definitions], [tuple(e) for e in r.exceptions]) for r in contexts.collect()}
    want = {n: brute_context(n) for n, _, _ in SECTIONS}
    assert got == want
    # an exception belongs to the section that it modifies, not to the one that states it
    assert [e[0] for e in want["1"][3]] == ["1.2", "1.3", "1.4"] and not want["1.3"][3] and want["1.5"][2]
    rows = {r.rule_id: r for r in G.checklist(rules, nodes, contexts).collect()}
    assert set(rows) == {r for r, _ in RULES} and rows["C"].cited is None and rows["D"].body is None and rows["B"].body == ""
    assert rows["E"].trail == "3 Notwithstanding the drain field" and rows["E"].body == SECTIONS[-1][2]
    assert [x.label for x in rows["E"].references] == [f"Section {i.split(':')[1]}" if "section" in i else "Exhibit C" for i, _ in want["3.2"][1]]


def test_context_queries(spark, tables):
    row = queries()["r4_context"](spark, tables).where("number = '1.0.1500'").first()
    assert [a.number for a in row.ancestors] == ["1", "1.0"] and [r.id for r in row.references] == ["section:1.0"] and row.text.startswith("refer to")
    assert {"trail", "references", "definitions", "exceptions"} < set(queries()["c24_rule_checklist"](spark, tables).columns)


def test_differences_between_two_forms(spark):
    """What SURVEY T11 lists: five hops, words inside of words, fewer words, and line breaks."""
    rows = [(str(k), f"S{k}", f"See {k + 1}" if k < 8 else "") for k in range(1, 9)]
    rows += [("10", "A mustard field", ""), ("11", "Odd", "It is required here"), ("12", "Even", "first\nit shall be"), ("13", "Both", "it shall be")]
    nodes = spark.createDataFrame([(f"section:{n}", "Section", n, t, x) for n, t, x in rows], "id string, type string, number string, title string, text string")
    edges = spark.createDataFrame([("rule:A", "section:1", "CITES"), ("rule:B", "section:6", "CITES")] + [(f"section:{k}", f"section:{k + 1}", "REFERENCES") for k in range(1, 8)], "src string, dst string, type string")
    starts = spark.createDataFrame([("rule:A",), ("rule:B",)], "start string")
    got = {tuple(r) for r in G.backend_differences(starts, nodes, edges).collect()}
    assert got == {("unresolved", "rule:A", "section:8", "in-process"), ("orphans", "section:10", "10", "twin"), ("orphans", "section:11", "11", "in-process"), ("orphans", "section:12", "12", "in-process")}


def test_two_forms_of_a_context(spark, small):
    nodes, rules = small
    edges = G.build_edges(nodes, rules)
    a = {tuple(r) for r in G.context_items(G.context(nodes, edges)).collect()}
    want = {(f"section:{n}", p, i) for n, _, _ in SECTIONS for p, items in zip(("ancestors", "references", "definitions", "exceptions"), brute_context(n), strict=True) for i, *_ in items}
    assert a == want == {tuple(r) for r in G.twin_context_items(nodes, edges).collect()}


def test_c25_compares_contexts(spark, tables, monkeypatch):
    rows = queries()["c25_context_differential"](spark, tables).collect()
    assert all(r.same and r.a == r.b for r in rows) and max(r.a for r in rows) > 1
    twin = G.twin_context_items
    monkeypatch.setattr(G, "twin_context_items", lambda *a: twin(*a).where("part <> 'ancestors'"))
    assert not all(r.same for r in queries()["c25_context_differential"](spark, tables).collect())


def test_ancestors_by_prefix_are_those_of_the_walk(spark):
    numbers = ["1", "1.1", "1.1.2", "1.1.2.5", "1.3.1", "1.3.1.1", "2.1", "2.1.1", "10", "10.1"]
    contains = [(f"section:{n.rpartition('.')[0]}", f"section:{n}", "CONTAINS") for n in numbers if "." in n] + [("section:1", "section:10", "REFERENCES")]
    contains.remove(("section:1.1", "section:1.1.2", "CONTAINS"))  # replaced by a later kind: the way up ends there
    edges = spark.createDataFrame(contains, "src string, dst string, type string")
    up = edges.where("type = 'CONTAINS'").selectExpr("dst as src", "src as dst", "type")
    walk = G.reach(up.selectExpr("src as start").distinct(), up, ["CONTAINS"])
    want = {(r.start, r.node, r.hops) for r in walk.collect()}
    assert {tuple(r) for r in G.ancestors(edges).collect()} == want
    assert {tuple(r) for r in G.ancestors(edges, 1).collect()} == {w for w in want if w[2] == 1}
