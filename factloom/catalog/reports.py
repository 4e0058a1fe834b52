"""Composed reports of orders, and of documents from their fields and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.catalog import domain, graphs
from factloom.catalog.rules import _BLOCK, EV, RULES, subjects
from factloom.functions import text as T
from factloom.operators import compose as C
from factloom.operators import graph as G
from factloom.operators import rules as R
from factloom.registry import query

#: Rules over the facts of ``domain.form_fields``, with sections of the graph.
PACKET_RULES = [
    R.Rule("F-1", "design_flow", "<=", 2000, units="gpd", section="3.1", quote="The flow shall not exceed 2000, note b", remedy="Lower the flow."),
    R.Rule("F-2", "bedrooms", "<=", 6, {"use": ["home"]}, severity="advisory", section="4"),
    R.Rule("F-3", "well_setback", ">=", 50, {"system_scale": ["small"]}, units="feet", section="Exhibit C", page=41),
    R.Rule("F-4", "system_type", "in", ["bed", "drip"]),
    R.Rule("F-5", "design_flow_per_bedroom", ">=", 120, verified=False),
]
NAMES = {"design_flow": ("Design flow", "on the permit form"), "well_setback": ("Distance to the well", "on the site plan")}
#: Parts of reports are opened by outer explodes: inner ones took 36 s where these take 20 s (c9_report_groups on sf0.1).
_PARTS = ("deficiencies", "unresolved", "satisfied", "not_applicable")


@query("c9_report_items", f"""WITH {EV}, x AS (SELECT ev.*, f.value AS observed, {_BLOCK} AS b, CASE WHEN outcome = 'FAIL' THEN 'deficiencies' WHEN outcome = 'UNKNOWN' THEN 'unresolved' WHEN applicability = 'not_applicable' THEN 'not_applicable' ELSE 'satisfied' END AS part FROM ev LEFT JOIN facts f ON f.subject = ev.subject AND f.name = ev.parameter)
SELECT subject, part, CAST(row_number() OVER (PARTITION BY subject, part ORDER BY CASE WHEN part <> 'deficiencies' THEN 0 WHEN severity = 'return' THEN 0 ELSE 1 END, CASE WHEN part = 'deficiencies' THEN rule_id END, seq) AS INT) AS pos, rule_id, observed, b AS blocked_by, gate FROM x""")
def c9_items(spark, sf):
    own = C.compose(subjects(spark, sf), RULES)
    item = lambda p: F.transform(p, lambda x, i: F.struct(F.lit(p).alias("part"), (i + 1).alias("pos"), x["rule_id"].alias("rule_id"), x["observed"].alias("observed"), x["blocked_by"].alias("blocked_by"), x["excluded_by"]["parameter"].alias("gate")))
    return own.select("subject", F.explode_outer(F.concat(*[item(p) for p in _PARTS])).alias("i")).where("i is not null").select("subject", "i.*")


@query("c9_report_groups", f"WITH {EV} SELECT subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY min(seq)) AS INT) AS pos, {_BLOCK} AS blocked_by, CAST(count(*) AS INT) AS n, string_agg(rule_id, '|' ORDER BY seq) AS rules FROM ev WHERE outcome = 'UNKNOWN' GROUP BY subject, {_BLOCK}")
def c9_groups(spark, sf):
    own = C.compose(subjects(spark, sf), RULES).select("subject", F.posexplode_outer("unresolved_groups").alias("at", "g")).where("g is not null")
    return own.select("subject", (F.col("at") + 1).alias("pos"), "g.blocked_by", F.col("g.count").alias("n"), F.array_join("g.findings.rule_id", "|").alias("rules"))


@query("c21_missing_items", f"WITH {EV} SELECT subject, parameter, string_agg(rule_id, '|' ORDER BY rule_id) AS rules FROM ev WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.subject = ev.subject AND f.name = ev.parameter) GROUP BY 1, 2 HAVING bool_or(applicability <> 'not_applicable')")
def c21_missing(spark, sf):
    own = C.chat(C.compose(subjects(spark, sf), RULES)).select("subject", F.explode_outer("missing_information").alias("m")).where("m is not null")
    return own.select("subject", "m.parameter", F.array_join("m.blocks_rules", "|").alias("rules"))


def packets(spark, sf) -> DataFrame:
    """Reports of documents, with the contexts of the sections that the rules cite, found in all of their texts."""
    nodes, edges = graphs.graph(spark, sf, None)
    cited = spark.createDataFrame([(r.id, r.section) for r in PACKET_RULES], "rule_id string, section string")
    contexts = C.rule_contexts(cited, nodes, G.context(nodes, edges, cited.select(T.citation_node(F.col("section")).alias("id")), None))
    return C.review(*domain.form_fields(spark, sf), domain._SPECS, PACKET_RULES, NAMES, contexts)


@query("c10_packet_review")
def c10_packets(spark, sf):
    return packets(spark, sf)


@query("s21_report_json")
def s21_json(spark, sf):
    own = C.review(*domain.form_fields(spark, sf), domain._SPECS, PACKET_RULES, NAMES)
    return own.select("subject", F.to_json(F.struct("*")).alias("report"))


@query("c20_letter_text")
def c20_text(spark, sf):
    own = C.review(*domain.form_fields(spark, sf), domain._SPECS, PACKET_RULES, NAMES)
    return own.select("subject", C.letter(F.concat(F.lit("order "), F.col("subject").cast("string"))).alias("letter"))


@query("c21_chat_payload")
def c21_payload(spark, sf):
    return C.chat(C.review(*domain.form_fields(spark, sf), domain._SPECS, PACKET_RULES, NAMES))


@query("j14_findings")
def j14_findings(spark, sf):
    return packets(spark, sf).select("subject", F.explode_outer(F.concat(*_PARTS)).alias("f")).where("f is not null").select("subject", "f.*")
