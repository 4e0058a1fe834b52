"""Rule evaluation over orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import rules as R
from factloom.registry import query, read

RULES = [
    R.Rule("Q-1", "quantity_max", ">=", "20 units", {"scale": "small"}),
    R.Rule("Q-2", "price_sum", "<=", 150000),
    R.Rule("Q-3", "discount_pct", "<", 9, {"scale": "small", "priority": ["1-urgent", "2-high", "3-medium"]}),
    R.Rule("Q-4", "status", "in", ["O", "F"]),
    R.Rule("Q-5", "note", "present"),
    R.Rule("Q-6", "flag", "absent"),
    R.Rule("Q-7", "priority", "!=", "5-LOW", severity="advisory"),
    R.Rule("Q-8", "quantity_max", ">", 1, verified=False),
    R.Rule("Q-9", "never_read", ">=", 3),
    R.Rule("Q-10", "status", "not_in", "F"),
    R.Rule("Q-11", "lines", "==", "4", {"status": "f"}),
]


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order: greatest quantity ``q`` and discount ``d``, sum of prices ``p``, number of lines ``n``.

    Prices are added in the order of the file, as one thread does: where a sum ends in .5, the order decides what it is rounded to, and partial sums come in any order.
    """
    own = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), "l_quantity", "l_discount", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("l_extendedprice").alias("price")).alias("at"))
    per = own.groupBy("subject").agg(F.max("l_quantity").cast("int").alias("q"), F.max(F.round(F.col("l_discount") * 100)).cast("int").alias("d"), F.array_sort(F.collect_list("at"))["price"].alias("prices"), F.count("*").alias("n"))
    known = F.filter("prices", lambda x: x.isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x))
    return per.select("subject", "q", "d", F.round(total).cast("long").alias("p"), "n")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts of orders; some are absent, some blank."""
    lines = line_facts(spark, sf_dir)
    from_lines = lines.unpivot("subject", [F.col("q").cast("string").alias("quantity_max"), F.col("d").cast("string").alias("discount_pct"), F.col("p").cast("string").alias("price_sum"), F.col("n").cast("string").alias("lines")], "name", "value")
    fact = lambda name, value: F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), value.cast("string").alias("value"))
    key = F.col("o_orderkey")
    own = F.array(
        fact("status", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))),
        fact("priority", F.col("o_orderpriority")),
        fact("scale", F.when(key % 5 == 0, F.lit(None)).when(F.col("o_totalprice") < 250000, "Small ").otherwise("large")),
        fact(F.when(key % 3 == 0, "note"), F.when(key % 2 == 0, "yes").otherwise("")),
        fact(F.when(key % 7 == 0, "flag"), F.lit("x")),
    )
    order = read(spark, sf_dir, "orders").select(key.alias("subject"), own.alias("f"))
    return order.select("subject", F.explode("f").alias("f")).select("subject", "f.name", "f.value").where("name is not null").unionByName(from_lines)


FACTS = """li AS (SELECT l_orderkey AS subject, CAST(max(l_quantity) AS INT) AS q, CAST(max(round(l_discount * 100)) AS INT) AS d, CAST(round(sum(l_extendedprice)) AS BIGINT) AS p, count(*) AS n FROM lineitem GROUP BY 1),
facts AS MATERIALIZED (SELECT subject, 'quantity_max' AS name, CAST(q AS STRING) AS value FROM li UNION ALL SELECT subject, 'discount_pct', CAST(d AS STRING) FROM li UNION ALL SELECT subject, 'price_sum', CAST(p AS STRING) FROM li UNION ALL SELECT subject, 'lines', CAST(n AS STRING) FROM li
 UNION ALL SELECT o_orderkey, 'status', CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders
 UNION ALL SELECT o_orderkey, 'scale', CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_totalprice < 250000 THEN 'Small ' ELSE 'large' END FROM orders
 UNION ALL SELECT o_orderkey, 'note', CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE '' END FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'flag', 'x' FROM orders WHERE o_orderkey % 7 = 0)"""


def _values() -> str:
    q = lambda v: "NULL" if v is None else "'" + str(v) + "'"
    rules = ", ".join(f"({i}, '{r.id}', '{r.parameter}', '{r.operator}', {q(None if isinstance(r.threshold, list) else r.threshold)}, {'[' + ', '.join(q(x.lower()) for x in r.threshold) + ']' if isinstance(r.threshold, list) else 'NULL'}, '{r.severity}', {r.verified})" for i, r in enumerate(RULES))
    gates = ", ".join(f"('{r.id}', {k}, '{key}', [{', '.join(q(x) for x in allowed)}])" for r in RULES for k, (key, allowed) in enumerate(r.applies_to.items()))
    return f"rules(seq, rule_id, parameter, op, threshold, items, severity, verified) AS (VALUES {rules}), gates(rule_id, gseq, key, allowed) AS (VALUES {gates})"


_N = "TRY_CAST(regexp_extract(replace({0}, ',', ''), '[-+]?\\d*\\.?\\d+') AS DOUBLE)"
EV = f"""{FACTS}, {_values()}, subjects AS (SELECT o_orderkey AS subject FROM orders),
state AS (SELECT s.subject, g.rule_id, g.gseq, g.key, CASE WHEN f.value IS NULL OR f.value = '' THEN 2 WHEN NOT list_contains(g.allowed, lower(trim(f.value))) THEN 1 ELSE 0 END AS st FROM subjects s CROSS JOIN gates g LEFT JOIN facts f ON f.subject = s.subject AND f.name = g.key),
decided AS MATERIALIZED (SELECT subject, rule_id, arg_min(st, gseq) AS st, arg_min(key, gseq) AS gate FROM state WHERE st > 0 GROUP BY 1, 2),
pairs AS (SELECT s.subject, r.*, f.subject IS NOT NULL AS known, f.value, d.st, d.gate, {_N.format('f.value')} AS l, {_N.format('r.threshold')} AS t FROM subjects s CROSS JOIN rules r LEFT JOIN facts f ON f.subject = s.subject AND f.name = r.parameter LEFT JOIN decided d ON d.subject = s.subject AND d.rule_id = r.rule_id),
ev AS MATERIALIZED (SELECT subject, rule_id, seq, parameter, severity, CASE WHEN NOT verified THEN 'UNKNOWN' WHEN st = 2 THEN 'UNKNOWN' WHEN st = 1 THEN 'PASS'
  WHEN op = 'present' THEN CASE WHEN value <> '' THEN 'PASS' WHEN NOT known THEN 'UNKNOWN' ELSE 'FAIL' END WHEN op = 'absent' THEN CASE WHEN value <> '' THEN 'FAIL' ELSE 'PASS' END
  WHEN value IS NULL OR value = '' THEN 'UNKNOWN'
  WHEN op IN ('>=', '<=', '>', '<') THEN CASE WHEN l IS NULL OR t IS NULL THEN 'UNKNOWN' WHEN (op = '>=' AND l >= t) OR (op = '<=' AND l <= t) OR (op = '>' AND l > t) OR (op = '<' AND l < t) THEN 'PASS' ELSE 'FAIL' END
  WHEN op = '==' THEN CASE WHEN lower(trim(value)) = lower(trim(threshold)) THEN 'PASS' ELSE 'FAIL' END WHEN op = '!=' THEN CASE WHEN lower(trim(value)) <> lower(trim(threshold)) THEN 'PASS' ELSE 'FAIL' END
  WHEN items IS NULL THEN 'UNKNOWN' WHEN (op = 'in') = list_contains(items, lower(trim(value))) THEN 'PASS' ELSE 'FAIL' END AS outcome,
  CASE WHEN NOT verified OR st = 2 THEN 'undetermined' WHEN st = 1 THEN 'not_applicable' ELSE 'applies' END AS applicability, CASE WHEN verified THEN gate END AS gate FROM pairs)"""
REPORT = EV + """, rep AS (SELECT subject, count(*) FILTER (outcome = 'PASS') AS n_pass, count(*) FILTER (outcome = 'FAIL') AS n_fail, count(*) FILTER (outcome = 'UNKNOWN') AS n_unknown, count(*) FILTER (outcome = 'FAIL' AND severity = 'return') AS return_reasons,
  count(*) FILTER (outcome <> 'UNKNOWN' AND applicability <> 'not_applicable') AS evaluated, count(*) FILTER (applicability = 'not_applicable') AS not_applicable, count(*) FILTER (outcome = 'UNKNOWN') AS unreadable, count(*) AS total FROM ev GROUP BY 1)"""


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = R.fact_map(facts(spark, sf_dir))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("subject")).join(have, "subject", "left")


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.compile_rules(subjects(spark, sf_dir), RULES)


@query("p5_rule_outcomes", f"WITH {EV} SELECT subject, rule_id, outcome, applicability FROM ev")
def p5(spark, sf):
    return evaluations(spark, sf).select("subject", "rule_id", "outcome", "applicability")


@query("p5_rule_outcomes_table", f"WITH {EV} SELECT subject, rule_id, outcome, applicability FROM ev")
def p5_table(spark, sf):
    return R.evaluate(subjects(spark, sf), R.rules_frame(spark, RULES)).select("subject", "rule_id", "outcome", "applicability")


@query("p6_gate_applicability", f"WITH {EV} SELECT subject, rule_id, applicability, gate FROM ev WHERE gate IS NOT NULL")
def p6(spark, sf):
    return evaluations(spark, sf).where("gate is not null").select("subject", "rule_id", "applicability", "gate")


@query("j1_facts_by_rules", f"WITH {FACTS}, {_values()} SELECT f.subject, r.rule_id, f.value FROM facts f JOIN rules r ON f.name = r.parameter")
def j1(spark, sf):
    rules = F.broadcast(R.rules_frame(spark, RULES).select("rule_id", F.col("parameter").alias("name")))
    return facts(spark, sf).join(rules, "name").select("subject", "rule_id", "value")


@query("a5_outcome_counts", f"WITH {REPORT} SELECT subject, n_pass, n_fail, n_unknown, return_reasons FROM rep")
def a5(spark, sf):
    return R.report(evaluations(spark, sf)).select("subject", "n_pass", "n_fail", "n_unknown", "return_reasons")


@query("a6_coverage", f"WITH {REPORT} SELECT subject, evaluated, not_applicable, unreadable, total, concat_ws(', ', evaluated || ' of ' || total || ' checked', CASE WHEN not_applicable > 0 THEN not_applicable || ' not applicable' END, CASE WHEN unreadable > 0 THEN unreadable || ' not readable' END) AS coverage FROM rep")
def a6(spark, sf):
    return R.report(evaluations(spark, sf)).select("subject", "evaluated", "not_applicable", "unreadable", "total", "coverage")


_VERDICT = "CASE WHEN n_fail > 0 THEN 'DEFICIENCIES FOUND' WHEN evaluated > 0 THEN 'NO DEFICIENCIES FOUND' ELSE 'CANNOT VERIFY' END"


@query("a7_verdict", f"WITH {REPORT} SELECT subject, {_VERDICT} AS verdict FROM rep")
def a7(spark, sf):
    return R.report(evaluations(spark, sf)).select("subject", "verdict")


@query("c6_evaluate_report", f"WITH {REPORT} SELECT subject, {_VERDICT} AS verdict, n_pass, n_fail, n_unknown, evaluated, not_applicable, unreadable, total FROM rep")
def c6(spark, sf):
    return R.report(evaluations(spark, sf)).select("subject", "verdict", "n_pass", "n_fail", "n_unknown", "evaluated", "not_applicable", "unreadable", "total")


_BLOCK = "CASE WHEN applicability = 'undetermined' AND gate IS NOT NULL THEN gate WHEN outcome = 'UNKNOWN' THEN parameter END"


@query("a22_missing_information", f"WITH {EV} SELECT subject, parameter, string_agg(rule_id, '|' ORDER BY rule_id) AS rules FROM ev WHERE outcome = 'UNKNOWN' AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.subject = ev.subject AND f.name = ev.parameter) GROUP BY 1, 2")
def a22(spark, sf):
    return R.missing_information(evaluations(spark, sf), facts(spark, sf)).select("subject", "parameter", F.array_join("rules", "|").alias("rules"))


@query("a23_unresolved_groups", f"WITH {EV} SELECT subject, {_BLOCK} AS blocked_by, CAST(min(seq) AS INT) AS first, count(*) AS n, string_agg(rule_id, '|' ORDER BY seq) AS rules FROM ev WHERE {_BLOCK} IS NOT NULL GROUP BY 1, 2")
def a23(spark, sf):
    return R.unresolved_groups(evaluations(spark, sf)).withColumn("rules", F.array_join("rules", "|"))


@query("p14_missing_not_excused", f"WITH {EV}, na AS (SELECT subject, list(rule_id) AS ids FROM ev WHERE applicability = 'not_applicable' GROUP BY 1), b AS (SELECT subject, {_BLOCK} AS blocked_by, list(rule_id) AS ids FROM ev WHERE {_BLOCK} IS NOT NULL GROUP BY 1, 2) SELECT b.subject, b.blocked_by FROM b LEFT JOIN na USING (subject) WHERE len(list_filter(b.ids, x -> NOT list_contains(coalesce(na.ids, []), x))) > 0")
def p14(spark, sf):
    e = evaluations(spark, sf)
    excused = e.where("applicability = 'not_applicable'").groupBy("subject").agg(F.collect_set("rule_id").alias("ids"))
    groups = R.unresolved_groups(e)
    return groups.join(excused, "subject", "left").where(F.size(F.array_except("rules", F.coalesce("ids", F.array().cast("array<string>")))) > 0).select("subject", "blocked_by")


@query("j14_finding_enrichment", f"WITH {EV} SELECT ev.subject, ev.rule_id, ev.outcome, f.value AS observed FROM ev LEFT JOIN facts f ON f.subject = ev.subject AND f.name = ev.parameter WHERE ev.outcome = 'FAIL'")
def j14(spark, sf):
    seen = facts(spark, sf).select("subject", F.col("name").alias("parameter"), F.col("value").alias("observed"))
    return evaluations(spark, sf).where("outcome = 'FAIL'").join(seen, ["subject", "parameter"], "left").select("subject", "rule_id", "outcome", "observed")


@query("w10_deficiency_order", f"WITH {EV} SELECT subject, rule_id, row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN severity = 'return' THEN 0 ELSE 1 END, rule_id) AS pos FROM ev WHERE outcome = 'FAIL'")
def w10(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("subject").orderBy(F.when(F.col("severity") == "return", 0).otherwise(1), "rule_id")
    return evaluations(spark, sf).where("outcome = 'FAIL'").select("subject", "rule_id", F.row_number().over(w).alias("pos"))


_G = "CASE o.o_orderstatus WHEN 'F' THEN 'denied' WHEN 'O' THEN 'approved' END"


@query("a8_discrimination", f"WITH {EV} SELECT {_G} AS grp, rule_id, count(*) FILTER (outcome = 'FAIL') AS n_fail, count(*) FILTER (outcome = 'PASS' AND applicability <> 'not_applicable') AS n_pass, count(*) FILTER (outcome = 'UNKNOWN') AS n_unknown, count(*) FILTER (applicability = 'not_applicable') AS n_na FROM ev JOIN orders o ON o.o_orderkey = ev.subject WHERE o.o_orderstatus IN ('F', 'O') GROUP BY 1, 2")
def a8(spark, sf):
    return discrimination(spark, sf)


def discrimination(spark: SparkSession, sf: str) -> DataFrame:
    group = read(spark, sf, "orders").where("o_orderstatus in ('F', 'O')").select(F.col("o_orderkey").alias("subject"), F.when(F.col("o_orderstatus") == "F", "denied").otherwise("approved").alias("grp"))
    bucket = F.when(F.col("applicability") == "not_applicable", "NA").otherwise(F.col("outcome"))
    n = lambda b: F.count(F.when(F.col("bucket") == b, 1))
    return evaluations(spark, sf).withColumn("bucket", bucket).join(group, "subject").groupBy("grp", "rule_id").agg(n("FAIL").alias("n_fail"), n("PASS").alias("n_pass"), n("UNKNOWN").alias("n_unknown"), n("NA").alias("n_na"))


_EVALUABLE = ["Q-1", "Q-2", "Q-4"]


@query(
    "a9_group_totals",
    f"""WITH {EV}, w AS (SELECT ev.*, r.verified, EXISTS (SELECT 1 FROM facts f WHERE f.subject = ev.subject AND f.name = ev.parameter) AS has FROM ev JOIN rules r USING (rule_id)),
per AS (SELECT {_G} AS grp, subject, bool_or(outcome = 'FAIL') AS tripped, bool_or(outcome = 'FAIL' AND rule_id IN ('Q-1', 'Q-2', 'Q-4')) AS ofe, NOT bool_or(outcome <> 'UNKNOWN' AND applicability <> 'not_applicable') AS blind, count(*) FILTER (outcome = 'UNKNOWN' AND NOT verified) AS a, count(*) FILTER (outcome = 'UNKNOWN' AND verified AND NOT has) AS b, count(*) FILTER (outcome = 'UNKNOWN' AND verified AND has) AS c
 FROM w JOIN orders o ON o.o_orderkey = w.subject WHERE o.o_orderstatus IN ('F', 'O') GROUP BY 1, 2)
SELECT grp, count(*) AS records, count(*) FILTER (subject IN (SELECT subject FROM facts)) AS mapped, count(*) FILTER (tripped) AS tripped_any, count(*) FILTER (ofe) AS tripped_evaluable, count(*) FILTER (blind) AS unknown_all, CAST(sum(a) AS BIGINT) AS not_certified, CAST(sum(b) AS BIGINT) AS parameter_missing, CAST(sum(c) AS BIGINT) AS not_comparable FROM per GROUP BY 1""",
)
def a9(spark, sf):
    group = read(spark, sf, "orders").where("o_orderstatus in ('F', 'O')").select(F.col("o_orderkey").alias("subject"), F.when(F.col("o_orderstatus") == "F", "denied").otherwise("approved").alias("grp"))
    return R.group_totals(evaluations(spark, sf), group, facts(spark, sf), RULES, _EVALUABLE)


@query("a10_separation", f"WITH {EV}, d AS (SELECT rule_id, 100.0 * count(*) FILTER (outcome = 'FAIL' AND o.o_orderstatus = 'F') / nullif(count(*) FILTER (o.o_orderstatus = 'F'), 0) AS a, 100.0 * count(*) FILTER (outcome = 'FAIL' AND o.o_orderstatus = 'O') / nullif(count(*) FILTER (o.o_orderstatus = 'O'), 0) AS b FROM ev JOIN orders o ON o.o_orderkey = ev.subject WHERE o.o_orderstatus IN ('F', 'O') GROUP BY 1) SELECT rule_id, round(a - b, 4) AS points, CASE WHEN a > b THEN 'denied' WHEN a < b THEN 'approved' ELSE 'none' END AS side FROM d")
def a10(spark, sf):
    d = discrimination(spark, sf).withColumn("rate", 100.0 * F.col("n_fail") / (F.col("n_fail") + F.col("n_pass") + F.col("n_unknown") + F.col("n_na")))
    p = d.groupBy("rule_id").agg(F.max(F.when(F.col("grp") == "denied", F.col("rate"))).alias("a"), F.max(F.when(F.col("grp") == "approved", F.col("rate"))).alias("b"))
    return p.select("rule_id", F.round(F.col("a") - F.col("b"), 4).alias("points"), F.when(F.col("a") > F.col("b"), "denied").when(F.col("a") < F.col("b"), "approved").otherwise("none").alias("side"))


@query("c12_rule_discrimination", f"WITH {EV}, d AS (SELECT {_G} AS grp, rule_id, count(*) AS n, count(*) FILTER (outcome = 'FAIL') AS n_fail FROM ev JOIN orders o ON o.o_orderkey = ev.subject WHERE o.o_orderstatus IN ('F', 'O') GROUP BY 1, 2) SELECT grp, rule_id, n, n_fail, round(100.0 * n_fail / n, 3) AS pct FROM d")
def c12(spark, sf):
    d = discrimination(spark, sf).withColumn("n", F.col("n_fail") + F.col("n_pass") + F.col("n_unknown") + F.col("n_na"))
    return d.select("grp", "rule_id", "n", "n_fail", F.round(100.0 * F.col("n_fail") / F.col("n"), 3).alias("pct"))


@query("j15_threshold_lookup", f"WITH {_values()} SELECT parameter, arg_min(threshold, seq) AS threshold FROM rules WHERE threshold IS NOT NULL GROUP BY 1")
def j15(spark, sf):
    return R.rules_frame(spark, RULES).where("threshold is not null").groupBy("parameter").agg(F.min_by("threshold", "seq").alias("threshold"))


@query("a27_rules_by_threshold", f"WITH {_values()} SELECT {_N.format('threshold')} AS t, string_agg(rule_id, '|' ORDER BY rule_id) AS rules FROM rules WHERE threshold IS NOT NULL AND op IN ('>=', '<=', '>', '<') GROUP BY 1")
def a27(spark, sf):
    from factloom.functions.numbers import coerce_number

    own = R.rules_frame(spark, RULES).where(F.col("operator").isin(R.NUMERIC) & F.col("threshold").isNotNull())
    return own.groupBy(coerce_number(F.col("threshold")).alias("t")).agg(F.array_join(F.array_sort(F.collect_list("rule_id")), "|").alias("rules"))


@query("f37_requirement_text", f"WITH {EV} SELECT subject, rule_id, CASE outcome WHEN 'FAIL' THEN parameter || ' does not meet the requirement' WHEN 'PASS' THEN CASE WHEN applicability = 'not_applicable' THEN 'does not apply because of ' || gate ELSE parameter || ' meets the requirement' END ELSE coalesce(gate, parameter) || ' could not be read' END AS txt FROM ev")
def f37(spark, sf):
    text = F.when(F.col("outcome") == "FAIL", F.concat("parameter", F.lit(" does not meet the requirement"))).when(F.col("outcome") == "UNKNOWN", F.concat(F.coalesce("gate", "parameter"), F.lit(" could not be read")))
    text = text.when(F.col("applicability") == "not_applicable", F.concat(F.lit("does not apply because of "), "gate")).otherwise(F.concat("parameter", F.lit(" meets the requirement")))
    return evaluations(spark, sf).select("subject", "rule_id", text.alias("txt"))


@query("c20_correction_letter", f"WITH {REPORT}, f AS (SELECT subject, string_agg(rule_id || ': ' || parameter, chr(10) ORDER BY CASE WHEN severity = 'return' THEN 0 ELSE 1 END, rule_id) AS body FROM ev WHERE outcome = 'FAIL' GROUP BY 1) SELECT rep.subject, CASE WHEN n_fail > 0 THEN 'Please correct:' || chr(10) || f.body ELSE '' END AS letter FROM rep LEFT JOIN f USING (subject)")
def c20(spark, sf):
    e = evaluations(spark, sf)
    line = F.struct(F.when(F.col("severity") == "return", 0).otherwise(1).alias("o"), "rule_id", F.concat("rule_id", F.lit(": "), "parameter").alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("outcome") == "FAIL", line))), lambda x: x["t"]), "\n")
    return e.groupBy("subject").agg(body.alias("body"), F.bool_or(F.col("outcome") == "FAIL").alias("any")).select("subject", F.when(F.col("any"), F.concat(F.lit("Please correct:\n"), "body")).otherwise("").alias("letter"))


@query("c9_composed_report", f"WITH {REPORT} SELECT rep.subject, {_VERDICT} AS verdict, coalesce(g.failing, '') AS failing, coalesce(g.unresolved, '') AS unresolved, coalesce(g.excused, '') AS excused FROM rep LEFT JOIN (SELECT subject, string_agg(rule_id, '|' ORDER BY rule_id) FILTER (outcome = 'FAIL') AS failing, string_agg(rule_id, '|' ORDER BY rule_id) FILTER (outcome = 'UNKNOWN') AS unresolved, string_agg(rule_id, '|' ORDER BY rule_id) FILTER (applicability = 'not_applicable') AS excused FROM ev GROUP BY 1) g USING (subject)")
def c9(spark, sf):
    e = evaluations(spark, sf)
    some = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("rule_id")))), "|")
    groups = e.groupBy("subject").agg(some(F.col("outcome") == "FAIL").alias("failing"), some(F.col("outcome") == "UNKNOWN").alias("unresolved"), some(F.col("applicability") == "not_applicable").alias("excused"))
    return R.report(e).select("subject", "verdict").join(groups, "subject")


@query("c21_chat_context", f"WITH {REPORT}, p AS (SELECT subject, name, value FROM facts WHERE name NOT IN ('note', 'flag') AND value IS NOT NULL) SELECT rep.subject, {_VERDICT} AS verdict, count(p.name) AS n_facts FROM rep LEFT JOIN p USING (subject) GROUP BY ALL")
def c21(spark, sf):
    safe = F.map_filter("facts", lambda k, v: ~k.isin("note", "flag") & v.isNotNull())
    own = subjects(spark, sf).withColumn("n_facts", F.coalesce(F.size(safe), F.lit(0)).cast("long"))
    return R.report(R.compile_rules(own, RULES, keep=("n_facts",)), by=["subject", "n_facts"]).select("subject", "n_facts", "verdict")


@query("p18_finding_payload", f"WITH {EV} SELECT subject, rule_id, outcome, '{{' || '\"rule\":\"' || rule_id || '\",\"outcome\":\"' || outcome || '\"}}' AS payload FROM ev")
def p18(spark, sf):
    return evaluations(spark, sf).select("subject", "rule_id", "outcome", F.to_json(F.struct(F.col("rule_id").alias("rule"), "outcome")).alias("payload"))


@query("a11_survey_summary", f"WITH {REPORT}, v AS (SELECT *, {_VERDICT} AS verdict FROM rep) SELECT verdict, count(*) AS packets, max(evaluated) AS best, min(evaluated) AS worst, round(avg(evaluated), 2) AS mean FROM v GROUP BY 1")
def a11(spark, sf):
    return R.report(evaluations(spark, sf)).groupBy("verdict").agg(F.count("*").alias("packets"), F.max("evaluated").alias("best"), F.min("evaluated").alias("worst"), F.round(F.avg("evaluated"), 2).alias("mean"))


@query("c10_review_chain", f"WITH {REPORT} SELECT rep.subject, {_VERDICT} AS verdict, evaluated, total, c.c_mktsegment AS segment FROM rep JOIN orders o ON o.o_orderkey = rep.subject LEFT JOIN customer c ON c.c_custkey = o.o_custkey")
def c10(spark, sf):
    rep = R.report(evaluations(spark, sf)).select("subject", "verdict", "evaluated", "total")
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("subject"), F.col("o_custkey").alias("c_custkey"))
    return rep.join(o, "subject").join(read(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), "c_custkey", "left").drop("c_custkey")
