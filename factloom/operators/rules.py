"""Rule evaluation: three outcomes, explicit applicability, verdict and coverage.

Facts come as one map for each subject, so that a fact that is absent differs from one that is
there without a value. ``compile_rules`` turns a rule set into expressions over that map: no join, no
shuffle, everything in one generated stage. ``evaluate`` reads the rules from a table.
Both follow the same order of tests; the first that holds decides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import coerce_number
from factloom.functions.text import once, strip

OPERATORS = [">=", "<=", ">", "<", "==", "!=", "in", "not_in", "present", "absent"]
NUMERIC = OPERATORS[:4]
#: Rules that are sent to every task at once.
MOST_RULES = 10_000


@dataclass
class Rule:
    id: str
    parameter: str
    operator: str
    threshold: object = None
    applies_to: dict[str, list[str]] = field(default_factory=dict)
    severity: str = "return"
    verified: bool = True
    section: str = "0"
    remedy: str = ""
    page: int | None = None
    quote: str = ""
    units: str = ""
    notes: str = ""

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise ValueError(f"rule {self.id}: unknown operator {self.operator!r}")
        if self.operator not in ("present", "absent") and self.threshold is None:
            raise ValueError(f"rule {self.id}: {self.operator} needs a threshold")
        if not self.section:
            raise ValueError(f"rule {self.id}: no citation")
        self.applies_to = {k: [str(x).strip().lower() for x in (v if isinstance(v, list) else [v])] for k, v in self.applies_to.items()}


def load_rules(text: str) -> list[Rule]:
    """Rules from YAML text; unknown keys and repeated ids are errors."""
    import yaml

    rows = yaml.safe_load(text)
    rules = [Rule(**r) for r in (rows["rules"] if isinstance(rows, dict) else rows)]
    if len({r.id for r in rules}) < len(rules):
        raise ValueError("a rule id occurs twice")
    return rules


def fact_map(facts: DataFrame, subject: str = "subject", name: str = "name", value: str = "value") -> DataFrame:
    """``subject, facts``; of several values for a name, the smallest. One shuffle, by subject, serves both steps and what is joined by subject."""
    one = facts.repartition(subject).groupBy(subject, name).agg(F.min(value).alias(value))
    return one.groupBy(subject).agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias("facts"))


def _folded(c: Column) -> Column:
    return F.lower(strip(c))


def _result(outcome: Column | str, applicability: str, parameter: Column | None = None) -> Column:
    out = outcome if isinstance(outcome, Column) else F.lit(outcome)
    return F.struct(out.alias("outcome"), F.lit(applicability).alias("applicability"), (parameter if parameter is not None else F.lit(None).cast("string")).alias("gate"))


def _pass(c: Column) -> Column:
    return F.when(c, "PASS").otherwise("FAIL")


def compiled(rule: Rule, facts: Column) -> Column:
    """The evaluation of one rule as an expression."""
    value = facts[rule.parameter]
    there = value.isNotNull() & (value != "")
    applies = lambda o: _result(o, "applies")
    if rule.operator == "present":
        out = F.when(there, applies("PASS")).when(~F.map_contains_key(facts, rule.parameter), applies("UNKNOWN")).otherwise(applies("FAIL"))
    elif rule.operator == "absent":
        out = F.when(there, applies("FAIL")).otherwise(applies("PASS"))
    elif rule.operator in NUMERIC:
        left, right = coerce_number(value), coerce_number(F.lit(str(rule.threshold)))
        holds = {">=": left >= right, "<=": left <= right, ">": left > right, "<": left < right}[rule.operator]
        out = F.when(there & left.isNotNull() & right.isNotNull(), applies(_pass(holds))).otherwise(applies("UNKNOWN"))
    elif rule.operator in ("==", "!="):
        same = _folded(value) == str(rule.threshold).strip().lower()
        out = F.when(there, applies(_pass(same if rule.operator == "==" else ~same))).otherwise(applies("UNKNOWN"))
    elif isinstance(rule.threshold, list):
        among = _folded(value).isin([str(x).strip().lower() for x in rule.threshold])
        out = F.when(there, applies(_pass(among if rule.operator == "in" else ~among))).otherwise(applies("UNKNOWN"))
    else:
        out = applies("UNKNOWN")
    for key, allowed in reversed(rule.applies_to.items()):
        got = facts[key]
        out = F.when(got.isNull() | (got == ""), _result("UNKNOWN", "undetermined", F.lit(key))).when(~_folded(got).isin(allowed), _result("PASS", "not_applicable", F.lit(key))).otherwise(out)
    return out if rule.verified else _result("UNKNOWN", "undetermined")


def compile_rules(subjects: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ()) -> DataFrame:
    """``subject, rule_id, seq, parameter, severity, outcome, applicability, gate`` from ``subject, facts``; columns of ``keep`` are carried on."""
    found = lambda facts: F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(i).alias("seq"), F.lit(r.parameter).alias("parameter"), F.lit(r.severity).alias("severity"), compiled(r, facts).alias("e")) for i, r in enumerate(rules)])
    if not rules:
        return subjects.select("subject", *keep).limit(0).selectExpr("subject", *keep, "'' rule_id", "0 seq", "'' parameter", "'' severity", "'' outcome", "'' applicability", "'' gate")
    # one generated method with all rules took nearly four times as long, probably as it is too large for the JVM to compile
    each = once(F.coalesce("facts", F.create_map().cast("map<string,string>")), found)
    return subjects.select("subject", *keep, F.explode(each).alias("r")).select("subject", *keep, "r.rule_id", "r.seq", "r.parameter", "r.severity", "r.e.outcome", "r.e.applicability", "r.e.gate")


def rules_frame(spark, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.id, r.parameter, r.operator, None if isinstance(r.threshold, list) or r.threshold is None else str(r.threshold), [str(x).strip().lower() for x in r.threshold] if isinstance(r.threshold, list) else None, r.severity, r.verified, [(k, v) for k, v in r.applies_to.items()]) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "seq int, rule_id string, parameter string, operator string, threshold string, threshold_list array<string>, severity string, verified boolean, gates array<struct<key: string, allowed: array<string>>>")


def evaluate(subjects: DataFrame, rules: DataFrame) -> DataFrame:
    """The same from a table of rules, for rule sets that are data."""
    if rules.count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; evaluate them in blocks")
    both = subjects.select("subject", F.coalesce("facts", F.create_map().cast("map<string,string>")).alias("facts")).crossJoin(F.broadcast(rules))
    value, facts = F.col("facts")[F.col("parameter")], F.col("facts")
    state = F.transform("gates", lambda g: F.struct(F.when(facts[g["key"]].isNull() | (facts[g["key"]] == ""), 2).when(~F.array_contains(g["allowed"], _folded(facts[g["key"]])), 1).otherwise(0).alias("state"), g["key"].alias("key")))
    both = both.withColumns({"value": value, "first": F.get(F.filter(state, lambda s: s["state"] > 0), F.lit(0)), "left": coerce_number(value), "right": coerce_number(F.col("threshold"))})
    op, there = F.col("operator"), F.col("value").isNotNull() & (F.col("value") != "")
    same = _folded(F.col("value")) == F.lower(strip(F.col("threshold")))
    among = F.array_contains("threshold_list", _folded(F.col("value")))
    outcome = (
        F.when(~F.col("verified"), "UNKNOWN")
        .when(F.col("first.state") == 2, "UNKNOWN")
        .when(F.col("first.state") == 1, "PASS")
        .when(op == "present", F.when(there, "PASS").when(~F.map_contains_key("facts", F.col("parameter")), "UNKNOWN").otherwise("FAIL"))
        .when(op == "absent", _pass(~F.coalesce(there, F.lit(False))))
        .when(~F.coalesce(there, F.lit(False)), "UNKNOWN")
        .when(op.isin(NUMERIC), F.when(F.col("left").isNull() | F.col("right").isNull(), "UNKNOWN").when(((op == ">=") & (F.col("left") >= F.col("right"))) | ((op == "<=") & (F.col("left") <= F.col("right"))) | ((op == ">") & (F.col("left") > F.col("right"))) | ((op == "<") & (F.col("left") < F.col("right"))), "PASS").otherwise("FAIL"))
        .when(op == "==", _pass(same))
        .when(op == "!=", _pass(~same))
        .when(F.col("threshold_list").isNull(), "UNKNOWN")
        .when(op == "in", _pass(among))
        .otherwise(_pass(~among))
    )
    applicability = F.when(~F.col("verified") | (F.col("first.state") == 2), "undetermined").when(F.col("first.state") == 1, "not_applicable").otherwise("applies")
    return both.select("subject", "rule_id", "seq", "parameter", "severity", outcome.alias("outcome"), applicability.alias("applicability"), F.when(F.col("verified"), F.col("first.key")).alias("gate"))


def compared() -> Column:
    return F.col("outcome").isin("PASS", "FAIL") & (F.col("applicability") != "not_applicable")


def coverage_text() -> Column:
    part = lambda c, t: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(" " + t)))
    return F.concat_ws(", ", F.concat(F.col("evaluated").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" checked")), part("not_applicable", "not applicable"), part("unreadable", "not readable"))


def verdict() -> Column:
    return F.when(F.col("n_fail") > 0, "DEFICIENCIES FOUND").when(F.col("evaluated") > 0, "NO DEFICIENCIES FOUND").otherwise("CANNOT VERIFY")


def report(evaluations: DataFrame, by: str | list[str] = "subject", subjects: DataFrame | None = None) -> DataFrame:
    """Counts, coverage and verdict of each subject; evaluated + not applicable + unreadable = all.

    With ``subjects``, also of those without any evaluation, as when there are no rules: nothing can be verified.
    """
    n = lambda c: F.count(F.when(c, 1))
    out = evaluations.groupBy(by).agg(
        n(F.col("outcome") == "PASS").alias("n_pass"),
        n(F.col("outcome") == "FAIL").alias("n_fail"),
        n(F.col("outcome") == "UNKNOWN").alias("n_unknown"),
        n((F.col("outcome") == "FAIL") & (F.col("severity") == "return")).alias("return_reasons"),
        n(compared()).alias("evaluated"),
        n(F.col("applicability") == "not_applicable").alias("not_applicable"),
        n((F.col("outcome") == "UNKNOWN")).alias("unreadable"),
        F.count("*").alias("total"),
    )
    if subjects is not None:
        keys = [by] if isinstance(by, str) else by
        out = subjects.select(keys).distinct().join(out, keys, "left").fillna(0, [c for c in out.columns if c not in keys])
    return out.withColumns({"coverage": coverage_text(), "verdict": verdict()})


def blocked_by() -> Column:
    """What an unresolved evaluation waits for: its gate, else its parameter."""
    return F.when((F.col("applicability") == "undetermined") & F.col("gate").isNotNull(), F.col("gate")).when(F.col("outcome") == "UNKNOWN", F.col("parameter"))


def missing_information(evaluations: DataFrame, facts: DataFrame) -> DataFrame:
    """Parameters without a fact (a blank one isn't missing), with the rules that wait for them."""
    waiting = evaluations.where("outcome = 'UNKNOWN'").groupBy("subject", "parameter").agg(F.array_sort(F.collect_list("rule_id")).alias("rules"))
    return waiting.join(facts.select("subject", F.col("name").alias("parameter")).distinct(), ["subject", "parameter"], "left_anti")


def unresolved_groups(evaluations: DataFrame) -> DataFrame:
    """Unresolved evaluations of a subject by what blocks them, in the order of first appearance."""
    own = evaluations.withColumn("blocked_by", blocked_by()).where("blocked_by is not null")
    return own.groupBy("subject", "blocked_by").agg(F.min("seq").alias("first"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "rule_id"))), lambda x: x["rule_id"]).alias("rules"))


def group_totals(evaluations: DataFrame, groups: DataFrame, facts: DataFrame, rules: list[Rule], evaluable: list[str]) -> DataFrame:
    """What the rules say of each group of ``subject, grp``.

    ``records``; ``mapped``: with any fact; ``tripped_any``, ``tripped_evaluable``: with a failure, of any rule or of one of ``evaluable``;
    ``unknown_all``: without any comparison (a rule that doesn't apply compares nothing); and why single checks didn't run: ``not_certified``, ``parameter_missing``, ``not_comparable``.
    """
    certified = F.col("rule_id").isin([r.id for r in rules if r.verified])
    have = facts.select("subject", F.col("name").alias("parameter")).distinct().withColumn("has", F.lit(True))
    waiting = (F.col("outcome") == "UNKNOWN")
    per = evaluations.join(have, ["subject", "parameter"], "left").groupBy("subject").agg(
        F.bool_or(F.col("outcome") == "FAIL").alias("tripped"),
        F.bool_or((F.col("outcome") == "FAIL") & F.col("rule_id").isin(evaluable)).alias("of_evaluable"),
        (~F.bool_or(compared())).alias("blind"),
        F.count_if(waiting & ~certified).alias("not_certified"),
        F.count_if(waiting & certified & F.col("has").isNull()).alias("parameter_missing"),
        F.count_if(waiting & certified & F.col("has").isNotNull()).alias("not_comparable"),
    )
    mapped = facts.select("subject").distinct().withColumn("mapped", F.lit(True))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return groups.join(per, "subject", "left").join(mapped, "subject", "left").groupBy("grp").agg(
        F.count("*").alias("records"),
        F.count_if(no("mapped")).alias("mapped"),
        F.count_if(no("tripped")).alias("tripped_any"),
        F.count_if(no("of_evaluable")).alias("tripped_evaluable"),
        F.count_if(F.coalesce("blind", F.lit(True))).alias("unknown_all"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("not_certified", "parameter_missing", "not_comparable")],
    )
