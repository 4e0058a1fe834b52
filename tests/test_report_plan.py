"""Facts of a subject are shuffled once."""

from factloom.operators import rules as R


def test_one_shuffle_by_subject(spark):
    facts = spark.createDataFrame([(1, "a", "2"), (1, "a", "1"), (2, "b", None)], "subject long, name string, value string")
    have = R.fact_map(facts)
    assert have._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.subject: r.facts for r in have.collect()} == {1: {"a": "1"}, 2: {"b": None}}


def test_rules_are_not_one_generated_method(spark):
    """The JVM compiles no method of more than 8,000 bytes, and all rules in one are more."""
    rules = [R.Rule(f"R-{i}", "a", ">=", i) for i in range(3)]
    own = spark.createDataFrame([(1, {"a": "2"}, 5), (2, None, 6)], "subject long, facts map<string,string>, n long")
    out = R.compile_rules(own, rules, keep=("n",))
    assert not [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if ") Generate" in x]
    assert {(r.subject, r.n, r.n_pass, r.n_unknown) for r in R.report(out, ["subject", "n"]).collect()} == {(1, 5, 3, 0), (2, 6, 0, 3)}
