"""Reports of subjects: findings with where their values come from, what is missing, letters, and payloads for a chat.

All about a subject is in its row: evaluations and their groups are array expressions over its map of facts, so a report
needs no shuffle but the one that gathers the facts. What is known of the rules is constant; their contexts are a map
of at most ``rules.MOST_RULES`` entries, in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import extract as E
from factloom.operators import rules as R

#: How a comparison is said.
SAID = {">=": "be at least", "<=": "be at most", ">": "be greater than", "<": "be less than", "==": "equal"}
READ = "struct<value: string, source: string, label: string, page: int, raw: string, confidence: double>"
CONTEXT = "struct<cross_references: array<struct<label: string, title: string, text: string>>, definitions: array<struct<term: string, defined_in: string>>, exceptions: array<struct<section: string, text: string>>>"


def gathered(facts: DataFrame) -> DataFrame:
    """``subject, facts, read`` from ``subject, name, value, source, label, page, raw, confidence``: values and where they were read, by name.

    Of several values for a name the smallest counts, as in ``rules.fact_map``; one without a value counts last.
    """
    read = F.struct(*[F.col(n).cast(t).alias(n) for n, t in (f.split(": ") for f in READ[7:-1].split(", "))])
    one = facts.groupBy("subject", "name").agg(F.min(F.struct(F.col("value").isNull().alias("blank"), read.alias("read"))).alias("r"))
    out = one.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("name", "r.read"))).alias("read"))
    return out.select("subject", F.transform_values("read", lambda _, v: v["value"]).alias("facts"), "read")


def described(read: Column) -> Column:
    """Where a value was read, in one line."""
    label = F.concat(F.lit("'"), read["label"], F.lit("'"))
    kind = F.when(read["source"] == "form_field", F.concat_ws(" ", F.lit("form field"), label)).when(read["source"] == "checkbox", F.concat_ws(" ", F.lit("ticked box"), label))
    kind = kind.when(read["source"] == "text_pattern", "text on the page").otherwise(F.coalesce(read["source"], F.lit("derived")))
    return F.when(read.isNotNull(), F.concat_ws(", ", kind, F.concat(F.lit("page "), read["page"].cast("string")), F.when(read["confidence"].isNotNull(), F.format_string("OCR confidence %.0f%%", read["confidence"]))))


def rule_contexts(rules: DataFrame, nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """``rule_id, context``: of what a rule cites, 4 references, 6 terms and 3 exceptions; an exhibit is its own reference.

    ``rules(rule_id, section)``; ``contexts`` as ``graph.context`` gives them. Rules that cite nothing known have no row.
    """
    own = contexts.select(
        F.col("id").alias("cited"),
        F.struct(
            F.transform(F.slice("references", 1, 4), lambda r: F.struct(F.concat_ws(" ", r["type"], r["number"]).alias("label"), r["title"].alias("title"), F.left(r["text"], F.lit(400)).alias("text"))).alias("cross_references"),
            F.slice("definitions", 1, 6).alias("definitions"),
            F.transform(F.slice("exceptions", 1, 3), lambda e: F.struct(e["number"].alias("section"), F.left(e["text"], F.lit(300)).alias("text"))).alias("exceptions"),
        ).cast(CONTEXT).alias("context"),
    )
    label = F.concat(F.lit("Exhibit "), F.regexp_extract("id", "^exhibit:(.*)", 1))
    itself = F.struct(label.alias("label"), "title", F.left(F.coalesce("text", F.lit("")), F.lit(600)).alias("text"))
    exhibits = nodes.where("type = 'Exhibit'").select(F.col("id").alias("cited"), F.struct(F.array(itself), F.array().cast("array<struct<term: string, defined_in: string>>"), F.array().cast("array<struct<section: string, text: string>>")).cast(CONTEXT).alias("context"))
    return rules.select("rule_id", T.citation_node(F.col("section")).alias("cited")).join(own.unionByName(exhibits), "cited").select("rule_id", "context")


def _names(names: dict[str, tuple[str, str]]) -> Column:
    entries = [x for k, (named, found) in names.items() for x in (F.lit(k), F.struct(F.lit(named).alias("named"), F.lit(found).alias("found")))]
    return F.create_map(*entries).cast("map<string, struct<named: string, found: string>>")


def _constant(rule: R.Rule, rank: int, names: dict[str, tuple[str, str]]) -> Column:
    """What a finding says of its rule, whoever the subject is."""
    named = names.get(rule.parameter, (rule.parameter, ""))[0]
    limit = None if rule.threshold is None else ", ".join(map(str, rule.threshold)) if isinstance(rule.threshold, list) else str(rule.threshold)
    words = [f"{named} must be provided"] if limit is None else [named, *(["must", SAID[rule.operator]] if rule.operator in SAID else [rule.operator]), limit, *([rule.units] if rule.units else [])]
    citation = f"{rule.section}, page {rule.page}" if rule.page else rule.section
    values = {"rank": rank, "rule_id": rule.id, "parameter": rule.parameter, "severity": rule.severity, "verified": rule.verified, "requirement": " ".join(words), "threshold": limit, "units": rule.units, "section": rule.section, "page": rule.page, "citation": citation, "quote": rule.quote, "remedy": rule.remedy, "caveats": " ".join(rule.notes.split())}
    types = {"rank": "int", "verified": "boolean", "page": "int"}
    return F.struct(*[F.lit(v).cast(types.get(k, "string")).alias(k) for k, v in values.items()])


def findings(subjects: DataFrame, rules: list[R.Rule], names: dict[str, tuple[str, str]] | None = None, contexts: DataFrame | None = None, kept: list[str] = ()) -> DataFrame:
    """``subject, facts, read, findings`` and the columns ``kept``: the evaluation of each rule, in their order, with its value, provenance, gate and context.

    ``subjects(subject, facts)``, and ``read`` where it is known where values come from; ``names`` has what a parameter is called and where a
    packet has it; ``contexts`` as from ``rule_contexts``. A subject without facts has all findings; without rules it has none.
    """
    if len(rules) > R.MOST_RULES:
        raise ValueError(f"more than {R.MOST_RULES} rules")
    rank = {r.id: i for i, r in enumerate(sorted(rules, key=lambda r: (r.severity != "return", r.id)))}
    facts = F.coalesce("facts", F.create_map().cast("map<string,string>")).alias("facts")
    read = F.coalesce("read", F.create_map().cast(f"map<string, {READ}>")) if "read" in subjects.columns else F.create_map().cast(f"map<string, {READ}>")
    own = subjects.select("subject", facts, read.alias("read"), *kept)
    if contexts is None:
        own = own.withColumn("contexts", F.create_map().cast(f"map<string, {CONTEXT}>"))
    else:
        own = own.crossJoin(F.broadcast(contexts.agg(F.map_from_entries(F.collect_list(F.struct("rule_id", "context"))).alias("contexts"))))
    if not rules:
        rules_free = findings(subjects, [R.Rule("", "", "present")], names, contexts, kept)
        return rules_free.withColumn("findings", F.slice("findings", 1, 0))
    constants = F.array(*[_constant(r, rank[r.id], names or {}) for r in rules])
    none = F.struct(*[F.array().cast(t.split(": ", 1)[1]).alias(t.split(": ", 1)[0]) for t in CONTEXT[7:-1].replace(">>, ", ">>|").split("|")])

    def finding(e: Column, r: Column) -> Column:
        gate = e["gate"]
        excluded = F.when(gate.isNotNull(), F.struct(gate.alias("parameter"), F.col("facts")[gate].alias("value"), described(F.col("read")[gate]).alias("where")))
        blocked = F.when((e["applicability"] == "undetermined") & gate.isNotNull(), gate).when(e["outcome"] == "UNKNOWN", r["parameter"])
        given = F.coalesce(F.col("contexts")[r["rule_id"]], none)
        said = [r[f].alias(f) for f in ("rank", "rule_id", "parameter", "severity", "verified", "requirement", "threshold", "units", "section", "page", "citation", "quote", "remedy", "caveats")]
        return F.struct(*said, e["outcome"].alias("outcome"), e["applicability"].alias("applicability"), F.col("facts")[r["parameter"]].alias("observed"), described(F.col("read")[r["parameter"]]).alias("provenance"), F.col("read")[r["parameter"]]["page"].alias("fact_page"), excluded.alias("excluded_by"), blocked.alias("blocked_by"), given["cross_references"].alias("cross_references"), given["definitions"].alias("definitions"), given["exceptions"].alias("exceptions"))

    own = own.withColumn("e", F.array(*[R.compiled(r, F.col("facts")) for r in rules]))
    return own.select("subject", "facts", "read", *kept, F.zip_with("e", constants, finding).alias("findings"))


def compose(subjects: DataFrame, rules: list[R.Rule], names: dict[str, tuple[str, str]] | None = None, contexts: DataFrame | None = None, kept: list[str] = ()) -> DataFrame:
    """A report for each row of ``subjects``, then its columns ``kept``; see ``findings`` for what it takes.

    Verdict, counts and coverage; ``deficiencies`` (those that return an application first), ``unresolved``, ``satisfied`` and ``not_applicable``;
    ``unresolved_groups`` by what blocks them, in order of appearance; ``missing_information``, ``facts_read``, ``notices``. Nothing is decided anew here.
    """
    names = names or {}
    known = _names(names)
    have = findings(subjects, rules, names, contexts, kept)
    of = lambda c: F.filter("findings", c)
    out_of_scope = lambda x: x["applicability"] == "not_applicable"
    by_rank = lambda found: F.transform(F.array_sort(F.transform(found, lambda x: F.struct(x["rank"].alias("rank"), x.alias("x")))), lambda y: y["x"])
    have = have.withColumns({
        "deficiencies": by_rank(of(lambda x: x["outcome"] == "FAIL")),
        "unresolved": of(lambda x: x["outcome"] == "UNKNOWN"),
        "satisfied": of(lambda x: (x["outcome"] == "PASS") & ~out_of_scope(x)),
        "not_applicable_findings": of(out_of_scope),
        "unconfirmed": F.size(of(lambda x: ~x["verified"])),
    }).withColumns({
        "n_fail": F.size("deficiencies"),
        "unreadable": F.size("unresolved"),
        "not_applicable": F.size("not_applicable_findings"),
        "total": F.size("findings"),
        "n_pass": F.size(of(lambda x: x["outcome"] == "PASS")),
        "evaluated": F.size("satisfied") + F.size(F.filter("deficiencies", lambda x: ~out_of_scope(x))),
    })
    wanted: dict[str, list[str]] = {}
    for r in rules:
        wanted.setdefault(r.parameter, []).append(r.id)
    item = lambda p: F.struct(F.lit(p).alias("parameter"), F.lit(names.get(p, (p, ""))[0]).alias("named"), F.lit(names.get(p, (p, ""))[1]).alias("normally_found"), T.literal_words(sorted(wanted[p])).alias("blocks_rules"))
    missing = F.filter(F.array(*[item(p) for p in sorted(wanted)]), lambda x: ~F.map_contains_key("facts", x["parameter"])) if wanted else F.array().cast("array<struct<parameter: string, named: string, normally_found: string, blocks_rules: array<string>>>")

    def group(k: Column) -> Column:
        own = F.filter("unresolved", lambda x: x["blocked_by"] == k)
        return F.struct(k.alias("blocked_by"), F.coalesce(known[k]["named"], k).alias("described"), F.coalesce(known[k]["found"], F.lit("")).alias("location"), F.size(own).alias("count"), F.transform(own, lambda x: F.struct(x["rule_id"].alias("rule_id"), x["requirement"].alias("requirement"), x["citation"].alias("citation"))).alias("findings"))

    def fact(k: Column) -> Column:
        v = F.col("read")[k]
        return F.struct(k.alias("parameter"), v["value"].alias("value"), v["source"].alias("source"), described(v).alias("where"), v["raw"].alias("raw"), v["page"].alias("page"))

    notice = F.when(F.col("unconfirmed") > 0, F.concat(F.col("unconfirmed").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" rules await a person's check against the regulation; they were not evaluated and lower the coverage.")))
    return have.select(
        "subject",
        R.verdict().alias("verdict"),
        R.coverage_text().alias("coverage"),
        F.struct("n_pass", "n_fail", F.col("unreadable").alias("n_unknown"), "evaluated", "not_applicable", "unreadable", "total").alias("counts"),
        "deficiencies",
        "unresolved",
        "satisfied",
        F.col("not_applicable_findings").alias("not_applicable"),
        F.transform(F.array_distinct(F.transform("unresolved", lambda x: x["blocked_by"])), group).alias("unresolved_groups"),
        missing.alias("missing_information"),
        F.transform(F.array_sort(F.map_keys("read")), fact).alias("facts_read"),
        F.array_compact(F.array(notice)).alias("notices"),
        *kept,
    )


def letter(title: Column | None = None) -> Column:
    """The draft of a letter from a report's columns: what to correct, then what to provide; empty unless deficiencies were found."""
    lines = lambda *parts: F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    said = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"   {label}: "), c))
    with_units = lambda c, x: F.when(c.isNotNull(), F.concat_ws(" ", c, F.when(x["units"] != "", x["units"])))

    def deficiency(x: Column, i: Column) -> Column:
        return lines(F.concat((i + 1).cast("string"), F.lit(". "), x["requirement"]), said("Found", with_units(x["observed"], x)), F.when(x["observed"].isNotNull(), said("Required", with_units(x["threshold"], x))), said("Citation", x["citation"]), said("Regulation", x["quote"]), said("To correct", x["remedy"]))

    def group(g: Column) -> Column:
        return lines(F.concat(F.lit("- "), g["described"]), said("Normally found", g["location"]), F.array_join(F.transform(g["findings"], lambda f: F.concat(F.lit("   Needed by: "), f["requirement"], F.lit(" ("), f["citation"], F.lit(")"))), "\n"))

    more = F.when(F.size("unresolved_groups") > 0, lines("", "PLEASE PROVIDE OR CLARIFY", F.array_join(F.transform("unresolved_groups", group), "\n")))
    body = lines("DRAFT, to be read and edited by a reviewer", *([F.concat(F.lit("Re: "), title)] if title is not None else []), F.concat(F.lit("Scope: "), F.col("coverage"), F.lit(".")), "", "PLEASE CORRECT", F.array_join(F.transform("deficiencies", deficiency), "\n"), more)
    return F.when(F.col("verdict") == "DEFICIENCIES FOUND", body).otherwise("")


def chat(reports: DataFrame) -> DataFrame:
    """What a chat may know of a report: no remedies, caveats or personal facts; e-mail addresses and telephone numbers are replaced, raw readings left out.

    Missing information stays only where a rule waits for it that isn't out of scope.
    """
    kept = ("rule_id", "outcome", "requirement", "observed", "threshold", "units", "severity", "citation", "section", "page", "verified", "applicability", "excluded_by")

    def compact(x: Column) -> Column:
        quote = F.trim(T.strip_notes(x["quote"]))
        return F.struct(
            *[x[k].alias(k) for k in kept],
            F.when(quote != "", quote).alias("quote"),
            F.transform(x["cross_references"], lambda r: F.struct(r["label"].alias("label"), r["title"].alias("title"))).alias("cross_references"),
            x["definitions"].alias("definitions"),
            F.transform(x["exceptions"], lambda e: F.struct(e["section"].alias("section"), F.left(e["text"], F.lit(200)).alias("text"))).alias("exceptions"),
        )

    excused = F.transform("not_applicable", lambda x: x["rule_id"])
    personal = lambda f: F.lower(f["parameter"]).isin(T.PERSONAL_KEYS)
    safe = F.transform(F.filter("facts_read", lambda f: ~personal(f)), lambda f: F.struct(f["parameter"].alias("parameter"), T.redact(f["value"]).alias("value"), f["source"].alias("source"), T.redact(f["where"]).alias("where"), f["page"].alias("page")))
    parts = {p: F.transform(p, compact) for p in ("deficiencies", "unresolved", "satisfied", "not_applicable")}
    return reports.select("subject", "verdict", "coverage", "counts", *[c.alias(p) for p, c in parts.items()], F.filter("missing_information", lambda m: F.size(F.array_except(m["blocks_rules"], excused)) > 0).alias("missing_information"), safe.alias("facts_read"), "notices")


def review(fields: DataFrame, pages: DataFrame, specs: list[E.Spec], rules: list[R.Rule], names: dict[str, tuple[str, str]] | None = None, contexts: DataFrame | None = None) -> DataFrame:
    """Facts of documents, then their reports, with ``discarded_readings``; a document without any fact has a report too."""
    own = E.documents(fields, pages, specs).withColumnRenamed("doc_id", "subject")
    read = F.map_from_entries(F.transform("facts", lambda x: F.struct(x["name"].alias("name"), F.struct(*[x[n].cast(t).alias(n) for n, t in (f.split(": ") for f in READ[7:-1].split(", "))]).alias("read"))))
    own = own.select("subject", read.alias("read"), F.array_sort("rejected").alias("discarded_readings"))
    own = own.withColumn("facts", F.transform_values("read", lambda _, v: v["value"]))
    return compose(own, rules, names, contexts, ["discarded_readings"])
