"""Facts of documents: ticked boxes, then form fields, then text, then what follows from them.

A stage is only asked where the ones before it found nothing and refused nothing; a blank answer is no refusal.
Everything is one pass over the fields and one over the pages, one shuffle by document, and aggregations by document and name, then by document.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import numbers as N
from factloom.functions import text as T


@dataclass
class Spec:
    """What is known of a fact: ``kind`` is number, category or presence; ``checkbox`` has the options of each value; ``patterns`` are (pattern, fixed value or None)."""

    name: str
    kind: str = "number"
    checkbox: dict[str, list[str]] = field(default_factory=dict)
    labels: list[str] = field(default_factory=list)
    patterns: list[tuple[str, str | None]] = field(default_factory=list)
    allowed: list[str] | None = None
    range: tuple[float, float] | None = None
    units: str = ""
    distance: bool = False


#: What a candidate carries besides document and name.
_CANDIDATE = "name string, stage int, score int, page int, pos long, value string, num double, problem string, raw string, label string, confidence double"


def _candidate(name: str, stage: int, score: Column, page: Column, pos: Column, value: Column, num: Column, problem: Column, raw: Column, label: Column, confidence: Column) -> Column:
    columns = (F.lit(name), F.lit(stage), score, page, pos, value, num, problem, raw, label, confidence)
    return F.struct(*[c.cast(t).alias(n) for c, (n, t) in zip(columns, (x.split(" ") for x in _CANDIDATE.split(", ")), strict=True)])


def _outside(num: Column, spec: Spec) -> Column:
    return F.when((num < spec.range[0]) | (num > spec.range[1]), "outside the plausible range") if spec.range else F.lit(None).cast("string")


def _none() -> Column:
    return F.lit(None)


def _boxes(spec: Spec) -> list[Column]:
    """A candidate for each value with an option that the words of a ticked field's label begin with."""
    own = F.col("words")
    begins = lambda option: F.slice(own, 1, len(option.split())) == T.literal_words(option.split())
    out = []
    for value, options in spec.checkbox.items():
        hit = F.col("value").contains("[X]") & F.exists(F.array(*[begins(o) for o in options]), lambda x: x)
        bad = F.lit("not one of the allowed values" if spec.allowed and value not in spec.allowed else None)
        out.append(F.when(hit, _candidate(spec.name, 1, F.lit(0), F.col("page"), F.col("pos"), F.lit(value), _none(), bad, F.concat(F.trim("key"), F.lit(" [X]")), F.rtrim(F.trim("key"), F.lit(":")), F.col("confidence"))))
    return out


def _form(spec: Spec) -> Column:
    """The candidate of a field whose label names the fact."""
    value = F.trim("value")
    blank = T.is_blank(value)

    def of(score: Column, got: Column, num: Column, problem: Column) -> Column:
        problem = F.when(blank, "blank").otherwise(problem)
        return _candidate(spec.name, 2, -score, F.col("page"), F.col("pos"), got, num, problem, value, F.rtrim(F.trim("key"), F.lit(":")), F.col("confidence"))

    def read(score: Column) -> Column:
        if spec.kind == "number":
            return T.once(T.measurement(value, spec.units), lambda m: of(score, m["value"].cast("string"), m["value"], F.coalesce(m["refused"], _outside(m["value"], spec))))
        if spec.kind == "presence":
            return of(score, F.lit("present"), _none(), _none().cast("string"))
        problem = F.when(~F.lower(value).isin(spec.allowed), "not one of the allowed values") if spec.allowed else _none().cast("string")
        return of(score, (F.lower(value) if spec.allowed else value), _none(), problem)

    return T.once(T.label_score(F.col("key"), spec.labels, spec.distance, F.col("words")), lambda score: F.when(score > 0, read(score)))


def _numbered(of: Callable[[Column, Column, Column], Column], spec: Spec) -> Callable[[Column], Column]:
    return lambda num: F.when(num.isNotNull(), of(num.cast("string"), num, _outside(num, spec)))


def _text(spec: Spec) -> list[Column]:
    """A candidate for each pattern that a page's text has."""
    flat, out = F.col("flat"), []
    for k, (pattern, fixed) in enumerate(spec.patterns):
        insensitive = "(?i)" + pattern
        raw = F.regexp_extract(flat, insensitive, 0)
        of = lambda value, num, problem, k=k, raw=raw: _candidate(spec.name, 3, F.lit(0), F.col("page"), F.lit(k), value, num, problem, F.left(raw, F.lit(120)), _none(), _none())
        if spec.kind == "number":
            if not re.compile(pattern).groups:
                continue
            found = T.once(N.first_number(F.regexp_extract(flat, insensitive, 1)), _numbered(of, spec))
        else:
            value = F.lit(fixed or "present") if spec.kind == "presence" or fixed else F.lower(F.trim(raw))
            found = of(value, _none(), _none().cast("string"))
        out.append(F.when(flat.rlike(insensitive), found))
    return out


def _found(fields: DataFrame, pages: DataFrame, specs: list[Spec]) -> DataFrame:
    """``doc_id, c``, by document: the candidates; a row without any has one of null, so that its document is known. Rows are shuffled as they come, which is less than their candidates."""
    of_fields = [c for s in specs for c in [*_boxes(s), *([_form(s)] if s.labels else [])]]
    of_pages = [c for s in specs for c in _text(s)]
    none = f"array<struct<{_CANDIDATE.replace(' ', ': ')}>>".replace(",: ", ", ")
    held = lambda found: F.array_compact(F.array(*found)) if found else F.array().cast(none)
    own = fields.select("doc_id", "pos", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("value", F.lit("")).alias("value"), "confidence", "page")
    rows = own.unionByName(pages.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text")), allowMissingColumns=True).repartition("doc_id")
    rows = rows.withColumns({"words": T.tokens(F.col("key")), "flat": T.squeeze(F.col("text"))})
    # an inner explode would repeat the whole expression in a filter on its size
    return rows.select("doc_id", F.explode_outer(F.when(F.col("key").isNotNull(), held(of_fields)).otherwise(held(of_pages))).alias("c"))


def candidates(fields: DataFrame, pages: DataFrame, specs: list[Spec]) -> DataFrame:
    """``doc_id`` and a candidate's columns, from ``fields(doc_id, pos, key, value, confidence, page)`` and ``pages(doc_id, page, text)``."""
    return _found(fields, pages, specs).where("c is not null").select("doc_id", "c.*")


def decide(found: DataFrame) -> DataFrame:
    """Of each document and name: the accepted candidate ``c`` (null: none), ``last``, the last stage that was asked, and what was ``rejected`` until then."""
    at = F.struct("score", "page", "pos")
    payload = F.struct("stage", "score", "page", "pos", "value", "num", "raw", "label", "confidence")
    best = lambda k: F.min(F.when((F.col("stage") == k) & F.col("problem").isNull(), F.struct(at.alias("at"), payload.alias("c"))))["c"]
    refused = lambda k: F.coalesce(F.bool_or((F.col("stage") == k) & F.col("problem").isNotNull() & (F.col("problem") != "blank")), F.lit(False))
    boxes = lambda c: F.when(F.col("stage") == 1, F.col(c))
    bad = F.collect_list(F.when(F.col("problem").isNotNull(), F.struct("stage", at.alias("at"), F.col("problem").alias("reason"), "raw")))
    per = found.groupBy("doc_id", "name").agg(
        F.size(F.collect_set(boxes("value"))).alias("ticked"),
        *[best(k).alias(f"c{k}") for k in (1, 2, 3)],
        *[refused(k).alias(f"r{k}") for k in (1, 2)],
        bad.alias("bad"),
        F.collect_set(boxes("label")).alias("labels"),
        F.min(boxes("page")).alias("first"),
    )
    stop1, stop2 = (F.col("ticked") > 0), (F.col("c2").isNotNull() | F.col("r2"))
    last = F.when(stop1, 1).when(stop2, 2).otherwise(3)
    chosen = F.when(F.col("ticked") == 1, F.col("c1")).when(stop1, F.lit(None)).when(stop2, F.col("c2")).otherwise(F.col("c3"))
    per = per.select("doc_id", "name", "ticked", last.alias("last"), chosen.alias("c"), "bad", "labels", "first")
    own = F.struct(F.col("c.score").alias("score"), F.col("c.page").alias("page"), F.col("c.pos").alias("pos"))
    asked = lambda x: ((x["stage"] == F.col("last")) | ((x["stage"] < F.col("last")) & (x["stage"] > 1))) & ((x["stage"] > 1) | (F.col("ticked") == 1))
    before = lambda x: F.col("c").isNull() | (x["at"] < own) | (x["stage"] < F.col("last"))
    single = F.transform(F.filter("bad", lambda x: asked(x) & before(x)), lambda x: F.struct(x["reason"].alias("reason"), x["at"]["page"].alias("page"), x["raw"].alias("raw")))
    several = F.struct(F.lit("several boxes are ticked").alias("reason"), F.col("first").alias("page"), F.array_join(F.array_sort("labels"), ", ").alias("raw"))
    return per.select("doc_id", "name", "ticked", "last", "c", F.when(F.col("ticked") > 1, F.concat(single, F.array(several))).otherwise(single).alias("rejected"))


SOURCES = {1: "checkbox", 2: "form_field", 3: "text_pattern"}
FACT = "name string, value string, num double, source string, raw string, page int, confidence double, label string"


def documents(fields: DataFrame, pages: DataFrame, specs: list[Spec], flow: str = "design_flow", bedrooms: str = "bedrooms", scale: str = "system_scale", per_bedroom: str = "design_flow_per_bedroom") -> DataFrame:
    """``doc_id, facts, rejected, missing``, a row for each document: what ``extract`` gives, as arrays. A row holds the refused readings of a document.

    Scale (below 2500 is small) and flow for each bedroom (one digit) follow from flow and bedrooms where the page doesn't state them.
    """
    decided = decide(_found(fields, pages, specs).select("doc_id", "c.*"))
    per = decided.groupBy("doc_id").agg(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "c", "rejected"))).alias("n"))
    source = F.create_map(*[x for k, v in SOURCES.items() for x in (F.lit(k), F.lit(v))])
    fact = lambda *values: F.struct(*[v.cast(t).alias(n) for v, (n, t) in zip(values, (x.split(" ") for x in FACT.split(", ")), strict=True)])
    read = F.transform(F.filter("n", lambda x: x["c"].isNotNull()), lambda x: fact(x["name"], x["c"]["value"], x["c"]["num"], source[x["c"]["stage"]], x["c"]["raw"], x["c"]["page"], x["c"]["confidence"], x["c"]["label"]))
    rejected = F.flatten(F.transform("n", lambda x: F.transform(x["rejected"], lambda r: F.struct(x["name"].alias("name"), r["reason"].alias("reason"), r["page"].alias("page"), r["raw"].alias("raw")))))
    own = per.select("doc_id", read.alias("read"), rejected.alias("rejected"))
    of = lambda n: F.array_max(F.transform(F.filter("read", lambda x: x["name"] == n), lambda x: F.coalesce(x["num"], x["value"].try_cast("double"))))
    has = lambda n: F.exists("read", lambda x: x["name"] == n)
    own = own.withColumns({"f": of(flow), "b": of(bedrooms), "s": has(scale), "p": has(per_bedroom)})
    derived = lambda name, value, num, raw: fact(F.lit(name), value, num, F.lit("derived"), raw, _none(), _none(), _none())
    each = F.round(F.col("f") / F.nullif(F.col("b"), F.lit(0.0)), 1)
    more = F.array_compact(F.array(
        F.when(F.col("f").isNotNull() & ~F.col("s"), derived(scale, F.when(F.col("f") < 2500, "small").otherwise("large"), _none(), F.concat(F.lit(f"{flow}="), F.col("f").cast("string")))),
        F.when(F.col("f").isNotNull() & (F.col("b") != 0) & ~F.col("p"), derived(per_bedroom, each.cast("string"), each, F.concat(F.lit(f"{flow}="), F.col("f").cast("string"), F.lit(f" / {bedrooms}="), F.col("b").cast("string")))),
    ))
    own = own.select("doc_id", F.concat("read", more).alias("facts"), "rejected")
    names = sorted({s.name for s in specs} | {scale, per_bedroom})
    return own.withColumn("missing", F.array_except(T.literal_words(names), F.transform("facts", lambda x: x["name"])))


def extract(fields: DataFrame, pages: DataFrame, specs: list[Spec], flow: str = "design_flow", bedrooms: str = "bedrooms", scale: str = "system_scale", per_bedroom: str = "design_flow_per_bedroom") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts with provenance, refusals, and what is missing.

    ``facts(doc_id, name, value, num, source, raw, page, confidence, label)``, ``rejected(doc_id, name, reason, page, raw)``, ``missing(doc_id, name)``.
    Whoever takes more than one of them reads ``documents`` once instead.
    """
    own = documents(fields, pages, specs, flow, bedrooms, scale, per_bedroom)
    rows = lambda c: own.select("doc_id", F.explode_outer(c).alias("x")).where("x is not null")
    return rows("facts").select("doc_id", "x.*"), rows("rejected").select("doc_id", "x.*"), rows("missing").select("doc_id", F.col("x").alias("name"))
