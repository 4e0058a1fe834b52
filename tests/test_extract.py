"""Stages of the extraction against a plain loop over each document."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import extract as X

SPECS = [
    X.Spec("design_flow", labels=["design flow"], patterns=[(r"flow of (\d[\d,]*)", None)], range=(50, 20000), units="gpd"),
    X.Spec("bedrooms", labels=["bedrooms", "number of bedrooms"], patterns=[(r"(\d+)\s+bedroom", None), (r"bedrooms", None)], range=(1, 12)),
    X.Spec("system_type", "category", checkbox={"bed": ["bed", "bed system"], "drip": ["drip"], "odd": ["odd"]}, patterns=[(r"drip", "drip"), (r"\bbed\b", None)], allowed=["bed", "drip"]),
    X.Spec("well_shown", "presence", labels=["existing wells"], patterns=[(r"well", None)]),
    X.Spec("use", "category", labels=["use type"], allowed=["home", "shop"]),
    X.Spec("setback", labels=["distance to well"], distance=True, range=(0, 500), units="feet"),
]
R = random.Random(4)
KEYS = ["Design Flow:", "Avg design flow", "# of Bedrooms", "Bedrooms", "Bed", "Drip (CF)", "ODD", "Existing wells", "Use type", "Distance to well", "PROP WELL", "", None, "Bedroom count of the whole house and more words here"]
VALUES = ["[X]"] * 6 + ["300", "9 Employees", "", "N/A", "99", "30 feet", "12 gpm", "Home", "barn", None, "1,200", "2"]
TEXTS = ["", None, "A flow of 1,500 and 3 bedroom house", "flow of 7", "drip field by the well", "the bed", "bedrooms", "flow of many", "44 bedroom"]


def documents():
    fields, pages = [], []
    for d in range(150):
        fields += [(d, k, R.choice(KEYS), R.choice(VALUES), round(R.random(), 3), R.randint(1, 3)) for k in range(R.randint(0, 9))]
        pages += [(d, p, R.choice(TEXTS)) for p in range(1, R.randint(1, 4))]
    return fields, pages


def by_loop(d, fields, pages, score, measured):
    """Facts and refusals of a document."""
    facts, rejected = {}, []
    number = lambda s: (m := re.search(r"\d{1,4}(?:,\d{3})?(?:\.\d+)?", s)) and float(m[0].replace(",", ""))
    outside = lambda s, x: s.range and not s.range[0] <= x <= s.range[1]
    own = [(k, key or "", value or "", conf, page) for i, k, key, value, conf, page in fields if i == d]
    for s in SPECS:
        begun = len(rejected)
        ticked = {}
        for k, key, value, _, page in own:
            words = re.sub("[^a-z0-9 ]", " ", key.lower()).split()
            for v, options in s.checkbox.items():
                if "[X]" in value and any(words[: len(o.split())] == o.split() for o in options):
                    ticked.setdefault(v, []).append((page, k))
        if len(ticked) > 1:
            rejected.append((s.name, "several boxes are ticked", min(p for x in ticked.values() for p, _ in x)))
        elif ticked:
            (v, at), *_ = ticked.items()
            if s.allowed and v not in s.allowed:
                rejected += [(s.name, "not one of the allowed values", p) for p, _ in at]
            else:
                facts[s.name] = (v, "checkbox", min(at)[0])
        refused = lambda: any(r != "blank" for _, r, _ in rejected[begun:])  # noqa: B023, E731
        if s.name not in facts and not refused():
            for _, page, k, value in sorted((-score[s.name, key], page, k, value.strip()) for k, key, value, _, page in own if s.labels and score[s.name, key]):
                num, problem = measured[s.units, value]
                if value.lower() in BLANK:
                    rejected.append((s.name, "blank", page))
                elif s.kind == "number" and (problem or outside(s, num)):
                    rejected.append((s.name, problem or "outside the plausible range", page))
                elif s.kind == "category" and s.allowed and value.lower() not in s.allowed:
                    rejected.append((s.name, "not one of the allowed values", page))
                else:
                    facts[s.name] = (num if s.kind == "number" else "present" if s.kind == "presence" else value.lower(), "form_field", page)
                    break
        if s.name not in facts and not refused():
            hits = [(page, re.search(p, " ".join((t or "").split()), re.I), fixed) for i, page, t in sorted(pages, key=lambda x: x[:2]) if i == d for p, fixed in s.patterns]
            for page, m, fixed in hits:
                if not m or s.kind == "number" and (not m.groups() or number(m[1]) is None):
                    continue
                if s.kind == "number" and outside(s, number(m[1])):
                    rejected.append((s.name, "outside the plausible range", page))
                    continue
                facts[s.name] = (number(m[1]) if s.kind == "number" else fixed or ("present" if s.kind == "presence" else m[0].strip().lower()), "text_pattern", page)
                break
    if "design_flow" in facts:
        flow = facts["design_flow"][0]
        facts["system_scale"] = ("small" if flow < 2500 else "large", "derived", None)
        if facts.get("bedrooms", (0,))[0]:
            facts["design_flow_per_bedroom"] = (round(flow / facts["bedrooms"][0], 1), "derived", None)
    return facts, rejected


BLANK = set()


def test_stages(spark):
    fields, pages = documents()
    names = sorted({k or "" for k in KEYS})
    scored = spark.createDataFrame([(k,) for k in names], "key string").select("key", *[T.label_score(F.col("key"), s.labels, s.distance).alias(s.name) for s in SPECS]).collect()
    score = {(s.name, r["key"]): r[s.name] for r in scored for s in SPECS}
    values = spark.createDataFrame([((v or "").strip(),) for v in VALUES], "v string")
    measured = {(u, r.v): (r.m.value, r.m.refused) for u in {s.units for s in SPECS} for r in values.select("v", T.measurement(F.col("v"), u).alias("m")).collect()}
    BLANK.update(r.v.lower() for r in values.where(T.is_blank(F.col("v"))).collect())
    facts, rejected, missing = X.extract(spark.createDataFrame(fields, "doc_id long, pos long, key string, value string, confidence double, page int"), spark.createDataFrame(pages, "doc_id long, page int, text string"), SPECS)
    got = {(r.doc_id, r.name): (r.num if r.num is not None else r.value, r.source, r.page) for r in facts.collect()}
    docs = {x[0] for x in fields} | {x[0] for x in pages}
    want, refusals = {}, []
    for d in docs:
        f, r = by_loop(d, fields, pages, score, measured)
        want |= {(d, n): v for n, v in f.items()}
        refusals += [(d, *x) for x in r]
    assert {k: (v[0] if isinstance(v[0], str) else pytest.approx(v[0]), *v[1:]) for k, v in want.items()} == got
    assert sorted((r.doc_id, r.name, r.reason, r.page) for r in rejected.collect()) == sorted(refusals)
    every = {s.name for s in SPECS} | {"system_scale", "design_flow_per_bedroom"}
    assert {(r.doc_id, r.name) for r in missing.collect()} == {(d, n) for d in docs for n in every} - set(want)
    assert {v[1] for v in want.values()} == {"checkbox", "form_field", "text_pattern", "derived"} and {r[2] for r in refusals} >= {"blank", "several boxes are ticked", "outside the plausible range", "not one of the allowed values"}
