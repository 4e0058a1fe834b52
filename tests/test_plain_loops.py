"""Operators that SQL can't tell, against plain loops."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from factloom.functions import geo as G
from factloom.functions import text as T
from factloom.operators import drawing
from factloom.operators import facts as X
from factloom.operators import rules as R

RANDOM = random.Random(8)


def test_nfkc(spark):
    texts = ["ﬁne ½ Ａ", "e\u0301", "", None, "Å ① ㎞", "plain", "한글", "x" * 5000 + "ﬃ"]
    got = {r.k: r.n for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.nfkc(F.col("t")).alias("n")).collect()}
    assert got == {k: t and unicodedata.normalize("NFKC", t) if t is not None else None for k, t in enumerate(texts)}


def test_greedy_match(spark):
    side = lambda: [(s, RANDOM.choice("ab"), float(RANDOM.randint(0, 30)), float(RANDOM.randint(0, 30)), k) for s in range(4) for k in range(12)]
    found, truth = side(), side()
    want = set()
    for s in range(4):
        for label in "ab":
            pairs = sorted((((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5, a[4], b[4]) for a in found for b in truth if a[:2] == b[:2] == (s, label))
            used_a, used_b = set(), set()
            for d, i, j in pairs:
                if d <= 9 and i not in used_a and j not in used_b:
                    used_a.add(i)
                    used_b.add(j)
                    want.add((s, label, i, j, round(d, 6)))
    schema = "sheet long, label string, x double, y double, id long"
    assert {tuple(r) for r in drawing.greedy_match(spark.createDataFrame(found, schema), spark.createDataFrame(truth, schema), 9.0).collect()} == want and want


def test_wrapped_lines_keep_their_words(spark):
    texts = [" ".join("w" * RANDOM.randint(1, 30) for _ in range(RANDOM.randint(1, 40))) for _ in range(20)] + ["", "one"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.wrap_lines(F.col("t"), 40).alias("lines")).collect()
    for r in got:
        own = texts[r.k].split()
        assert " ".join(r.lines).split() == own and all(len(x) <= 40 for x in r.lines)
        for a, b in zip(r.lines, r.lines[1:]):  # no line could have taken the next one's first word
            assert len(a) + 1 + len(b.split(" ")[0]) > 40


def test_no_rules_verify_nothing(spark):
    subjects = R.fact_map(spark.createDataFrame([("a", "x", "1"), ("b", "x", None)], "subject string, name string, value string"))
    got = {r.subject: (r.verdict, r.total, r.coverage) for r in R.report(R.compile_rules(subjects, []), subjects=subjects).collect()}
    assert got == dict.fromkeys("ab", ("CANNOT VERIFY", 0, "0 of 0 checked"))


def test_section_passages(spark):
    """As a loop over lines would collect them: sections go on over pages, sentences over lines, headers and numbers of sections don't count."""
    pages = [
        ["Rules of the State", "Anything of 5 feet is front matter.", "1.2 Wells and", "tanks shall be at least 100 feet apart; See Section 2.1 of it.", "", "Keep 1,250 gal-", "lons. No number here, of feet."],
        ["Rules of the State", "Still the same section: 12 inches must stay. Then 3.4.5 ends.", "2.1 \"Second\" has 7 days", "3 Third part is 20 % steep"],
    ]
    rows = [(1, p, k, x) for p, lines in enumerate(pages, 1) for k, x in enumerate(lines)] + [(2, 1, 0, "Another text with 9 feet.")]
    got = X.section_passages(spark.createDataFrame(rows, "doc_id long, page int, line int, txt string"), ["Rules of the State"]).collect()
    want = {
        (1, 1, "front matter", "Anything of 5 feet is front matter.", ("5",)),
        (1, 1, "1.2", "1.2 Wells and tanks shall be at least 100 feet apart;", ("100",)),
        (1, 1, "1.2", "Keep 1,250 gallons.", ("1,250",)),
        (1, 2, "1.2", "Still the same section: 12 inches must stay.", ("12",)),
        (2, 1, "front matter", "Another text with 9 feet.", ("9",)),
    }
    said = {(r.doc_id, r.page, r.section, r.quote, tuple(n for n in r.numbers if not re.match(r.section + "$", n))) for r in got}
    assert want <= said, said
    assert all(r.units for r in got) and {r.quote: r.obligation for r in got}["1.2 Wells and tanks shall be at least 100 feet apart;"]


def test_polygon_with_a_hole(spark):
    outer, hole = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
    want = {(5, 5): 1.0, (2, 2): 0.0, (12, 5): 2.0, (-3, -4): 5.0, (5, 3.5): 0.0, (5, 4.25): 0.25}
    rows = [(float(x), float(y), [[(float(a), float(b)) for a, b in r] for r in (outer, hole)]) for x, y in want]
    got = spark.createDataFrame(rows, "px double, py double, rings array<array<struct<x: double, y: double>>>").select("px", "py", G.to_polygon(F.col("px"), F.col("py"), F.col("rings")).alias("d")).collect()
    assert {(r.px, r.py): r.d for r in got} == want
    none = spark.createDataFrame([(1.0, []), (1.0, [[(0.0, 0.0)]])], "p double, rings array<array<struct<x: double, y: double>>>")
    assert [r.d for r in none.select(G.to_polygon(F.col("p"), F.col("p"), F.col("rings")).alias("d")).collect()] == [None, None]
