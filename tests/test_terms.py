"""Terms in texts against ``in``."""

import random

import pytest

from factloom.operators import terms as M

X = random.Random(3)
TERMS = ["a", "ab", "aba", "cab", "bcab", "ééa", " b", "zzz", "", None, "abc abc", "中文"]


@pytest.mark.parametrize("most", [10**6, 12, 8])
def test_every_term_in_every_text(spark, monkeypatch, most):
    texts = [(k, "".join(X.choice("abcé 中文") for _ in range(X.randint(0, 40)))) for k in range(300)] + [(300, None), (301, ""), (7, "abc abc"), (7, "abc abc"), (None, "cab")]
    t, w = spark.createDataFrame(texts, "k long, t string").repartition(3), spark.createDataFrame([(x,) for x in TERMS + ["aba"]], "w string")
    got = [tuple(r) for r in M.term_hits(t, "k", "t", w, "w", most).collect()]
    want = {(k, x) for k, s in texts if s is not None for x in TERMS if x and x in s}
    assert set(got) == want
    assert len(got) == len(set(got))


def test_no_terms_or_texts(spark):
    t, w = spark.createDataFrame([(1, "a")], "k long, t string"), spark.createDataFrame([], "w string")
    assert M.term_hits(t, "k", "t", w, "w").count() == 0
    assert M.term_hits(t.limit(0), "k", "t", spark.createDataFrame([("a",)], "w string"), "w").count() == 0


def test_too_many_short_terms(spark):
    w = spark.createDataFrame([(a + b,) for a in "abcdefgh" for b in "abcdefgh"], "w string")
    with pytest.raises(ValueError):
        M.term_hits(spark.createDataFrame([(1, "a")], "k long, t string"), "k", "t", w, "w", 20)
