"""Exact search by an inverted file against plain loops."""

import math
import random

import pytest

from factloom.operators import nearest

SCHEMA = "id long, v array<double>, kind string"


def vectors(seed: int, n: int = 400, size: int = 6) -> list[tuple]:
    """Narrow clusters, copies in plenty, and rows without a direction."""
    x = random.Random(seed)
    centers = [[x.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    out = []
    for i in range(n):
        c = x.choice(centers)
        out.append((i, list(c) if i % 3 == 0 else [a + x.gauss(0, 0.05) for a in c], x.choice("ab")))
    return out + [(n, [0.0] * size, "a"), (n + 1, None, "a"), (n + 2, [], "b"), (n + 3, [1.0, None] + [0.0] * (size - 2), "b"), (n + 4, [1.0, 2.0], "a"), (n + 5, [2.0, 4.0], "a"), (n + 6, [1.0] * size, None), (n + 7, [-1.0, -2.0], "a")]


def plain(queries, index, k, own=False):
    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return 0.0
        m = math.sqrt(sum(p * p for p in a)) * math.sqrt(sum(p * p for p in b))
        return sum(p * q for p, q in zip(a, b, strict=True)) / m if m else 0.0

    out = []
    for q, a, b in queries:
        rows = [(-round(cosine(a, v), 9), i) for i, v, c in index if not own or (b is not None and b == c)]
        out += [(q, i, r, -s) for r, (s, i) in enumerate(sorted(rows)[:k], 1) if s < 0]
    return sorted(out)


def got(df):
    return sorted((r.q, r.id, r["rank"], round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize(("k", "own", "block"), [(3, False, 4096), (7, True, 16), (600, False, 50)])
def test_like_every_pair(spark, monkeypatch, k, own, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    rows = vectors(k)
    index, queries = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[::9] + rows[-8:], SCHEMA).dropDuplicates(["id"])
    asked = {r[0]: r for r in rows[::9] + rows[-8:]}.values()
    found = nearest.top_cosine(queries, index.repartition(5), "id", "v", k, "kind" if own else None)
    want = plain(asked, rows, k, own)
    assert {0, 9} <= {r[0] for r in want}
    assert got(found) == want


def test_a_null_backend_is_no_backend(spark):
    rows = [(1, [1.0, 0.0], None), (2, [1.0, 0.0], "a"), (3, [1.0, 1.0], "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.q, r.id) for r in nearest.top_cosine(df, df, "id", "v", 5, "kind").orderBy("q", "rank").collect()] == [(2, 2), (2, 3), (3, 3), (3, 2)]


def test_report_tells_a_mismatch(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 1.0], "hash")], SCHEMA)
    asked = spark.createDataFrame([(7, [1.0, 0.0], "a"), (8, [1.0, 0.0], "other"), (9, [1.0, 0.0], "hash"), (10, None, "a")], SCHEMA)
    rows = {r.q: r for r in nearest.search_report(asked, index, "id", "v", 3, "kind", fallback="hash").collect()}
    assert [(q, rows[q].degraded, [p.id for p in rows[q].precedents], rows[q].index_size) for q in sorted(rows)] == [(7, False, [1], 2), (8, True, [], 2), (9, True, [2], 2), (10, False, [], 2)]
    none = nearest.search_report(asked, index.limit(0), "id", "v", 3, "kind").collect()
    assert len(none) == 4 and not any(r.precedents or r.degraded for r in none)
