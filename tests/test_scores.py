"""Scores of sheets against a plain loop in the order of the truth."""

import math
import random

from factloom.operators import drawing

X = random.Random(6)


def plain(found, truth):
    out = {}
    for sheet in {r[0] for r in found + truth}:
        left, pairs, missed = sorted((r for r in found if r[0] == sheet), key=lambda r: r[2]), [], 0
        for t in sorted((r for r in truth if r[0] == sheet), key=lambda r: r[2]):
            own = [d for d in left if d[1] == t[1]]
            if not own:
                missed += 1
                continue
            best = min(own, key=lambda d: math.dist(d[3:], t[3:]))
            left.remove(best)
            pairs.append((best, t, math.dist(best[3:], t[3:])))
        swapped = 0
        for i, (a, ta, ea) in enumerate(pairs):
            for b, tb, eb in pairs[i + 1 :]:
                there, back = math.dist(a[3:], tb[3:]), math.dist(b[3:], ta[3:])
                swapped += a[1] != b[1] and there < ea and back < eb and there + back < ea + eb - 2
        e = [p[2] for p in pairs]
        out[sheet] = (len(pairs), missed, len(left), swapped, sum(e) / len(e) if e else None, max(e) if e else None)
    return out


def test_scores(spark):
    symbol = lambda sheet, k: (sheet, X.choice("TWD"), k, float(X.randint(0, 90)), float(X.randint(0, 90)))
    found = [symbol(s, k) for s in range(12) for k in range(X.randint(0, 14))] + [symbol(50, 0)] + [(60, "T", 1, 0.0, 0.0), (60, "D", 2, 30.0, 0.0)]
    truth = [symbol(s, k) for s in range(12) for k in range(X.randint(0, 14))] + [symbol(51, 0)] + [(60, "T", 1, 29.0, 1.0), (60, "D", 2, 1.0, 1.0)]
    got = drawing.scores(spark.createDataFrame(found, "sheet long, label string, id long, x double, y double"), spark.createDataFrame(truth, "sheet long, label string, tid long, tx double, ty double")).collect()
    want = plain(found, truth)
    assert want[60][3] == 1 and {r.sheet for r in got} == set(want)
    for r in got:
        m = want[r.sheet]
        assert (r.matched, r.missed, r.spurious, r.swapped) == m[:4]
        assert (r.mean_error is None) == (m[4] is None) and (m[4] is None or (abs(r.mean_error - m[4]) <= 0.0501 and abs(r.max_error - m[5]) <= 0.0501))


def test_groups_without_frames(spark):
    """A group costs no Python, and each side is read once."""
    found = spark.createDataFrame([(1, "T", 7, 0.0, 0.0), (1, "T", 8, 0.0, 0.0), (1, "T", 9, None, 1.0)], "sheet long, label string, id long, x double, y double")
    truth = spark.createDataFrame([(1, "T", 1, 3.0, 4.0), (1, "T", 2, 0.0, 1.0), (1, "T", 3, 0.0, 0.0), (1, "T", 4, 0.0, 0.0)], "sheet long, label string, tid long, tx double, ty double")
    out = drawing.match_in_order(found, truth)
    assert [(r.tid, r.id, r.error) for r in out.orderBy("tid").collect()] == [(1, 7, 5.0), (2, 8, 1.0), (3, 9, None)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and plan.count("hashpartitioning") == 1
