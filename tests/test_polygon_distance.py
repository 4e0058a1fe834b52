"""The distance to a polygon computes its segments, and the nearest point of each, once."""

import math
import random

from factloom.functions import geo as G
from pyspark.sql import functions as F

SHAPE = "px double, py double, rings array<array<struct<x: double, y: double>>>"


def test_each_step_is_written_once(spark):
    """Lambdas are interpreted, so what is written twice is computed twice."""
    frame = spark.createDataFrame([(0.0, 0.0, [])], SHAPE)
    plan = frame.select(G.to_polygon(F.col("px"), F.col("py"), F.col("rings")).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("flatten(") == 1 and plan.count("least(") == 1


def formula(px, py, rings):
    """The distance as it was written before, in plain Python."""
    best, odd = None, False
    for ring in rings or []:
        for (ax, ay), (bx, by) in zip(ring or [], (ring or [])[1:], strict=False):
            if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
                odd = not odd
            dx, dy = bx - ax, by - ay
            length = dx * dx + dy * dy
            t = 0.0 if length == 0 else max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / length))
            d = math.hypot(px - (ax + t * dx), py - (ay + t * dy))
            best = d if best is None else min(best, d)
    return 0.0 if odd else best


def test_against_plain_python(spark):
    rng = random.Random(31)
    at = lambda: (float(rng.randint(0, 6)), float(rng.randint(0, 6)))
    ring = lambda n: (lambda p: [*p, p[0]])([at() for _ in range(n)])
    shapes = [[ring(rng.randint(1, 6)) for _ in range(rng.randint(1, 3))] for _ in range(150)]
    rows = [(*at(), s) for s in [*shapes, [], None, [[]], [[(1.0, 1.0)]], [None, ring(4)], [[(1.0, 1.0)] * 2, []], [[(1.0, 1.0), (1.0 + 1e-200, 1.0)]]]]
    got = spark.createDataFrame(rows, SHAPE).select(G.to_polygon(F.col("px"), F.col("py"), F.col("rings")).alias("d")).collect()
    for row, r in zip(rows, got, strict=True):
        want = formula(*row)
        assert (r.d is None) == (want is None) and (want is None or math.isclose(r.d, want, rel_tol=1e-12, abs_tol=1e-12)), (row, r.d, want)
