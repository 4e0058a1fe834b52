"""Nearest features and range joins against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import geo as G
from factloom.operators import nearest, rtree

X = random.Random(8)


def distance(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = 0.0 if n == 0 else max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / n))
    return math.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def plain(points, segments):
    out = {}
    for s, x, y in points:
        if x is None or y is None:
            continue
        for layer, f, *c in segments:
            if None in c:
                continue
            d = distance(x, y, *c)
            k = (s, layer)
            if k not in out or (d, f) < out[k]:
                out[k] = (d, f)
    return out


SEGMENTS = [
    *[("rivers", k, a := X.uniform(0, 900), b := X.uniform(0, 900), a + X.uniform(-60, 60), b + X.uniform(-60, 60)) for k in range(150)],
    ("rivers", 900, -2000.0, -1500.0, 60000.0, 41000.0), ("rivers", 901, 500.0, -10.0, 500.0, 950.0), ("rivers", 902, -10.0, 20.0, 950.0, 20.0),
    ("ponds", 1, 90000.0, 90000.0, 90001.0, 90000.0), ("ditches", 5, 5.0, 5.0, 5.0, 5.0), ("ditches", 4, 5.0, 5.0, 5.0, 5.0), ("ditches", 6, 700.0, None, 1.0, 1.0),
    *[("far", k, 50000 + X.uniform(0, 30), -40000 + X.uniform(0, 30), 50010.0, -40010.0) for k in range(60)],
]
POINTS = [*[(k, X.uniform(-50, 950), X.uniform(-50, 950)) for k in range(150)], (900, 0.0, 0.0), (901, 80000.0, -70000.0), (902, None, 1.0), (903, 5.0, 5.0), (904, 640.0, 320.0), (905, -64.0, 64.0)]


@pytest.mark.parametrize("cell", [7.0, 64.0, 5000.0])
def test_nearest(spark, cell):
    got = nearest.nearest(spark.createDataFrame(POINTS, "subject long, x double, y double"), spark.createDataFrame(SEGMENTS, "layer string, feature long, x1 double, y1 double, x2 double, y2 double"), cell).collect()
    want = plain(POINTS, SEGMENTS)
    assert len(got) == len(want)
    for r in got:
        d, f = want[r.subject, r.layer]
        assert r.feature == f and abs(r.metres - d) < 1e-6


def test_nearest_of_nothing(spark):
    p, s = spark.createDataFrame(POINTS, "subject long, x double, y double"), spark.createDataFrame([], "layer string, feature long, x1 double, y1 double, x2 double, y2 double")
    assert nearest.nearest(p, s, 10.0).count() == 0
    assert nearest.nearest(p.limit(0), spark.createDataFrame(SEGMENTS, s.schema), 10.0).count() == 0


def test_a_diagonal_has_as_many_cells_as_it_is_long(spark):
    s = spark.createDataFrame([("a", 1, 0.0, 0.0, 10000.0, 10000.0)], "layer string, feature long, x1 double, y1 double, x2 double, y2 double")
    cells = nearest.segment_cells(s, 10.0)
    assert 1000 <= cells.count() <= 3100 and cells.count() == cells.distinct().count()


def meets(x1, y1, x2, y2, left, bottom, right, top):
    """By cutting the segment in many places would be inexact: by the signs of the corners and the boxes instead."""
    if max(x1, x2) < left or min(x1, x2) > right or max(y1, y2) < bottom or min(y1, y2) > top:
        return False
    side = [(x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1) for cx in (left, right) for cy in (bottom, top)]
    return min(side) <= 0 <= max(side)


@pytest.mark.parametrize(("page", "fanout", "n"), [(4, 3, 400), (64, 32, 400), (2, 2, 60), (4, 3, 0)])
def test_range_join(spark, page, fanout, n):
    whole = lambda a, b: float(X.randint(a, b))  # noqa: E731  touching sides are common
    shapes = [(k, a := whole(0, 400), b := whole(0, 400), a + whole(-30, 30), b + whole(-30, 30)) for k in range(n)] + ([(n, 0.0, 0.0, 400.0, 400.0), (n + 1, None, 1.0, 2.0, 3.0)] if n else [])
    windows = [(k, a := whole(-20, 400), b := whole(-20, 400), a + whole(0, 60), b + whole(0, 60), "kept") for k in range(200)] + [(900, -9.0, -9.0, 999.0, 999.0, "all"), (901, None, 1.0, 1.0, 1.0, "none"), (902, 5000.0, 5000.0, 6000.0, 6000.0, "off")]
    s = spark.createDataFrame(shapes, "f long, x1 double, y1 double, x2 double, y2 double")
    s = s.withColumns({"xmin": F.least("x1", "x2"), "ymin": F.least("y1", "y2"), "xmax": F.greatest("x1", "x2"), "ymax": F.greatest("y1", "y2")}).where("x1 is not null or f is null")
    w = spark.createDataFrame(windows, "w long, wxmin double, wymin double, wxmax double, wymax double, note string")
    packed = rtree.pack(s, ["f"], page)
    if n:
        assert packed.groupBy("page").count().agg(F.max("count")).first()[0] <= page
    exact = G.meets_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "wxmin", "wymin", "wxmax", "wymax")])
    got = rtree.range_join(w, packed, "w", exact, fanout).select("w", "f", "note").collect()
    want = {(k, f, note) for k, *box, note in windows if None not in box for f, *c in shapes if None not in c and meets(*c, *box)}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_cells_fit_the_segments(spark):
    dense = spark.range(4000).selectExpr("'a' as layer", "id as feature", "id * 37 % 1000 * 1.0 as x1", "id * 53 % 997 * 1.0 as y1").selectExpr("*", "x1 as x2", "y1 as y2")
    side = nearest.fitted_cell(dense, 1000.0)
    assert dense.count() / nearest.segment_cells(dense, side).select("cx", "cy").distinct().count() <= 2 * nearest.FILL
    long = dense.limit(400).selectExpr("layer", "feature", "x1", "y1", "x1 + 900 as x2", "y2")
    assert nearest.fitted_cell(long, 1000.0) >= 450
    assert nearest.fitted_cell(dense.where("false"), 1000.0) == 1000.0


def test_tasks_of_a_range_join_grow_with_its_work(spark, tmp_path, monkeypatch):
    """Windows and pages count, not bytes, which are few where many pairs come of them."""
    monkeypatch.setattr(rtree, "TASK", 100)
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    box = lambda p: ", ".join(f"cast(id as double) + {d} as {p}{c}" for c, d in zip(rtree.BOX, (0, 0, 3, 3), strict=True))
    s = spark.range(200).selectExpr("id as f", *box("").split(", "))
    w = spark.range(100).selectExpr("id as w", *box("w").split(", "))
    out = rtree.range_join(w, rtree.pack(s, ["f"], 8), "w")
    assert out.count() == sum(abs(a - b) <= 3 for a in range(200) for b in range(100))
    assert out.rdd.getNumPartitions() >= 25
