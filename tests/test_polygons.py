"""Points in polygons, and the nearest of lines and polygons, against plain loops; shapes of GeoJSON."""

import json
import math
import random

from pyspark.sql import functions as F

from factloom.operators import polygons
from factloom.sources import files
from test_space import distance

X = random.Random(5)


def star(cx, cy, r, n):
    return [(cx + r * X.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), cy + r * X.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


SHAPES = [
    *[("lots", k, "polygon", [star(X.uniform(0, 500), X.uniform(0, 500), X.uniform(5, 80), X.choice([3, 7, 60]))]) for k in range(25)],
    ("lots", 90, "polygon", [[(-900, -900), (900, -900), (900, 900), (-900, 900)], [(-850, -850), (850, -850), (850, 850), (-850, 850)], [(-2, -2), (2, -2), (2, 2), (-2, 2)]]),
    ("ponds", 1, "polygon", [star(250, 250, 200, 900)]), ("ponds", 2, "polygon", [[(0, 0), (40, 40), (40, 0), (0, 40)]]), ("ponds", 3, "line", [[(0, 9), (700, 9)]]),
]
POINTS = [(k, X.uniform(-1000, 1000) if k % 4 == 0 else X.uniform(0, 500), X.uniform(0, 500)) for k in range(150)] + [(900, 0.0, 0.0), (901, 20.0, 10.0), (902, 20.0, 30.0), (903, None, 1.0), (904, 5e4, 5e4)]


def sides(rings, closed):
    return [(a, b) for r in rings for a, b in zip(r, r[1:] + r[:1] if closed else r[1:], strict=False)]


def odd(x, y, pairs):
    return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in pairs) % 2 == 1


def lines(spark):
    rows = [(layer, f, kind, [[(float(x), float(y)) for x, y in r] for r in rings]) for layer, f, kind, rings in SHAPES]
    df = spark.createDataFrame(rows, "layer string, feature long, kind string, rings array<array<struct<x: double, y: double>>>")
    closed = F.transform("rings", polygons.clean_ring)
    return polygons.edges(df.withColumn("rings", F.when(F.col("kind") == "polygon", closed).otherwise(F.col("rings"))), "layer", "feature")


def test_inside_and_nearest_like_plain_loops(spark):
    points = spark.createDataFrame(POINTS, "subject long, x double, y double")
    own = lines(spark)
    want = {(s, layer, f) for s, x, y in POINTS if x is not None for layer, f, kind, rings in SHAPES if kind == "polygon" and odd(x, y, sides(rings, True))}
    assert {tuple(r) for r in polygons.inside(points, own.where("polygon")).collect()} == want and len(want) > 40
    best = {}
    for s, x, y in POINTS:
        for layer, f, kind, rings in SHAPES if x is not None else []:
            d = 0.0 if (s, layer, f) in want else min(distance(x, y, *a, *b) for a, b in sides(rings, kind == "polygon"))
            best[s, layer] = min(best.get((s, layer), (d, f)), (d, f))
    got = {(r.subject, r.layer): (round(r.metres, 6), r.feature) for r in polygons.nearest_shapes(points, own, 50.0).collect()}
    assert got == {k: (round(d, 6), f) for k, (d, f) in best.items()}


def test_nothing_to_be_in(spark):
    points = spark.createDataFrame(POINTS, "subject long, x double, y double")
    assert polygons.inside(points, lines(spark).limit(0)).count() == 0
    assert polygons.inside(points.limit(0), lines(spark).where("polygon")).count() == 0


def test_shapes_of_geojson(spark, tmp_path):
    shape = lambda kind, c: {"type": "Feature", "properties": {"NAME": kind}, "geometry": {"type": kind, "coordinates": c}}
    square, hole = [[0, 0], [0, 4], [4, 4], [4, 4], [4, 0], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2]]
    features = [shape("Polygon", [square, hole, [[3, 3], [3, 3]]]), shape("MultiPolygon", [[square], [[[9, 9], [9, 8]]], [hole]]), shape("LineString", [[0, 0], [1, 1, 7]]), shape("MultiLineString", [[[0, 0]], [[0, 0], [1, 0], [1, 5]]]), shape("Point", [1, 1]), {"type": "Feature", "properties": {}, "geometry": None}, shape("Polygon", []), shape("Polygon", [[[0, 0], [1, None], [2, 2]], hole])]
    path = tmp_path / "layer.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    area = F.transform("rings", polygons.ring_area)
    rows = files.geojson_shapes(spark, str(path)).withColumn("area", F.when(F.col("kind") == "polygon", area)).orderBy("feature", "part").collect()
    assert [(r.feature, r.part, r.kind, r.area, [len(x) for x in r.rings]) for r in rows] == [(0, 0, "polygon", [16.0, -1.0], [5, 5]), (1, 0, "polygon", [16.0], [5]), (1, 2, "polygon", [1.0], [5]), (2, 0, "line", None, [2]), (3, 0, "line", None, [3])]
    moved = files.geojson_shapes(spark, str(path), lambda x, y: F.struct((x + 10).alias("east"), (y * 2).alias("north"))).where("feature = 2").first()
    assert [(p.x, p.y) for p in moved.rings[0]] == [(10.0, 0.0), (11.0, 2.0)]


def test_small_polygons_meet_points_in_one_row(spark):
    """Squares that overlap: the least that holds a point, on an edge too, and outlines only of points that a layer doesn't hold."""
    square = lambda x, y, r: [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r)]
    shapes = [(layer, k, square(3.0 * k + layer, 2.0 * (k % 5), 6.0)) for layer in (0, 1) for k in range(40)]
    lines = spark.createDataFrame([(f"layer{n}", k, True, *a, *b) for n, k, ring in shapes for a, b in zip(ring, ring[1:], strict=False)], "layer string, feature long, polygon boolean, x1 double, y1 double, x2 double, y2 double")
    at = {i: (x, y) for i, (x, y) in enumerate([(-6.0, 1.0), (-7.5, 0.0), (30.0, 3.0), (30.5, 3.5), (54.0, 14.0), (60.0, 40.0), (3.0, -6.0), (140.0, 4.0)])}
    points = spark.createDataFrame([(i, *p) for i, p in at.items()], "subject long, x double, y double")
    want = set()
    for i, (x, y) in at.items():
        for layer in (0, 1):
            away = lambda ring: max(abs(x - (ring[0][0] + ring[2][0]) / 2), abs(y - (ring[0][1] + ring[2][1]) / 2)) <= 6  # noqa: B023, E731
            far = lambda ring: 0.0 if away(ring) else (max(ring[0][0] - x, x - ring[2][0], 0) ** 2 + max(ring[0][1] - y, y - ring[2][1], 0) ** 2) ** 0.5  # noqa: B023, E731
            metres, k = min((far(ring), k) for n, k, ring in shapes if n == layer)
            want.add((i, f"layer{layer}", k, round(metres, 6)))
    got = [(r.subject, r.layer, r.feature, round(r.metres, 6)) for r in polygons.nearest_shapes(points, lines, 50.0).collect()]
    assert set(got) == want and len(got) == len(want)
    held = polygons.first_holding(points, lines)
    assert {(r.subject, r.layer, r.feature) for r in held.collect()} == {w[:3] for w in want if w[3] == 0}
    # a row for each point and layer: pairs of points and polygons aren't shuffled one by one
    assert held.count() == sum(w[3] == 0 for w in want)
