"""Points in polygons and the nearest of lines and polygons, on tables of edges.

A polygon is the set of its edges, of all rings and parts: a point is inside if a ray from it crosses an odd number of them. So holes and parts need no
care, a ring that touches or crosses itself is no error, and neither the order nor the direction of rings matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.geo import to_segment
from factloom.operators import nearest, rtree

#: Edges of a strip that are aimed at, strips of a polygon at most, and parts that a strip's points are dealt to.
EDGES, STRIPS, SALT = 8, 65_536, 8
#: Edges of a polygon that goes through the R-tree in one row; what boxes are wider for rounding, as a part of a coordinate.
HELD, SLACK = 64, 1e-12
ENDS = ("x1", "y1", "x2", "y2")


def clean_ring(points: Column) -> Column:
    """A closed ring of points ``x, y``: without points that have a null or repeat the one before, the first one again at the end; null where fewer than three are left."""
    real = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    kept = F.filter(real, lambda p, i: (i == 0) | (F.get(real, i - 1) != p))
    opened = F.when((F.size(kept) > 1) & (F.get(kept, F.lit(0)) == F.get(kept, F.size(kept) - 1)), F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
    return F.when(F.size(opened) >= 3, F.concat(opened, F.slice(opened, 1, 1)))


def ring_area(ring: Column) -> Column:
    """Area of a closed ring, positive if it runs against the clock."""
    step = lambda i: F.get(ring, i)["x"] * F.get(ring, i + 1)["y"] - F.get(ring, i + 1)["x"] * F.get(ring, i)["y"]
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.size(ring) - 2), step), F.lit(0.0), lambda s, v: s + v) / 2


def oriented(rings: Column) -> Column:
    """Closed rings with the first against the clock and the others, holes, with it."""
    turned = lambda r, i: F.when((ring_area(r) < 0) == (i == 0), F.reverse(r)).otherwise(r)
    return F.transform(rings, turned)


def edges(shapes: DataFrame, *keep: str) -> DataFrame:
    """``*keep, polygon, x1, y1, x2, y2`` of ``shapes(kind, rings)``: each edge of each ring or line once."""
    pairs = lambda r: F.when(F.size(r) > 1, F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: F.struct(F.get(r, i).alias("a"), F.get(r, i + 1).alias("b"))))
    each = shapes.select(*keep, (F.col("kind") == "polygon").alias("polygon"), F.explode("rings").alias("_r")).select(*keep, "polygon", F.explode(pairs(F.col("_r"))).alias("_e"))
    return each.select(*keep, "polygon", *[F.col(f"_e.{p}.{c}").alias(n) for p, c, n in (("a", "x", "x1"), ("a", "y", "y1"), ("b", "x", "x2"), ("b", "y", "y2"))])


def inside(points: DataFrame, lines: DataFrame) -> DataFrame:
    """``subject, layer, feature`` of each point within each polygon, once. ``points(subject, x, y)``, ``lines(layer, feature, x1, y1, x2, y2)``: the polygons' edges.

    Boxes of polygons meet points in an R-tree. A polygon is cut into strips of some EDGES edges, so a point meets the few edges at its height, however many the polygon has.
    A point on an edge is in or out, as rounding falls; its distance is 0 either way. Subjects are unique; nulls among coordinates are left out.
    """
    key = ["layer", "feature"]
    lines = lines.select(*key, *ENDS).dropna(subset=list(ENDS))
    boxes = lines.groupBy(*key).agg(F.min(F.least("x1", "x2")).alias("xmin"), F.min(F.least("y1", "y2")).alias("ymin"), F.max(F.greatest("x1", "x2")).alias("xmax"), F.max(F.greatest("y1", "y2")).alias("ymax"), F.count("*").alias("_n"))
    boxes = boxes.where("ymax > ymin").withColumn("_strips", F.least(F.ceil(F.col("_n") / EDGES), F.lit(STRIPS)).cast("int"))
    strip = lambda y: F.least(F.floor((y - F.col("ymin")) / (F.col("ymax") - F.col("ymin")) * F.col("_strips")), F.col("_strips") - 1).cast("int")
    packed = nearest._cut(rtree.pack(boxes, key))
    windows = points.select("subject", "x", "y", F.col("x").alias("wxmin"), F.col("y").alias("wymin"), F.col("x").alias("wxmax"), F.col("y").alias("wymax"))
    met = rtree.range_join(windows, packed, "subject").select("subject", "x", "y", *key, strip(F.col("y")).alias("_strip"))
    cut = lines.join(packed.select(*key, "ymin", "ymax", "_strips"), key).where("y1 <> y2")
    cut = cut.withColumn("_strip", F.explode(F.sequence(strip(F.least("y1", "y2")), strip(F.greatest("y1", "y2"))))).select(*key, "_strip", *ENDS)
    cut = cut.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    pairs = met.withColumn("_salt", F.pmod(F.xxhash64("subject"), F.lit(SALT)).cast("int")).join(cut, [*key, "_strip", "_salt"])
    at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossed = pairs.where(((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < at))
    return crossed.groupBy("subject", *key).agg((F.count("*") % 2).alias("_odd")).where("_odd = 1").select("subject", *key)


def _holds(x: Column, y: Column, edges: Column) -> Column:
    """Whether a polygon has the point inside, as ``inside`` has it, or on an edge."""
    at = lambda e: e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
    between = lambda v, a, b: (v >= F.least(a, b) - F.abs(v) * SLACK) & (v <= F.greatest(a, b) + F.abs(v) * SLACK)
    crossed = F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < at(e)))
    on = F.exists(edges, lambda e: between(x, e["x1"], e["x2"]) & between(y, e["y1"], e["y2"]) & (to_segment(x, y, *[e[c] for c in ENDS]) == 0))
    return (F.size(crossed) % 2 == 1) | on


def first_holding(points: DataFrame, lines: DataFrame) -> DataFrame:
    """``subject, layer, feature`` of each point and layer: the smallest polygon that has the point inside or on an edge. Polygons of at most HELD edges.

    A polygon is one row with its edges, so a pair is decided where point and polygon meet, and what is shuffled are points by pages, not points by polygons.
    """
    key = ["layer", "feature"]
    low, high = lambda *c: F.min(F.least(*c)), lambda *c: F.max(F.greatest(*c))
    wider = lambda c, sign: c + sign * F.abs(c) * SLACK
    held = lines.select(*key, *ENDS).dropna(subset=list(ENDS)).groupBy(*key).agg(
        wider(low("x1", "x2"), -1).alias("xmin"), wider(low("y1", "y2"), -1).alias("ymin"), wider(high("x1", "x2"), 1).alias("xmax"), wider(high("y1", "y2"), 1).alias("ymax"), F.collect_list(F.struct(*ENDS)).alias("_edges")
    )
    packed = nearest._cut(rtree.pack(held, key))
    windows = points.select("subject", F.col("x").alias("wxmin"), F.col("y").alias("wymin"), F.col("x").alias("wxmax"), F.col("y").alias("wymax"))
    met = rtree.range_join(windows, packed, "subject", _holds(F.col("wxmin"), F.col("wymin"), F.col("_edges")))
    return met.groupBy("subject", "layer").agg(F.min("feature").alias("feature"))


def nearest_shapes(points: DataFrame, lines: DataFrame, cell: float) -> DataFrame:
    """``subject, layer, feature, metres``: the nearest line or polygon of each layer, 0 within a polygon, the smaller feature on a tie. ``lines`` as ``edges`` gives them, with ``layer, feature``.

    Where all shapes are polygons of at most HELD edges, outlines are only asked about points that some layer's polygons don't hold.
    """
    known = lines.select("layer", "feature", "polygon", *ENDS).dropna(subset=list(ENDS))
    shapes = known.groupBy("layer", "feature").agg(F.bool_and("polygon").alias("polygon"), F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("subject", "layer").orderBy("metres", "feature"))
    zero = F.lit(0.0).alias("metres")
    if shapes.where(f"not polygon or n > {HELD}").take(1):
        outline = nearest.nearest(points, lines.select("layer", "feature", *ENDS), cell)
        within = inside(points, lines.where("polygon")).select("subject", "layer", "feature", zero)
        within = within.withColumn("_r", best).where("_r = 1").drop("_r")
    else:
        within = nearest._cut(first_holding(points, known)).select("subject", "layer", "feature", zero)
        layers = shapes.select("layer").distinct().count()
        done = within.groupBy("subject").count().where(F.col("count") == layers)
        outline = nearest.nearest(points.join(done, "subject", "left_anti"), lines.select("layer", "feature", *ENDS), cell)
    return outline.unionByName(within).withColumn("_r", best).where("_r = 1").drop("_r")
