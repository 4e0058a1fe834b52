"""Projection, distances, drawings, vectors, page scores."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.catalog import domain
from factloom.functions import geo as G
from factloom.functions import vectors as V
from factloom.operators import drawing, nearest, pages, polygons, raster, rtree, scan
from factloom.operators import facts as X
from factloom.operators import relational as R
from factloom.registry import Source, on, query, read

C = F.col
POINTS = Source("customer", k="c_custkey", lat="38.45 + (c_custkey % 1399) / 1000.0", lon="-75.79 + (c_custkey % 811) / 1000.0")


def utm_sql(lat: str, lon: str, prefix: str = "") -> str:
    radius, alpha, e = G._series()
    num = lambda v: f"CAST('{v!r}' AS DOUBLE)"
    t = f"sinh(atanh(sin(radians({lat}))) - {num(e)} * atanh({num(e)} * sin(radians({lat}))))"
    xi, eta = f"atan2({t}, cos(radians({lon} + 75.0)))", f"atanh(sin(radians({lon} + 75.0)) / sqrt(1 + {t} * {t}))"
    east = eta + "".join(f" + {num(a)} * cos(2 * {j} * {xi}) * sinh(2 * {j} * {eta})" for j, a in enumerate(alpha, 1))
    north = xi + "".join(f" + {num(a)} * sin(2 * {j} * {xi}) * cosh(2 * {j} * {eta})" for j, a in enumerate(alpha, 1))
    return f"500000 + {num(0.9996 * radius)} * ({east}) AS {prefix}east, {num(0.9996 * radius)} * ({north}) AS {prefix}north"


@on("g1_utm", POINTS, f"SELECT k, round(east, 2) AS east, round(north, 2) AS north FROM (SELECT k, {utm_sql('CAST(lat AS DOUBLE)', 'CAST(lon AS DOUBLE)')} FROM src)")
def g1(d):
    return d.select("k", G.utm(C("lat").cast("double"), C("lon").cast("double")).alias("u")).select("k", F.round("u.east", 2).alias("east"), F.round("u.north", 2).alias("north"))


@on("g1_utm_inverse", POINTS, "SELECT k, round(CAST(lat AS DOUBLE), 6) AS lat, round(CAST(lon AS DOUBLE), 6) AS lon FROM src")
def g1_inverse(d):
    u = G.utm(C("lat").cast("double"), C("lon").cast("double"))
    return d.select("k", u.alias("u")).select("k", G.from_utm(C("u.east"), C("u.north")).alias("p")).select("k", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


SEG = Source("lineitem", k="l_orderkey", n="l_linenumber", p="l_partkey", px="l_quantity", py="l_discount * 100", x1="l_tax * 100", y1="CAST(l_linenumber AS DOUBLE)", x2="CAST(l_suppkey % 50 AS DOUBLE)", y2="CAST(l_partkey % 50 AS DOUBLE)")


@on("g2_segment_distance", SEG, "WITH a AS (SELECT *, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS l FROM src), b AS (SELECT *, CASE WHEN l = 0 THEN 0 ELSE greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / CASE WHEN l = 0 THEN 1 ELSE l END)) END AS t FROM a) SELECT k, n, p, round(sqrt(power(px - (x1 + t * (x2 - x1)), 2) + power(py - (y1 + t * (y2 - y1)), 2)) * 3.280839895, 4) AS feet FROM b")
def g2(d):
    return d.select("k", "n", "p", F.round(G.to_segment(C("px"), C("py"), C("x1"), C("y1"), C("x2"), C("y2")) * G.FEET, 4).alias("feet"))


@on("g2_polygon_distance", SEG, "SELECT k, n, p, round(sqrt(power(greatest(x1 - px, px - x1 - 9, 0), 2) + power(greatest(y1 - py, py - y1 - 6, 0), 2)) * 3.280839895, 4) AS feet FROM src")
def g2_polygon(d):
    corner = lambda dx, dy: F.struct((C("x1") + dx).cast("double").alias("x"), (C("y1") + dy).cast("double").alias("y"))
    ring = F.array(corner(0, 0), corner(9, 0), corner(9, 6), corner(0, 6), corner(0, 0))
    return d.select("k", "n", "p", F.round(G.to_polygon(C("px").cast("double"), C("py").cast("double"), F.array(ring)) * G.FEET, 4).alias("feet"))


@on("g3_compass", SEG, "SELECT k, n, p, ['" + "','".join(G.POINTS) + "'][CAST(floor(((((degrees(atan2(x2 - x1, y2 - y1)) % 360) + 360) % 360 + 11.25) % 360) / 22.5) AS INT) + 1] AS bearing FROM src")
def g3(d):
    return d.select("k", "n", "p", G.compass(C("x1"), C("y1"), C("x2"), C("y2")).alias("bearing"))


@on("g4_scale_bar", Source("orders", k="o_orderkey", span="o_totalprice / 50"), "SELECT k, (list_sort(list_transform([" + ", ".join(map(str, G.BARS)) + "], b -> struct_pack(gap := abs(b - span * 0.25), bar := CAST(b AS DOUBLE))))[1]).bar AS bar FROM src")
def g4(d):
    return d.select("k", G.scale_bar(C("span")).alias("bar"))


BOX = Source("lineitem", k="l_orderkey", n="l_linenumber", p="l_partkey", al="l_quantity", tp="l_tax * 100", aw="5.0 + l_linenumber", ah="4.0", bl="CAST(l_suppkey % 60 AS DOUBLE)", bt="CAST(l_partkey % 40 AS DOUBLE)", bw="6.0", bh="3.0 + l_linenumber")


@on("g5_box_gap", BOX, """
WITH a AS (SELECT *, least(greatest(bl + bw / 2, al), al + aw) AS x1, least(greatest(bt + bh / 2, tp), tp + ah) AS y1 FROM src), b AS (SELECT *, least(greatest(x1, bl), bl + bw) AS x2, least(greatest(y1, bt), bt + bh) AS y2 FROM a),
c AS (SELECT *, least(greatest(x2, al), al + aw) AS x3, least(greatest(y2, tp), tp + ah) AS y3 FROM b) SELECT k, n, p, round(sqrt(power(x3 - x2, 2) + power(y3 - y2, 2)), 4) AS gap FROM c""")
def g5(d):
    a = {"left": C("al"), "top": C("tp"), "width": C("aw"), "height": C("ah")}
    b = {"left": C("bl"), "top": C("bt"), "width": C("bw"), "height": C("bh")}
    return d.select("k", "n", "p", F.round(G.box_gap(a, b), 4).alias("gap"))


@on("g6_uncertainty", BOX, "SELECT k, n, p, round(0.0092 * sqrt(aw * aw + ah * ah) * 1.414 * 0.25, 8) AS feet FROM src")
def g6(d):
    return d.select("k", "n", "p", F.round(G.uncertainty_feet(C("aw"), C("ah"), F.lit(0.25)), 8).alias("feet"))


@on("g7_withholding", BOX, "SELECT k, n, p, CASE WHEN n = 1 THEN 'label not validated' WHEN al < 5 THEN 'smaller than its uncertainty' WHEN abs(al - 25) <= 5 THEN 'within its uncertainty of the threshold' END AS reason FROM src")
def g7(d):
    return d.select("k", "n", "p", G.withheld(C("n") != 1, C("al"), F.lit(5.0), F.lit(25.0)).alias("reason"))


@on("g8_to_feet", Source("part", k="p_partkey", v="p_retailprice", u="CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'ft' WHEN 1 THEN 'Inches' WHEN 2 THEN 'm' WHEN 3 THEN 'yd' ELSE 'rod' END"), "SELECT k, round(CASE lower(u) WHEN 'ft' THEN v WHEN 'inches' THEN v / 12 WHEN 'm' THEN v * 3.280839895 WHEN 'yd' THEN v * 3 END, 6) AS feet FROM src")
def g8(d):
    return d.select("k", F.round(G.to_feet(C("v"), C("u")), 6).alias("feet"))


@on("g9_scale_choice", Source("part", k="p_partkey", bar="CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size / 10.0 END", ratio="CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size / 12.0 END", clipped="p_partkey % 2 = 0"), """
WITH a AS (SELECT k, CAST(bar AS DOUBLE) AS bar, CAST(ratio AS DOUBLE) AS ratio, clipped FROM src), b AS (SELECT *, coalesce(bar BETWEEN 0.005 AND 20, FALSE) AS fb, coalesce(ratio BETWEEN 0.005 AND 20, FALSE) AS fr, 100 * (1 - abs(bar - ratio) / greatest(bar, ratio)) AS agree FROM a),
c AS (SELECT *, (fb AND fr AND clipped AND agree < 85) OR (NOT fb AND fr) AS by_ratio FROM b)
SELECT k, round(CASE WHEN by_ratio THEN ratio WHEN fb THEN bar END, 6) AS feet_per_pixel, CASE WHEN by_ratio THEN 'ratio_and_dpi' WHEN fb THEN 'graphic_bar' END AS source, CASE WHEN fb AND fr THEN round(agree, 1) END AS agreement_pct FROM c""")
def g9(d):
    d = d.select("k", C("bar").cast("double"), C("ratio").cast("double"), "clipped")
    return d.select("k", G.choose_scale(C("bar"), C("ratio"), C("clipped")).alias("c")).select("k", F.round("c.feet_per_pixel", 6).alias("feet_per_pixel"), "c.source", "c.agreement_pct")


@on("g11_pdf_rect", Source("part", k="p_partkey", l="p_size / 100.0", w="p_size / 80.0"), "SELECT k, round(CASE WHEN l + w <= 1.001 THEN CAST(l AS DOUBLE) * 612 END, 4) AS x0, round(CASE WHEN l + w <= 1.001 THEN (CAST(l AS DOUBLE) + CAST(w AS DOUBLE)) * 612 END, 4) AS x1 FROM src")
def g11(d):
    ok, left, width = C("l") + C("w") <= 1.001, C("l").cast("double"), C("w").cast("double")
    return d.select("k", F.round(F.when(ok, left * 612), 4).alias("x0"), F.round(F.when(ok, (left + width) * 612), 4).alias("x1"))


@query("g12_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def g12(spark, sf):
    e = read(spark, sf, "embeddings")
    return e.select(C("vec_id").alias("a"), C("embedding").alias("x")).join(e.select(C("vec_id").alias("b"), C("embedding").alias("y")), C("b") == C("a") + 1).select("a", "b", F.round(V.cosine(C("x"), C("y")), 6).alias("sim"))


@query("g13_hash_slot", "SELECT DISTINCT w, CAST((('0x' || substr(sha256(w), 1, 2))::INT + 256 * ('0x' || substr(sha256(w), 3, 2))::INT) % 1024 AS INT) AS slot FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) WHERE w <> ''")
def g13(spark, sf):
    w = read(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).where("w <> ''").distinct()
    return w.select("w", V.hash_slot(C("w")).alias("slot"))


@query("g13_hash_embed", "WITH t AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark), s AS (SELECT item_id, CAST((('0x' || substr(sha256(w), 1, 2))::INT + 256 * ('0x' || substr(sha256(w), 3, 2))::INT) % 1024 AS INT) AS slot, count(*) AS n FROM t WHERE w <> '' GROUP BY 1, 2) SELECT item_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS v FROM s")
def g13b(spark, sf):
    return nearest.hash_embed(read(spark, sf, "benchmark"), "item_id", "text").withColumn("v", F.round("v", 6))


@query("g14_content_hash", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, left(sha256(text), 32) AS short FROM documents")
def g14(spark, sf):
    b = C("text").cast("binary")
    return read(spark, sf, "documents").select("doc_id", F.md5(b).alias("md5"), F.sha2(b, 256).alias("sha256"), F.left(F.sha2(b, 256), F.lit(32)).alias("short"))


@on("g15_window_size", BOX, "SELECT k, n, p, least(greatest(greatest(aw, ah) * 4, 56), 400) AS side FROM src")
def g15(d):
    return d.select("k", "n", "p", F.least(F.greatest(F.greatest("aw", "ah") * 4, F.lit(56.0)), F.lit(400.0)).alias("side"))


@on("g16_contrast", Source("part", k="p_partkey", r="CAST((p_partkey * 7) % 256 AS DOUBLE)", g="CAST((p_partkey * 13) % 256 AS DOUBLE)", b="CAST((p_partkey * 29) % 256 AS DOUBLE)"), "WITH l AS (SELECT k, " + " + ".join(f"{w} * CASE WHEN {c} / 255 <= 0.03928 THEN {c} / 255 / 12.92 ELSE power(({c} / 255 + 0.055) / 1.055, 2.4) END" for w, c in ((0.2126, "r"), (0.7152, "g"), (0.0722, "b"))) + " AS lum FROM src) SELECT k, round(1.05 / (lum + 0.05), 4) AS ratio FROM l")
def g16(d):
    return d.select("k", F.round(G.contrast(F.lit(1.0), G.luminance(C("r"), C("g"), C("b"))), 4).alias("ratio"))


@on("g17_box_edges", BOX, "SELECT k, n, p, round(al + aw / 2, 4) AS cx, round(tp + ah / 2, 4) AS cy, al + aw AS rt FROM src")
def g17(d):
    return d.select("k", "n", "p", F.round(C("al") + C("aw") / 2, 4).alias("cx"), F.round(C("tp") + C("ah") / 2, 4).alias("cy"), (C("al") + C("aw")).alias("rt"))


@on("g19_crop_to_page", BOX, "SELECT k, n, p, least(greatest(round_even(bl / 4 + 10, 0), 0), 99) AS lft, greatest(1, least(round_even(bw / 4, 0), 100 - least(greatest(round_even(bl / 4 + 10, 0), 0), 99))) AS w FROM src")
def g19(d):
    c = G.crop_to_page({"left": C("bl"), "top": C("bt"), "width": C("bw"), "height": C("bh")}, F.lit(4.0), F.lit(10.0), F.lit(10.0), F.lit(100.0), F.lit(100.0))
    return d.select("k", "n", "p", c.alias("c")).select("k", "n", "p", C("c.left").alias("lft"), C("c.width").alias("w"))


_NEAR = f"""WITH p AS (SELECT c_custkey AS k, {utm_sql('CAST(38.45 + (c_custkey % 1399) / 1000.0 AS DOUBLE)', 'CAST(-75.79 + (c_custkey % 811) / 1000.0 AS DOUBLE)')} FROM customer),
s AS (SELECT s_suppkey AS f, 'layer' || CAST(s_suppkey % 3 AS STRING) AS layer, {utm_sql('CAST(38.45 + (s_suppkey * 37 % 1399) / 1000.0 AS DOUBLE)', 'CAST(-75.79 + (s_suppkey * 53 % 811) / 1000.0 AS DOUBLE)')} FROM supplier),
d AS (SELECT k, layer, f, sqrt(power(p.east - s.east, 2) + power(p.north - s.north, 2)) * 3.280839895 AS feet FROM p CROSS JOIN s),
n AS (SELECT k, layer, f, feet, row_number() OVER (PARTITION BY k, layer ORDER BY feet, f) AS r FROM d)"""


def _places(spark, sf):
    p = read(spark, sf, "customer").select(C("c_custkey").alias("subject"), G.utm((38.45 + (C("c_custkey") % 1399) / 1000.0), (-75.79 + (C("c_custkey") % 811) / 1000.0)).alias("u")).select("subject", C("u.east").alias("x"), C("u.north").alias("y"))
    s = read(spark, sf, "supplier").select(C("s_suppkey").alias("feature"), F.concat(F.lit("layer"), (C("s_suppkey") % 3).cast("string")).alias("layer"), G.utm((38.45 + (C("s_suppkey") * 37 % 1399) / 1000.0), (-75.79 + (C("s_suppkey") * 53 % 811) / 1000.0)).alias("u"))
    s = s.select("feature", "layer", C("u.east").alias("x1"), C("u.north").alias("y1"), C("u.east").alias("x2"), C("u.north").alias("y2"))
    return p, s


def _near(spark, sf):
    return nearest.nearest(*_places(spark, sf), cell=12_000.0)


@query("j5_nearest_feature", f"{_NEAR} SELECT k AS subject, layer, f AS feature, round(feet, 1) AS feet FROM n WHERE r = 1")
def j5(spark, sf):
    return _near(spark, sf).select("subject", "layer", "feature", F.round(C("metres") * G.FEET, 1).alias("feet"))


@query("c7_screen_location", f"{_NEAR} SELECT k AS subject, arg_min(layer, feet) AS layer, round(min(feet), 1) AS feet, min(feet) <= 200 AS flagged FROM n WHERE r = 1 GROUP BY 1")
def c7(spark, sf):
    n = _near(spark, sf).withColumn("feet", C("metres") * G.FEET)
    return n.groupBy("subject").agg(F.min_by("layer", "feet").alias("layer"), F.min("feet").alias("feet")).select("subject", "layer", F.round("feet", 1).alias("feet"), (C("feet") <= 200).alias("flagged"))


@query("c7_screen_polygons", f"{_NEAR[: _NEAR.index(chr(10) + 'd AS')]} d AS (SELECT k, layer, f, abs(p.east - s.east) AS dx, abs(p.north - s.north) AS dy, 1000 + f * 37 % 900 AS half FROM p CROSS JOIN s), e AS (SELECT k, layer, f, CASE WHEN dx > half OR dy > half THEN sqrt(power(greatest(dx - half, 0), 2) + power(greatest(dy - half, 0), 2)) WHEN dx < half / 2 AND dy < half / 2 THEN least(half / 2 - dx, half / 2 - dy) ELSE 0 END AS metres FROM d), n AS (SELECT *, row_number() OVER (PARTITION BY k, layer ORDER BY metres, f) AS r FROM e) SELECT k AS subject, layer, f AS feature, round(metres * 3.280839895, 1) AS feet, metres = 0 AS inside FROM n WHERE r = 1")
def c7_polygons(spark, sf):
    """Each site is a square with a square hole."""
    p, s = _places(spark, sf)
    half = (1000 + C("feature") * 37 % 900).cast("double")
    ring = lambda r: F.array(*[F.struct((C("x1") + r * a).alias("x"), (C("y1") + r * b).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    rings = F.transform(F.array(ring(half), ring(half / 2)), polygons.clean_ring)
    lines = polygons.edges(s.select("layer", "feature", F.lit("polygon").alias("kind"), rings.alias("rings")), "layer", "feature")
    near = polygons.nearest_shapes(p, lines, cell=12_000.0)
    return near.select("subject", "layer", "feature", F.round(C("metres") * G.FEET, 1).alias("feet"), (C("metres") == 0).alias("inside"))


_STATED = Source("orders", subject="o_custkey", page="o_orderkey", txt="CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'Latitude: 38.' || CAST(600 + o_orderkey % 300 AS STRING) || ' Longitude: -75.' || CAST(200 + o_orderkey % 700 AS STRING) WHEN 1 THEN 'LATITUDE 38,' || CAST(500 + o_orderkey % 400 AS STRING) WHEN 2 THEN 'Latitude: 38.5, longitude unknown' ELSE o_orderpriority END")


@query("c27_screened_locations", rf"""WITH src AS ({domain.PLACES.sql}), {domain._POINT[5:]}, t AS ({_STATED.sql}),
x AS (SELECT *, nullif(regexp_extract(txt, '(?i)latitude\s*:?\s*(-?\d{{1,3}}[.,]\d{{3,}})', 1), '') AS la, nullif(regexp_extract(txt, '(?i)longitude\s*:?\s*(-?\d{{1,3}}[.,]\d{{3,}})', 1), '') AS lo FROM t),
d AS (SELECT subject AS k, TRY_CAST(replace(arg_max(la, page) FILTER (la IS NOT NULL), ',', '.') AS DOUBLE) AS dy, TRY_CAST(replace(arg_max(lo, page) FILTER (lo IS NOT NULL), ',', '.') AS DOUBLE) AS dx FROM x GROUP BY 1),
l AS (SELECT k, CASE WHEN error IS NULL THEN y WHEN inbox THEN dy END AS lat, CASE WHEN error IS NULL THEN x WHEN inbox THEN dx END AS lon, CASE WHEN error IS NULL THEN 'record' WHEN inbox THEN 'document' END AS origin, error FROM (SELECT *, dx BETWEEN -75.80 AND -74.98 AND dy BETWEEN 38.44 AND 39.85 AS inbox FROM p LEFT JOIN d USING (k))),
u AS (SELECT k, origin, error, {utm_sql('lat', 'lon')} FROM l), s AS (SELECT s_suppkey AS f, {utm_sql('CAST(38.45 + (s_suppkey * 37 % 1399) / 1000.0 AS DOUBLE)', 'CAST(-75.79 + (s_suppkey * 53 % 811) / 1000.0 AS DOUBLE)')} FROM supplier),
n AS (SELECT u.*, f, sqrt(power(u.east - s.east, 2) + power(u.north - s.north, 2)) * 3.280839895 AS feet, row_number() OVER (PARTITION BY k ORDER BY sqrt(power(u.east - s.east, 2) + power(u.north - s.north, 2)), f) AS r FROM u CROSS JOIN s)
SELECT k AS subject, origin, CASE WHEN origin IS NULL THEN error END AS error, CASE WHEN origin IS NOT NULL THEN f END AS feature, CASE WHEN origin IS NOT NULL THEN round(feet, 1) END AS feet FROM n WHERE r = 1""")
def c27_screened(spark, sf):
    """Records with a location of their own, else the one that their documents state, and the nearest site to it."""
    records = domain.PLACES.frame(spark, sf).withColumnRenamed("k", "subject")
    at = X.located(records, _STATED.frame(spark, sf), domain.BOX).join(records.select("subject"), "subject", "left_semi")
    sites = _places(spark, sf)[1].withColumn("layer", F.lit("site"))
    near = nearest.nearest(at.select("subject", G.utm(C("lat"), C("lon")).alias("u")).select("subject", C("u.east").alias("x"), C("u.north").alias("y")), sites, cell=12_000.0)
    return at.join(near, "subject", "left").select("subject", "origin", "error", "feature", F.round(C("metres") * G.FEET, 1).alias("feet"))


@query("c17_distance_distribution", f"{_NEAR} SELECT layer, count(*) AS n, round(median(feet), 2) AS med, count(*) FILTER (feet <= 20000) AS near FROM n WHERE r = 1 GROUP BY 1")
def c17(spark, sf):
    n = _near(spark, sf).withColumn("feet", C("metres") * G.FEET)
    near = n.groupBy("layer").agg(F.count_if(C("feet") <= 20000).alias("near"))
    return scan.medians(n, ["layer"], "feet").join(near, "layer").select("layer", "n", F.round("median", 2).alias("med"), "near")


#: Reaches of water between two mapped points, and the window of a figure around each customer.
_REACH = _NEAR[: _NEAR.index("\nd AS")] + """
w AS (SELECT k, east - 2500 AS l, north - 2500 AS b, east + 2500 AS r, north + 2500 AS t FROM p),
g AS (SELECT f, layer, east AS x1, north AS y1, east + (f * 7919 % 9001) - 4500 AS x2, north + (f * 104729 % 8009) - 4000 AS y2 FROM s),
c AS (SELECT k, f, layer, CASE WHEN x1 = x2 THEN CASE WHEN x1 BETWEEN l AND r THEN 0.0 ELSE 2.0 END ELSE least((l - x1) / (x2 - x1), (r - x1) / (x2 - x1)) END AS a0, CASE WHEN x1 = x2 THEN 1.0 ELSE greatest((l - x1) / (x2 - x1), (r - x1) / (x2 - x1)) END AS a1,
CASE WHEN y1 = y2 THEN CASE WHEN y1 BETWEEN b AND t THEN 0.0 ELSE 2.0 END ELSE least((b - y1) / (y2 - y1), (t - y1) / (y2 - y1)) END AS b0, CASE WHEN y1 = y2 THEN 1.0 ELSE greatest((b - y1) / (y2 - y1), (t - y1) / (y2 - y1)) END AS b1 FROM w, g)"""


@query("j6_window_features", f"{_REACH} SELECT k AS subject, layer, f AS feature FROM c WHERE greatest(a0, b0, 0) <= least(a1, b1, 1)")
def j6(spark, sf):
    p, s = _places(spark, sf)
    shapes = s.select("feature", "layer", C("x1"), C("y1"), (C("x1") + (C("feature") * 7919 % 9001) - 4500).alias("x2"), (C("y1") + (C("feature") * 104729 % 8009) - 4000).alias("y2"))
    shapes = shapes.withColumns({"xmin": F.least("x1", "x2"), "ymin": F.least("y1", "y2"), "xmax": F.greatest("x1", "x2"), "ymax": F.greatest("y1", "y2")})
    windows = p.select("subject", (C("x") - 2500).alias("wxmin"), (C("y") - 2500).alias("wymin"), (C("x") + 2500).alias("wxmax"), (C("y") + 2500).alias("wymax"))
    exact = G.meets_box(*[C(c) for c in ("x1", "y1", "x2", "y2", "wxmin", "wymin", "wxmax", "wymax")])
    return rtree.range_join(windows, rtree.pack(shapes, ["feature"]), "subject", exact).select("subject", "layer", "feature")


SYM = "SELECT l_orderkey AS sheet, l_returnflag AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS id, l_quantity AS lft, l_tax * 100 AS top, 5.0 AS w, 4.0 AS h FROM lineitem"


def symbols(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return read(spark, sf, "lineitem").select(C("l_orderkey").alias("sheet"), C("l_returnflag").alias("label"), F.row_number().over(w).alias("id"), C("l_quantity").alias("left"), (C("l_tax") * 100).alias("top"), F.lit(5.0).alias("width"), F.lit(4.0).alias("height"))


_GAP = f"""WITH s AS ({SYM}), p AS (SELECT a.sheet, a.id AS a_id, b.id AS b_id, a.lft AS al, a.top AS tp, b.lft AS bl, b.top AS bt FROM s a JOIN s b ON a.sheet = b.sheet AND a.label = 'N' AND b.label = 'R'),
x AS (SELECT *, least(greatest(bl + 2.5, al), al + 5) AS x1, least(greatest(bt + 2, tp), tp + 4) AS y1 FROM p), y AS (SELECT *, least(greatest(x1, bl), bl + 5) AS x2, least(greatest(y1, bt), bt + 4) AS y2 FROM x),
z AS (SELECT *, round(sqrt(power(least(greatest(x2, al), al + 5) - x2, 2) + power(least(greatest(y2, tp), tp + 4) - y2, 2)), 6) AS gap FROM y), q AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY gap, a_id, b_id) AS r FROM z)"""


@query("j8_nearest_pair", f"{_GAP} SELECT sheet, a_id, b_id, gap FROM q WHERE r = 1")
def j8(spark, sf):
    return drawing.nearest_pair(symbols(spark, sf), "N", "R")


@query("c18_measure", f"{_GAP} SELECT sheet, round(gap * 2.5, 4) AS feet, CASE WHEN gap * 2.5 < 3 THEN 'smaller than its uncertainty' WHEN abs(gap * 2.5 - 25) <= 3 THEN 'within its uncertainty of the threshold' END AS withheld FROM q WHERE r = 1")
def c18(spark, sf):
    m = drawing.nearest_pair(symbols(spark, sf), "N", "R").withColumn("feet", C("gap") * 2.5)
    return m.select("sheet", F.round("feet", 4).alias("feet"), G.withheld(F.lit(True), C("feet"), F.lit(3.0), F.lit(25.0)).alias("withheld"))


@query("j10_swapped_labels", f"WITH s AS ({SYM}) SELECT a.sheet, a.id AS a, b.id AS b FROM s a JOIN s b ON a.sheet = b.sheet AND a.id < b.id AND a.label <> b.label WHERE abs(a.lft - b.top) + 2 < abs(a.lft - a.top) AND abs(b.lft - a.top) + 2 < abs(b.lft - b.top)")
def j10(spark, sf):
    s = symbols(spark, sf)
    a, b = s.alias("a"), s.alias("b")
    near = lambda x, y: F.abs(C(f"{x}.left") - C(f"{y}.top"))
    return a.join(b, (C("a.sheet") == C("b.sheet")) & (C("a.id") < C("b.id")) & (C("a.label") != C("b.label"))).where((near("a", "b") + 2 < near("a", "a")) & (near("b", "a") + 2 < near("b", "b"))).select(C("a.sheet").alias("sheet"), C("a.id").alias("a"), C("b.id").alias("b"))


@query("a24_vision_score", "WITH s AS (SELECT l_returnflag AS label, l_quantity AS d FROM lineitem) SELECT label, count(*) FILTER (d <= 20) AS matched, count(*) FILTER (d > 20) AS missed, round(avg(d) FILTER (d <= 20), 4) AS mean, max(d) FILTER (d <= 20) AS worst, round(100 * avg(d) FILTER (d <= 20) / sqrt(885 * 885 + 1259 * 1259), 4) AS pct FROM s GROUP BY 1")
def a24(spark, sf):
    d = read(spark, sf, "lineitem").select(C("l_returnflag").alias("label"), C("l_quantity").alias("d"))
    near = F.when(C("d") <= 20, C("d"))
    return d.groupBy("label").agg(F.count(near).alias("matched"), F.count_if(C("d") > 20).alias("missed"), F.round(F.avg(near), 4).alias("mean"), F.max(near).alias("worst"), F.round(100 * F.avg(near) / F.lit((885**2 + 1259**2) ** 0.5), 4).alias("pct"))


@query("c23_vision_evaluation", None)
def c23(spark, sf):
    """All symbols as found; as truth a moved copy of them, without some and with two labels crossed on others. Both of a kind are numbered by id."""
    s = symbols(spark, sf).select("sheet", "label", C("left").alias("x"), C("top").alias("y"), C("id").cast("long").alias("id"))
    crossed = F.when(C("id") % 4 == 0, F.translate("label", "NR", "RN")).otherwise(C("label"))
    truth = s.where("(sheet + id) % 11 <> 0").select("sheet", crossed.alias("label"), C("id").alias("tid"), (C("x") + C("id") * 7 % 5 - 2).alias("tx"), (C("y") + C("id") * 3 % 7 - 3).alias("ty"))
    return drawing.scores(s.where("(sheet + id) % 13 <> 0"), truth)


@query("a25_sited_counts", "SELECT l_returnflag AS label, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def a25(spark, sf):
    return read(spark, sf, "lineitem").where("l_linestatus = 'F'").groupBy(C("l_returnflag").alias("label")).agg(F.count("*").alias("n"))


@query("p12_detection_filter", f"WITH s AS ({SYM}) SELECT sheet, id, least(w, 52 - lft) AS w FROM s WHERE label IN ('N', 'R') AND lft < 52 AND lft + w <= 52 * 1.001 AND least(w, 52 - lft) > 0")
def p12(spark, sf):
    w = F.least(C("width"), F.lit(52.0) - C("left"))
    return symbols(spark, sf).where(C("label").isin("N", "R") & (C("left") < 52) & (C("left") + C("width") <= 52 * 1.001) & (w > 0)).select("sheet", "id", w.alias("w"))


@query("w6_topk_cosine", "WITH q AS (SELECT vec_id AS q, embedding AS x FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q, vec_id, list_cosine_similarity(CAST(x AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS s FROM q CROSS JOIN embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS rank FROM s) SELECT q, vec_id, rank, round(s, 6) AS score FROM r WHERE rank <= 5 AND s > 0")
def w6(spark, sf):
    e = read(spark, sf, "embeddings")
    return nearest.top_cosine(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5).withColumn("score", F.round("score", 6))


@query("c8_index_search", "WITH q AS (SELECT vec_id AS q, embedding AS x, label FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q, vec_id, list_cosine_similarity(CAST(x AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS s FROM q JOIN embeddings e ON e.label = q.label), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS rank FROM s) SELECT q, vec_id, rank, round(s, 6) AS score FROM r WHERE rank <= 3 AND s > 0")
def c8(spark, sf):
    e = read(spark, sf, "embeddings")
    return nearest.top_cosine(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 3, backend="label").withColumn("score", F.round("score", 6))


@query("c8_search_report", "WITH q AS (SELECT vec_id AS q, embedding AS x, CASE WHEN vec_id % 3 = 0 THEN 'other' ELSE CAST(label AS STRING) END AS backend FROM embeddings WHERE vec_id % 50 = 0), i AS (SELECT vec_id, embedding, CAST(label AS STRING) AS backend FROM embeddings), s AS (SELECT q, vec_id, list_cosine_similarity(CAST(x AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS s FROM q JOIN i USING (backend)), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS rank FROM s), f AS (SELECT q, max(rank) AS found, max(vec_id) FILTER (rank = 1) AS best FROM r WHERE rank <= 3 AND s > 0 GROUP BY 1) SELECT q, backend, (SELECT count(*) FROM i) AS index_size, backend NOT IN (SELECT backend FROM i) OR backend = '0' AS degraded, coalesce(found, 0) AS found, best FROM q LEFT JOIN f USING (q)")
def c8_report(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", "embedding", C("label").cast("string").alias("backend"))
    asked = e.where("vec_id % 50 = 0").withColumn("backend", F.when(C("vec_id") % 3 == 0, "other").otherwise(C("backend")))
    r = nearest.search_report(asked, e, "vec_id", "embedding", 3, "backend", fallback="0")
    return r.select("q", "backend", "index_size", "degraded", F.size("precedents").alias("found"), F.get("precedents", F.lit(0))["vec_id"].alias("best"))


def _doc_score_sql() -> str:
    return "(" + " + ".join([*(f"CASE WHEN contains(low, '{p}') THEN {w} ELSE 0 END" for p, w in pages.PHRASES.items())]) + ")"


@query("f32_page_score", f"WITH d AS (SELECT doc_id AS k, lower(text || ' site plan ' || CASE WHEN doc_id % 3 = 0 THEN 'graphic scale north' ELSE 'septic tank' END) AS low, doc_id % 20 AS fields FROM documents) SELECT k, round({_doc_score_sql()} * CASE WHEN fields > 12 THEN 0.4 ELSE 1 END, 4) AS score, contains(low, 'graphic scale') AS drawn FROM d")
def f32(spark, sf):
    d = read(spark, sf, "documents").select(C("doc_id").alias("k"), F.concat("text", F.lit(" site plan "), F.when(C("doc_id") % 3 == 0, "graphic scale north").otherwise("septic tank")).alias("txt"), (C("doc_id") % 20).alias("fields"))
    return d.select("k", pages.score(C("txt"), C("fields")).alias("s")).select("k", F.round("s.score", 4).alias("score"), C("s.drawn").alias("drawn"))


@query("c19_rank_pages", f"WITH d AS (SELECT doc_id, source, lower(text || CASE WHEN doc_id % 3 = 0 THEN ' graphic scale north' ELSE ' septic tank' END) AS low FROM documents), s AS (SELECT doc_id, source, {_doc_score_sql()} AS score, contains(low, 'graphic scale') AS drawn FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY drawn DESC, score DESC, doc_id) AS pos FROM s) SELECT source, doc_id, round(score, 4) AS score FROM r WHERE pos = 1 AND score >= 5")
def c19(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", F.concat("text", F.when(C("doc_id") % 3 == 0, " graphic scale north").otherwise(" septic tank")).alias("txt"))
    s = d.select("doc_id", "source", pages.score(C("txt"), F.lit(0)).alias("s")).select("doc_id", "source", "s.score", "s.drawn")
    return R.first_by(s, ["source"], F.desc("drawn"), F.desc("score"), "doc_id").where("score >= 5").select("source", "doc_id", F.round("score", 4).alias("score"))


@on("f33_page_flags", Source("documents", k="doc_id", low="lower(text)"), "SELECT k, contains(low, 'licensed') OR contains(low, ' plan') AS plan, contains(low, 'question') OR contains(low, ' que ') AS form FROM src")
def f33(d):
    some = lambda *w: F.exists(F.array(*[F.lit(x) for x in w]), lambda k: F.contains("low", k))
    return d.select("k", some("licensed", " plan").alias("plan"), some("question", " que ").alias("form"))


@on("f34_page_evidence", Source("documents", k="doc_id", txt="text"), "SELECT k, least(len(regexp_extract_all(txt, '[0-9]+')) * 2, 6) + CASE WHEN length(txt) > 3000 THEN -3 ELSE 0 END AS score FROM src")
def f34(d):
    return d.select("k", (F.least(F.regexp_count("txt", F.lit("[0-9]+")) * 2, F.lit(6)) + F.when(F.length("txt") > 3000, -3).otherwise(0)).alias("score"))


@query("g18_ring_positions", "SELECT n_nationkey AS k, round(cos(2 * pi() * (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) / count(*) OVER (PARTITION BY n_regionkey)), 6) AS x FROM nation")
def g18(spark, sf):
    w = Window.partitionBy("n_regionkey")
    turn = (F.row_number().over(w.orderBy("n_nationkey")) - 1) / F.count("*").over(w)
    return read(spark, sf, "nation").select(C("n_nationkey").alias("k"), F.round(F.cos(2 * F.pi() * turn), 6).alias("x"))


@query("g10_ink_runs", "WITH v AS (SELECT l_suppkey AS img, CAST(l_quantity AS INT) AS col FROM lineitem GROUP BY 1, 2 HAVING count(*) > 2), g AS (SELECT img, col, col - row_number() OVER (PARTITION BY img ORDER BY col) AS grp FROM v), r AS (SELECT img, min(col) AS a, count(*) AS n FROM g GROUP BY img, grp) SELECT img, a AS start, n AS length FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY n DESC, a) AS k FROM r) WHERE k = 1")
def g10(spark, sf):
    v = read(spark, sf, "lineitem").groupBy(C("l_suppkey").alias("img"), C("l_quantity").cast("int").alias("col")).count().where("count > 2")
    g = v.withColumn("grp", C("col") - F.row_number().over(Window.partitionBy("img").orderBy("col")))
    r = g.groupBy("img", "grp").agg(F.min("col").alias("start"), F.count("*").alias("length"))
    return R.first_by(r, ["img"], F.desc("length"), "start").select("img", "start", "length")


#: A page of each customer, 128 x 64: a bar of two bands, filled in turns, and a stamp at its height; and the box where the bar is said to be.
_BAR = {"k": "c_custkey", "l": "CAST(CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 10 + c_custkey % 12 END AS INT)", "t": "CAST(20 + c_custkey % 10 AS INT)", "q": "CAST(10 + c_custkey % 8 AS INT)", "blank": "c_custkey % 17 = 0", "wide": "c_custkey % 13 = 0"}


def bar_pages(d):
    """Pages drawn as runs of bytes: bands of a bar of four parts, each ``q`` wide and three rows high."""
    paper = lambda n: F.repeat(F.lit("ff"), n)
    ink = lambda n: F.when(C("blank"), F.repeat(F.lit("ff"), n)).otherwise(F.repeat(F.lit("20"), n))
    q, rest = C("q"), 128 - C("l") - 4 * C("q") - 6
    row = lambda *parts: F.concat(paper(C("l")), *parts, paper(rest), ink(F.lit(4)), paper(F.lit(2)))
    upper, lower = row(ink(q), paper(q), ink(q), paper(q)), row(paper(q), ink(q), paper(q), ink(q))
    pixels = F.unhex(F.concat(paper(128 * C("t")), F.repeat(upper, F.lit(3)), F.repeat(lower, F.lit(3)), paper(128 * (58 - C("t")))))
    told = F.when(C("wide"), 12 * q).otherwise(4 * q + C("k").cast("int") % 7 - 3)
    return d.select("k", F.lit(128).alias("width"), F.lit(64).alias("height"), pixels.alias("pixels"), (C("l") + C("k").cast("int") % 5 - 2).alias("bar_left"), (C("t") + C("k").cast("int") % 3 - 1).alias("bar_top"), told.alias("bar_width"), F.lit(6).alias("bar_height"))


@on("g10_scale_bars", Source("customer", **_BAR), "SELECT k, CASE WHEN fine THEN l END AS lft, CASE WHEN fine THEN 4 * q - 1 END AS length, CASE WHEN fine THEN t END AS top, CASE WHEN fine THEN 6 END AS band, CASE WHEN fine THEN l = 0 END AS clipped, CASE WHEN blank THEN 'no ink' WHEN wide THEN 'not the bar' END AS refused FROM (SELECT *, NOT blank AND NOT wide AS fine FROM src)")
def g10_bars(d):
    return raster.measure_bars(bar_pages(d), "k").select("k", C("left").alias("lft"), "length", "top", "band", "clipped", "refused")


@on("st7_refined_symbols", Source("customer", **_BAR), "SELECT k, CASE WHEN blank THEN 64 ELSE l END AS lft, CASE WHEN blank THEN 30 ELSE t END AS top, CASE WHEN blank THEN 5 ELSE 4 * q END AS w, CASE WHEN blank THEN 'lost' WHEN greatest(56, floor(4 * q * CAST(1.7 AS DOUBLE)), 2 * floor(0.15 * one) + 4 * q) >= one THEN 'same window' ELSE 'settled' END AS ended FROM (SELECT *, greatest(56, floor(4 * q * CAST(1.7 AS DOUBLE)), 38 + 4 * q) AS one FROM src)")
def st7(d):
    """The bar, first told a few pixels off, is found again by its ink; a blank page has nothing to find."""
    told = d.select("k", F.when(C("blank"), 64).otherwise(C("l") + 3).alias("left"), F.when(C("blank"), 30).otherwise(C("t") + 2).alias("top"), F.when(C("blank"), 5).otherwise(4 * C("q")).alias("width"), F.lit(6).alias("height"), F.lit(128).alias("page_width"), F.lit(64).alias("page_height"))
    return raster.refine(told, raster.ink_box(bar_pages(d), "k", ["k"]), ["k"]).select("k", C("left").alias("lft"), "top", C("width").alias("w"), "ended")
