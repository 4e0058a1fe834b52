"""Bars by their ink and symbols found again, against plain loops."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import raster

X = random.Random(3)
SCHEMA = "k long, width int, height int, pixels binary, bar_left int, bar_top int, bar_width int, bar_height int"


def plain(page, left, top, wide, high):
    """Pixel by pixel."""
    pad = int(0.25 * max(wide, high))
    x0, y0, x1, y1 = max(0, left - pad), max(0, top - pad), max(0, min(len(page[0]), left + wide + pad)), max(0, min(len(page), top + high + pad))
    crop = [[v < 160 for v in row[x0:x1]] for row in page[y0:y1]]
    if not crop or not crop[0]:
        return "empty region"
    counts = [sum(r) for r in crop]
    if max(counts) == 0:
        return "no ink"
    a = b = counts.index(max(counts))
    enough = max(1, int(0.15 * max(counts)))
    while a > 0 and counts[a - 1] >= enough:
        a -= 1
    while b + 1 < len(counts) and counts[b + 1] >= enough:
        b += 1
    dark = [any(crop[y][x] for y in range(a, b + 1)) for x in range(x1 - x0)]
    tolerance, runs, last = max(2, int(0.01 * len(dark))), [], None
    for x, on in enumerate(dark):
        if on:
            if last is not None and x - last <= tolerance:
                runs[-1][1] = x
            else:
                runs.append([x, x])
            last = x
    near = [r for r in runs if r[1] >= left - x0 and r[0] <= left + wide - x0] or runs
    longest = max(r[1] - r[0] for r in near)
    s, e = next(r for r in near if r[1] - r[0] == longest)
    if e - s < 8:
        return "too short"
    if wide > 0 and not 0.5 <= (e - s) / wide <= 2:
        return "not the bar"
    return (x0 + s, x0 + e, e - s, y0 + a, b - a + 1, s <= 1 or e >= len(dark) - 2)


def page(kind):
    w, h = X.randint(30, 150), X.randint(20, 60)
    p = np.full((h, w), 255, np.uint8)
    if kind != "blank":
        t, left, n = X.randint(0, h - 8), X.randint(0, w - 20), X.randint(4, w)
        p[t : t + 2, left : left + n : 2 if kind == "dashed" else 1] = 10
        p[t + 2 : t + X.randint(2, 6), left : left + n] = X.choice([10, 159, 160])
        for _ in range(X.randint(0, 60)):
            p[X.randrange(h), X.randrange(w)] = 0
    return p


def test_bars_like_plain_loops(spark):
    rows, want = [], {}
    for k in range(300):
        p = page(X.choice(["solid", "dashed", "blank"]) if k % 7 else "solid")
        box = (X.randint(-5, p.shape[1] + 3), X.randint(-3, p.shape[0] + 3), X.randint(0, 60), X.randint(0, 9))
        rows.append((k, p.shape[1], p.shape[0], p.tobytes(), *box))
        want[k] = plain(p.tolist(), *box)
    rows += [(900, 10, 10, None, 1, 1, 5, 5), (901, 10, 10, b"\0" * 100, None, 1, 5, 5), (902, 0, 0, b"", 0, 0, 5, 5)]
    want |= dict.fromkeys((900, 901, 902), "empty region")
    got = {r.k: r.refused or (r.left, r.right, r.length, r.top, r.band, r.clipped) for r in raster.measure_bars(spark.createDataFrame(rows, SCHEMA).repartition(3), "k").collect()}
    assert got == want
    assert {"no ink", "too short", "not the bar", "empty region"} <= set(map(str, want.values())) and sum(isinstance(v, tuple) for v in want.values()) > 30


def test_symbols_end_as_they_should(spark):
    """Each pass halves the error, never seen, no area, or still where it was; told by a made-up locator that reads the window only."""
    schema = "k long, left int, top int, width int, height int, page_width int, page_height int"
    told = [(k, X.randint(0, 900), X.randint(0, 700), X.randint(4, 60), X.randint(4, 60), 1000, 800) for k in range(60)]
    symbols = spark.createDataFrame(told, schema)

    def locate(asked):
        step = F.when(F.col("k") % 3 == 0, 0).when(F.col("k") % 3 == 1, 40).otherwise(90)
        out = asked.where("k % 5 <> 4").withColumn("zoom", F.lit(4.0))
        return out.select("k", "zoom", ((F.col("left") + step - F.col("x0")) * 4.0).alias("fleft"), ((F.col("top") - F.col("y0")) * 4.0).alias("ftop"), F.when(F.col("k") % 5 == 3, 0.0).otherwise(F.col("width") * 4.0).alias("fwidth"), (F.col("height") * 4.0).alias("fheight"))

    def loop(k, left, top, w, h, pw, ph):
        view, n = max(pw, ph), 0
        for i in range(4):
            span = max(w, h)
            side = min(max(56, int(span * (1 + 2 * 0.35)), 2 * int(0.15 * view) + span), max(pw, ph))
            if i and side >= view:
                return (left, top, w, h, n, "same window")
            if k % 5 >= 3:
                return (left, top, w, h, n, "lost")
            new = max(0, min(pw - 1, left + (0, 40, 90)[k % 3]))
            nw, nh = max(1, min(w, pw - new)), max(1, min(h, ph - top))
            moved = math.dist((left + w / 2, top + h / 2), (new + nw / 2, top + nh / 2))
            left, w, h, n, view = new, nw, nh, n + 1, side
            if moved <= 3:
                return (left, top, w, h, n, "settled")
            if side <= 56:
                return (left, top, w, h, n, "floor")
        return (left, top, w, h, n, "passes")

    got = {r.k: (r.left, r.top, r.width, r.height, r.passes, r.ended) for r in raster.refine(symbols, locate, ["k"]).collect()}
    assert got == {t[0]: loop(*t) for t in told}
    assert {v[5] for v in got.values()} >= {"settled", "lost"} and max(v[4] for v in got.values()) > 1
    assert raster.refine(symbols.limit(0), locate, ["k"]).count() == 0


def test_pages_are_not_broadcast(spark):
    pages = spark.range(8).selectExpr("id as k", "8 as width", "8 as height", "unhex(repeat('20', 64)) as pixels")
    asked = spark.range(8).selectExpr("id as k", "0 as x0", "0 as y0", "8 as side")
    seen = raster.ink_box(pages, "k", ["k"])(asked)
    assert "BroadcastHashJoin" not in seen._jdf.queryExecution().executedPlan().toString()
    assert {(r.fleft, r.fwidth, r.fheight) for r in seen.collect()} == {(0.0, 8.0, 8.0)}
