"""Geometry in numbers: projection, distance, bearings, boxes, scales."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

FEET = 3.280839895
POINTS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
#: Lengths of a scale bar; feet per unit.
BARS = [25, 50, 100, 200, 250, 500, 1000, 2000, 5000]
UNIT_FEET = {"ft": 1.0, "feet": 1.0, "foot": 1.0, "in": 1 / 12, "inch": 1 / 12, "inches": 1 / 12, "m": FEET, "meter": FEET, "meters": FEET, "yd": 3.0, "yard": 3.0, "yards": 3.0}
#: WGS84 and zone 18 north.
A, FLAT, K0, LON0, EAST0 = 6378137.0, 1 / 298.257223563, 0.9996, -75.0, 500000.0


def _series() -> tuple[float, list[float], float]:
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return radius, [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240], 2 * sqrt(n) / (1 + n)


def utm(lat: Column, lon: Column) -> Column:
    """Easting and northing in metres, zone 18 north."""
    radius, alpha, e = _series()
    phi, lam = F.radians(lat), F.radians(lon - LON0)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((EAST0 + K0 * radius * east).alias("east"), (K0 * radius * north).alias("north"))


def from_utm(east: Column, north: Column) -> Column:
    """Latitude and longitude in degrees from zone 18 north."""
    n = FLAT / (2 - FLAT)
    radius, _, _ = _series()
    xi0, eta0 = north / (K0 * radius), (east - EAST0) / (K0 * radius)
    xi, eta = xi0, eta0
    for j, b in enumerate([n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480], 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate([2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15], 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.struct(F.degrees(phi).alias("lat"), (LON0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))).alias("lon"))


def ring_segments(rings: Column) -> Column:
    """Segments of rings of points ``x, y``: where they begin (``x, y``), how far they go (``dx, dy``) and the ``y`` where they end (``end``); rings of one point or none have none."""
    segment = lambda a, b: F.named_struct(F.lit("x"), a["x"], F.lit("y"), a["y"], F.lit("dx"), b["x"] - a["x"], F.lit("dy"), b["y"] - a["y"], F.lit("end"), b["y"])
    pairs = lambda r: F.when(F.size(r) > 1, F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), segment))
    return F.flatten(F.filter(F.transform(rings, pairs), lambda x: x.isNotNull()))


def to_polygon(px: Column, py: Column, rings: Column) -> Column:
    """Distance from a point to a polygon of closed rings (the first outside, the others holes): 0 inside, null without segments.

    Lambdas are interpreted, node by node: segments, and where on them the nearest point is, are each computed once and bound to a name by a ``transform``.
    """
    crosses = lambda s: ((s["y"] > py) != (s["end"] > py)) & (px < s["dx"] * (py - s["y"]) / F.nullif(s["dy"], F.lit(0.0)) + s["x"])
    length = lambda s: s["dx"] * s["dx"] + s["dy"] * s["dy"]
    along = lambda s: F.when(length(s) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - s["x"]) * s["dx"] + (py - s["y"]) * s["dy"]) / length(s))))
    near = lambda s: F.named_struct(F.lit("s"), s, F.lit("t"), along(s))
    far = lambda n: F.hypot(px - (n["s"]["x"] + n["t"] * n["s"]["dx"]), py - (n["s"]["y"] + n["t"] * n["s"]["dy"]))
    distance = lambda s: F.when(F.size(F.filter(s, crosses)) % 2 == 1, F.lit(0.0)).otherwise(F.array_min(F.transform(F.transform(s, near), far)))
    return F.get(F.transform(F.array(ring_segments(rings)), distance), F.lit(0))


def to_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.when(length == 0, F.lit(1.0)).otherwise(length))))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def meets_box(x1: Column, y1: Column, x2: Column, y2: Column, left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """Whether a segment has a point in a closed box: the stretches of it between the box's sides, in x and in y, overlap."""

    def stretch(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
        d = F.when(a == b, F.lit(1.0)).otherwise(b - a)
        s, t = (low - a) / d, (high - a) / d
        flat, inside = a == b, (a >= low) & (a <= high)
        return F.when(flat, F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(s, t)), F.when(flat, F.lit(1.0)).otherwise(F.greatest(s, t))

    (a0, a1), (b0, b1) = stretch(x1, x2, left, right), stretch(y1, y2, bottom, top)
    return F.greatest(a0, b0, F.lit(0.0)) <= F.least(a1, b1, F.lit(1.0))


def compass(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Sixteen-point bearing."""
    angle = F.pmod(F.degrees(F.atan2(x1 - x0, y1 - y0)), F.lit(360.0))
    at = F.floor(F.pmod(angle + 11.25, F.lit(360.0)) / 22.5).cast("int") + 1
    return F.element_at(F.array(*[F.lit(p) for p in POINTS]), at)


def scale_bar(span: Column) -> Column:
    """The bar length nearest to a quarter of the span, the smaller one on a tie."""
    return F.array_min(F.transform(F.array(*[F.lit(float(b)) for b in BARS]), lambda b: F.struct(F.abs(b - span * 0.25).alias("gap"), b.alias("bar"))))["bar"]


def box_gap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Gap of two boxes: clamp A to B's centre, B to that, A to that."""
    inside = lambda v, lo, hi: F.least(F.greatest(v, lo), hi)
    bx, by = b["left"] + b["width"] / 2, b["top"] + b["height"] / 2
    for_a = lambda x, y: (inside(x, a["left"], a["left"] + a["width"]), inside(y, a["top"], a["top"] + a["height"]))
    for_b = lambda x, y: (inside(x, b["left"], b["left"] + b["width"]), inside(y, b["top"], b["top"] + b["height"]))
    ax, ay = for_a(bx, by)
    bx, by = for_b(ax, ay)
    ax, ay = for_a(bx, by)
    return F.hypot(ax - bx, ay - by)


def uncertainty_feet(width: Column, height: Column, feet_per_pixel: Column) -> Column:
    return 0.0092 * F.hypot(width, height) * 1.414 * feet_per_pixel


def withheld(validated: Column, feet: Column, allowance: Column, threshold: Column) -> Column:
    """Why a measured distance isn't reported; null if it is."""
    return (
        F.when(~validated, "label not validated")
        .when(feet < allowance, "smaller than its uncertainty")
        .when(threshold.isNotNull() & (F.abs(feet - threshold) <= allowance), "within its uncertainty of the threshold")
    )


def to_feet(value: Column, unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for names, factor in {f: [u for u, g in UNIT_FEET.items() if g == f] for f in set(UNIT_FEET.values())}.items():
        out = F.when(F.lower(F.trim(unit)).isin(factor), value * names).otherwise(out)
    return out


def choose_scale(bar: Column, ratio: Column, clipped: Column) -> Column:
    """A graphic bar beats a written ratio, unless it is clipped and they disagree."""
    fine = lambda c: c.isNotNull() & c.between(0.005, 20.0)
    agree = 100 * (1 - F.abs(bar - ratio) / F.greatest(bar, ratio))
    both = fine(bar) & fine(ratio)
    use_ratio = (both & clipped & (agree < 85)) | (~fine(bar) & fine(ratio))
    return F.struct(F.when(use_ratio, ratio).when(fine(bar), bar).alias("feet_per_pixel"), F.when(use_ratio, "ratio_and_dpi").when(fine(bar), "graphic_bar").alias("source"), F.when(both, F.round(agree, 1)).alias("agreement_pct"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    lin = lambda v: F.when(v / 255 <= 0.03928, v / 255 / 12.92).otherwise(F.pow((v / 255 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * lin(r) + 0.7152 * lin(g) + 0.0722 * lin(b)


def contrast(x: Column, y: Column) -> Column:
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def crop_to_page(box: dict[str, Column], zoom: Column, x0: Column, y0: Column, width: Column, height: Column) -> Column:
    """A box found on an enlarged crop, in page pixels: scaled back, moved, clamped, one pixel at least."""
    left = F.least(F.greatest(F.bround(box["left"] / zoom + x0), F.lit(0.0)), width - 1)
    top = F.least(F.greatest(F.bround(box["top"] / zoom + y0), F.lit(0.0)), height - 1)
    w = F.greatest(F.lit(1.0), F.least(F.bround(box["width"] / zoom), width - left))
    h = F.greatest(F.lit(1.0), F.least(F.bround(box["height"] / zoom), height - top))
    return F.struct(left.alias("left"), top.alias("top"), w.alias("width"), h.alias("height"))
