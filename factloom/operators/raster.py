"""Pages as rasters: scale bars measured by their ink, and symbols found again in ever smaller windows.

A page is a row with ``width, height`` and ``pixels``, one byte of grey for each pixel, row by row. Only the rows of a page that a window covers are cut out, as an
expression, before anything goes to Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.geo import crop_to_page
from factloom.sources.files import checkpoint_dir

#: Grey of ink, what a crop has around a bar, least share of the densest row, gap that is bridged (share and pixels), shortest bar, its length against the box's.
INK, BAR_PAD, ROW_SHARE, GAP_SHARE, GAP, SHORTEST, RATIO = 160, 0.25, 0.15, 0.01, 2, 8, (0.5, 2.0)
#: Error of a pass as a share of its view, what a window has around a symbol, its least side, passes, and the move that ends them.
ALLOWANCE, REFINE_PAD, FLOOR, PASSES, SETTLED = 0.15, 0.35, 56, 4, 3
FOUND = "left int, right int, length int, top int, band int, clipped boolean, refused string"


def measure_ink(crop: np.ndarray, low: int, high: int, width: int) -> dict:
    """The bar in a crop, in its own pixels, told to be between columns ``low`` and ``high``, ``width`` wide.

    The band is the densest row and those around it that hold enough ink; columns with ink anywhere in the band make runs, across small gaps; the longest run that
    meets the told columns is the bar, or the longest of all if none does. A run at the crop's edge is clipped.
    """
    if crop.size == 0:
        return {"refused": "empty region"}
    ink = crop < INK
    rows = ink.sum(axis=1)
    if not rows.any():
        return {"refused": "no ink"}
    seed, thin = int(rows.argmax()), np.flatnonzero(rows < max(1, int(ROW_SHARE * rows.max())))
    top, bottom = max(thin[thin < seed], default=-1) + 1, min(thin[thin > seed], default=len(rows)) - 1
    columns = np.flatnonzero(ink[top : bottom + 1].any(axis=0))
    breaks = np.flatnonzero(np.diff(columns) > max(GAP, int(GAP_SHARE * crop.shape[1])))
    starts, ends = columns[np.append(0, breaks + 1)], columns[np.append(breaks, len(columns) - 1)]
    meets = (ends >= low) & (starts <= high)
    if meets.any():
        starts, ends = starts[meets], ends[meets]
    best = int((ends - starts).argmax())
    left, right = int(starts[best]), int(ends[best])
    length = right - left
    if length < SHORTEST:
        return {"refused": "too short"}
    if width > 0 and not RATIO[0] <= length / width <= RATIO[1]:
        return {"refused": "not the bar"}
    return {"left": left, "right": right, "length": length, "top": int(top), "band": int(bottom - top + 1), "clipped": left <= 1 or right >= crop.shape[1] - 2}


def _rows_of(y0: Column, y1: Column) -> Column:
    """The bytes of a page's rows from y0 to before y1."""
    return F.substring("pixels", y0 * F.col("width") + 1, F.greatest(y1 - y0, F.lit(0)) * F.col("width"))


def measure_bars(pages: DataFrame, key: str) -> DataFrame:
    """``key, left, right, length, top, band, clipped, refused`` of ``pages(key, width, height, pixels, bar_left, bar_top, bar_width, bar_height)``, whole numbers in page pixels.

    Either the measure or the reason of its refusal is null. A page without pixels, or a null in its box or size, is refused as an empty region.
    """
    n = lambda c: F.col(c).cast("int")
    pad = F.floor(F.lit(BAR_PAD) * F.greatest("bar_width", "bar_height")).cast("int")
    clamp = lambda v, most: F.least(F.greatest(v, F.lit(0)), n(most))
    box = {"_x0": clamp(n("bar_left") - pad, "width"), "_y0": clamp(n("bar_top") - pad, "height"), "_x1": clamp(n("bar_left") + n("bar_width") + pad, "width"), "_y1": clamp(n("bar_top") + n("bar_height") + pad, "height")}
    known = pages.select(key, n("width").alias("width"), "pixels", "bar_left", "bar_width", *[c.alias(k) for k, c in box.items()])
    cut = known.select(key, "width", n("bar_left").alias("_at"), n("bar_width").alias("_wide"), *box, _rows_of(F.col("_y0"), F.col("_y1")).alias("_bytes"))

    told = ["_at", "_wide", *box]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                got = {"refused": "empty region"}
                if r["_bytes"] and not any(pd.isna(r[c]) for c in told):
                    x0, y0, x1 = int(r["_x0"]), int(r["_y0"]), int(r["_x1"])
                    rows = np.frombuffer(r["_bytes"], np.uint8)
                    rows = rows[: len(rows) // int(r["width"]) * int(r["width"])].reshape(-1, int(r["width"]))
                    at = int(r["_at"]) - x0
                    got = measure_ink(rows[:, x0:x1], at, at + int(r["_wide"]), int(r["_wide"]))
                    if "left" in got:
                        got |= {"left": got["left"] + x0, "right": got["right"] + x0, "top": got["top"] + y0}
                out.append({key: r[key], **got})
            yield pd.DataFrame(out, columns=[key, *[c.split()[0] for c in FOUND.split(", ")]]).astype({c: "Int32" for c in ("left", "right", "length", "top", "band")} | {"clipped": "boolean"})

    return cut.mapInPandas(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, {FOUND}")


def window_side(span: Column, view: Column, edge: Column) -> Column:
    """Side of the window that a symbol is looked for in, after a pass that saw ``view``: it holds that pass' error, keeps some surroundings, and isn't larger than the page's edge."""
    whole = lambda c: F.floor(c).cast("int")
    return F.least(F.greatest(F.lit(FLOOR), whole(span * (1 + 2 * REFINE_PAD)), 2 * whole(view * ALLOWANCE) + span), edge)


def refine(symbols: DataFrame, locate: Callable[[DataFrame], DataFrame], key: list[str], passes: int = PASSES) -> DataFrame:
    """``*key, left, top, width, height, passes, ended``: symbols found again in windows around them until they settle.

    ``symbols(*key, left, top, width, height, page_width, page_height)`` in whole pixels, without nulls; ``key`` is unique. ``locate`` takes rows with the window ``x0, y0, side`` and gives ``*key, zoom`` and the box
    ``fleft, ftop, fwidth, fheight`` in the enlarged window, at most one row of a symbol, none or a null where it isn't seen or has no area.
    A symbol ends as ``settled`` (moved by SETTLED pixels at most), ``floor`` (least window), ``same window`` (it would not shrink), ``lost`` (not found again, the last place is kept) or ``passes``.
    Only symbols that haven't ended take part in the next pass; what a pass found is written, so the plan doesn't grow.
    """
    checkpoint_dir(symbols.sparkSession)
    box = ["left", "top", "width", "height"]
    edge = F.greatest("page_width", "page_height")
    active = symbols.select(*key, *[F.col(c).cast("int").alias(c) for c in (*box, "page_width", "page_height")]).withColumns({"_view": edge, "passes": F.lit(0)})
    out = None
    for k in range(passes):
        active = active.withColumn("side", window_side(F.greatest("width", "height"), F.col("_view"), edge))
        start = lambda at, size, most: F.greatest(F.lit(0), F.least(F.floor(F.col(at) + F.col(size) / 2 - F.col("side") / 2).cast("int"), F.col(most) - F.col("side")))
        asked = active.withColumns({"x0": start("left", "width", "page_width"), "y0": start("top", "height", "page_height")})
        same = F.lit(k > 0) & (F.col("side") >= F.col("_view"))
        seen = locate(asked.where(~same)).select(*key, "zoom", "fleft", "ftop", "fwidth", "fheight")
        met = asked.join(seen, key, "left")
        found = ~same & F.coalesce((F.bround("fwidth") > 0) & (F.bround("fheight") > 0) & F.col("fleft").isNotNull() & F.col("ftop").isNotNull(), F.lit(False))
        new = crop_to_page({c: F.bround(f"f{c}") for c in box}, F.col("zoom"), F.col("x0"), F.col("y0"), F.col("page_width"), F.col("page_height"))
        met = met.withColumns({"_found": found, "_same": same, "_new": new})
        moved = F.hypot(F.col("left") + F.col("width") / 2 - F.col("_new.left") - F.col("_new.width") / 2, F.col("top") + F.col("height") / 2 - F.col("_new.top") - F.col("_new.height") / 2)
        ended = F.when(F.col("_same"), "same window").when(~F.col("_found"), "lost").when(moved <= SETTLED, "settled").when(F.col("side") <= FLOOR, "floor").when(F.lit(k == passes - 1), "passes")
        met = met.withColumn("ended", ended)
        met = met.withColumns({**{c: F.when(F.col("_found"), F.col(f"_new.{c}").cast("int")).otherwise(F.col(c)) for c in box}, "passes": F.col("passes") + F.col("_found").cast("int"), "_view": F.when(F.col("_found"), F.col("side")).otherwise(F.col("_view"))})
        met = met.select(*key, *box, "page_width", "page_height", "_view", "passes", "ended").checkpoint()
        done = met.where("ended is not null").select(*key, *box, "passes", "ended")
        out = done if out is None else out.unionByName(done)
        active = met.where("ended is null").drop("ended")
        if k < passes - 1 and not active.take(1):
            break
    return out


def ink_box(pages: DataFrame, page: str, key: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A ``locate`` for ``refine``: the box of all ink in the window, at zoom 1. ``pages(page, width, height, pixels)``; symbols have the page's key."""

    def locate(asked: DataFrame) -> DataFrame:
        own = pages.select(F.col(page).alias("_page"), F.col("width").alias("_w"), "pixels")
        # pages are large though their files may be small: they must not be broadcast
        cut = asked.hint("merge").join(own, asked[page] == F.col("_page")).select(*key, F.col("_w").cast("int").alias("width"), "x0", "y0", "side", "pixels")
        cut = cut.select(*key, "width", "x0", "side", _rows_of(F.col("y0"), F.col("y0") + F.col("side")).alias("_bytes"))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for *own_key, width, x0, side, data in f.itertuples(index=False, name=None):
                    rows = np.frombuffer(data or b"", np.uint8)
                    ink = rows[: len(rows) // width * width].reshape(-1, width)[:, x0 : x0 + side] < INK
                    y, x = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
                    if len(x):
                        out.append((*own_key, 1.0, float(x[0]), float(y[0]), float(x[-1] - x[0] + 1), float(y[-1] - y[0] + 1)))
                yield pd.DataFrame(out, columns=[*key, "zoom", "fleft", "ftop", "fwidth", "fheight"])

        kinds = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in key)
        return cut.mapInPandas(run, f"{kinds}, zoom double, fleft double, ftop double, fwidth double, fheight double")

    return locate
