"""Range joins with a packed R-tree: tables of shapes and of windows, each pair told once.

Packing is sort-tile-recursive: shapes are numbered by the middle of their boxes in x and cut into slices, numbered again by slice and the middle in y, and pages are
runs of those numbers. A page's parent is its number divided by the fan-out, and so on up to a root of at most FANOUT boxes. Both numberings are two-level scans, so
nothing is sorted in one task. A join goes down level by level: windows meet the children of the nodes they touch, in the end the shapes of their pages.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import scan

#: Shapes of a page, children of a node, and parts that a node's windows are dealt to, so that a busy region isn't one task's.
PAGE, FANOUT, SALT = 64, 32, 16
#: Windows times pages of a task of the last join, where a window touches few of the pages; tasks at most.
TASK, MOST_TASKS = 8_000_000, 20_000
BOX = ("xmin", "ymin", "xmax", "ymax")


def pack(shapes: DataFrame, key: list[str], page: int = PAGE) -> DataFrame:
    """The shapes (with ``xmin, ymin, xmax, ymax``) and their ``page``; shapes with a null in their box have none and are left out. ``key`` breaks ties."""
    own = shapes.dropna(subset=list(BOX)).withColumns({"_mx": (F.col("xmin") + F.col("xmax")) / 2, "_my": (F.col("ymin") + F.col("ymax")) / 2})
    by_x = scan.ordinals(scan.placed(own, "_mx", *key), "_at").drop("_part", "_n")
    n = by_x.count()
    pages = max(1, ceil(n / page))
    slice_of = page * ceil(pages / ceil(sqrt(pages)))  # whole pages, so that none lies in two slices
    by_y = scan.ordinals(scan.placed(by_x.withColumn("_slice", F.floor(F.col("_at") / slice_of)), "_slice", "_my", *key), "_at").drop("_part", "_n")
    return by_y.withColumn("page", F.floor(F.col("_at") / page).cast("long")).drop("_mx", "_my", "_at", "_slice")


def _box(rows: DataFrame, by: Column) -> DataFrame:
    return rows.groupBy(by.alias("node")).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def levels(packed: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Boxes ``node, xmin, ymin, xmax, ymax`` of each level, pages first, the last of at most ``fanout`` rows."""
    out = [_box(packed, F.col("page")).checkpoint()]
    while out[-1].limit(fanout + 1).count() > fanout:
        out.append(_box(out[-1], F.floor(F.col("node") / fanout).cast("long")).checkpoint())
    return out


def touches(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def range_join(windows: DataFrame, packed: DataFrame, window: str, exact: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """Each window (``window, wxmin, wymin, wxmax, wymax`` and other columns) with each packed shape whose box touches its own and that ``exact`` agrees to, once.

    ``exact`` is a condition on columns of both. Windows with a null in their box touch nothing.
    """
    tree = levels(packed, fanout)
    own = {c: F.col(f"w{c}") for c in BOX}
    root = tree[-1].collect()  # at most ``fanout`` boxes
    if not root:
        return windows.join(packed.drop("page"), F.lit(False))
    boxes = F.array(*[F.struct(F.lit(r.node).alias("node"), *[F.lit(float(r[c])).alias(c) for c in BOX]) for r in root])
    # bytes tell little of a join's work, so its tasks are counted by windows and pages; windows are dealt out before the descent, a page's windows to parts after it
    parts = int(min(MOST_TASKS, max(packed.sparkSession.sparkContext.defaultParallelism, windows.count() * tree[0].count() // TASK)))
    at = windows.dropna(subset=[f"w{c}" for c in BOX]).repartition(parts, window)
    front = at.select(window, *[f"w{c}" for c in BOX], F.explode(F.filter(boxes, lambda n: touches({c: n[c] for c in BOX}, own))["node"]).alias("node"))
    salt = F.pmod(F.xxhash64(window), F.lit(SALT)).cast("int")
    for level in reversed(tree[:-1]):
        child = level.withColumn("_child", F.struct("node", *BOX)).groupBy(F.floor(F.col("node") / fanout).cast("long").alias("node")).agg(F.collect_list("_child").alias("_children"))  # a node's children: at most ``fanout``
        child = child.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = front.withColumn("_salt", salt).join(child, ["node", "_salt"])
        front = met.select(window, *[f"w{c}" for c in BOX], F.explode(F.filter("_children", lambda n: touches({c: n[c] for c in BOX}, own))["node"]).alias("node"))
    dealt = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).repartition(parts, "page", "_salt")
    met = front.select(window, *[f"w{c}" for c in BOX], F.col("node").alias("page"), salt.alias("_salt")).repartition(parts, "page", "_salt")
    pairs = met.join(dealt, ["page", "_salt"]).drop("_salt").where(touches({c: F.col(c) for c in BOX}, own)).drop("page")
    rest = [c for c in windows.columns if c != window and c not in {f"w{b}" for b in BOX}]
    if rest:
        pairs = pairs.join(windows.select(window, *rest), window)
    return pairs if exact is None else pairs.where(exact)
