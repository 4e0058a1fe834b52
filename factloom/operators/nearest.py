"""Nearest features and nearest vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.geo import to_segment
from factloom.functions.vectors import hash_slot, norm
from factloom.sources.files import checkpoint_dir

#: Cells of a level in a row and column of one cell of the next; layers told apart at most.
FAN, LAYERS = 8, 1000
#: Segments of a layer in an occupied cell on average, halvings of a cell and copies of a segment at most.
FILL, HALVINGS, COPIES = 2, 12, 2


def segment_cells(segments: DataFrame, cell: float) -> DataFrame:
    """The segments once for each cell ``cx, cy`` that they cross: as many as they are long, not as their box is wide."""
    at = lambda c: F.floor(c / cell).cast("long")
    lo, hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    columns = segments.withColumn("cx", F.explode(F.sequence(at(lo), at(hi))))
    flat = F.col("x1") == F.col("x2")
    on = lambda x: F.col("y1") + (x - F.col("x1")) * (F.col("y2") - F.col("y1")) / F.when(flat, F.lit(1.0)).otherwise(F.col("x2") - F.col("x1"))
    left, right = on(F.greatest(lo, F.col("cx") * cell)), on(F.least(hi, (F.col("cx") + 1) * cell))
    bottom, top = F.least("y1", "y2"), F.greatest("y1", "y2")
    slack = cell * 1e-9  # of rounding at a corner
    low = F.when(flat, bottom).otherwise(F.greatest(bottom, F.least(left, right) - slack))
    high = F.when(flat, top).otherwise(F.least(top, F.greatest(left, right) + slack))
    return columns.withColumn("cy", F.explode(F.sequence(at(F.least(low, high)), at(F.greatest(low, high)))))


def fitted_cell(segments: DataFrame, cell: float) -> float:
    """``cell``, halved until its occupied cells hold FILL segments of a layer on average, or segments would lie in more than COPIES further cells; so pairs grow as points do, not as points times features."""
    sides = [cell / 2**k for k in range(HALVINGS + 1)]
    middle = lambda a, b, s: F.floor((F.col(a) + F.col(b)) / 2 / s).cast("long")
    held = [F.approx_count_distinct(F.struct("layer", middle("x1", "x2", s), middle("y1", "y2", s))).alias(f"k{k}") for k, s in enumerate(sides)]
    length = F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))
    known = segments.agg(F.count("*").alias("n"), F.sum(length.cast("double")).alias("length"), *held).first()
    best = cell
    for k, side in enumerate(sides):
        if known.n == 0 or (k and known.length / side > COPIES * known.n):
            break
        best = side
        if known.n <= FILL * known[f"k{k}"]:
            break
    return best


def nearest(points: DataFrame, segments: DataFrame, cell: float) -> DataFrame:
    """``subject, layer, feature, metres``: the nearest feature of each layer, the smaller feature on a tie.

    ``points(subject, x, y)``, ``segments(layer, feature, x1, y1, x2, y2)``; rows with a null among the coordinates don't count, a feature may have any number of segments.

    Occupied cells form a pyramid, FAN x FAN cells of a level to one of the next. At each level the points that are still open meet the nine cells around them, and
    go down from those: of the occupied cells below, only those stay whose near corner isn't farther than the least far corner, which some feature is sure to
    be within. A distance below a cell's side is final, since all outside of the nine cells is farther. At the last level nine cells hold everything. So a
    point in an empty region meets some cells of each level and the segments of a few smallest ones, never a whole layer. ``cell`` is the largest side of a smallest cell; see ``fitted_cell``.
    """
    given = ["x1", "y1", "x2", "y2"]
    own = segments.select("layer", "feature", *given).dropna(subset=given)
    cell = fitted_cell(own, cell)
    placed = _cut(segment_cells(own, cell))
    points = points.select("subject", "x", "y").dropna(subset=["x", "y"])
    layers = [r.layer for r in placed.select("layer").distinct().limit(LAYERS + 1).collect()]
    if len(layers) > LAYERS:
        raise ValueError(f"more than {LAYERS} layers")
    none = points.select("subject", F.lit(None).cast(placed.schema["layer"].dataType).alias("layer"), F.lit(None).cast(placed.schema["feature"].dataType).alias("feature"), F.lit(None).cast("double").alias("metres")).limit(0)
    if not layers:
        return none
    ends = [placed.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first(), points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()]
    if ends[1][0] is None:
        return none
    reach = max(max(e[k + 1] for e in ends) - min(e[k] for e in ends) for k in (0, 2))
    cells = [_cut(placed.select("layer", "cx", "cy").distinct())]
    while cell * FAN ** (len(cells) - 1) < reach:
        cells.append(_cut(cells[-1].select("layer", F.floor(F.col("cx") / FAN).cast("long").alias("cx"), F.floor(F.col("cy") / FAN).cast("long").alias("cy")).distinct()))

    open_ = points.withColumn("layer", F.explode(F.array(*[F.lit(x) for x in layers])))
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    pair = Window.partitionBy("subject", "layer")
    metres = to_segment(*[F.col(c) for c in ("x", "y", *given)])
    best = F.min(F.struct(metres.alias("metres"), "feature")).alias("m")
    out = None
    for level in range(len(cells)):
        side = cell * FAN**level
        at = lambda c, s=side: F.floor(c / s).cast("long")
        near = open_.withColumn("d", F.explode(around)).select("subject", "layer", "x", "y", (at(F.col("x")) + F.col("d.dx")).alias("cx"), (at(F.col("y")) + F.col("d.dy")).alias("cy"))
        for below in range(level - 1, -1, -1):
            s = cell * FAN**below
            child = cells[below].select("layer", F.floor(F.col("cx") / FAN).cast("long").alias("cx"), F.floor(F.col("cy") / FAN).cast("long").alias("cy"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
            near = near.join(child, ["layer", "cx", "cy"])
            gap = lambda p, c, s=s: F.greatest(c * s - p, p - (c + 1) * s, F.lit(0.0))
            far = lambda p, c, s=s: F.greatest(F.abs(p - c * s), F.abs((c + 1) * s - p))
            near = near.withColumns({"_near": F.hypot(gap(F.col("x"), F.col("bx")), gap(F.col("y"), F.col("by"))), "_far": F.hypot(far(F.col("x"), F.col("bx")), far(F.col("y"), F.col("by")))})
            near = near.withColumn("_bound", F.min("_far").over(pair)).where(F.col("_near") <= F.col("_bound") * (1 + 1e-9)).select("subject", "layer", "x", "y", F.col("bx").alias("cx"), F.col("by").alias("cy"))
        found = near.join(placed, ["layer", "cx", "cy"]).groupBy("subject", "layer").agg(best)
        last = level == len(cells) - 1
        found = _cut(found if last else found.where(F.col("m.metres") < side)).select("subject", "layer", "m.feature", "m.metres")
        out = found if out is None else out.unionByName(found)
        if last:
            break
        open_ = _cut(open_.join(found, ["subject", "layer"], "left_anti"))
        if not open_.take(1):
            break
    return out


def _cut(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Centroids and rings of an inverted file, the sample that centroids are fitted on, and rows of a block of vectors or queries.
CENTROIDS, RINGS, SAMPLE, BLOCK = 64, 16, 4096, 4096
#: Cells told apart at most; what bounds and scores may be off by.
CELLS, SLACK = 500_000, 1e-9


def _centroids(index: DataFrame, key: str, vector: str, backend: str | None) -> dict[int, np.ndarray]:
    """Unit centroids by dimension, fitted on the SAMPLE rows with the least hash of their key. They only decide how much is skipped, never what is found."""
    sample = _units(index.orderBy(F.xxhash64(key), key).limit(SAMPLE), key, vector, backend).select("_v").collect()
    out = {}
    for size in {len(r._v) for r in sample}:
        x = np.array([r._v for r in sample if len(r._v) == size])
        c = x[:: -(-len(x) // max(1, min(CENTROIDS, len(x) // 64)))].copy()  # 64 vectors of the sample for each at least
        for _ in range(4):
            nearest = np.argmax(x @ c.T, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, nearest, x)
            norms = np.linalg.norm(sums, axis=1)
            c[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
        out[size] = c
    return out


def _angles(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ c.T, -1.0, 1.0))


def _units(df: DataFrame, key: str, vector: str, backend: str | None) -> DataFrame:
    """``_b, _size, <key>, _v``: unit vectors of what has a direction; the backend's null and vectors with nulls are left out."""
    x = F.col(vector).cast("array<double>")
    length = norm(x)
    own = df.select((F.col(backend).cast("string") if backend else F.lit("")).alias("_b"), F.col(key), x.alias("_x"), length.alias("_length"))
    own = own.where((F.col("_length") > 0) & (F.col("_length") < float("inf")) & F.col("_b").isNotNull())
    return own.select("_b", F.size("_x").alias("_size"), key, F.transform("_x", lambda v: v / F.col("_length")).alias("_v"))


def inverted_file(index: DataFrame, key: str, vector: str, backend: str | None = None) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The index's unit vectors with their nearest centroid ``_list`` and angle to it (``_angle``, and ``_ring``), written once; and the centroids."""
    units = _units(index, key, vector, backend)
    centroids = _centroids(index, key, vector, backend)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.assign(_list=-1, _angle=0.0)
            for size, rows in f.groupby("_size"):
                if size in centroids and len(rows):
                    angles = _angles(np.stack(rows["_v"].to_numpy()), centroids[size])
                    best = np.argmin(angles, axis=1)
                    f.loc[rows.index, "_list"] = best
                    f.loc[rows.index, "_angle"] = angles[np.arange(len(best)), best]
            yield f

    schema = f"_b string, _size int, `{key}` {index.schema[key].dataType.simpleString()}, _v array<double>, _list int, _angle double"
    placed = units.mapInPandas(place, schema)
    return _cut(placed.withColumn("_ring", F.floor(F.col("_angle") / (np.pi / RINGS)).cast("int"))), centroids


def top_cosine(queries: DataFrame, index: DataFrame, key: str, vector: str, k: int, backend: str | None = None) -> DataFrame:
    """``q, key, rank, score``: the k best of all vectors for each query, then those above zero; ties by key. Keys of queries are unique.

    Exact, by an inverted file. Vectors lie in cells: a centroid's list, cut into rings of the angle to it. A query at angle f of a centroid can't score more than the cosine of the
    gap between f and a ring's angles. Its k best among the most promising cells that hold k vectors give a bound from below; of the other cells only those are looked at whose
    bound reaches it. Cells and queries meet in blocks of BLOCK rows, where each query keeps k, so neither a hot cell nor many queries make a large task, and the plan is
    the same for any number of queries. Where the data leave nothing to skip (directions that all differ), every pair is scored.
    Vectors of another backend or size are never compared; those with nulls or without a direction score nothing.
    """
    spark = index.sparkSession
    placed, centroids = inverted_file(index, key, vector, backend)
    cell = ["_b", "_size", "_list", "_ring"]
    cells = placed.groupBy(*cell).agg(F.count("*").alias("n"), F.min("_angle").alias("low"), F.max("_angle").alias("high"))
    known = cells.limit(CELLS + 1).collect()
    if len(known) > CELLS:
        raise ValueError(f"more than {CELLS} cells: too many backends")
    table: dict = {}
    for r in sorted(known, key=lambda r: (r._list, r._ring)):
        table.setdefault((r._b, r._size), []).append((r._list, r._ring, r.n, r.low, r.high))
    shared = spark.sparkContext.broadcast((table, centroids))
    kind = index.schema[key].dataType.simpleString()

    def wanted(first: bool):
        def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            all_cells, centers = shared.value
            for f in frames:
                parts = []
                for (b, size), rows in f.groupby(["_b", "_size"]):
                    if (b, size) not in all_cells:
                        continue
                    lists, rings, n, low, high = (np.array(c) for c in zip(*all_cells[b, size], strict=True))
                    x = np.stack(rows["_v"].to_numpy())
                    bound = np.ones((len(x), len(lists)))
                    if size in centers:
                        at = _angles(x, centers[size])[:, np.maximum(lists, 0)]
                        gap = np.maximum(np.maximum(at - high, low - at), 0.0)
                        bound = np.where(lists >= 0, np.cos(gap), 1.0)
                    order = np.argsort(-bound, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    head = np.zeros(bound.shape, dtype=bool)
                    np.put_along_axis(head, order, before < k, axis=1)
                    take = head if first else ~head & (bound >= rows["_floor"].to_numpy()[:, None] - SLACK)
                    i, j = np.nonzero(take)
                    parts.append(pd.DataFrame({"q": rows["q"].to_numpy()[i], "_b": b, "_size": size, "_list": lists[j], "_ring": rings[j]}))
                if parts:
                    yield pd.concat(parts)

        return choose

    asked = _units(queries, key, vector, backend).withColumnRenamed(key, "q")
    blocks = F.broadcast(cells.select(*cell, F.ceil(F.col("n") / BLOCK).cast("int").alias("_blocks")))  # CELLS rows at most
    stored = placed.join(blocks, cell).withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    many = max(1, -(-asked.count() // BLOCK))

    def score(_, a: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        kept, rows, scores = [], [], []
        if len(v):
            v = v.sort_values(key, kind="stable")
            x = np.stack(v["_v"].to_numpy())
            for y in a["_v"]:
                s = (x * y).sum(axis=1)  # row by row, so that equal vectors have equal scores
                some = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                best = some[np.argsort(-s[some], kind="stable")[:k]]
                rows.append(best)
                scores.append(s[best])
            kept = [len(r) for r in rows]
        if not kept:
            return pd.DataFrame({"q": [], key: [], "score": []})
        return pd.DataFrame({"q": np.repeat(a["q"].to_numpy(), kept), key: v[key].to_numpy()[np.concatenate(rows)], "score": np.concatenate(scores)})

    def meet(first: bool, rows: DataFrame) -> DataFrame:
        pairs = rows.mapInPandas(wanted(first), f"q {kind}, _b string, _size int, _list int, _ring int").join(blocks, cell)
        pairs = pairs.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("_part", F.pmod(F.xxhash64("q"), F.lit(many)).cast("int"))
        pairs = _cut(pairs.select("q", *cell, "_block", "_part"))
        met = stored.join(pairs.select(*cell, "_block", "_part").distinct(), [*cell, "_block"])
        by = [*cell, "_block", "_part"]
        other = met.select(*[F.col(c).alias(f"_m{c}") for c in by], key, "_v")  # both sides come from one table, so names of its own
        sides = pairs.join(asked.select("q", "_v"), "q").groupBy(*by), other.groupBy(*[f"_m{c}" for c in by])
        scored = sides[0].cogroup(sides[1]).applyInPandas(score, f"q {kind}, `{key}` {kind}, score double")
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), key))).where(F.col("rank") <= k).drop("rank")

    head = _cut(meet(True, asked))
    floor = head.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("_kth"))
    rest = meet(False, asked.join(floor, "q").withColumn("_floor", F.greatest(F.col("_kth"), F.lit(0.0))))
    ranked = head.unionByName(rest).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), key)))
    return ranked.where((F.col("rank") <= k) & (F.col("score") > 0)).select("q", key, "rank", "score")


def search_report(queries: DataFrame, index: DataFrame, key: str, vector: str, k: int, backend: str, fallback: str | None = None) -> DataFrame:
    """``q, backend, index_size, degraded, precedents``: one row for each query, also where nothing is found.

    A query is compared with vectors of its own backend only. Where an index holds none of those, the result is empty and degraded; so is what the fallback backend finds degraded.
    """
    found = top_cosine(queries, index, key, vector, k, backend).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key), "score"))).alias("precedents"))  # k at most
    sizes = F.broadcast(index.groupBy(F.col(backend).alias("_own")).agg(F.count("*").alias("_n")).where("_own is not null").limit(CELLS))
    total = F.broadcast(index.agg(F.count("*").alias("index_size")))  # one row
    asked = queries.select(F.col(key).alias("q"), F.col(backend).alias("backend")).crossJoin(total).join(sizes, F.col("backend") == F.col("_own"), "left")
    out = asked.join(found, "q", "left")
    degraded = (F.col("_n").isNull() & (F.col("index_size") > 0)) | (F.coalesce(F.col("backend") == fallback, F.lit(False)) if fallback else F.lit(False))
    return out.select("q", "backend", "index_size", degraded.alias("degraded"), F.coalesce("precedents", F.array().cast(found.schema["precedents"].dataType)).alias("precedents"))


def hash_embed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Sparse vectors of hashed words with unit length: ``key, slot, v``."""
    words = rows.select(key, F.explode(F.split(F.lower(text), " ")).alias("w")).where("w <> ''")
    counts = words.groupBy(key, hash_slot(F.col("w")).alias("slot")).agg(F.count("*").alias("n"))
    return counts.select(key, "slot", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))).alias("v"))
