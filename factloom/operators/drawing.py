"""Symbols on drawings: greedy matching, swaps, nearest pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import once
from factloom.sources.files import checkpoint_dir


def greedy_match(found: DataFrame, truth: DataFrame, reach: float) -> DataFrame:
    """One-to-one matches of the same sheet and label, nearest first; a taken symbol is out.

    Each match depends on those before it, so a group of a sheet and label is matched as a whole; sheets are small.
    """

    def match(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["sheet", "label", "found", "truth", "distance"])
        pairs = a.merge(b, how="cross")
        pairs["d"] = ((pairs["x"] - pairs["tx"]) ** 2 + (pairs["y"] - pairs["ty"]) ** 2) ** 0.5
        out, used_a, used_b = [], set(), set()
        for r in pairs[pairs["d"] <= reach].sort_values(["d", "id", "tid"]).itertuples():
            if r.id not in used_a and r.tid not in used_b:
                used_a.add(r.id)
                used_b.add(r.tid)
                out.append((key[0], key[1], r.id, r.tid, round(r.d, 6)))
        return pd.DataFrame(out, columns=["sheet", "label", "found", "truth", "distance"])

    # names of their own, so that both sides can come from one table
    truth = truth.select(F.col("sheet").alias("tsheet"), F.col("label").alias("tlabel"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("id").alias("tid"))
    return found.groupBy("sheet", "label").cogroup(truth.groupBy("tsheet", "tlabel")).applyInPandas(match, "sheet long, label string, found long, truth long, distance double")


def nearest_pair(symbols: DataFrame, a: str, b: str) -> DataFrame:
    """Per sheet, the pair of a symbol of each label with the least gap; ties by ids."""
    from factloom.functions.geo import box_gap

    side = lambda label, p: symbols.where(F.col("label") == label).select("sheet", *[F.col(c).alias(p + c) for c in ("id", "left", "top", "width", "height")])
    box = lambda p: {c: F.col(p + c) for c in ("left", "top", "width", "height")}
    pairs = side(a, "a_").join(side(b, "b_"), "sheet").withColumn("gap", box_gap(box("a_"), box("b_")))
    return pairs.groupBy("sheet").agg(F.min(F.struct(F.round("gap", 6).alias("gap"), "a_id", "b_id")).alias("m")).select("sheet", "m.a_id", "m.b_id", "m.gap")


def _matched(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``sheet, label, n_found, n_true, pairs``: one shuffle of both tables; each group is matched as two lists, with no frame or Python for it."""
    real = lambda c: F.col(c).cast("double").alias(c)
    own = found.select("sheet", "label", F.struct(F.col("id").cast("long").alias("id"), real("x"), real("y")).alias("f"))
    given = truth.select("sheet", "label", F.struct(F.col("tid").cast("long").alias("tid"), real("tx"), real("ty")).alias("t"))
    lists = own.unionByName(given, allowMissingColumns=True).groupBy("sheet", "label").agg(F.array_sort(F.collect_list("f")).alias("f"), F.array_sort(F.collect_list("t")).alias("t"))
    none = F.array().cast("array<struct<id: bigint, x: double, y: double, tid: bigint, tx: double, ty: double, error: double>>")

    def take(state: Column, t: Column) -> Column:
        def gap(f: Column) -> Column:
            dx, dy = f["f"]["x"] - t["tx"], f["f"]["y"] - t["ty"]
            return F.sqrt(dx * dx + dy * dy)

        # symbols without a place come last
        near = F.array_min(F.transform(state["left"], lambda f: F.struct(F.coalesce(gap(f), F.lit(float("nan"))).alias("order"), f["at"].alias("at"), gap(f).alias("error"), f["f"].alias("f"))))

        def drop(best: Column) -> Column:
            pair = F.struct(best["f"]["id"].alias("id"), best["f"]["x"].alias("x"), best["f"]["y"].alias("y"), t["tid"].alias("tid"), t["tx"].alias("tx"), t["ty"].alias("ty"), best["error"].alias("error"))
            return F.struct(F.filter(state["left"], lambda f: f["at"] != best["at"]).alias("left"), F.concat(state["pairs"], F.array(pair)).alias("pairs"))

        return F.when(F.size(state["left"]) > 0, once(near, drop)).otherwise(state)

    numbered = F.transform("f", lambda f, at: F.struct(at.alias("at"), f.alias("f")))
    pairs = F.aggregate("t", F.struct(numbered.alias("left"), none.alias("pairs")), take, lambda state: state["pairs"])
    return lists.select("sheet", "label", F.size("f").cast("long").alias("n_found"), F.size("t").cast("long").alias("n_true"), pairs.alias("pairs"))


def _opened(matched: DataFrame) -> DataFrame:
    # an inner explode would match once more in a filter on its size
    return matched.select("sheet", "label", F.explode_outer("pairs").alias("p")).where("p is not null").select("sheet", "label", "p.*")


def match_in_order(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``sheet, label, id, x, y, tid, tx, ty, error``: each true symbol, by ``tid``, takes the nearest one of its label that is left, however far; the smaller ``id`` on a tie.

    ``found(sheet, label, id, x, y)``, ``truth(sheet, label, tid, tx, ty)``. Each choice depends on those before it, so a sheet's symbols of one label are one group; a step holds no more than those.
    """
    return _opened(_matched(found, truth))


def swaps(pairs: DataFrame, margin: float = 2.0) -> DataFrame:
    """``sheet, a_id, b_id, as_labelled, swapped``: matches of different labels each of which is nearer the other's truth, by more than ``margin`` together."""
    side = lambda p: pairs.select("sheet", *[F.col(c).alias(p + c) for c in pairs.columns if c != "sheet"])
    both = side("a_").join(side("b_"), "sheet").where("a_tid < b_tid and a_label <> b_label")
    gap = lambda f, t: F.hypot(F.col(f + "x") - F.col(t + "tx"), F.col(f + "y") - F.col(t + "ty"))
    there, back = gap("a_", "b_"), gap("b_", "a_")
    labelled = F.col("a_error") + F.col("b_error")
    crossed = both.where((there < F.col("a_error")) & (back < F.col("b_error")) & (there + back < labelled - margin))
    return crossed.select("sheet", "a_id", "b_id", F.round(labelled, 1).alias("as_labelled"), F.round(there + back, 1).alias("swapped"))


def scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Per sheet: ``matched, missed, spurious, swapped, mean_error, max_error``; a sheet of one side only counts as missed or spurious throughout. ``tid`` is unique in a sheet."""
    checkpoint_dir(found.sparkSession)
    matched = _matched(found, truth).checkpoint()
    pairs = _opened(matched)
    counts = matched.groupBy("sheet").agg(F.sum("n_found").alias("f"), F.sum("n_true").alias("t"))
    errors = pairs.groupBy("sheet").agg(F.count("*").alias("matched"), F.round(F.avg("error"), 1).alias("mean_error"), F.round(F.max("error"), 1).alias("max_error"))
    swapped = swaps(pairs).groupBy("sheet").agg(F.count("*").alias("swapped"))
    out = counts.join(errors, "sheet", "left").join(swapped, "sheet", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return out.select("sheet", n("matched").alias("matched"), (n("t") - n("matched")).alias("missed"), (n("f") - n("matched")).alias("spurious"), n("swapped").alias("swapped"), "mean_error", "max_error")
