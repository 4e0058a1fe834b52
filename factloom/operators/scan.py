"""Positions, running sums and maxima, and order statistics in a total order, in two levels.

Rows are dealt to range partitions, sorted there and numbered, and that is written once below ``spark.checkpoint.dir``. All that follows reads what was written, so
the boundaries can't differ between two reads of it. A first level gives one row for each partition; prefix sums over those few rows are offsets of
the second level. No task sees all rows, and a hot key is spread over as many partitions as it fills.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.files import checkpoint_dir

#: Rows that a partition numbers at most, by the form of ``monotonically_increasing_id``.
SHIFT = 33


def placed(df: DataFrame, *order: Column | str, partitions: int | None = None) -> DataFrame:
    """The rows with ``_part``, which grows with the order, and ``_n``, their place in it from 0. The order has to be total for a defined result; nulls come first in ascending columns."""
    checkpoint_dir(df.sparkSession)
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *columns).sortWithinPartitions(*columns)
    ranged = ranged.withColumn("_id", F.monotonically_increasing_id())
    cut = ranged.withColumns({"_part": F.shiftright("_id", SHIFT).cast("int"), "_n": F.col("_id").bitwiseAND(F.lit((1 << SHIFT) - 1))}).drop("_id")
    return cut.checkpoint()


def _offsets(rows: DataFrame, **first: tuple[str, Column]) -> DataFrame:
    """One row for each partition: what lies before it. As many rows as there are partitions."""
    sums = rows.groupBy("_part").agg(*[getattr(F, kind)(c).alias(name) for name, (kind, c) in first.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", *[getattr(F, kind)(name).over(before).alias(f"_before_{name}") for name, (kind, _) in first.items()])


def ordinals(rows: DataFrame, name: str = "_ord") -> DataFrame:
    """Placed rows with their position from 0."""
    starts = F.broadcast(_offsets(rows, n=("sum", F.lit(1).cast("long"))))
    return rows.join(starts, "_part").withColumn(name, F.coalesce("_before_n", F.lit(0).cast("long")) + F.col("_n")).drop("_before_n")


def running(rows: DataFrame, **of: tuple[str, Column]) -> DataFrame:
    """Placed rows with running values, each row's own included: ``name=("sum" or "max", column)``; nulls don't count."""
    w = Window.partitionBy("_part").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(F.broadcast(_offsets(rows, **of)), "_part")
    out = {}
    for name, (kind, c) in of.items():
        own, before = getattr(F, kind)(c).over(w), F.col(f"_before_{name}")
        out[name] = F.greatest(own, before) if kind == "max" else F.coalesce(own + before, own, before)
    return joined.withColumns(out).drop(*[f"_before_{name}" for name in of])


def paced(requests: DataFrame, arrival: str, gap: Column, *order: Column | str) -> DataFrame:
    """Requests with ``at``, when each may start: not before its arrival, nor less than its gap after the start of the one before.

    ``t = max(arrival, t before + gap)`` is a running sum of gaps plus a running maximum of what arrivals are above it, so two scans do it.
    """
    rows = running(placed(requests, *order), _gaps=("sum", gap))
    rows = running(rows, _late=("max", F.col(arrival) - F.col("_gaps")))
    return rows.withColumn("at", F.col("_gaps") + F.col("_late")).drop("_gaps", "_late", "_part", "_n")


def order_statistics(df: DataFrame, keys: list[str], column: str, **ranks: Callable[[Column], Column]) -> DataFrame:
    """Per key, the values at given ranks from 0, each a function of the number of values; nulls don't count, a key without values has no row.

    Values are counted before anything is shuffled, then found by a running sum of the counts, so a key may hold any share of the rows.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_value")).agg(F.count("*").alias("_count"))
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    upto = running(placed(counts.select(*own, "_value", "_count"), *names, "_value"), _upto=("sum", F.col("_count")))
    totals = upto.groupBy(*names).agg(F.sum("_count").alias("_all"), (F.max("_upto") - F.sum("_count")).alias("_start"))
    totals = totals.where("_all > 0")
    if names:
        totals = totals.select(*[F.col(n).alias(f"_t{n}") for n in names], "_all", "_start")
        same = F.lit(True)
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"_t{n}"))
        found = upto.join(totals, same)
    else:
        found = upto.crossJoin(F.broadcast(totals))  # one row
    at = lambda rank: F.min(F.when(F.col("_upto") - F.col("_start") > rank(F.col("_all")), F.col("_value")))
    out = found.groupBy(*names).agg(F.max("_all").alias("n"), *[at(r).alias(name) for name, r in ranks.items()])
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "n", *ranks)


def medians(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``*keys, n, upper_median, median``: the value at half of the count, rounded up, and the mean of the two in the middle."""
    half = lambda up: lambda n: F.floor((n - 1 + up) / 2)
    got = order_statistics(df, keys, column, upper_median=lambda n: F.floor(n / 2), low=half(0), high=half(1))
    return got.select(*keys, "n", "upper_median", ((F.col("low") + F.col("high")) / 2).alias("median"))


def shares(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Rows with ``share``: of a key's rows, the part up to and with this one; ties in the order count one after the other."""
    rows = ordinals(placed(df, *keys, *order))
    starts = rows.groupBy(*keys).agg(F.min("_ord").alias("_first"), F.count("*").alias("_all")).select(*[F.col(k).alias(f"_s_{k}") for k in keys], "_first", "_all")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    joined = rows.join(starts, same) if keys else rows.crossJoin(F.broadcast(starts))
    return joined.withColumn("share", (F.col("_ord") - F.col("_first") + 1) / F.col("_all")).select(*df.columns, "share")
