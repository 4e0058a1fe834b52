"""Joins, dedups, aggregates and samples with an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import scan


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key; the order must be total for a defined result."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each key, with their rank."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", n).where(F.col("rank") <= k)


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def parity(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Full outer comparison: one row for each key and field that differs."""
    both = left.select(F.col(key).alias("_k"), *[F.col(f).cast("string").alias(f"l_{f}") for f in fields], F.lit(True).alias("_l")).join(
        right.select(F.col(key).alias("_k"), *[F.col(f).cast("string").alias(f"r_{f}") for f in fields], F.lit(True).alias("_r")), "_k", "full_outer"
    )
    diffs = F.array_compact(F.array(*[F.when(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("left_value"), F.col(f"r_{f}").alias("right_value"))) for f in fields]))
    return both.select(F.col("_k").alias(key), F.explode(diffs).alias("d")).select(key, "d.*")


def upper_median_of(df: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """The value at half of the count, rounded up, in ascending order, of all rows or of each key."""
    return scan.medians(df, list(keys), column).select(*keys, F.col("upper_median").alias(column))


def systematic(df: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """Every n-th row in order, ``limit`` of them at most; numbering is by partition offsets, not in one task."""
    numbered = with_ordinal(df, *order)
    step = max(1, numbered.count() // limit)
    return numbered.where((F.col("_ord") % step == 0) & (F.col("_ord") < step * limit)).drop("_ord")


def with_ordinal(df: DataFrame, *order: Column | str, partitions: int | None = None) -> DataFrame:
    """Rows numbered from 0 in a total order: range partitions that are written once, and the counts of those before."""
    return scan.ordinals(scan.placed(df, *order, partitions=partitions)).drop("_part", "_n")


def histogram(df: DataFrame, value: Column, width: float, bins: int) -> DataFrame:
    """Counts and densities of values clipped to the bins."""
    clipped = F.least(F.greatest(value, F.lit(0.0)), F.lit(width * bins))
    at = F.least(F.floor(clipped / width), F.lit(bins - 1)).cast("int")
    counts = df.where(value.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    total = counts.groupBy().agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("bin", "n", (F.col("n") / (F.col("total") * width)).alias("density"))


def ecdf(df: DataFrame, value: str, keys: list[str], *ties: Column | str) -> DataFrame:
    """Share of rows up to each row, by value within each key; ties count one after the other, in the order of ``ties``."""
    return scan.shares(df, keys, value, *ties)


def merge_first_wins(facts: DataFrame, key: str, name: str, value: str, *order: Column | str) -> DataFrame:
    """The first value of each name, and the others that differ."""
    w = Window.partitionBy(key, name).orderBy(*order)
    own = facts.withColumn("_first", F.first(value).over(w))
    return own.groupBy(key, name).agg(F.min("_first").alias("value"), F.array_sort(F.collect_set(F.when(F.col(value) != F.col("_first"), F.col(value)))).alias("conflicts"))


def fingerprint(label: Column, digest: Column) -> Column:
    """Aggregate that changes with any member of a set; ``none`` for an empty one."""
    own = F.array_sort(F.collect_list(F.concat(label, F.lit(":"), digest)))
    return F.when(F.size(own) == 0, "none").otherwise(F.left(F.sha2(F.array_join(own, "").cast("binary"), 256), F.lit(16)))
