"""Sharding by a minimax contiguous partition.

Rows fall into atoms by the hash of their text, so equal texts share an atom
and an atom never splits. The atoms, ordered by hash, are summed with map-side
combining into at most ``atoms`` rows, whatever the size of the table. On those
sums the smallest feasible shard capacity is found by binary search with a
greedy check, and the table is cut there: every cut is the feasible one next
to its ideal place, so no shard exceeds the capacity and the last one is not short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ordered atoms; bounds what reaches the driver and every broadcast.
ATOMS = 1 << 16
#: Parts of an atom that holds more than 1 in ``HOT`` of all rows.
SALTS = HOT = 128


def _reach(prefix: np.ndarray, at: int, capacity: int) -> int:
    return int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """Least capacity for which a greedy pass needs at most ``shards`` contiguous shards."""
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    low, high = max(int(sizes.max(initial=0)), -(-int(prefix[-1]) // shards)), int(prefix[-1])
    while low < high:
        mid, at = (low + high) // 2, 0
        for _ in range(shards):
            at = _reach(prefix, at, mid)
        low, high = (low, mid) if at == len(sizes) else (mid + 1, high)
    return low


def cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """``shards`` + 1 places between ordered atoms; no part is larger than the smallest capacity."""
    prefix, capacity = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), smallest_capacity(sizes, shards)
    least = [len(sizes)]
    for _ in range(shards):  # the earliest place from which the shards left still reach the end
        least.append(int(np.searchsorted(prefix, prefix[least[-1]] - capacity, side="left")))
    least = least[::-1]
    out = [0]
    for k in range(1, shards):
        ideal = prefix[out[-1]] + (prefix[-1] - prefix[out[-1]]) / (shards - k + 1)
        near = int(np.searchsorted(prefix, ideal))
        if near > 0 and ideal - prefix[near - 1] <= prefix[min(near, len(sizes))] - ideal:
            near -= 1
        out.append(min(max(near, least[k], out[-1]), _reach(prefix, out[-1], capacity)))
    return [*out, len(sizes)]


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", atoms: int = ATOMS) -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Law ``bytes``: shard sizes are near equal, equal texts share a shard. ``size`` is the
    text's UTF-8 bytes plus 1 (null text: 1; null counts as the empty text). ``slot`` numbers a shard's rows from 0
    without gaps, in the order of atom and id (repeated rows take different slots).
    An empty table gives an empty result; shards can stay empty when there are fewer texts than shards.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(atoms)).cast("int").alias("atom"),
    )
    sums = rows.groupBy("atom").agg(F.sum("size"), F.count("*")).collect()  # at most `atoms` rows
    sizes, counts = np.zeros(atoms, np.int64), np.zeros(atoms, np.int64)
    for a, s, n in sums:
        sizes[a], counts[a] = s, n
    places = cuts(sizes, shards)
    shard_of = np.searchsorted(places[1:-1], np.arange(atoms), side="right")
    hot = np.flatnonzero(counts > max(1000, counts.sum() // HOT)).tolist()  # at most HOT atoms
    salt = F.when(F.col("atom").isin(hot), F.pmod(F.hash("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)) if hot else F.lit(0)
    rows = rows.withColumn("salt", salt)
    hot_set = set(hot)
    parts = {(a, 0): int(counts[a]) for a in np.flatnonzero(counts).tolist() if a not in hot_set}
    if hot:
        for a, s, n in rows.where(F.col("atom").isin(hot)).groupBy("atom", "salt").count().collect():  # at most HOT * SALTS rows
            parts[a, s] = n
    first, at = [], {}
    for a, s in sorted(parts):
        k = int(shard_of[a])
        first.append((a, s, k, at.get(k, 0)))
        at[k] = at.get(k, 0) + parts[a, s]
    table = spark.createDataFrame(first or [(0, 0, 0, 0)], "atom int, salt int, shard int, first long")
    within = F.row_number().over(Window.partitionBy("atom", "salt").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("within", within)
        .join(F.broadcast(table), ["atom", "salt"])  # at most atoms + HOT * SALTS rows
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("within")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
