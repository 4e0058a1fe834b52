"""Structured Streaming twins of the incremental steps."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_new(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what has arrived to a table, once each, and stop; a rerun goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: States that keys share. Spark pays some milliseconds, a frame and a row of its store for each state in a batch, so a state is a bucket of keys. Fixed while a checkpoint lasts.
BUCKETS = 2048


def _packed(rows: list) -> bytes:
    return zlib.compress(json.dumps(rows, separators=(",", ":")).encode(), 1)


def _unpacked(packed: bytes) -> list:
    return json.loads(zlib.decompress(bytes(packed)))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("detail_id"), F.lit(buckets)).alias("bucket")


def agreement_stream(stream: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Settled observations of a stream of ``detail_id, attempt, kind, doc_count``: two equal counts in a row.

    What is known of a key: the last count, or that it is settled; a failed fetch forgets, an exception keeps it. A task holds the keys of one of ``buckets`` states.
    """

    def step(_, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = dict(_unpacked(state.get[0])) if state.exists else {}  # a count, or True where it is settled
        told = {}
        # plain lists: a key has a few rows, and frames of that size cost more than they hold
        rows = [r for f in frames for r in zip(*[f[c].tolist() for c in ("attempt", "known", "id", "ok", "count")], strict=True)]
        for _, known, key, ok, count in sorted(rows, key=lambda r: r[0]):
            key = key if known else None
            last = kept.get(key)
            if last is True:
                continue
            if not ok:
                kept.pop(key, None)
            elif last is not None and last == count:
                kept[key], told[key] = True, count
            else:
                kept[key] = count
        state.update((_packed(list(kept.items())),))
        if told:
            yield pd.DataFrame({"detail_id": pd.array(list(told), "Int64"), "outcome": ["PARSED_DOCS" if n else "PARSED_ZERO_DOCS" for n in told.values()], "doc_count": list(told.values())})

    # nulls would turn a frame's longs into doubles
    long = lambda c, default: F.coalesce(F.col(c).cast("long"), F.lit(default))
    ok = F.coalesce((F.col("kind") == "ok") & F.col("doc_count").isNotNull(), F.lit(False))
    own = stream.where("kind is null or kind <> 'exception'").select(_bucket(buckets), long("attempt", 2**63 - 1).alias("attempt"), F.col("detail_id").isNotNull().alias("known"), long("detail_id", 0).alias("id"), ok.alias("ok"), long("doc_count", 0).alias("count"))
    return own.groupBy("bucket").applyInPandasWithState(step, "detail_id long, outcome string, doc_count long", "packed binary", "append", "NoTimeout")


def decided(seen: dict[int, tuple[str, int, bool]], attempts: int, final: bool) -> tuple[str, int] | None:
    """Outcome and count of the attempts seen by number, or None while it can still change.

    Unless ``final``, only attempts without a gap before them count, so what arrives later can't change what was told.
    """
    numbers = sorted(seen)
    if not final:
        numbers = [n for i, n in enumerate(numbers) if n == i + 1]
    last, counts = None, []
    for n in numbers:
        kind, count, _ = seen[n]
        if kind == "ok":
            if last == count:
                return ("PARSED_DOCS" if count else "PARSED_ZERO_DOCS"), count
            counts.append(count)
            last = count
        elif kind != "exception":
            last = None
    if not final and len(numbers) < attempts:
        return None
    if not counts:
        return ("PARSE_ERROR" if any(seen[n][0] == "exception" for n in numbers) else "FETCH_FAILED"), 0
    if len(set(counts)) > 1:
        return "UNSTABLE", max(counts)
    if counts[0]:
        return "PARSED_DOCS", counts[0]
    grid = any(seen[n][0] == "ok" and seen[n][2] for n in numbers)
    return ("PARSED_ZERO_DOCS" if grid else "GRID_ABSENT"), 0


def outcome_stream(stream: DataFrame, attempts: int = 3, late: str = "10 minutes", silence_ms: int = 600_000, buckets: int = BUCKETS) -> DataFrame:
    """``detail_id, outcome, doc_count`` of a stream of ``detail_id, attempt, kind, doc_count, grid_present, at``, once each: the stream's form of ``facts.agreement``.

    Attempts may come in any order and in any micro-batch; they wait until those before them are there. A key is told when two counts agree, when all
    ``attempts`` are in, or when event time has passed its last attempt by ``silence_ms``; then what has come by then decides. A key holds at most ``attempts`` entries and goes when
    that time is over, also if it was told, and ignores what follows until then. Rows behind the watermark (``late``) are dropped by Spark.
    Of rows that repeat an attempt before its key is told, the least (by kind, count and grid) counts. Rows without an id, a kind or a number from 1 to ``attempts`` only move event time on; a count or grid of null is 0 or no.
    Keys share ``buckets`` states; a state's timer is that of its first key to end.
    """

    def step(_, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # of a key: until when it was seen, when it ends, and its attempts, or None if it was told
        kept = {key: (until, end, None if seen is None else {n: tuple(own) for n, *own in seen}) for key, until, end, seen in (_unpacked(state.get[0]) if state.exists else [])}
        now, came, out = state.getCurrentWatermarkMs(), {}, {}
        for known, key, valid, attempt, kind, count, grid, at in (r for f in frames for r in zip(*[f[c].tolist() for c in ("known", "id", "valid", "attempt", "kind", "count", "grid", "ms")], strict=True)):
            if not known:
                continue
            rows = came.setdefault(key, [])
            if valid:
                rows.append((attempt, (kind, count, grid), at))
        for key, rows in came.items():
            until, _, seen = kept.get(key, (0, 0, {}))
            for attempt, own, at in rows:
                until = max(until, at)
                if seen is not None:
                    seen[attempt] = min(seen.get(attempt, own), own)
            if seen is not None:
                if not seen:
                    continue
                got = decided(seen, attempts, False)
                if got is not None:
                    out[key], seen = got, None
            kept[key] = (until, max(until + silence_ms, now + 1), seen)
        for key in [key for key, (_, end, _) in kept.items() if end < now]:
            seen = kept.pop(key)[2]
            if seen is not None:
                out[key] = decided(seen, attempts, True)
        if kept:
            state.update((_packed([[key, until, end, None if seen is None else [[n, *own] for n, own in seen.items()]] for key, (until, end, seen) in kept.items()]),))
            state.setTimeoutTimestamp(max(min(end for _, end, _ in kept.values()), now))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"detail_id": list(out), "outcome": [x for x, _ in out.values()], "doc_count": [n for _, n in out.values()]})

    # nulls would turn a frame's longs into doubles; rows that don't count stay, for their event time
    valid = F.col("detail_id").isNotNull() & F.col("kind").isNotNull() & F.coalesce(F.col("attempt").between(1, attempts), F.lit(False))
    own = stream.withWatermark("at", late).select(
        _bucket(buckets),
        F.col("detail_id").isNotNull().alias("known"),
        valid.alias("valid"),
        F.coalesce(F.col("detail_id").cast("long"), F.lit(0)).alias("id"),
        F.coalesce(F.col("attempt").cast("int"), F.lit(0)).alias("attempt"),
        "kind",
        F.coalesce(F.col("doc_count").cast("long"), F.lit(0)).alias("count"),
        F.coalesce("grid_present", F.lit(False)).alias("grid"),
        F.coalesce(F.unix_millis("at"), F.lit(0)).alias("ms"),
        "at",
    )
    return own.groupBy("bucket").applyInPandasWithState(step, "detail_id long, outcome string, doc_count long", "packed binary", "append", "EventTimeTimeout")


def embed_resumable(stream: DataFrame, key: str, text: str, backend: str, root: str) -> None:
    """Embed what is new, in micro-batches; the backend is part of the paths, so vectors of two backends never mix."""
    from factloom.operators.nearest import hash_embed

    def write(batch: DataFrame, epoch: int) -> None:
        hash_embed(batch, key, text).withColumn("backend", F.lit(backend)).write.mode("overwrite").parquet(f"{root}/{backend}/vectors/epoch={epoch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/{backend}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def admitted(work: DataFrame, pages: str, order: str, budget: int) -> DataFrame:
    """Page budget in batch form: the work before the running sum passes the budget, with ``running`` and ``mean_pages``, the running average."""
    from factloom.operators import scan

    rows = scan.running(scan.placed(work, order), running=("sum", F.col(pages)), _count=("sum", F.lit(1).cast("long")))
    return rows.where(F.col("running") <= budget).select(*work.columns, "running", (F.col("running") / F.col("_count")).alias("mean_pages"))


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)
