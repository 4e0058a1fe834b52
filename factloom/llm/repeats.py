"""Removal of repeated 200-byte strings by a distributed difference cover.

Suffixes are looked at through the places whose position in the text lies, modulo
``PERIOD``, in a perfect difference cover. For any two positions some shift
below PERIOD brings both into the cover, so two equal 200-byte strings contain a pair
of sampled tuples of ``TUPLE`` = 201 - PERIOD bytes. The steps:

1. sort the sampled tuples: each gets a name, and names are dealt out by value and sorted; equal neighbours mark a tuple as repeated.
   A tuple is 144 bytes, so that names of one level decide and the recursion on names ends at once;
2. merge the remaining suffixes: every position from which a repeated tuple is within reach gets the name of its 200-byte prefix, and those are dealt out and sorted;
3. compare adjacent prefixes: equal neighbours are repeats, and the bytes they cover go.

Names are hashes, so suffixes are sorted by name and not by the alphabet; only equality of neighbours is used.
Names in step 3 have 96 bits besides the bucket's, so that a false repeat is not to be expected in 100 TB either. They travel packed, in one row for each block of texts and bucket, and come back as a bit each, in the same order.
A text with a copy repeats as a whole; only its first copy takes part in the steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import chunks, discard, materialize, tidy
from factloom.llm.shingles import mix, powers

LENGTH, PERIOD = 200, 57
#: A perfect difference cover: every difference modulo PERIOD occurs (fixed values).
COVER = [0, 1, 3, 13, 32, 36, 43, 52]
TUPLE = LENGTH - PERIOD + 1
#: Bytes of text for each bucket of names, about: the first, until there are MANY buckets, then up to the second. A task holds one bucket at a time, whatever the size of the table.
BUCKET_BYTES, LARGEST, MANY = 6 << 20, 64 << 20, 1 << 14
#: Most partitions that buckets are dealt to.
PARTITIONS = 1 << 16
#: Bytes of text in a block; a task works with some twenty bytes for each.
BLOCK_BYTES = 1 << 20
SEGMENT = 1 << 19

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_TABLES = np.random.default_rng(11).integers(1, 1 << 63, size=(3, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def names(raw: np.ndarray, at: np.ndarray, width: int, table: int = 0) -> np.ndarray:
    """64-bit name of the ``width`` bytes at each place (ascending)."""
    out = np.zeros(len(at), np.uint64)
    p = powers(SEGMENT + width + 1)
    for a in range(0, len(raw), SEGMENT):
        x, y = np.searchsorted(at, [a, a + SEGMENT])
        if x == y:
            continue
        part = raw[a : a + SEGMENT + width]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLES[table][part] * p[: len(part)], dtype=np.uint64, out=sums[1:])
        own = at[x:y] - a
        out[x:y] = (sums[own + width] - sums[own]) * p[SEGMENT - own]
    return mix(out)


class Block:
    """Texts of at least LENGTH bytes, packed together."""

    def __init__(self, row: dict):
        import zstandard

        self.row = row
        self.sizes = np.frombuffer(row["sizes"], "<i8")
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        kind = np.int32 if len(self.raw) < 1 << 31 else np.int64
        self.place = np.arange(len(self.raw), dtype=kind) - np.repeat(self.starts.astype(kind), self.sizes)
        self.left = np.repeat(self.sizes.astype(kind), self.sizes) - self.place

    def samples(self) -> np.ndarray:
        return np.flatnonzero(_IN_COVER[self.place % PERIOD] & (self.left >= TUPLE))

    def repeated(self) -> np.ndarray:
        at = self.samples()
        return at[np.unpackbits(np.frombuffer(self.row["marks"], np.uint8))[: len(at)] == 1]

    def candidates(self) -> np.ndarray:
        """Places of prefixes from which a repeated tuple is within reach."""
        at = self.repeated()
        step = np.zeros(len(self.raw) + 1, np.int32)
        np.add.at(step, at - np.minimum(self.place[at], PERIOD - 1), 1)
        np.add.at(step, at + 1, -1)
        return np.flatnonzero((np.cumsum(step)[:-1] > 0) & (self.left >= LENGTH))


BLOCK = "keys array<binary>, sizes binary, body binary, marks binary"


def block_row(keys: list[bytes], texts: list[bytes], marks: bytes = b"") -> pa.RecordBatch:
    import zstandard

    body = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
    return pa.RecordBatch.from_arrays(
        [pa.array([keys], pa.list_(pa.binary())), pa.array([np.array([len(x) for x in texts], "<i8").tobytes()]), pa.array([body]), pa.array([marks])],
        names=["keys", "sizes", "body", "marks"],
    )


def tuple_names(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and name (six bytes) of each sampled tuple."""
    h = names(block.raw, block.samples(), TUPLE)
    return (mix(h) % np.uint64(buckets)).astype(np.int64), np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def prefix_names(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and name (twelve bytes) of each candidate prefix, from two independent hashes."""
    at = block.candidates()
    first, second = names(block.raw, at, LENGTH), names(block.raw, at, LENGTH, 1)
    out = np.zeros(len(at), [("a", "<u8"), ("b", "<u4")])
    out["a"], out["b"] = first, second >> np.uint64(32)
    return ((second & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64), out.view(np.uint8).reshape(-1, 12)


def repeated_of(raw: np.ndarray) -> np.ndarray:
    """Which of the names (rows of up to twelve bytes) occur more than once."""
    wide = np.zeros((len(raw), 16), np.uint8)
    wide[:, : raw.shape[1]] = raw
    a, b = wide.view("<u8").reshape(-1, 2).T
    order = np.argsort(a)
    same = a[order[1:]] == a[order[:-1]]
    if (b[order[1:]][same] != b[order[:-1]][same]).any():  # one half alike, the other not
        order = np.lexsort((b, a))
        same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    hit = np.zeros(len(raw), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return hit


def dealt(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that deals entries out by bucket, the buckets, and their first entries with the end."""
    order = np.argsort(bucket, kind="stable")
    own = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return order, own[first], np.append(first, len(own))


def repeated_names(blocks: DataFrame, of: Callable, width: int, buckets: int, size: int) -> tuple[DataFrame, DataFrame]:
    """A scratch table, and from it ``block, answers``: for each bucket the bits that tell which names of the block occur more than once anywhere."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bucket, name = of(Block(row), buckets)
                order, own, cut = dealt(bucket)
                name = name[order]
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([row["block"]] * len(own), pa.int64()), pa.array([name[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)])], names=["bucket", "block", "names"])

    def answer(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch | None:
        hit = repeated_of(np.frombuffer(b"".join(x for _, _, x in held), np.uint8).reshape(-1, width))
        out, at = [], 0
        for bucket, block, x in held:
            n = len(x) // width
            if hit[at : at + n].any():
                out.append((block, bucket, np.packbits(hit[at : at + n]).tobytes()))
            at += n
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate([pa.int64(), pa.int32(), pa.binary()])], names=["block", "bucket", "bits"]) if out else None

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and held[0][0] != x[0]:
                    if (got := answer(held)) is not None:
                        yield got
                    held = []
                held.append(x)
        if held and (got := answer(held)) is not None:
            yield got

    sent = blocks.mapInArrow(tidy(send), "bucket int, block long, names binary").repartition(min(buckets, PARTITIONS), "bucket").sortWithinPartitions("bucket")
    got = materialize(sent.mapInArrow(tidy(receive), "block long, bucket int, bits binary"), "marks", size=size)
    return got, got.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))  # at most one for each bucket


def marked(block: Block, of: Callable, buckets: int, answers: list[dict]) -> np.ndarray:
    """Which of the block's names were answered with repeated."""
    order, own, cut = dealt(of(block, buckets)[0])
    at, hit = {int(b): k for k, b in enumerate(own)}, np.zeros(len(order), bool)
    for x in answers:
        k = at[x["bucket"]]
        hit[order[cut[k] : cut[k + 1]]] = np.unpackbits(np.frombuffer(x["bits"], np.uint8))[: cut[k + 1] - cut[k]] == 1
    return hit


RESULT = "key binary, n_removed long, spans array<struct<start: long, length: long>>, kept_sha256 string, kept_text string"


def find_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each text with repeats: ``key, whole, n_removed, spans, kept_sha256, kept_text``.

    ``key`` is the SHA-256 of the text; ``whole`` says that the text has a copy and goes as a whole (the others are null then);
    ``kept_text`` is what stays without the bytes of characters that a cut went through. Null texts, empty texts and those of under 200 bytes
    have no repeats; a text of many megabytes is a block of its own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"))
    rows = rows.where(F.octet_length("text") >= LENGTH)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    keys = materialize(rows.groupBy("key").agg(F.count("*").alias("copies")), "keys", size=size)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MANY, -(-size // BUCKET_BYTES)), -(-size // LARGEST))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=BLOCK_BYTES):
            yield block_row(batch.column(0).to_pylist(), [x.encode() for x in batch.column(1).to_pylist()])

    # one row for each text; copies are put together before the shuffle
    first = rows.groupBy("key").agg(F.any_value("text").alias("text"))
    numbered = lambda b: b.withColumn("block", F.monotonically_increasing_id())
    blocks = materialize(numbered(first.mapInArrow(tidy(pack), BLOCK)), "blocks", size=size)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                hit, at = marked(block, tuple_names, buckets, row["answers"]), block.samples()
                owner = np.searchsorted(block.starts, at, side="right") - 1
                some = np.bincount(owner[hit], minlength=len(block.sizes)) > 0
                texts = [block.raw[a : a + n].tobytes() for a, n in zip(block.starts[some].tolist(), block.sizes[some].tolist(), strict=True)]
                yield block_row([k for k, x in zip(row["keys"], some.tolist(), strict=True) if x], texts, np.packbits(hit[some[owner]]).tobytes())

    marks, answers = repeated_names(blocks, tuple_names, 6, buckets, size)
    some = materialize(numbered(blocks.join(answers, "block").mapInArrow(tidy(narrow), BLOCK)), "blocks", size=size)
    discard(blocks, marks)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                at = block.candidates()[marked(block, prefix_names, buckets, row["answers"])]
                step = np.zeros(len(block.raw) + 1, np.int32)
                step[at] += 1
                np.add.at(step, at + LENGTH, -1)
                gone = np.cumsum(step)[:-1] > 0
                out = []
                for key, a, n in zip(row["keys"], block.starts.tolist(), block.sizes.tolist(), strict=True):
                    own = gone[a : a + n]
                    if own.any():
                        edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
                        x, y = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
                        kept = block.raw[a : a + n][~own].tobytes()
                        out.append((key, int(own.sum()), [{"start": i, "length": j - i} for i, j in zip(x, y, strict=True)], hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", errors="ignore")))
                if out:
                    kinds = [pa.binary(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["key", "n_removed", "spans", "kept_sha256", "kept_text"])

    marks, answers = repeated_names(some, prefix_names, 12, buckets, size)
    found = materialize(some.join(answers, "block").mapInArrow(tidy(remove), RESULT), "repeats", size=size)
    copied = keys.where("copies > 1").select("key", F.lit(True).alias("whole"))
    # a row for each text with repeats, in files: what is joined with it can be split where a text has very many copies
    out = materialize(found.join(copied, "key", "full").select("key", F.coalesce("whole", F.lit(False)).alias("whole"), *[F.when(F.col("whole").isNull(), F.col(c)).alias(c) for c in ("n_removed", "spans", "kept_sha256", "kept_text")]), "removals", size=size)
    discard(keys, some, marks, found)
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A null text counts as empty; texts shorter than 200 bytes have no repeats; a text with a copy of itself, of
    200 bytes or more, goes as a whole. Overlapping repeats count, also in one
    text. Repeated rows repeat; an empty table gives an empty result.
    """
    found = find_repeats(docs, text_col)
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"))
    got = rows.join(found.select("key", "whole", F.col("n_removed").alias("n"), F.size("spans").cast("long").alias("s"), F.col("kept_sha256").alias("sha")), "key", "left")
    return got.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.lit(1)).when(F.col("n").isNotNull(), F.col("s")).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(F.col("whole"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", F.lower(F.hex("key")))).alias("kept_sha256"),
    )
