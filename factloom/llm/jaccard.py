"""N-gram Jaccard join: documents whose sets of word shingles are similar.

A node is a distinct text, told by its SHA-256, whatever ids its rows have. Nodes are found by
prefix filtering: in the global order of grams, rare first, similar sets share a
gram in their prefixes. Postings of a gram pass the length, positional and suffix
filters, and each candidate pair is verified once on whole texts.

In a group of many similar documents not all pairs are looked at: a first round
takes, for each gram, neighbours and hubs, and a second one every pair that the first
left in different components. So no link between components is lost. Groups that a gram makes large are split in both rounds:
by a salt in the first, into blocks of ``UNIT`` postings, of which two meet in a task, in the second.
The order is by a sketch of counts over all documents (``COUNTERS`` counters, a fixed size),
ties by hash; a collision can move a gram in the order, the same way everywhere, and so costs candidates, never links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import chunks, discard, materialize, texts_of, tidy
from factloom.llm.components import components
from factloom.llm.shingles import mix, shingle_sets

#: Counters of the frequency sketch (16 MB), sent in PARTS parts.
COUNTERS, PARTS = 1 << 22, 64
#: Groups of postings up to this size give all their pairs in the first round.
SMALL = 6
#: Postings of a gram from which the first round splits them, and postings of a block of the second.
HOT, UNIT = 20_000, 500
#: Bytes of text for each bucket of postings, about; most partitions they are dealt to.
BUCKET_BYTES, PARTITIONS = 4 << 20, 1 << 16
#: Postings that a task holds before it sends them.
HELD = 150_000

POSTING = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("n", "<u4"), ("pos", "<u4"), ("sig", "<u8", 2), ("hot", "u1")])

#: Offsets at which members of a larger group, in the order of sizes, are compared in the first round.
OFFSETS = (1, 2, 4, 8, 16)
#: Bits of the map of documents that take part in a comparison (1 MB).
ID_BITS = 1 << 23


def overlap_needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least overlap of sets of sizes n and m for a similarity of 0.8."""
    return (4 * (n + m) + 8) // 9


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _bit(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(40)).astype(np.int64) & 127


def suffix_signatures(ordered: np.ndarray, prefix: int) -> np.ndarray:
    """For each place of the prefix, the parities of the counts, in 128 parts, of the grams behind it.

    Where two suffixes differ in a parity, they differ in a gram at least.
    """
    whole = np.packbits(np.bincount(_bit(ordered), minlength=128).astype(np.uint8) & 1, bitorder="little").view("<u8")
    own, bit = np.zeros((prefix, 2), np.uint64), _bit(ordered[:prefix])
    own[np.arange(prefix), bit >> 6] = np.uint64(1) << (bit & 63).astype(np.uint64)
    return whole ^ np.bitwise_xor.accumulate(own, axis=0)


def passes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length, positional and suffix filters for pairs of postings of one gram.

    Places count as if the gram were the first that both have: a similar pair passes at its first common gram. There, what lies
    before differs wholly, and the suffixes may differ in no more than what is left of the difference that is allowed.
    """
    n, m, i, j = (x.astype(np.int64) for x in (a["n"], b["n"], a["pos"], b["pos"]))
    need = overlap_needed(n, m)
    ok = (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (np.minimum(n - i, m - j) >= need)
    at = np.flatnonzero(ok)
    if len(at):
        ok[at] = np.bitwise_count(a["sig"][at] ^ b["sig"][at]).sum(axis=1, dtype=np.int64) <= (n + m - 2 * need - i - j)[at]
    return ok


def _ordered(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings by gram, size and document; the starts of groups, and the end."""
    p = p[np.lexsort((p["doc"], p["n"], p["gram"]))]
    starts = np.flatnonzero(np.concatenate([[True], p["gram"][1:] != p["gram"][:-1]])) if len(p) else np.zeros(0, np.int64)
    return p, np.append(starts, len(p))


def _pairs(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = p[x], p[y]
    ok = passes(a, b) & (a["doc"] != b["doc"])
    a, b = a["doc"][ok], b["doc"][ok]
    return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def first_round(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct candidate pairs, and the postings of groups that aren't done with: large ones, and all of hot grams, whose other postings are elsewhere."""
    p, starts = _ordered(p)
    size = np.diff(starts)
    hot = p["hot"][starts[:-1]] > 0
    found, big = [np.zeros((0, 2), np.int64)], [p[np.repeat(hot & (size <= SMALL), size)]]
    for g in range(2, SMALL + 1):
        at = starts[:-1][size == g]
        for i, j in combinations(range(g), 2):
            found.append(_pairs(p, at + i, at + j))
    for a, g in zip(starts[:-1][size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        group, n = p[a : a + g], p["n"][a : a + g].astype(np.int64)
        hubs, hub = np.zeros(g, np.int64), 0
        while hub < g:  # a hub serves the sizes it can be similar to
            end = int(np.searchsorted(n, n[hub] * 5 // 4, side="right"))
            end = max(end, hub + 1)
            hubs[hub:end] = hub + (end - hub) // 2
            hub = end
        k = np.arange(g)
        found.append(_pairs(group, k, hubs))
        found += [_pairs(group, k[:-d], k[d:]) for d in OFFSETS if d < g]
        big.append(group)
    return np.unique(np.concatenate(found), axis=0), np.concatenate(big)


def count_grams(nodes: DataFrame) -> DataFrame:
    """Rows of two kinds: per node ``node, n``; per task the counters, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counts = np.zeros(COUNTERS, np.uint32)
        for batch in chunks(batches, most=2 << 20):
            sets = shingle_sets(texts_of(batch))
            for s in sets:
                np.add.at(counts, (s & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
            none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *none], names=["node", "n", "part", "counts"])
        if counts.any():
            pack = zstandard.ZstdCompressor(level=1).compress
            for k, x in enumerate(np.split(counts, PARTS)):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([pack(x.tobytes())], pa.binary())], names=["node", "n", "part", "counts"])

    return nodes.select("node", "text").mapInArrow(tidy(run), "node long, n long, part int, counts binary")


def sketch_of(counted: DataFrame) -> np.ndarray:
    """The counters of all documents: COUNTERS * 4 bytes, whatever the size of the table."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, sums = zstandard.ZstdDecompressor().decompress, {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(unpack(data), np.uint32)
                sums[part] = sums[part] + x if part in sums else x.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros((PARTS, COUNTERS // PARTS), np.uint32)
    rows = counted.where("part is not null").select("part", "counts").repartition(PARTS, "part")
    for part, data in rows.mapInArrow(tidy(add), "part int, counts binary").collect():
        out[part] = np.frombuffer(data, np.uint32)
    return out.reshape(-1)


def taking_part(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The nodes of the pairs, and a few others: by a bit map of fixed size, before any shuffle."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BITS)) + 1
    ids = pairs.select(F.explode(F.array("a", "b")).alias("i")).select(place("i").alias("h"))
    bits = ids.groupBy(F.bitmap_bucket_number("h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits"))
    at = nodes.select("node", "text").withColumn("_h", place("node")).withColumn("_p", F.bitmap_bit_position("_h"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_p div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return at.join(F.broadcast(bits), F.bitmap_bucket_number("_h") == F.col("_bucket")).where(F.lit(1) == F.getbit(byte, (F.col("_p") % 8).cast("int"))).select("node", "text")


def verify(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose whole texts are similar, each looked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "ta", 1 << 20):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = dict(zip(a, batch.column(2).to_pylist(), strict=True)) | dict(zip(b, batch.column(3).to_pylist(), strict=True))
            sets = dict(zip(texts, shingle_sets(list(texts.values())), strict=True))
            good = []
            for x, y in zip(a, b, strict=True):
                s, t = sets[x], sets[y]
                both = np.concatenate([s, t])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(shared > 0 and 100 * shared >= 80 * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    nodes = taking_part(nodes, pairs)
    left = nodes.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = nodes.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long")


def post(nodes: DataFrame, sketch, buckets: int) -> DataFrame:
    """``bucket, postings``: the prefix of each node's set, with its filters, dealt out by gram (and salt, where the sketch says that a gram is hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sketch.value
        held, weight = [], 0

        def out() -> pa.RecordBatch:
            p = np.concatenate(held)
            parts = seen[(p["gram"] & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) // np.uint64(HOT) + np.uint64(1)
            salt = mix(p["gram"] ^ mix(p["doc"].astype(np.uint64))) % parts
            bucket = (mix(p["gram"] + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            p, bucket = p[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), pa.array([x.tobytes() for x in np.split(p, cut[1:])], pa.binary())], names=["bucket", "postings"])

        for batch in chunks(batches, most=2 << 20):
            for doc, grams in zip(batch.column(0).to_pylist(), shingle_sets(texts_of(batch)), strict=True):
                n = len(grams)
                if not n:
                    continue
                count = seen[(grams & np.uint64(COUNTERS - 1)).astype(np.int64)]
                order, size = np.lexsort((grams, count)), prefix_size(n)
                p = np.zeros(size, POSTING)
                p["gram"], p["doc"], p["n"], p["pos"], p["sig"] = grams[order[:size]], doc, n, np.arange(size), suffix_signatures(grams[order], size)
                p["hot"] = count[order[:size]] >= HOT
                held.append(p)
                weight += size
                if weight > HELD:
                    yield out()
                    held, weight = [], 0
        if held:
            yield out()

    return nodes.select("node", "text").mapInArrow(tidy(run), "bucket int, postings binary").repartition(min(buckets, PARTITIONS), "bucket").sortWithinPartitions("bucket")


def candidates(posted: DataFrame) -> DataFrame:
    """Pairs of the first round (``a, b``), and the postings (``a, gram, n, pos, sig``) of the groups that the second one looks at; a bucket at a time."""

    def answer(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        pairs, big = first_round(np.frombuffer(b"".join(held), POSTING))
        for a in range(0, len(pairs), 20_000):
            x = pairs[a : a + 20_000]
            none = [*(pa.nulls(len(x), pa.int64()) for _ in range(3)), pa.nulls(len(x), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy()), *none], names=["a", "b", "gram", "n", "pos", "sig"])
        for a in range(0, len(big), 20_000):
            x = big[a : a + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(x["doc"].copy()), pa.nulls(len(x), pa.int64()), pa.array(x["gram"].astype("<i8")), pa.array(x["n"].astype(np.int64)), pa.array(x["pos"].astype(np.int64)), pa.array([r.tobytes() for r in x["sig"]], pa.binary())], names=["a", "b", "gram", "n", "pos", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and held:
                    yield from answer(held)
                    held = []
                now = bucket
                held.append(x)
        if held:
            yield from answer(held)

    return posted.mapInArrow(tidy(run), "a long, b long, gram long, n long, pos long, sig binary")


def _compare(p: np.ndarray, x: np.ndarray, y: np.ndarray, same: bool) -> np.ndarray:
    """Candidate pairs between the postings at x and at y (``same``: each pair of x once) of different components and neighbouring sizes."""
    if len(x) > len(y) and not same:
        x, y = y, x
    found = [np.zeros((0, 2), np.int64)]
    for k, i in enumerate(x.tolist()):
        j = y[k + 1 :] if same else y
        j = j[(p["component"][j] != p["component"][i]) & (p["role"][j] + p["role"][i] < 2)]
        if len(j):
            found.append(_pairs(p, np.full(len(j), i), j))
    return np.concatenate(found)


def second_round(open_groups: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """Candidate pairs ``a, b`` of one gram whose nodes are in different components.

    Sizes of similar sets lie in one band (a power of 5/4) or in two next to each other, so a cell is a gram and two bands. In a cell the largest
    component's postings are never compared among themselves: they meet the others, and the others meet each other, both in blocks of about UNIT.
    """
    rows = open_groups.join(labels.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    rows = materialize(rows, "open", size=size)
    mixed = materialize(rows.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("gram"), "mixed", size=size)
    band = F.floor(F.log("n") / F.lit(float(np.log(1.25)))).cast("int")
    both = F.explode(F.array(*(F.struct((band + r).alias("cell"), F.lit(r).alias("role")) for r in (0, 1))))
    roles = rows.join(mixed, "gram", "left_semi").select("gram", F.col("a").alias("doc"), "n", "pos", "sig", "component", both.alias("at")).select("*", "at.cell", "at.role").drop("at")
    per = roles.groupBy("gram", "cell", "component").agg(F.count("*").alias("k"), F.sum(1 - F.col("role")).alias("own"))
    cells = per.groupBy("gram", "cell").agg(F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("total"), F.sum("own").alias("own")).where("total > top.k and own > 0")
    chunks_of = lambda n: F.ceil(n / UNIT).cast("int")
    cells = materialize(cells.select("gram", "cell", F.col("top.component").alias("top"), chunks_of(F.col("top.k")).alias("tops"), chunks_of(F.col("total") - F.col("top.k")).alias("rests")), "cells", size=size)
    is_top = F.col("component") == F.col("top")
    own = F.pmod(F.xxhash64("doc"), F.when(is_top, F.col("tops")).otherwise(F.col("rests"))).cast("int")
    unit = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    zero, one = F.lit(0), F.lit(1)
    met = F.when(is_top, F.transform(F.sequence(zero, F.col("rests") - 1), lambda j: unit(0, F.col("own"), j, zero))).otherwise(
        F.concat(
            F.transform(F.sequence(zero, F.col("tops") - 1), lambda i: unit(0, i, F.col("own"), one)),
            F.transform(F.sequence(zero, F.col("rests") - 1), lambda j: unit(1, F.least("own", j), F.greatest("own", j), F.when(F.col("own") <= j, zero).otherwise(one))),
        )
    )
    kind = np.dtype([(k, POSTING.fields[k][0]) for k in ("gram", "doc", "n", "pos", "sig")] + [(k, "<i8") for k in ("component", "role", "cell", "kind", "i", "j", "side")])
    names = list(kind.names)

    def pairs_of(held: list[np.ndarray]) -> np.ndarray:
        p = np.concatenate(held)
        x, y = np.flatnonzero(p["side"] == 0), np.flatnonzero(p["side"] == 1)
        return _compare(p, x, x, True) if p["kind"][0] == 1 and p["i"][0] == p["j"][0] else _compare(p, x, y, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, weight = [], 0

        def out() -> pa.RecordBatch:
            x = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], names=["a", "b"])

        held: list[np.ndarray] = []
        key = key_columns()
        for batch in batches:
            p = np.zeros(batch.num_rows, kind)
            for k, name in enumerate(names):
                p[name] = np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u8").reshape(-1, 2) if name == "sig" else np.asarray(batch.column(k)).astype(p.dtype[name])
            cut = np.flatnonzero((p[key][1:] != p[key][:-1])) + 1
            for part in np.split(p, cut):
                if not len(part):
                    continue
                if held and (held[-1][key][-1:] != part[key][:1]).any():
                    found.append(pairs_of(held))
                    weight += len(found[-1])
                    held = []
                held.append(part)
                if weight > 200_000:
                    yield out()
                    found, weight = [], 0
        if held:
            found.append(pairs_of(held))
        if found:
            yield out()

    dealt = roles.join(cells, ["gram", "cell"]).withColumn("own", own).withColumn("u", F.explode(met))
    dealt = dealt.select("gram", "doc", "n", "pos", "sig", "component", "role", "cell", "u.kind", "u.i", "u.j", "u.side")
    parts = min(PARTITIONS, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    sent = dealt.repartition(parts, *key_columns()).sortWithinPartitions(*key_columns())
    out = materialize(sent.mapInArrow(tidy(run), "a long, b long").distinct(), "pairs", size=size)
    discard(rows, mixed, cells)
    return out


def key_columns() -> list[str]:
    return ["gram", "cell", "kind", "i", "j"]


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id``; documents link at a Jaccard similarity of 0.8 or more.

    ``component_id`` is the smallest id reachable by links (null where none of the rows has one). A null, empty or blank text has
    no shingles, links with nothing, and is its own component; fewer than five words count as one shingle.
    Rows that repeat a text are one node, rows that repeat an id with other texts are several. Very long texts are compared whole, each by one task. An empty table gives an empty result.
    With ``with_groups`` also ``key``, the SHA-256 of the text, and ``group``, a number of the component that does not depend on ids (null without shingles).
    """
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    nodes = docs.groupBy("key").agg(F.min("doc_id").alias("first"), F.any_value("text").alias("text")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(nodes, "nodes", size=size)
    counted = materialize(count_grams(nodes), "grams")
    sketch = spark.sparkContext.broadcast(sketch_of(counted))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    found = materialize(candidates(post(nodes, sketch, buckets)), "candidates", size=size)
    sketch.destroy()
    given = found.where("b is not null").select("a", "b")
    pairs = materialize(given.distinct(), "pairs", rows=given.count())
    links = materialize(verify(pairs, nodes), "similar", size=size)
    labels = materialize(components(links), "labels", rows=2 * links.count())
    more = more_links = None
    open_groups = found.where("b is null").select("a", "gram", "n", "pos", "sig")
    if open_groups.take(1):
        more = second_round(open_groups, labels, size)
        more_links = materialize(verify(more.join(pairs, ["a", "b"], "left_anti"), nodes), "similar", size=size)
        if more_links.take(1):
            discard(labels)
            labels = materialize(components(links.unionByName(more_links)), "labels", rows=2 * links.count())
    own = nodes.select("node", "key", "first").join(counted.where("part is null").select("node", "n"), "node").join(labels, "node", "left")
    own = materialize(own, "own", size=size)
    tops = materialize(own.where("component is not null").groupBy("component").agg(F.min("first").alias("top")), "tops", size=size)
    named = own.join(tops, "component", "left").select("key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("group"), F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("top")).alias("component"))
    named = materialize(named, "named", size=size)
    discard(nodes, counted, found, pairs, links, more, more_links, labels, own, tops)
    # both sides are read from files, so that a text with very many copies can be split
    out = docs.select("doc_id", "key").join(named, "key", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", *["key", "group"][: 2 * with_groups])
