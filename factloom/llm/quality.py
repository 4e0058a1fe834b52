"""Quality score by a factorisation machine.

A document's inputs are its hashed words and word shapes, structure statistics,
and text metadata (its size). Pairwise interactions are of low rank and are scored in
linear time: the sum over pairs is half of (square of the sum minus sum of the squares).
Labels, language, source and id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import chunks, fine_batches, map_rows, texts_of, tidy

#: Bytes of text that are turned into inputs at once; each takes some hundred bytes meanwhile.
CHUNK = 1 << 20

#: Buckets of hashed words and shapes; rank of the interactions.
BUCKETS, RANK = 1 << 12, 8
#: Most labelled rows that the machine is fitted on: those whose hashed ids are the smallest.
SAMPLE = 6000
#: Score from which a document is kept.
THRESHOLD = 0.7

_CLASS = np.full(256, 5, np.int8)  # 0 lower case, 1 upper case, 2 digit, 3 white space, 4 beyond ASCII, 5 sentence marks, 6 other marks
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[128:] = 4
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-"]] = 6
_CLASS[[b for b in range(32) if b not in (9, 10, 11, 12, 13)] + [127]] = 6
_MIX = np.random.default_rng(7).integers(1, 1 << 62, size=(16, 256), dtype=np.uint64) | np.uint64(1)
_SHAPE = np.random.default_rng(8).integers(1, 1 << 62, size=(16, 8), dtype=np.uint64) | np.uint64(1)
N_STATS = 16


def featurize(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: document and bucket of each entry with its value (sorted by document and bucket), and the statistics."""
    data = [x.encode() for x in texts]
    n = len(data)
    sizes = np.array([len(x) for x in data], np.int64)
    stats = np.zeros((n, N_STATS), np.float32)
    # a blank after each text keeps words apart
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes + 1)
    kind = _CLASS[raw]
    of_kind = np.bincount(doc.astype(np.int64) * 8 + kind, minlength=n * 8).reshape(n, 8)
    blank = kind == 3
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(starts):  # as in a batch with words
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), featurize([*texts, "a"])[3][:n] if n else stats
    ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    length = ends - starts
    word_doc = doc[starts]
    inside = np.flatnonzero(~blank)
    at = np.minimum(np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length), 15)
    first = np.cumsum(length) - length
    words = np.add.reduceat(_MIX[at, raw[inside]], first)
    shapes = np.add.reduceat(_SHAPE[np.minimum(at, 2), kind[inside]] * (kind[inside] != 0), first)
    ends_with = kind[ends - 1]
    entry = np.concatenate([word_doc, word_doc]).astype(np.int64) * BUCKETS + np.concatenate([words >> np.uint64(17), (shapes ^ (shapes >> np.uint64(29))) >> np.uint64(3)]).astype(np.int64) % BUCKETS
    entry, count = np.unique(entry, return_counts=True)
    entry_doc, bucket = entry // BUCKETS, entry % BUCKETS
    n_words = np.bincount(word_doc, minlength=n)
    pairs = np.unique((word_doc.astype(np.uint64) << np.uint64(40)) | (words >> np.uint64(24)))
    distinct = np.bincount((pairs >> np.uint64(40)).astype(np.int64), minlength=n)
    # lines: how many, and how many repeat in the document (lines of the same characters count as the same)
    lines = np.flatnonzero(raw == 10)
    n_lines = np.bincount(doc[lines], minlength=n) + 1
    cut = np.unique(np.concatenate([[0], lines + 1, np.cumsum(sizes + 1)[:-1]]))
    cut = cut[cut < len(raw)]
    sums = np.add.reduceat(_MIX[0, raw], cut)
    line_key = np.unique((doc[cut].astype(np.uint64) << np.uint64(40)) | (sums >> np.uint64(24)))
    n_distinct_lines = np.bincount((line_key >> np.uint64(40)).astype(np.int64), minlength=n)
    total = np.maximum(sizes, 1)
    w = np.maximum(n_words, 1)
    mark = np.bincount(word_doc, weights=ends_with == 6, minlength=n)
    alone = np.bincount(word_doc, weights=(length == 1) & (ends_with == 6), minlength=n)
    upper = np.bincount(word_doc, weights=(np.add.reduceat((kind[inside] == 1).astype(np.int64), first) > 1), minlength=n)
    for k, x in enumerate(
        [of_kind[:, 0] / total, of_kind[:, 1] / total, of_kind[:, 2] / total, of_kind[:, 3] / total, of_kind[:, 4] / total, of_kind[:, 5] / total, of_kind[:, 6] / total, mark / w, alone / w, upper / w, distinct / w, n_lines / w, n_distinct_lines / n_lines, np.bincount(word_doc, weights=length, minlength=n) / w / 10, np.log1p(sizes) / 10, np.log1p(n_words) / 10]
    ):
        stats[:, k] = x
    value = np.log1p(count) / np.sqrt(np.maximum(np.bincount(entry_doc, minlength=n), 1))[entry_doc]
    return entry_doc, bucket, value.astype(np.float32), stats


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # of buckets and statistics
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def rows(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -4, 4).astype(np.float32) * np.float32(0.5)

    def raw(self, doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw score and the factor sums of each document."""
        n, x = len(stats), self.rows(stats)
        linear = self.bias + x @ self.weights[BUCKETS:]
        sums, squares = x @ self.factors[BUCKETS:], (x * x) @ (self.factors[BUCKETS:] ** 2)
        if len(doc):
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            own = self.factors[bucket] * value[:, None]
            linear[doc[first]] += np.add.reduceat(self.weights[bucket] * value, first)
            sums[doc[first]] += np.add.reduceat(own, first, axis=0)
            squares[doc[first]] += np.add.reduceat(own * own, first, axis=0)
        assert len(linear) == n
        return linear + 0.5 * (sums**2 - squares).sum(axis=1), sums

    def score(self, texts: list[str]) -> np.ndarray:
        raw, _ = self.raw(*featurize(texts))
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))


def train(samples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.08, decay: float = 1e-4) -> Machine:
    """Logistic loss, AdaGrad, from (buckets, values, statistics) of each sampled row."""
    rng = np.random.default_rng(1)
    stats = np.array([s for _, _, s in samples], np.float32).reshape(len(samples), N_STATS)
    m = Machine(0.0, np.zeros(BUCKETS + N_STATS, np.float32), (rng.standard_normal((BUCKETS + N_STATS, RANK)) * 0.02).astype(np.float32), stats.mean(axis=0) if len(stats) else np.zeros(N_STATS, np.float32), stats.std(axis=0) + 1e-3 if len(stats) else np.ones(N_STATS, np.float32))
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.02, 0.98)
    m.bias = float(np.log(share / (1 - share)))
    g_w, g_v, g_b = np.full(len(m.weights), 1e-2, np.float32), np.full(m.factors.shape, 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for a in range(0, len(order), batch):
            few = order[a : a + batch]
            doc = np.repeat(np.arange(len(few)), [len(samples[i][0]) for i in few])
            bucket = np.concatenate([samples[i][0] for i in few])
            value = np.concatenate([samples[i][1] for i in few])
            raw, sums = m.raw(doc, bucket, value, stats[few])
            gap = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[few]).astype(np.float32) / len(few)
            x = m.rows(stats[few])
            ids = np.concatenate([bucket, np.tile(np.arange(BUCKETS, BUCKETS + N_STATS), len(few))])
            vals = np.concatenate([value, x.reshape(-1)])
            owner = np.concatenate([doc, np.repeat(np.arange(len(few)), N_STATS)])
            pull = gap[owner] * vals
            d_w = np.bincount(ids, weights=pull, minlength=len(m.weights)).astype(np.float32) + decay * m.weights
            used, place = np.unique(ids, return_inverse=True)
            d_v = np.zeros((len(used), RANK), np.float32)
            push = pull[:, None] * (sums[owner] - m.factors[ids] * vals[:, None])
            for k in range(RANK):
                d_v[:, k] = np.bincount(place, weights=push[:, k], minlength=len(used))
            d_v += decay * m.factors[used]
            d_b = float(gap.sum())
            g_w += d_w**2
            g_v[used] += d_v**2
            g_b += d_b**2
            m.weights -= rate * d_w / np.sqrt(g_w)
            m.factors[used] -= rate * d_v / np.sqrt(g_v[used])
            m.bias -= rate * d_b / g_b**0.5
    return m


def held_out(id_column) -> F.Column:
    """True for ids that no model may learn from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled rows that aren't held out, whatever the size of the tables.

    Of the documents that repeat an id one counts, that with the smallest hash of its text; of several labels of an id, the smallest.
    Null ids and labels don't count; null and empty texts do; no labelled row at all gives a machine that scores everything alike.
    """
    fine_batches(docs.sparkSession)
    own = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(own), "doc_id")  # at most `sample` rows
    # one text for each id: what reaches the driver has at most `sample` rows
    given = given.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("of")).select("doc_id", F.col("of.text").alias("text"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=CHUNK):
            doc, bucket, value, stats = featurize(texts_of(batch))
            cut = np.searchsorted(doc, np.arange(len(stats) + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([bucket[a:b].astype("<u2").tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([value[a:b].astype("<f4").tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([s.astype("<f4").tobytes() for s in stats], pa.binary())],
                names=["doc_id", "y", "bucket", "value", "stats"],
            )

    got = sorted(given.mapInArrow(tidy(run), "doc_id long, y int, bucket binary, value binary, stats binary").collect(), key=lambda r: (r[0], bytes(r[2])))
    samples = [(np.frombuffer(r[2], "<u2").astype(np.int64), np.frombuffer(r[3], "<f4"), np.frombuffer(r[4], "<f4")) for r in got]
    return train(samples, np.array([r[1] for r in got], np.float32))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``; with ``keep``, the rows themselves that are predicted 1.

    Null and empty texts get a score too (that of a text without words); repeated rows repeat; an empty table gives an empty result.
    """
    fine_batches(docs.sparkSession)

    name = f"c{docs.columns.index(text_col)}" if keep else "text"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, name, CHUNK):
            s = machine.score(texts_of(batch, name))
            if keep:
                yield batch.filter(pa.array(s >= threshold))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    if keep:
        return map_rows(docs, scored)
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), held_out(docs[id_col]).alias("held_out"))
    return given.mapInArrow(tidy(scored), "doc_id long, held_out boolean, score double, predicted int")
