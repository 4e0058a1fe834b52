"""Token counts without token ids.

1. Distinct pre-tokens of all documents, with how often they occur, counted within each task before the shuffle.
2. The pieces of each distinct pre-token are counted once.
3. Per-document pre-token frequencies are joined to these counts and summed: the most frequent ``HEAD`` pre-tokens go to every task
   as a table of fixed size, and only what a document has of the others is shuffled to meet its counts. A hot pre-token is in the head, so the join has no hot key.

A text is cut into runs before every blank that a non-blank follows, where a byte-level pre-tokenizer always cuts; a run is cut into pre-tokens once.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.bpe import Memo, PairIndexBPE
from factloom.llm.common import chunks, discard, fine_batches, materialize, texts_of, tidy

#: Most frequent pre-tokens whose counts every task has.
HEAD = 200_000
#: Bytes of distinct runs that a task holds before it sends their pre-tokens; each counts COST more.
HELD, COST = 96 << 20, 120


@cache
def library(path: str):
    """Counts of whole texts by the tokenizer's own library, for tokenizers that aren't byte-level BPE."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda xs: [len(x) for x in sp.encode(xs, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda xs: [len(e) for e in tok.encode_batch_fast(xs, add_special_tokens=False)]


@cache
def cutter(path: str) -> PairIndexBPE:
    """One for each Python worker."""
    return PairIndexBPE(path)


def byte_level(path: str) -> bool:
    """Whether the file is a byte-level BPE with the usual pre-tokenizer and no normalizer."""
    import json

    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return spec["model"].get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["model"].get("ignore_merges")


def pretokens(docs: DataFrame, path: str) -> DataFrame:
    """``piece, freq``: each distinct pre-token of ``text``, and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held, weight = cutter(path), Counter(), 0

        def out() -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for piece, n in held.items():
                for p in cut.pretokens(piece):
                    found[p] += n
            names = list(found)
            for a in range(0, len(names), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 50_000]), pa.array([found[p] for p in names[a : a + 50_000]], pa.int64())], names=["piece", "freq"])

        for batch in chunks(batches, most=2 << 20):
            before = len(held)
            for text in texts_of(batch):
                own = cut.cut_runs(text)
                held.update(own)
                weight += max(map(len, own), default=0)
            weight += COST * (len(held) - before)
            if weight > HELD:
                yield from out()
                held, weight = Counter(), 0
        yield from out()

    return docs.select("text").mapInArrow(tidy(run), "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))


def counted(pieces: DataFrame, path: str) -> DataFrame:
    """``piece, freq, n``: the pieces of each distinct pre-token, counted once and without ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(path)
        for batch in chunks(batches, "piece", 1 << 18):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut.sizes(batch.column(0).to_pylist()), pa.int64())], names=["piece", "freq", "n"])

    return pieces.mapInArrow(tidy(run), "piece string, freq long, n long")


def _cutoff(pieces: DataFrame) -> float:
    """A frequency that at most HEAD pre-tokens exceed: by a histogram of some hundred bins, whatever the size of the table."""
    bins = sorted(pieces.groupBy(F.floor(F.log2("freq") * 16).alias("bin")).count().collect(), reverse=True)
    total = 0
    for b, n in bins:
        total += n
        if total > HEAD:
            return 2 ** ((b + 1) / 16) - 1e-6
    return 0


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per document: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    A null or empty text has no bytes and no tokens. Repeated rows and ties
    are counted row by row; very long texts are cut whole, by one task; an empty table gives an empty result.
    ``path`` must be readable on every executor (it belongs to the installed package). Files other than byte-level BPE
    have no pre-tokens that hold in any text; their library counts whole texts.
    """
    spark = docs.sparkSession
    fine_batches(spark)
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    told = lambda d, n: d.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
    if not byte_level(path):

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(library(path)(texts_of(batch)), pa.int64())], names=["doc_id", "n_bytes", "n"])

        given = given.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
        return told(given.mapInArrow(tidy(whole), "doc_id long, n_bytes long, n long"), F.col("n"))

    pieces = materialize(counted(pretokens(given, path), path), "pieces")
    head = dict(pieces.where(F.col("freq") > _cutoff(pieces)).select("piece", "n").collect())  # at most HEAD rows
    sent = spark.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, head = cutter(path), sent.value
        known, memo = Memo(head), Memo()  # counts of runs that the head has; of others, what it says of them and what it lacks
        get = known.get

        for batch in chunks(batches, most=2 << 20):
            sums, rest = [], []
            for row, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                own = cut.cut_runs(text)
                each = list(map(get, own))
                lacking: Counter = Counter()
                if None in each:
                    for piece, f in Counter([p for p, n in zip(own, each, strict=True) if n is None]).items():
                        got = memo.get(piece)
                        if got is None:
                            parts = cut.pretokens(piece)
                            got = sum(head.get(p, 0) for p in parts), [p for p in parts if p not in head]
                            if got[1]:
                                memo.keep_one(piece, got)
                            else:
                                known.keep_one(piece, got[0])
                        each.append(got[0] * f)
                        for p in got[1]:
                            lacking[p] += f
                total = sum(filter(None, each))
                sums.append(total)
                rest += [(row, p, f) for p, f in lacking.items()]
            rows, names, freqs = zip(*rest, strict=True) if rest else ((), (), ())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=["row", "doc_id", "n_bytes", "n", "piece", "f"])
            for a in range(0, len(rows), 50_000):
                b = min(a + 50_000, len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(rows[a:b], pa.int64()), *(pa.nulls(b - a, pa.int64()) for _ in range(3)), pa.array(names[a:b], pa.string()), pa.array(freqs[a:b], pa.int64())], names=["row", "doc_id", "n_bytes", "n", "piece", "f"])

    numbered = given.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    both = materialize(numbered.mapInArrow(tidy(run), "row long, doc_id long, n_bytes long, n long, piece string, f long"), "frequencies")
    sent.destroy()
    rest = both.where("piece is not null").select("row", "piece", "f").join(pieces.select("piece", F.col("n").alias("each")), "piece").groupBy("row").agg(F.sum(F.col("f") * F.col("each")).alias("more"))
    rest = materialize(rest, "rest")
    discard(pieces)
    return told(both.where("piece is null").select("row", "doc_id", "n_bytes", "n").join(rest, "row", "left"), F.col("n") + F.coalesce("more", F.lit(0)))
