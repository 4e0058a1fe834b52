"""Benchmark decontamination with an FM-index for each training shard.

A shard is a stretch of consecutive words. Its index is the Burrows-Wheeler
transform of the words in a wavelet matrix, with sampled suffix positions. Every
benchmark window is searched backwards, all windows at once; windows with a word that the shard
lacks end at once. Occurrences are located by walking to the next sampled suffix, and
the words they cover are merged into spans to remove.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import chunks, discard, fine_batches, map_rows, materialize, texts_of, tidy
from factloom.llm.shingles import words

#: Words of a window; words of a shard; every so many suffix positions are kept.
WINDOW, SHARD, SAMPLED = 10, 400_000, 16
#: Bytes of text that are searched at once; each takes some fifty bytes meanwhile.
CHUNK = 1 << 20
#: Most benchmark words that go to the executors at once; a larger benchmark is searched in blocks.
BLOCK_WORDS = 500_000

_INSIDE = np.zeros(256, bool)
_INSIDE[ord("0") : ord("9") + 1] = True
_INSIDE[ord("A") : ord("Z") + 1] = True
_INSIDE[ord("a") : ord("z") + 1] = True
_INSIDE[128:] = True


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling: first several symbols at once, then only groups that aren't settled."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    bits = int(s.max() + 1).bit_length()
    k = max(1, 62 // bits)
    padded = np.concatenate([s + 1, np.zeros(k, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(k):
        key = (key << bits) | padded[j : n + j]
    sa = np.argsort(key)
    rank, slots, order = np.zeros(n, np.int64), np.arange(n), sa
    key = key[sa]
    while True:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        rank[order] = np.repeat(slots[first], size)
        open_ = np.repeat(size > 1, size)
        if not open_.any():
            return sa
        slots, order = slots[open_], order[open_]
        after = order + k
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = (rank[order] << 32) | second
        by = np.argsort(key)
        order, key = order[by], key[by]
        sa[slots] = order
        k *= 2


class FMIndex:
    """Backward search and locating over a sequence of symbols 1, 2, ...; 0 separates texts."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        n = len(symbols)
        seps = np.flatnonzero(symbols == 0)
        s = symbols + (len(seps) - 1)
        s[seps] = np.arange(len(seps))
        sa = suffix_array(s)
        before = symbols[sa - 1]
        before[sa == 0] = 0
        counts = np.bincount(symbols, minlength=sigma + 1)
        self.first = np.cumsum(counts) - counts
        kept = (sa % SAMPLED == 0) | (before == 0)
        self.kept, self.kept_rank, self.positions = kept, np.cumsum(kept) - kept, sa[kept]
        self.levels = max(1, int(sigma).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (before >> level) & 1
            rank = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=rank[1:])
            self.ones.append(rank)
            self.zeros.append(n - int(rank[-1]))
            before = np.concatenate([before[bit == 0], before[bit == 1]])
        self.n = n

    def rank(self, c: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """How often symbol c comes before each place of the transform."""
        streams = [np.zeros(len(c), np.int64), *at]
        for k in range(self.levels):
            one = ((c >> (self.levels - 1 - k)) & 1).astype(bool)
            ones, zeros = self.ones[k], self.zeros[k]
            streams = [np.where(one, zeros + ones[x], x - ones[x]) for x in streams]
        return [x - streams[0] for x in streams[1:]]

    def symbol(self, row: np.ndarray) -> np.ndarray:
        c, x = np.zeros(len(row), np.int64), row
        for k in range(self.levels):
            ones = self.ones[k]
            one = ones[x + 1] > ones[x]
            c = (c << 1) | one
            x = np.where(one, self.zeros[k] + ones[x], x - ones[x])
        return c

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which patterns (rows of one length) occur, with their rows of the suffix order."""
        alive = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            low, high = self.rank(c, low, high)
            low, high = low + self.first[c], high + self.first[c]
            some = high > low
            alive, low, high = alive[some], low[some], high[some]
            if not len(alive):
                break
        return alive, low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text position of each row: walk back to a sampled suffix."""
        out, steps, which = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        while len(which):
            done = self.kept[row]
            out[which[done]] = self.positions[self.kept_rank[row[done]]] + steps
            row, which = row[~done], which[~done]
            if len(which):
                c = self.symbol(row)
                row = self.rank(c, row)[0] + self.first[c]
            steps += 1
        return out


class Windows:
    """Distinct benchmark windows, by length, and the items that have them (an item without id has windows, but no name)."""

    def __init__(self, items: list[tuple[str | None, str]]):
        h, owner, _, _ = words([x.encode() for _, x in items], _INSIDE)
        cut = np.searchsorted(owner, np.arange(len(items) + 1)).tolist()
        found: dict[bytes, set[str]] = {}
        for (item, _), a, b in zip(items, cut, cut[1:], strict=False):
            for k in range(a, max(b - WINDOW, a) + 1) if b > a else ():
                found.setdefault(h[k : min(k + WINDOW, b)].tobytes(), set()).update([] if item is None else [item])
        self.groups = []
        for size in sorted({len(k) for k in found}):
            own = [k for k in found if len(k) == size]
            self.groups.append((np.frombuffer(b"".join(own), np.uint64).reshape(len(own), size // 8), [sorted(found[k]) for k in own]))


def search_words(h: np.ndarray, owner: np.ndarray, groups: list) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words are hit, and the items found in each text."""
    n_texts = int(owner[-1]) + 1 if len(owner) else 0
    # a separator before each text's first word
    fresh = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    hit, items = np.zeros(len(h) + 1, np.int64), {}
    if not len(h) or not groups:
        return hit[:-1] > 0, items
    longest = max(g.shape[1] for g, _ in groups)
    for a in range(0, len(h), SHARD):
        own = h[a : a + SHARD + longest - 1]
        known, ids = np.unique(own, return_inverse=True)
        cuts = fresh[(fresh > a) & (fresh < a + len(own))] - a
        symbols = np.insert(ids.astype(np.int64) + 1, cuts, 0)
        symbols = np.append(symbols, 0)
        index = None
        for g, names in groups:
            at = np.minimum(np.searchsorted(known, g), len(known) - 1)
            there = np.flatnonzero((known[at] == g).all(axis=1))
            if not len(there):
                continue
            if index is None:
                index = FMIndex(symbols, len(known))
            which, low, high = index.search(at[there] + 1)
            if not len(which):
                continue
            n = high - low
            row = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            place = index.locate(row)
            place = a + place - np.searchsorted(cuts + np.arange(len(cuts)), place, side="right")
            np.add.at(hit, place, 1)
            np.add.at(hit, place + g.shape[1], -1)
            pairs = np.unique(np.repeat(there[which], n) * np.int64(n_texts) + owner[place])
            for w, t in zip((pairs // n_texts).tolist(), (pairs % n_texts).tolist(), strict=True):
                items.setdefault(t, set()).update(names[w])
    return np.cumsum(hit[:-1]) > 0, items


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list]:
    """The windows of the items, in blocks of bounded size; the driver holds one block at a time."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    # a word takes two bytes at least
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-size // (2 * BLOCK_WORDS)))
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect() if n > 1 else items.collect()
        yield n, Windows(sorted((tuple(r) for r in own), key=lambda r: (r[0] is None, r[0] or "", r[1]))).groups


def _edges(hit: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each stretch of hit words in one text."""
    if not len(hit):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], owner[1:] != owner[:-1]])
    before, after = np.concatenate([[False], hit[:-1]]) & ~new, np.concatenate([hit[1:], [False]]) & ~np.append(new[1:], True)
    return np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)


SPANS = "array<struct<start: long, length: long, word: long, words: long>>"
_SPAN = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "word", "words")]))


def _pass(docs: DataFrame, groups, with_spans: bool) -> DataFrame:
    """Of ``row, text``: ``row, n_words, n_hit, items`` and, if wanted, spans in bytes and in words. ``groups``: a broadcast, or none to count words only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=CHUNK):
            data = [x.encode() for x in texts_of(batch)]
            h, owner, start, length = words(data, _INSIDE)
            hit, items = search_words(h, owner, groups.value if groups else [])
            n = len(data)
            base = np.cumsum([0, *(len(x) + 1 for x in data)])
            out = [batch.column(0), pa.array(np.bincount(owner, minlength=n)), pa.array(np.bincount(owner, weights=hit, minlength=n).astype(np.int64)), pa.array([sorted(items.get(k, ())) for k in range(n)], pa.list_(pa.string()))]
            if with_spans:
                first, last = _edges(hit, owner)
                begin = np.searchsorted(owner, np.arange(n))
                spans: list[list[dict]] = [[] for _ in range(n)]
                for a, b in zip(first.tolist(), last.tolist(), strict=True):
                    t = int(owner[a])
                    spans[t].append({"start": int(start[a] - base[t]), "length": int(start[b] + length[b] - start[a]), "word": a - int(begin[t]), "words": b - a + 1})
                out.append(pa.array(spans, _SPAN))
            yield pa.RecordBatch.from_arrays(out, names=["row", "n_words", "n_hit", "items", "spans"][: len(out)])

    kind = docs.schema["row"].dataType.simpleString()
    return docs.select("row", "text").mapInArrow(tidy(run), f"row {kind}, n_words long, n_hit long, items array<string>" + f", spans {SPANS}" * with_spans)


def merged(spans: list[dict]) -> list[dict]:
    """Spans that overlap or touch in words become one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["word"]):
        if out and s["word"] <= out[-1]["word"] + out[-1]["words"]:
            top = out[-1]
            top["words"] = max(top["words"], s["word"] + s["words"] - top["word"])
            top["length"] = max(top["length"], s["start"] + s["length"] - top["start"])
        else:
            out.append(dict(s))
    return out


def hits_by_text(docs: DataFrame, first: list, more: Iterator[tuple[int, list]]) -> DataFrame:
    """For a benchmark of several blocks: ``key, n_hit, items, spans`` of each distinct text (``key, text``) with hits. One pass over the texts for each block, whose result is written; copies are put together before they are shuffled."""
    spark, parts, tables = docs.sparkSession, None, []
    for groups in (first, *(g for _, g in more)):
        sent = spark.sparkContext.broadcast(groups)
        own = _pass(docs.select(F.col("key").alias("row"), "text"), sent, True).where("n_hit > 0").groupBy("row").agg(F.any_value("items").alias("items"), F.any_value("spans").alias("spans"))
        tables.append(materialize(own, "hits"))
        sent.destroy()
        parts = tables[-1] if parts is None else parts.unionByName(tables[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sum(s["words"] for s in x) for x in spans], pa.int64()), batch.column(1), pa.array(spans, _SPAN)], names=["key", "n_hit", "items", "spans"])

    together = parts.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))  # one of each for each block at most
    out = materialize(together.mapInArrow(tidy(run), f"key binary, n_hit long, items array<string>, spans {SPANS}"), "hits")
    discard(*tables)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Words are runs of digits, letters and bytes from 128 on, A-Z lower-cased. An item of fewer than ten words is one window;
    items without text or words find nothing; items without id hit words, but aren't among the items found. A null text has no words. Repeated rows repeat; very long texts are
    searched whole, in shards; empty tables give an empty result, or one without hits.
    """
    fine_batches(docs.sparkSession)
    docs = docs.select(docs[id_col].cast("long").alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    blocks = blocks_of(benchmark, item_col, item_text)
    n, first = next(blocks)
    if n == 1:
        got = _pass(docs, docs.sparkSession.sparkContext.broadcast(first), False)
    else:
        keyed = docs.withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
        hits = hits_by_text(keyed, first, blocks)
        sizes = _pass(keyed.select(F.struct("row", "key").alias("row"), "text"), None, False).select("row.row", "row.key", "n_words")
        got = sizes.join(hits, "key", "left").select("row", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return got.select(F.col("row").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without(data: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without (first byte, length) spans, which are ascending and apart."""
    out, done = [], 0
    for a, n in spans:
        out.append(data[done:a])
        done = a + n
    return b"".join([*out, data[done:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows with every hit span cut out of the text, from its first to its last word; other columns stay as they are, whatever their names.

    Null and empty texts stay; repeated rows repeat; very long texts are searched whole, in shards; an empty table gives an empty result, an empty benchmark cuts nothing, and items
    without id are cut too. A benchmark of several blocks is searched one block after the other, each on the text as given.
    """
    fine_batches(docs.sparkSession)
    blocks = blocks_of(benchmark, item_col, item_text)
    n, first = next(blocks)
    at, several = docs.columns.index(text_col), n > 1
    sent = None if several else docs.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, f"c{at}", CHUNK):
            texts = batch.column(at).to_pylist()
            data = [(x or "").encode() for x in texts]
            new = list(texts)
            if several:
                for t, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    if spans:
                        new[t] = without(data[t], [(s["start"], s["length"]) for s in spans])
            else:
                h, owner, start, length = words(data, _INSIDE)
                first, last = _edges(search_words(h, owner, sent.value)[0], owner)
                base = np.cumsum([0, *(len(x) + 1 for x in data)])
                cut: dict[int, list[tuple[int, int]]] = {}
                for a, b in zip(first.tolist(), last.tolist(), strict=True):
                    t = int(owner[a])
                    cut.setdefault(t, []).append((int(start[a] - base[t]), int(start[b] + length[b] - start[a])))
                for t, spans in cut.items():
                    new[t] = without(data[t], spans)
            columns = list(batch.columns)[:width]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])

    width, more = len(docs.columns), []
    if several:
        text = F.coalesce(docs[text_col], F.lit(""))
        key = F.unhex(F.sha2(text.cast("binary"), 256))
        hits = hits_by_text(docs.select(text.alias("text"), key.alias("key")), first, blocks)
        own, more = f"_{uuid.uuid4().hex}", [f"_{uuid.uuid4().hex}"]  # no names of the input
        docs = docs.withColumn(own, key).join(hits.select(F.col("key").alias(own), F.col("spans").alias(more[0])), own, "left").drop(own)
    return map_rows(docs, run, more)
