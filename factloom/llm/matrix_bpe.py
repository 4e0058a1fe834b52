"""Byte-level BPE on padded matrices.

The distinct pre-tokens of a batch are put in buckets of like length, each a numpy matrix with a row for each pre-token, padded at the right. In each round
every row merges its leftmost pair of least rank: one ``argmin`` over the matrix of ranks, one gather that closes the gaps, one lookup of the two pairs that are
new. Ranks come from a hash table of all pairs of tokens whose bytes together are a token. Rows without a pair left go out, and the matrix gets as narrow as
its longest row. Rows of more than WIDE bytes are rounds of a single row, which merges as many places of the same rank from the left as come before any lower rank.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.bpe import Memo, PairIndexBPE
from factloom.llm.common import chunks, fine_batches, texts_of, tidy

#: Cells of one matrix; bytes from which a pre-token is merged alone.
CELLS, WIDE = 1 << 18, 128
#: Bytes of text that are encoded at once, and bytes that each of the two memos of a Python worker takes.
CHUNK, MEMO_BYTES = 3 << 20, 48 << 20
NONE = np.int32(2**31 - 1)


class PairTable:
    """Rank of a pair of ids: open addressing, all pairs of a question at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(4 * len(rank)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right
        at, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[at[todo]] < 0
            self.keys[at[todo[free]]] = key[todo[free]]  # of those that want one slot, the last gets it
            won = self.keys[at[todo]] == key[todo]
            self.values[at[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where the pair never merges; ids below 0 are padding."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        at = self._slot(key)
        seen = self.keys[at]
        out = np.where((seen == key) & (left >= 0) & (right >= 0), self.values[at], NONE)
        todo = np.flatnonzero((seen != key) & (seen >= 0) & (left >= 0) & (right >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out


@cache
def gaps() -> dict[str, tuple[str, str]]:
    """For letters and digits, the characters that only the ``regex`` module counts as such and those that only ``tiktoken`` does, as insides of a class.

    Their Unicode tables are of different years. Taken once, on the driver, from both libraries as installed (some two seconds).
    """
    import regex
    import tiktoken

    def ranges(points: set[int]) -> str:
        got = np.array(sorted(points), np.int64)
        cut = np.flatnonzero(np.diff(got) > 1) + 1
        return "".join(f"\\U{p[0]:08x}-\\U{p[-1]:08x}" for p in np.split(got, cut)) if len(got) else ""

    out = {}
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for name in (r"\p{L}", r"\p{N}"):
        matches = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs = {ord(c) for a in range(0, len(text), 1 << 14) for c in bytes(matches.encode_ordinary(text[a : a + (1 << 14)])).decode()}
        own = {ord(c) for c in regex.findall(name, text)}
        out[name] = ranges(own - theirs), ranges(theirs - own)
    return out


class MatrixBPE(PairIndexBPE):
    """Encoder and decoder for a rank file (base64 bytes and rank on each line); memos, cutting and decoding are those of the other byte-level coder.

    ``differing`` is what ``gaps`` gives: runs with such a character are cut by a pattern with the classes of ``tiktoken``.
    """

    def __init__(self, path: str, pattern: str, differing: tuple[tuple[str, tuple[str, str]], ...] = ()):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks_of, self.special, self.split_special = ranks, {}, None
        table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            table[i] = token
        self.bytes_at = np.concatenate([[0], np.cumsum([len(x) for x in table])]).astype(np.int64)
        self.bytes_of = np.frombuffer(b"".join(table), np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        split = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pair = PairTable(*(np.array(c, np.int32) for c in zip(*split, strict=True)))
        self.cut, exact = regex.compile(pattern), pattern
        for name, (less, more) in differing:
            exact = exact.replace(name, "[" + (f"[{name}--[{less}]]" if less else name) + (f"||[{more}]" if more else "") + "]")
        self.exact, either = regex.compile(exact, regex.V1), "".join(less + more for _, (less, more) in differing)
        self.odd = regex.compile(f"[{either}]") if either else None
        self.known, self.word_ids = Memo(), Memo()

    def pretokens(self, piece: str) -> list[str]:
        odd = self.odd is not None and not piece.isascii() and self.odd.search(piece)
        return (self.exact if odd else self.cut).findall(piece)

    def _matrix(self, words: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """Place and ids of each row of one matrix."""
        sizes = np.array([len(w) for w in words], np.int64)
        width = int(sizes.max())
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((len(words), width), NONE, np.int32)
        if width > 1:
            rank[:, :-1] = self.pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width - 1)
        row, place = np.arange(len(words)), np.arange(len(words))
        while True:
            best = rank.argmin(1)
            least = rank[row, best]
            done = least == NONE
            if done.any():
                out, upto = ids[done], sizes[done]
                flat = out[np.arange(out.shape[1]) < upto[:, None]].astype("<u4").tobytes()
                ends = np.cumsum(upto) * 4
                yield from ((p, flat[b - 4 * n : b]) for p, b, n in zip(place[done].tolist(), ends.tolist(), upto.tolist(), strict=True))
                live = ~done
                if not live.any():
                    return
                width = int(sizes[live].max())
                ids, rank, sizes, place, best, least = ids[live, :width], rank[live, :width], sizes[live], place[live], best[live], least[live]
                row = np.arange(len(ids))
            column = np.arange(width)
            source = np.minimum(column + (column > best[:, None]), width - 1)  # what stands right of the pair moves one to the left
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            sizes -= 1
            ids[row, sizes], rank[row, sizes] = -1, NONE
            ids[row, best] = least
            after = ids[row, np.minimum(best + 1, width - 1)]
            rank[row, best] = self.pair(least, np.where(best + 1 < sizes, after, -1))
            inner = np.flatnonzero(best > 0)
            rank[inner, best[inner] - 1] = self.pair(ids[inner, best[inner] - 1], least[inner])

    def _single(self, word: bytes) -> bytes:
        """Ids of one long row. Of the places of the least rank, those are merged at once that the leftmost-first order takes before any lower rank comes up."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].astype(np.int32)
        rank = np.append(self.pair(ids[:-1], ids[1:]), NONE)
        while True:
            least = rank.min()
            if least == NONE:
                return ids.astype("<u4").tobytes()
            at = np.flatnonzero(rank == least)
            fresh = np.r_[True, np.diff(at) > 1]  # in a run of neighbours every other place, from the left
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            end = len(ids) - 1
            right = np.where(at + 2 <= end, ids[np.minimum(at + 2, end)], -1)
            left = np.where(np.r_[False, np.diff(at) == 2], least, np.where(at > 0, ids[np.maximum(at - 1, 0)], -1))
            lower = np.flatnonzero((self.pair(np.full(len(at), least, np.int32), right) < least) | (self.pair(left, np.full(len(at), least, np.int32)) < least))
            if len(lower):
                at = at[: lower[0] + 1]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep]
            at = at - np.arange(len(at))
            touched = np.concatenate([at, at[at > 0] - 1])
            after = np.where(touched + 1 < len(ids), ids[np.minimum(touched + 1, len(ids) - 1)], -1)
            rank[touched] = self.pair(ids[touched], after)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each byte string, little-endian unsigned 32-bit; a string that is a token as a whole is that token."""
        whole = self.ranks_of.get
        out = [b"" if not w else None if (i := whole(w)) is None else i.to_bytes(4, "little") for w in words]
        todo = [k for k, got in enumerate(out) if got is None]
        buckets: dict[int, list[int]] = {}
        for k in todo:
            n = len(words[k])
            if n > WIDE:
                out[k] = self._single(words[k])
            else:
                buckets.setdefault((n + 1) // 2 if n < 17 else 8 + n // 8, []).append(k)
        for places in buckets.values():
            step = max(1, CELLS // max(len(words[k]) for k in places))
            for a in range(0, len(places), step):
                own = places[a : a + step]
                for p, got in self._matrix([words[k] for k in own]):
                    out[own[p]] = got
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        return np.array([len(x) // 4 for x in self.merge(words)], np.int64)


@cache
def coder(path: str, pattern: str, differing: tuple) -> MatrixBPE:
    return MatrixBPE(path, pattern, differing)


def encode(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, chunk: int = CHUNK, memo: int = MEMO_BYTES) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if wanted, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` (bytes).

    Each match of ``pattern`` is encoded on its own by the ranks in ``path``; there are no special tokens. ``pattern`` is that of the rank files by default;
    another one must cut before every blank that a non-blank follows.

    A null or empty text has no ids. Rows that repeat give rows that repeat; ids of documents are read as longs, null ones stay null; an empty table gives an empty
    result; columns of any other name are ignored. Very long texts are encoded whole, by one task; a pre-token of any length is merged in rounds of one row.
    ``chunk`` bytes of text are encoded at once; a memo of ``memo`` bytes only saves work. ``path`` must be readable on every executor. No shuffle.
    """
    import public_tokenizers

    pattern, differing = pattern or public_tokenizers.PATTERN, tuple(gaps().items())
    fine_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern, differing)
        bpe.known, bpe.word_ids = Memo(), Memo()
        bpe.known.most = bpe.word_ids.most = memo
        for batch in chunks(batches, most=chunk):
            all_ids = bpe.encode(texts_of(batch))
            raw = [x.tobytes() for x in all_ids]
            decoded = [bpe.decode_bytes(x) for x in all_ids]
            out = [
                batch.column(0),
                pa.array([len(x) for x in all_ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
            ]
            if with_ids:
                out += [pa.array(raw, pa.binary()), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out)])
        bpe.known, bpe.word_ids = Memo(), Memo()  # the worker goes on to other stages

    given = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return given.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * with_ids)
