"""Byte-level BPE by a pair occurrence index.

A partition's distinct pre-tokens are laid end to end in one symbol array. An
index maps every mergeable pair to all its positions. The active ranks are
applied in ascending order, each to all its positions at once, and the pairs
next to a merged place are added to the lists of their own ranks. A merge
only makes pairs of higher rank than its own, so each rank is visited once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import chunks, fine_batches, texts_of, tidy

#: Bytes of pre-tokens and of runs of them, each with its ids and COST more, that a Python worker keeps; later ones are encoded anew in each batch.
MEMO_BYTES, COST = 48 << 20, 150
#: Bytes of text that are encoded at once; each takes some forty bytes meanwhile.
CHUNK = 3 << 20

_SAFE_CUT = re.compile(r"(?= \S)")
_DOUBLE = re.compile(r" \s")


def runs(text: str) -> list[str]:
    """Cut a text before every blank that a non-blank follows: a byte-level pre-tokenizer always cuts there, so what holds for the runs adds up to the text."""
    if _DOUBLE.search(text):
        return [x for x in _SAFE_CUT.split(text) if x]
    first, *rest = text.split(" ")
    out = [" " + x for x in rest]
    return [first, *out] if first else out


class Memo(dict):
    """A mapping that stops taking entries once they weigh ``most`` bytes; a long text without blanks is never kept."""

    weight, most = 0, MEMO_BYTES

    def keep_one(self, k: str, v) -> None:
        own = 2 * len(k) + 2 * COST
        if self.weight <= self.most and own < self.most // 1000:
            self[k] = v
            self.weight += own

    def keep(self, new: dict[str, bytes]) -> None:
        for k, v in new.items():
            if self.weight > self.most:
                return
            own = len(k) + len(v) + COST
            if own < self.most // 1000:
                self[k] = v
                self.weight += own


class Both:
    """Two mappings read as one."""

    def __init__(self, first: dict, second: dict):
        self.first, self.second = first, second

    def __getitem__(self, key):
        got = self.first.get(key)
        return self.second[key] if got is None else got



def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, as a rule: bytes that print stand for themselves, the others follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndexBPE:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, of_byte = spec["model"]["vocab"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: bytes(of_byte[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        size = max(names) + 1
        table = [names.get(i, b"") for i in range(size)]
        self.bytes_at = np.concatenate([[0], np.cumsum([len(x) for x in table])]).astype(np.int64)
        self.bytes_of = np.frombuffer(b"".join(table), np.uint8)
        self.of_byte = np.zeros(256, np.int64)
        for c, b in of_byte.items():
            self.of_byte[b] = vocab[c]
        self.shift = max(1, size.bit_length())
        keys, made = [], []
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            keys.append((vocab[a] << self.shift) | vocab[b])
            made.append(vocab[a + b])
        self.made, order = np.array(made, np.int64), np.argsort(np.array(keys, np.int64), kind="stable")
        self.pairs, self.keys, self.ranks = np.array(keys, np.int64), np.array(keys, np.int64)[order], order
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known, self.word_ids = Memo(), Memo()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges."""
        key = (left << self.shift) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all byte strings laid end to end once nothing merges any more, where those stand that are left, and the ends of the strings."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), ends
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        alive = np.ones(total, bool)
        after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(left: np.ndarray) -> None:
            found = self.rank(ids[left], ids[after[left]])
            hit = found >= 0
            if not hit.any():
                return
            found, left = found[hit], left[hit]
            order = np.argsort(found, kind="stable")
            found, left = found[order], left[order]
            starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
            for r, places in zip(found[starts].tolist(), np.split(left, starts[1:]), strict=True):
                if r in index:
                    index[r].append(places)
                else:
                    index[r] = [places]
                    heapq.heappush(heap, r)

        add(np.flatnonzero(after >= 0))
        mask = (1 << self.shift) - 1
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b = int(self.pairs[r]) >> self.shift, int(self.pairs[r]) & mask
            at = at[alive[at]]
            nxt = after[at]
            good = (ids[at] == a) & (nxt >= 0)
            good &= ids[nxt] == b
            at, nxt = at[good], nxt[good]
            if a == b and len(at) > 1:  # in a run of equal symbols, every other place, from the left
                keep, last = [], -1
                for p, q in zip(at.tolist(), nxt.tolist(), strict=True):
                    if p != last:
                        keep.append(p)
                        last = q
                at = np.array(keep, np.int64)
                nxt = after[at]
            if not len(at):
                continue
            ids[at] = self.made[r]
            alive[nxt] = False
            far = after[nxt]
            after[at] = far
            inner = far >= 0
            before[far[inner]] = at[inner]
            prev = before[at]
            touched = np.concatenate([at[inner], prev[prev >= 0]])
            if len(touched):
                add(np.unique(touched))
        return ids, np.flatnonzero(alive), ends

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many ids each byte string has."""
        _, kept, ends = self._merged(words)
        return np.diff(np.searchsorted(kept, ends), prepend=0)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each byte string, little-endian unsigned 32-bit."""
        ids, kept, ends = self._merged(words)
        out = ids[kept].astype("<u4").tobytes()
        cut = (np.searchsorted(kept, ends) * 4).tolist()
        return [out[a:b] for a, b in zip([0, *cut], cut, strict=False)]

    def pretokens(self, piece: str) -> list[str]:
        """The pre-tokens of a run; a special token's string is one."""
        return [piece] if piece in self.special else self.cut.findall(piece)

    def sizes(self, words: list[str]) -> list[int]:
        """How many ids each pre-token has."""
        out = self.counts([w.encode() for w in words]).tolist()
        return [1 if w in self.special else n for w, n in zip(words, out, strict=True)] if self.special else out

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32-bit) of runs of pre-tokens that the memo doesn't have."""
        plan = [(p, self.pretokens(p)) for p in pieces]
        new = list({w for _, parts in plan for w in parts} - self.word_ids.keys() - self.special.keys())
        ids = dict(zip(new, self.merge([w.encode() for w in new]), strict=True))
        ids |= {t: self.special[t].to_bytes(4, "little") for t in self.special}
        out, kept = {}, self.word_ids
        for piece, parts in plan:
            out[piece] = b"".join([ids[w] if w in ids else kept[w] for w in parts])
        kept.keep(ids)
        return out

    def cut_runs(self, text: str) -> list[str]:
        """Runs of pre-tokens; a special token's string stands alone, as the library takes it out first."""
        if self.split_special and "<|" in text:
            return [y for x in self.split_special.split(text) if x for y in ([x] if x in self.special else runs(x))]
        return runs(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text, unsigned 32-bit."""
        cut = [self.cut_runs(x) for x in texts]
        known, new = self.known, set().union(*cut).difference(self.known)
        if new:
            got = self.learn(new)
            known = Both(known, got)
        of = known.__getitem__
        out = [np.frombuffer(b"".join(map(of, c)), "<u4") for c in cut]
        if new:
            self.known.keep(got)
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        ids = ids.astype(np.int64)
        sizes = self.bytes_at[ids + 1] - self.bytes_at[ids]
        total = int(sizes.sum())
        at = np.repeat(self.bytes_at[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        return self.bytes_of[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@cache
def coder(path: str) -> PairIndexBPE:
    """One for each Python worker; its memo lasts a task."""
    return PairIndexBPE(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, chunk: int = CHUNK, memo: int = MEMO_BYTES) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if wanted, ``ids`` (little-endian unsigned 32-bit) and ``decoded``.

    A null or empty text has no ids and decodes to the empty string. Repeated
    rows repeat; an empty table gives an empty result. Special strings inside
    texts become their special id. ``chunk`` bytes of text are encoded at once, and ``memo`` bytes are kept, twice: less memory for more time, the same result. Very long texts are encoded whole, by one task. ``path`` must be readable on every executor.
    """
    fine_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        bpe.known.most = bpe.word_ids.most = memo
        for batch in chunks(batches, most=chunk):
            all_ids = bpe.encode(texts_of(batch))
            raw = [x.astype("<u4").tobytes() for x in all_ids]
            decoded = [bpe.decode(x) for x in all_ids]
            out = [
                batch.column(0),
                pa.array([len(x) for x in all_ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
            ]
            if with_ids:
                out += [pa.array(raw, pa.binary()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out)])
        bpe.known, bpe.word_ids = Memo(), Memo()  # the worker goes on to other stages

    given = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return given.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids)
