"""Fill-in-the-middle rows by an overlapping-chunk decomposition.

A batch's texts are cut into chunks of bytes; each chunk also sees the one byte before it, so whether a unit begins at a byte is a test of two
neighbours that no chunk needs another for. A first pass only counts those places for each chunk. Prefix sums over the counts tell how many units a
text has and which chunk owns each of its two cuts, and only those chunks are scanned again for the exact place. Flags are never kept, so working
memory is that of a group of chunks however long a text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from factloom.llm.common import chunks, fine_batches, tidy

#: Bytes of a chunk, and chunks that are looked at in one step.
CHUNK, GROUP = 1 << 14, 64
SENTINELS = ("<P>", "<S>", "<M>")

#: Whether a unit begins between two neighbouring bytes of UTF-8.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "line": lambda left, right: left == 0x0A,
    "character": lambda left, right: (right & 0xC0) != 0x80,
    "word": lambda left, right: np.isin(left, (0x09, 0x0A, 0x0D, 0x20)) & ~np.isin(right, (0x09, 0x0A, 0x0D, 0x20)),
}


class Chunks:
    """Chunks of texts that lie end to end, with the number of units that begin inside each (a text's first byte doesn't count)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str, size: int = CHUNK):
        self.data, self.begins = data, UNITS[unit]
        sizes = np.diff(offsets)
        per_text = -(-sizes // size)
        self.first = np.concatenate([[0], np.cumsum(per_text)])
        text = np.repeat(np.arange(len(sizes)), per_text)
        nth = np.arange(len(text)) - self.first[text]
        self.start = offsets[text] + nth * size
        self.stop = np.minimum(self.start + size, offsets[text + 1])
        self.heads = np.flatnonzero(nth == 0)
        counts = np.zeros(len(text), np.int64)
        for a in range(0, len(text), GROUP):
            b = min(a + GROUP, len(text))
            flags = self._flags(int(self.start[a]), int(self.stop[b - 1]))
            heads = self.start[self.heads[np.searchsorted(self.heads, a) : np.searchsorted(self.heads, b)]]
            flags[heads - self.start[a]] = False
            counts[a:b] = np.add.reduceat(flags, self.start[a:b] - self.start[a], dtype=np.int64)
        self.upto = np.concatenate([[0], np.cumsum(counts)])
        self.units = np.where(sizes > 0, self.upto[self.first[1:]] - self.upto[self.first[:-1]] + 1, 0)

    def _flags(self, a: int, b: int) -> np.ndarray:
        """Where units begin in bytes a to b, by each byte and the one before it."""
        if a == 0:
            return np.concatenate([[True], self.begins(self.data[: b - 1], self.data[1:b])])
        return self.begins(self.data[a - 1 : b - 1], self.data[a:b])

    def place(self, text: int, rank: int) -> int:
        """The byte after ``rank`` units of a text, 0 < rank < its units: only the chunk that owns it is scanned."""
        wanted = self.upto[self.first[text]] + rank
        owner = int(np.searchsorted(self.upto, wanted)) - 1
        flags = self._flags(int(self.start[owner]), int(self.stop[owner]))
        if owner == self.first[text]:
            flags[0] = False
        return int(self.start[owner] + np.flatnonzero(flags)[wanted - self.upto[owner] - 1])


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned numbers of a document, from its id alone (none: the empty string)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def join(prefix: bytes, middle: bytes, suffix: bytes, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> bytes:
    p, s, m = (x.encode() for x in sentinels)
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def restore(output: bytes, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> bytes:
    """The text that an output of that form was made of: no part holds a sentinel, so the first of each is the one that was put in."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in sentinels)
    a, b = (p, s) if form == "psm" else (s, p)
    one, rest = output[len(a) :].split(b, 1)
    two, middle = rest.split(m, 1)
    return one + middle + two if form == "psm" else two + middle + one


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end and where each begins; null counts as empty."""
    flat = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_binary())])
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2], np.uint8) if flat.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]


def transform(
    docs: DataFrame, unit: str = "line", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, with_output: bool = True
) -> DataFrame:
    """Per row: ``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` and, if wanted, ``output``.

    A text of ``n`` units (lines, characters or words) is cut after two numbers of units that its id decides, and becomes
    prefix, suffix, middle (psm) or suffix, prefix, middle (spm). It stays plain if it is empty, holds a sentinel, or its draw isn't below ``fim_percent``.

    Null texts count as empty; rows that repeat give rows that repeat, and rows of one id draw alike; ids are read as longs, null ids draw as the empty
    string; an empty table gives an empty result; columns of any other name are ignored. Very long texts are held whole by one task, once as they are
    and once as they come out; what the method adds is some bytes for each chunk.
    No shuffle: a row depends on nothing but its id and text.
    """
    fine_batches(docs.sparkSession)
    if len(set(sentinels)) < 3 or any(not x.startswith("<") or "<" in x[1:] for x in sentinels):
        raise ValueError("sentinels have to differ, begin with < and hold no other, so that none can begin inside another")
    marks = [x.encode() for x in sentinels]

    def one(ids: list, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        table = Chunks(data, offsets, unit, chunk)
        for k, doc_id in enumerate(ids):
            a, b, n = int(offsets[k]), int(offsets[k + 1]), int(table.units[k])
            text = data[a:b].tobytes()
            h1, h2, h3, h4 = draws(seed, doc_id)
            if not text or h3 % 100 >= fim_percent or any(x in text for x in marks):
                yield n, "plain", None, None, text, text
                continue
            cut = [a if r == 0 else b if r == n else table.place(k, r) for r in sorted((h1 % (n + 1), h2 % (n + 1)))]
            form = "spm" if h4 % 100 < spm_percent else "psm"
            chars = [int(np.count_nonzero((data[x:y] & 0xC0) != 0x80)) for x, y in ((a, cut[0]), (cut[0], cut[1]))]
            out = join(text[: cut[0] - a], text[cut[0] - a : cut[1] - a], text[cut[1] - a :], form, sentinels)
            yield n, form, *chars, out, restore(out, form, sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            got = [(n, form, p, m, hashlib.sha256(out).hexdigest(), hashlib.sha256(back).hexdigest(), *([out.decode()] if with_output else [])) for n, form, p, m, out, back in one(batch.column(0).to_pylist(), *_flat(batch.column(1)))]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"][: 6 + with_output]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=False)]], names=["doc_id", *names])

    given = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return given.mapInArrow(tidy(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * with_output)
