"""Token files: ids packed to a fixed width, in blocks.

A file holds consecutive documents. Its body is the ids, each in the fewest
bits that hold every id of the vocabulary, cut into blocks of ``BLOCK`` ids; a
block starts on a byte, and since ``BLOCK`` is a multiple of 8 every block but
the last has the same number of bytes. ``offsets`` has each block's first byte,
so any id is found without reading what lies before it, and a block unpacks
with a few vectorised numpy steps. The container is a Parquet table with a row
for each file, in the shared folder. Files are cut within a part, a range of ids: a task
streams its part in order and holds one file at a time.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import chunks, fine_batches, materialize, tidy

#: Ids in a block.
BLOCK = 1 << 14
#: Bytes of text for each part, about; most parts, which also bounds what the driver holds of them.
PART_BYTES, PARTS = 8 << 20, 1 << 14
#: Ids from which a file is closed.
FILE_IDS = 4 << 20
#: Bytes of units whose ids a Python worker keeps (each unit counts UNIT_COST more); beyond, units are encoded anew in each batch.
MEMO_BYTES, UNIT_COST = 144 << 20, 200


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as consecutive ``width``-bit little-endian fields."""
    bits = ((ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8) if width % 8 else None
    if bits is not None:
        return np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : width // 8]).tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    """The first ``n`` fields of ``width`` bits."""
    raw = np.frombuffer(data, np.uint8)
    if width % 8 == 0:
        out = np.zeros((n, 4), np.uint8)
        out[:, : width // 8] = raw[: n * width // 8].reshape(n, width // 8)
        return out.view("<u4").reshape(-1)
    bits = np.unpackbits(raw, bitorder="little")[: n * width].reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def block_bytes(width: int) -> int:
    return BLOCK * width // 8


def pack_blocks(ids: np.ndarray, width: int) -> tuple[np.ndarray, bytes]:
    """First byte of each block, with the end, and the body; one block is packed at a time."""
    body = b"".join(pack(ids[a : a + BLOCK], width) for a in range(0, len(ids), BLOCK))
    return np.append(np.arange(0, -(-len(ids) // BLOCK)) * block_bytes(width), len(body)).astype("<i8"), body


def read_ids(body: bytes, offsets: np.ndarray, start: int, n: int, width: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of a file: only the blocks that hold them are unpacked."""
    if not n:
        return np.zeros(0, np.uint32)
    first, last = start // BLOCK, (start + n - 1) // BLOCK
    stop = int(offsets[last + 1])
    got = unpack(body[int(offsets[first]) : stop], min((last - first + 1) * BLOCK, (stop - int(offsets[first])) * 8 // width), width)
    return got[start - first * BLOCK : start - first * BLOCK + n]


_KIND = np.full(256, 4, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 other mark, 4 what only the library can cut
_KIND[33:127] = 3
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[[32, 10]] = 0
_KIND[[ord("'"), ord("<")]] = 4  # contractions, special tokens
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class WordEncoder:
    """Ids of whole texts with the tokenizers library, each distinct unit once.

    For a tokenizer that drops white space, never joins across it, lower-cases and ends each word with an
    end-of-word piece: a blank-separated part of plain ASCII is cut into words, single digits and marks, as the tokenizer does; any other
    part (beyond ASCII, with an apostrophe or with what may begin a special token) is a unit as a whole. The ids of a text are those of its units. New words of
    letters go to the library many at a time, as one text; the end-of-word pieces tell them apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.width = max(1, (size - 1).bit_length())
        self.ends = np.zeros(size, bool)
        for piece, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.ends[i] = piece.endswith("</w>")
        self.known: dict[bytes, int] = {}
        self.weight, self.offsets, self.ids = 0, np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _each(self, units: list[bytes]) -> list[np.ndarray]:
        out = []
        for a in range(0, len(units), 5000):
            out += [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([u.decode() for u in units[a : a + 5000]], add_special_tokens=False)]
        return out

    def _words(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after the other, and how many each has."""
        flat, sizes = [], []
        for a in range(0, len(units), 5000):
            few = units[a : a + 5000]
            ids = np.array(self.tok.encode_batch_fast([b" ".join(few).decode()], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(few):  # a word that the library takes apart
                each = self._each(few)
                ids, cut = np.concatenate(each), np.cumsum([len(x) for x in each])
            flat.append(ids)
            sizes.append(np.diff(cut, prepend=0))
        return (np.concatenate(flat), np.concatenate(sizes)) if flat else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def learn(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new units one after the other, and how many each has."""
        plain = np.array([u.isalpha() or (not u.isascii() and u.decode().isalpha()) for u in units], bool)
        at = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        ids, sizes = self._words([units[i] for i in np.flatnonzero(plain).tolist()])
        each = self._each([units[i] for i in np.flatnonzero(~plain).tolist()])
        ids, sizes = np.concatenate([ids, *each]), np.concatenate([sizes, np.array([len(x) for x in each], np.int64)])
        first, back = np.cumsum(sizes) - sizes, np.empty(len(units), np.int64)
        back[at] = np.arange(len(units))
        sizes = sizes[back]
        return ids[_ranges(first[back], sizes)], sizes

    def encode(self, data: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 texts one after the other, each with ``end_id`` behind, and how many each has."""
        raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
        texts = np.cumsum([len(x) + 1 for x in data])
        kind = _KIND[raw]
        full = kind > 0
        step = np.diff(full.view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(starts):
            odd = np.concatenate([[0], np.cumsum(kind == 4, dtype=np.int32)])
            strange = odd[ends] > odd[starts]
            kind[full] = np.where(np.repeat(strange, ends - starts), 4, kind[full])
        edge = full.copy()
        edge[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        starts = np.flatnonzero(edge)
        low = np.where(kind < 4, _LOWER[raw], raw)[full]
        place = np.cumsum(full, dtype=np.int64)[starts] - 1  # where each unit starts, without the blanks
        offsets = np.append(place, len(low)).astype(np.int64)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(low))]).dictionary_encode()
        names = units.dictionary.to_pylist()
        known, new, kept = self.known, [], len(self.offsets)
        code = np.array([known.get(u, -1) for u in names], np.int64)
        missing = np.flatnonzero(code < 0)
        if len(missing):
            new = [names[i] for i in missing.tolist()]
            ids, sizes = self.learn(new)
            code[missing] = np.arange(len(known), len(known) + len(new))
            known.update(zip(new, code[missing].tolist(), strict=True))
            self.weight = self.weight + sum(map(len, new)) + UNIT_COST * len(new) + 4 * len(ids) if self.weight <= MEMO_BYTES else self.weight
            self.ids = np.concatenate([self.ids, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        first, size = self.offsets[code], np.diff(self.offsets)[code] if len(code) else code
        which = np.asarray(units.indices)
        first, size = first[which], size[which]
        flat = self.ids[_ranges(first, size)]
        if new and self.weight > MEMO_BYTES:  # full: this batch's units aren't kept
            for u in new:
                del known[u]
            self.offsets = self.offsets[:kept].copy()
            self.ids = self.ids[: self.offsets[-1]].copy()
        before = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.searchsorted(starts, texts)])]
        counts = np.diff(before)
        if end_id is None:
            return flat, counts
        out = np.full(len(flat) + len(data), end_id, np.uint32)
        own = np.ones(len(out), bool)
        own[np.cumsum(counts + 1) - 1] = False
        out[own] = flat
        return out, counts + 1


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each, ``size`` of them, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@cache
def coder(path: str) -> WordEncoder:
    """One for each Python worker, with its memo."""
    return WordEncoder(path)


def write_token_files(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Encode, append ``end_id`` to each document, and write files in ascending id order.

    Returns the written table, a row for each file (``part, file, before, n_ids, doc_ids, n_tokens, offsets, body``:
    files in the order of part and number; ``before`` counts the ids of the part's earlier files; the last three are binary), and the width in bits. A null or empty text has only the end id; a null doc_id comes first;
    repeated ids stay, in the order of their ids; very long texts are encoded whole, by one task; an empty table writes no file.
    """
    width = coder(path).width
    kind = "<u2" if width <= 16 else "<u4"  # in which ids travel to their file
    size = F.coalesce(F.octet_length(docs[text_col]), F.lit(0))
    parts = min(PARTS, max(1, -(-(docs.agg(F.sum(size.cast("long"))).first()[0] or 0) // PART_BYTES)))
    steps = [k / parts for k in range(1, parts)]
    bounds = sorted(set(docs.select(docs[id_col].cast("double").alias("i")).stat.approxQuantile("i", steps, 0.1 / parts))) if steps else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cut = coder(path), np.array(bounds)
        for batch in chunks(batches, most=3 << 20):
            ids, counts = words.encode([x.encode() if x else b"" for x in batch.column(1).to_pylist()], end_id)
            doc_id = batch.column(0)
            part = np.where(np.asarray(doc_id.is_null()), 0, np.searchsorted(cut, np.asarray(doc_id.fill_null(0)).astype(np.float64), side="right"))
            ends = np.concatenate([[0], np.cumsum(counts)]) * np.dtype(kind).itemsize
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), doc_id, body], names=["part", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file, before, held, weight = None, 0, 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal before
            ids = np.frombuffer(b"".join(x for _, x in held), kind)
            offsets, body = pack_blocks(ids, width)
            counts = np.array([len(x) for _, x in held], "<i8") // np.dtype(kind).itemsize
            columns = [([now], pa.int32()), ([file], pa.int32()), ([before], pa.int64()), ([len(ids)], pa.int64()), ([[d for d, _ in held]], pa.list_(pa.int64())), ([counts.tobytes()], pa.binary()), ([offsets.tobytes()], pa.binary()), ([body], pa.binary())]
            before += len(ids)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=["part", "file", "before", "n_ids", "doc_ids", "n_tokens", "offsets", "body"])

        for batch in batches:
            for part, doc_id, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and (part != now or weight >= FILE_IDS * np.dtype(kind).itemsize):
                    yield out()
                    file, held, weight = file + 1, [], 0
                if part != now:
                    now, file, before = part, 0, 0
                held.append((doc_id, ids))
                weight += len(ids)
        if held:
            yield out()

    schema = "part int, file int, before long, n_ids long, doc_ids array<long>, n_tokens binary, offsets binary, body binary"
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    packed = given.mapInArrow(tidy(run), "part int, doc_id long, ids binary").repartition(parts, "part").sortWithinPartitions("part", "doc_id", "ids")
    return materialize(packed.mapInArrow(tidy(write), schema), "tokens"), width


def read_token_files(files: DataFrame, width: int, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32`` and, if wanted, the ids (little-endian unsigned 32-bit)."""
    fine_batches(files.sparkSession)
    totals = dict(files.groupBy("part").agg(F.sum("n_ids")).collect())  # at most PARTS rows
    order = sorted(totals)
    bases = dict(zip(order, np.cumsum([0, *(totals[p] for p in order)])[:-1].tolist(), strict=True))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, doc_ids, counts, offsets, body in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                base = bases[part] + before
                n, off = np.frombuffer(counts, "<i8"), np.frombuffer(offsets, "<i8")
                at = np.cumsum(n) - n
                for a in range(0, len(n), 1000):
                    b = min(a + 1000, len(n))
                    ids = read_ids(body, off, int(at[a]), int(n[a:b].sum()), width).astype("<u4")
                    raw, cut = memoryview(ids.tobytes()), ((np.append(at[a:b], at[b - 1] + n[b - 1]) - at[a]) * 4).tolist()
                    own = [raw[x:y] for x, y in zip(cut, cut[1:], strict=False)]
                    out = [pa.array(doc_ids[a:b], pa.int64()), pa.array(base + at[a:b], pa.int64()), pa.array(n[a:b], pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    if with_ids:
                        out.append(pa.array([bytes(x) for x in own], pa.binary()))
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    given = files.select("part", "before", "doc_ids", "n_tokens", "offsets", "body")
    return given.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
