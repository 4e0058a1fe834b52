"""Audio features of 8-bit samples.

A payload is stored losslessly as an 8-bit mono WAV. The samples read back are
resampled by 3/4 with a polyphase filter, cut into overlapping frames, turned
into log-mel energies, and segmented by a threshold with hysteresis. Log-mel
frames go into tensors of one fixed shape (``TENSOR`` frames by ``MELS`` bands, the last one
padded), each with its time span, in an Arrow fixed-shape tensor column.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import chunks, fine_batches, texts_of, tidy

RATE, UP, DOWN, TAPS = 16_000, 3, 4, 16
FRAME, HOP, FFT, MELS, TENSOR = 300, 120, 512, 40, 64
#: Payload unit in bytes, and the byte that fills it up.
UNIT, FILL = 576, b"\xff"
#: Frames transformed at once.
BLOCK = 2048
#: An active stretch starts above the clip's median plus ON dB and ends below the median plus OFF dB.
ON, OFF = 3.0, 0.5


def payload_of(data: bytes) -> bytes:
    """Data filled up to a positive multiple of UNIT bytes."""
    return data + FILL * (-len(data) % UNIT if data else UNIT)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


@cache
def _filters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cutoff = 1 / max(UP, DOWN)
    low = (np.sinc(n * cutoff) * cutoff * UP * np.hamming(UP * TAPS)).astype(np.float32)
    phases = np.stack([low[p::UP][::-1] for p in range(UP)])
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    rate = RATE * UP / DOWN
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), MELS + 2) / 2595) - 1)
    freq = np.arange(FFT // 2 + 1) * rate / FFT
    up = (freq[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - freq[:, None]) / (edges[2:] - edges[1:-1])
    return phases, np.maximum(0, np.minimum(up, down)).astype(np.float32), np.hanning(FRAME).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling by UP / DOWN."""
    phases, _, _ = _filters()
    n = len(x) * UP // DOWN
    padded = np.concatenate([np.zeros(TAPS // 2, np.float32), x, np.zeros(TAPS, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.zeros(n, np.float32)
    for first in range(min(UP, n)):  # outputs first, first + UP, ... share a phase and step by DOWN inputs
        m = len(range(first, n, UP))
        at = first * DOWN // UP
        out[first::UP] = windows[at : at + (m - 1) * DOWN + 1 : DOWN] @ phases[first * DOWN % UP]
    return out


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and the energy of each frame in dB."""
    _, bank, window = _filters()
    if len(y) < FRAME:
        y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    mels, energy = [], []
    for a in range(0, len(frames), BLOCK):
        part = frames[a : a + BLOCK]
        spectrum = np.fft.rfft(part * window, FFT)
        mels.append(np.log(np.maximum((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank, 1e-6)))
        energy.append(10 * np.log10(np.maximum(np.einsum("ij,ij->i", part, part) / FRAME, 1e-9)))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Active stretches of frames: on above the high threshold, off below the low one."""
    middle = float(np.median(energy))
    mark = np.where(energy > middle + ON, 1, np.where(energy < middle + OFF, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last] == 1, False).astype(np.int8)
    edges = np.diff(np.concatenate([[0], on, [0]]))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def tensors(mels: np.ndarray) -> np.ndarray:
    """Frames as tensors of shape (TENSOR, MELS), the last one padded with zeros."""
    n = -(-len(mels) // TENSOR)
    out = np.zeros((n * TENSOR, MELS), np.float32)
    out[: len(mels)] = mels
    return out.reshape(n, TENSOR, MELS)


def arrow_tensors(x: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """An Arrow stream with a fixed-shape tensor column and the time span of each tensor."""
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(x))
    table = pa.table({"tensor": column, "start_s": [a for a, _ in spans], "end_s": [b for _, b in spans]})
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue()


def from_arrow_tensors(stored: bytes) -> np.ndarray:
    column = pa.ipc.open_stream(stored).read_all().column("tensor").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.to_numpy_ndarray()


def features(samples: bytes) -> tuple[bytes, list[tuple[float, float]], list[tuple[float, float]], str]:
    """Tensors as they are stored, their time spans, the active time spans, and a summary of the tensors read back."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mel(resample(x))
    second = HOP * DOWN / (UP * RATE)
    cubes = tensors(mels)
    spans = [(i * TENSOR * second, min((i + 1) * TENSOR, len(mels)) * second) for i in range(len(cubes))]
    stored = arrow_tensors(cubes, spans)
    cubes = from_arrow_tensors(stored)
    active = [(a * second, b * second) for a, b in segments(energy)]
    summary = f"frames={len(mels)};tensors={len(cubes)};mel={mels.mean():.3f};db={np.median(energy):.2f};segments={len(active)};active_s={sum(b - a for a, b in active):.2f};sha1={hashlib.sha1(cubes.astype('<f2').tobytes()).hexdigest()[:16]}"
    return stored, spans, active, summary


_SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Per row: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, tensors, spans, active``.

    ``tensors`` is an Arrow stream with a fixed-shape tensor column, ``spans`` has each tensor's time, ``active`` the segments; with ``with_media`` also the
    stored form (``media``). A null text counts as empty, and an empty one has a payload of one unit of fill bytes. Equal texts
    give equal values; very long texts are one clip; repeated rows repeat; an empty table gives an empty result. Everything is computed from the stored bytes, read back.
    """
    fine_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=1 << 20):
            rows = []
            for text in texts_of(batch):
                data = text.encode()
                stored = to_wav(payload_of(data))
                back = from_wav(stored)
                tensor, spans, active, summary = features(back)
                row = [len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), summary, tensor]
                rows.append([*row, *([{"start_s": a, "end_s": b} for a, b in x] for x in (spans, active)), stored])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), _SPANS, _SPANS, pa.binary()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensors", "spans", "active", "media"]
            n = len(names) - (not with_media)
            columns = list(zip(*rows, strict=True))[:n]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[:n], strict=True))], names=["doc_id", *names[:n]])

    spans = "array<struct<start_s: double, end_s: double>>"
    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensors binary, spans {spans}, active {spans}"
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return given.mapInArrow(tidy(run), schema + ", media binary" * with_media)
