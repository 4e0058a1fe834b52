"""Word shingles as 64-bit hashes, vectorised over many texts.

Words are runs of bytes other than blanks (0x20, 0x09 to 0x0D), with A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_POWERS = np.ones(1 << 12, np.uint64)
_POWERS[1:] = _BASE
_POWERS = np.cumprod(_POWERS, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * _POWERS[-1] * _BASE])
    return _POWERS


def words(data: list[bytes], inside: np.ndarray, lower: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, first byte and length of each word; ``inside`` says which bytes belong to words. Places are in the texts joined by a byte between."""
    sizes = np.array([len(x) for x in data], np.int64)
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    full = inside[raw]
    step = np.diff(full.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts, starts
    length = ends - starts
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(first, length)
    p = powers(int(length.max()) + 1)
    hashes = np.add.reduceat((lower[raw[full]].astype(np.uint64) + np.uint64(1)) * p[at], first)
    owner = np.searchsorted(np.cumsum(sizes + 1), starts, side="right")
    return mix(hashes ^ (length.astype(np.uint64) << np.uint64(40))), owner, starts, length


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The set of each text, as sorted distinct hashes of five words in a row; fewer words count as one whole; no words, an empty set."""
    h, owner, _, _ = words([x.encode() for x in texts], ~_BLANK)
    n = len(texts)
    cut = np.searchsorted(owner, np.arange(n + 1))
    every = np.zeros(0, np.uint64)
    if len(h) >= WIDTH:
        m = len(h) - WIDTH + 1
        every = h[:m] * _STEP[0]
        for j in range(1, WIDTH):
            every += h[j : m + j] * _STEP[j]
        every = mix(every)
    out = []
    for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False):
        if b - a >= WIDTH:
            s = np.sort(every[a : b - WIDTH + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix((h[a:b] * _STEP[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
