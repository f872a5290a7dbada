"""Hashes of byte runs (words, or runs of one character class), vectorised.

Texts are joined to one byte buffer; a run is a maximal stretch of bytes of one
class other than 0. A short run's hash is a 64-bit polynomial over its bytes; as
polynomials modulo a power of two are equal for some long runs that differ (those
of Thue and Morse), a long run's hash is a digest of its bytes. Equal runs have
equal hashes on every machine; unequal ones collide with negligible probability.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from lumenreel.llm.common import mix64

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

#: Bytes above which a run is hashed by digest.
LONG = 32

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = np.ones(256, np.uint8)
WORD[list(SPACES)] = 0
#: Letters (and all bytes over 127), digits and signs as three classes.
KIND = np.full(256, 3, np.uint8)
KIND[list(SPACES)] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[list(range(48, 58))] = 2

_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        size = max(n, 1 << 20)
        for i, p in enumerate((_P, _P_INV)):
            a = np.full(size, p, np.uint64)
            a[0] = 1
            _power[i] = np.cumprod(a, dtype=np.uint64)
    return _power[0], _power[1]


def hash_runs(data: bytes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs of a buffer, in order."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    kind = classes[b]
    edge = np.flatnonzero(np.diff(kind)) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(b)]])
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    up, down = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h = mix64(h + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return starts, ends, h


def chunks(texts: list[str], lower: bool, most: int = 1 << 21) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, last, buffer, offsets): whole texts, about ``most`` bytes at a time.

    A line feed stands between texts, so no run crosses from one to the next.
    """
    first, parts, size, ends = 0, [], 0, [0]
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        parts.append(raw.lower() if lower else raw)
        size += len(raw) + 1
        ends.append(size)
        if size >= most or i == len(texts) - 1:
            yield first, i + 1, b"\n".join(parts) + b"\n", np.array(ends)
            first, parts, size, ends = i + 1, [], 0, [0]


def word_hashes(texts: list[str], lower: bool = True, classes: np.ndarray = WORD) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, offsets): run k of the chunk belongs to text first+j
    if offsets[j] <= k < offsets[j+1]."""
    for first, last, data, ends in chunks(texts, lower):
        starts, _, h = hash_runs(data, classes)
        yield first, last, h, np.searchsorted(starts, ends)
