"""Vectorised window hashing for the corpus scan (runs inside Arrow-batched tasks).

``window_hashes(text, w)`` returns the 64-bit polynomial hash of every ``w``-code-point
window in O(1) numpy work per position, via prefix sums of ``c[j] * B^-j`` (B odd, so
it is invertible mod 2^64; uint64 arithmetic wraps):

    H[i] = (Q[i+w] - Q[i]) * B^(i+w-1) = sum_{j=i..i+w-1} c[j] * B^(i+w-1-j)

Hashes only find candidates: those are compared as strings afterwards, so collisions can
never change a result.

``pack_run`` / ``unpack_run`` hold a sorted run of hashes in a few bytes an entry, for runs that
travel by hash range instead of as rows; ``pack_set`` / ``unpack_set`` in fewer, for distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Fixed values of the hash: an odd 64-bit multiplier and its inverse mod 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
_U64 = np.uint64


class Powers:
    """Growing tables of B^k and B^-k (mod 2^64)."""

    def __init__(self):
        self.fwd = np.ones(1, dtype=_U64)
        self.inv = np.ones(1, dtype=_U64)

    def ensure(self, n: int) -> None:
        if len(self.fwd) >= n:
            return
        size = max(n, 2 * len(self.fwd))
        with np.errstate(over="ignore"):
            f = np.full(size, _U64(BASE), dtype=_U64)
            f[0] = 1
            self.fwd = np.cumprod(f, dtype=_U64)
            i = np.full(size, _U64(BASE_INV), dtype=_U64)
            i[0] = 1
            self.inv = np.cumprod(i, dtype=_U64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(_U64)


def window_hashes(text: str, width: int, powers: Powers) -> np.ndarray:
    cp = code_points(text)
    n = len(cp) - width + 1
    if n <= 0:
        return np.empty(0, dtype=_U64)
    powers.ensure(len(cp) + 1)
    with np.errstate(over="ignore"):
        q = np.zeros(len(cp) + 1, dtype=_U64)
        np.cumsum(cp * powers.inv[: len(cp)], dtype=_U64, out=q[1:])
        return (q[width:] - q[:n]) * powers.fwd[width - 1 : width - 1 + n]


PIECE_CHARS = 1 << 20


def pieces(texts) -> Iterator[tuple[list[int], list[str]]]:
    """Texts (None: empty) in groups of about ``PIECE_CHARS`` characters, with their places."""
    at, held, size = [], [], 0
    for i, t in enumerate(texts):
        if t:
            at.append(i)
            held.append(t)
            size += len(t)
        if size >= PIECE_CHARS:
            yield at, held
            at, held, size = [], [], 0
    if held:
        yield at, held


def many_window_hashes(texts: list[str], width: int, powers: Powers, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``window_hashes`` of all texts in one go, at every ``step``-th position: the hashes, the
    number of the text each belongs to, and the position in it."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    cp = code_points("".join(texts))
    powers.ensure(len(cp) + 1)
    counts = np.maximum((lengths - width) // step + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    pos = (np.arange(owner.size) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    at = pos + np.repeat(np.cumsum(lengths) - lengths, counts)
    with np.errstate(over="ignore"):
        q = np.zeros(len(cp) + 1, dtype=_U64)
        np.cumsum(cp * powers.inv[: len(cp)], dtype=_U64, out=q[1:])
        return (q[at + width] - q[at]) * powers.fwd[at + (width - 1)], owner, pos


def spread(h: np.ndarray) -> np.ndarray:
    """Hashes with their bits mixed, so that any leading bits are evenly used."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U64(32))) * _U64(BASE)
        return h ^ (h >> _U64(29))


def pack_run(sorted_hashes: np.ndarray) -> bytes:
    """A sorted run of unsigned 64-bit numbers: the first, then differences in as many bytes as needed."""
    gaps = np.diff(sorted_hashes).astype("<u8")
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if gaps.size else 1
    return bytes([width]) + sorted_hashes[:1].astype("<u8").tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_run(data: bytes | memoryview) -> np.ndarray:
    if len(data) == 1:
        return np.empty(0, dtype=_U64)
    width = data[0]
    gaps = np.zeros(((len(data) - 9) // width, 8), dtype=np.uint8)
    gaps[:, :width] = np.frombuffer(data, dtype=np.uint8, offset=9).reshape(-1, width)
    out = np.empty(len(gaps) + 1, dtype=_U64)
    out[0] = np.frombuffer(data, dtype="<u8", count=1, offset=1)[0]
    with np.errstate(over="ignore"):
        out[1:] = out[0] + np.cumsum(gaps.view("<u8").ravel(), dtype=_U64)
    return out


def pack_set(sorted_hashes: np.ndarray) -> bytes:
    """A sorted run of distinct unsigned 64-bit numbers in some two bits more an entry than its mean
    difference has: whole low bytes as they are, the rest as marks, a 1 an entry and a 0 a step."""
    n = sorted_hashes.size
    if not n:
        return b""
    above = sorted_hashes - sorted_hashes[0]
    top = int(above[-1])
    low = min(range(8), key=lambda b: 8 * b * n + (top >> (8 * b)) + n)
    marks = np.zeros((top >> (8 * low)) + n, dtype=np.uint8)
    marks[(above >> _U64(8 * low)).astype(np.int64) + np.arange(n)] = 1
    head = bytes([low]) + np.array([n, sorted_hashes[0]], dtype="<u8").tobytes()
    return head + above.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].tobytes() + np.packbits(marks).tobytes()


def unpack_set(data: bytes | memoryview) -> np.ndarray:
    if not len(data):
        return np.empty(0, dtype=_U64)
    low, (n, first) = data[0], np.frombuffer(data, dtype="<u8", count=2, offset=1)
    n = int(n)
    above = np.zeros((n, 8), dtype=np.uint8)
    above[:, :low] = np.frombuffer(data, dtype=np.uint8, count=n * low, offset=17).reshape(n, low)
    steps = np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=17 + n * low))) - np.arange(n)
    with np.errstate(over="ignore"):
        return above.view("<u8").ravel() + (steps.astype(_U64) << _U64(8 * low)) + first
