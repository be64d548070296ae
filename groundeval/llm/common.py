"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundeval.session import checkpoint_dir, cut_lineage  # noqa: F401  (re-exported)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: str) -> Column:
    """crc32 of the identifier written as decimal text; the train / held-out folds use it."""
    return F.crc32(F.col(col).cast("string"))


def in_fold(col: str, modulus: int, remainder: int) -> Column:
    """True for rows of the fold ``crc32(id) mod modulus = remainder``; a null id is in no fold."""
    return F.coalesce(id_crc(col) % modulus == remainder, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty and lone surrogates are replaced."""
    return b"" if text is None else text.encode("utf-8", "replace")


class WordTable(dict):
    """``word bytes -> value`` filled on first use; emptied at ``limit`` entries so that a
    task's memory does not grow with the vocabulary (values are recomputed, never lost)."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


_BASE = 0x9E3779B97F4A7C15  # an odd multiplier, so that it has an inverse modulo 2^64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHasher:
    """64-bit hashes of a text's words (runs of bytes other than ASCII white space), worked
    out for whole texts at a time: prefix sums of ``byte * base^-i`` give every word's
    polynomial, whatever its place.  Texts go through in pieces of about a megabyte."""

    def __init__(self):
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def __call__(self, data: bytes) -> np.ndarray:
        return self.spans(data)[0]

    def spans(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the words, and where each begins and ends."""
        parts, at = [], 0
        while at < len(data) or not parts:
            end = min(at + _PIECE, len(data))
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
            h, start, stop = self._piece(data[at:end])
            parts.append((h, start + at, stop + at))
            at = end
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts' words in a row, and how many each text has."""
        data = b"\n".join(texts)
        h, start, _ = self.spans(data)
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        return h, np.diff(np.searchsorted(start, first))

    def _piece(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(data, dtype=np.uint8)
        n = len(raw)
        if n >= len(self.up):
            self._grow(2 * n)
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.down[:n], dtype=np.uint64, out=sums[1:])
        return mix((sums[end] - sums[start]) * self.up[end]), start, end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = x * np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))
