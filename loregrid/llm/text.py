"""Vectorised words and word shingles over the byte buffers of Arrow string columns.

Words are runs of bytes other than space and \\t..\\r; every byte of a multi-byte UTF-8
character is a word byte, so working on bytes gives the same words as on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; only a single longer document takes more memory.
PIECE_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NO_TERM = np.zeros(256, bool)
_NO_TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C55  # odd, so that it has an inverse
_P_INV = pow(_P, -1, 1 << 64)
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_SLOT = _RNG.integers(1, 1 << 63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["p"]) < n:
        size = max(n, PIECE_BYTES + 1024)
        out = []
        for base in (_P, _P_INV):
            x = np.full(size, U64(base))
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        if size > 4 * PIECE_BYTES:
            return out[0], out[1]
        _POWERS["p"], _POWERS["q"] = out
    return _POWERS["p"], _POWERS["q"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1, from 0) and bytes of a string column; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]


def characters(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first character of each text and the end, code points) of what ``buffers`` returns.

    A byte that is no UTF-8 is the one character 0xDC00 + byte, so that texts stay apart
    and their bytes can be told from it.
    """
    raw = data.tobytes()
    inner = offsets[:-1][offsets[:-1] < len(data)]
    try:
        text = raw.decode("utf-8")
        whole = not ((data[inner] & 0xC0) == 0x80).any()
    except UnicodeDecodeError:
        whole = False
    if whole:
        return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets], np.frombuffer(text.encode("utf-32-le"), np.uint32)
    rows = [raw[a:b].decode("utf-8", "surrogateescape") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    begins = np.cumsum([0, *map(len, rows)])
    return begins, np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)


def byte_lengths(points: np.ndarray) -> np.ndarray:
    """How many bytes each of the ``characters`` has."""
    escaped = (points >= 0xDC80) & (points < 0xDD00)
    return np.where(escaped, 1, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        offsets, _ = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


class Words:
    """The words of a batch of texts: where each starts and ends, and each text's first word."""

    GAP = _SPACE

    def __init__(self, column: pa.Array, lower: bool = False):
        self.offsets, data = buffers(column)
        self.data = _LOWER[data] if lower else data
        n, bounds = len(data), self.offsets
        space = self.GAP[data]
        first, last = np.empty(n + 1, bool), np.empty(n + 1, bool)
        first[0], first[1:] = True, space
        first[bounds] = True
        last[n], last[:n] = True, space
        last[bounds] = True
        word = ~space
        self.starts = np.flatnonzero(word & first[:n])
        self.ends = np.flatnonzero(word & last[1:]) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits for each word: a polynomial over its bytes from one running sum."""
        power, inverse = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_BYTE[self.data] * power[: len(self.data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * inverse[self.starts])


class Terms(Words):
    """Runs of letters and digits of ASCII and of all other characters, lower-cased over A-Z."""

    GAP = _NO_TERM

    def __init__(self, column: pa.Array):
        super().__init__(column, lower=True)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for every run of ``size`` words, across texts too; the caller drops those."""
    if len(words) < size:
        return np.zeros(0, U64)
    total = np.zeros(len(words) - size + 1, U64)
    for j in range(size):
        total += words[j : len(words) - size + 1 + j] * _SLOT[j]
    return mix(total)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes starts[i] .. starts[i] + sizes[i] - 1, one run after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, sizes)


def shingle_sets(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): each text's distinct word shingles, sorted.

    Texts of fewer words have the whole sequence as their only shingle; texts without
    words have none. Words are lower-cased over A-Z only.
    """
    words = Words(column, lower=True)
    hashes, counts = words.hashes(), words.counts
    short = (counts > 0) & (counts < size)
    sizes = np.where(counts >= size, counts - size + 1, 0)
    flat = windows(hashes, size)[ragged(words.first[:-1], sizes)] if sizes.any() else np.zeros(0, U64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for a, b in zip(at[:-1][sizes > 1], at[1:][sizes > 1], strict=True):
        flat[a:b].sort()
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[at[:-1][sizes > 0]] = True
    distinct = np.concatenate([[0], np.cumsum(keep)])[at]
    flat, sizes = flat[keep], np.diff(distinct)
    if short.any():
        rows = np.flatnonzero(short)
        own = np.array([windows(hashes[words.first[i] : words.first[i + 1]], int(counts[i]))[0] for i in rows], U64) ^ (_SLOT[63] * counts[rows].astype(U64))
        where = distinct[rows]
        flat = np.insert(flat, where, own)
        sizes[rows] = 1
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), flat
