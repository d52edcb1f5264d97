"""Vectorised views of text columns as UTF-8 bytes.

The operators of this subpackage that run in Python read whole Arrow batches and work on byte buffers with numpy, never
row by row.  A batch is cut into slices of about ``SLICE_BYTES`` of text (one longer document is a slice of its own), so
the temporary arrays stay small whatever the batch holds.  Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE, _BASE_INV = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 2**64)
_powers: dict[int, np.ndarray] = {}

WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (two rounds of xor-shift and multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, at least n of them."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, SLICE_BYTES + 4096)
        got = np.full(size, base, U64)
        got[0] = 1
        _powers[base] = got = np.cumprod(got, dtype=U64)
        if size > 8 * SLICE_BYTES:  # one very long text: don't keep its table
            del _powers[base]
    return got


class Slice:
    """Some consecutive documents of a batch, joined with newlines.

    buf: the bytes with one newline after each document; start, end: each document's range in buf.
    """

    def __init__(self, texts: list[bytes], lo: int, lower: bool = False):
        self.lo, self.n = lo, len(texts)
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.buf = LOWER[raw] if lower else raw
        sizes = np.fromiter(map(len, texts), np.int64, self.n)
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        self._sums: np.ndarray | None = None

    def sums(self) -> np.ndarray:
        """Prefix sums of the polynomial hash over buf, one longer than buf."""
        if self._sums is None:
            terms = _TABLE[self.buf] * powers(_BASE, len(self.buf))[: len(self.buf)]
            self._sums = np.concatenate([np.zeros(1, U64), np.cumsum(terms, dtype=U64)])
        return self._sums

    def hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte strings buf[lo:hi], equal for equal strings wherever they stand."""
        s = self.sums()
        return mix((s[hi] - s[lo]) * powers(_BASE_INV, len(self.buf) + 1)[lo] + (hi - lo).astype(U64) * _MULT)

    def words(self, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word (maximal run of bytes that table holds true) and the index of its document."""
        inside = table[self.buf].view(np.int8)
        step = np.diff(inside, prepend=np.int8(0))
        lo, hi = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        return lo, hi, self.document(lo)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, side="right") - 1

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes' flags are set in each document."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.end] - total[self.start]


def as_bytes(texts: pa.Array) -> list[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [x or b"" for x in texts.cast(kind).to_pylist()]


def slices(texts: list[bytes], lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    lo = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield Slice(texts[lo:i], lo, lower)
            lo, size = i, 0
        size += len(x) + 1
    if lo < len(texts):
        yield Slice(texts[lo:], lo, lower)


def windows(values: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of width values with one owner, and the places where those runs start."""
    if len(values) < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    n = len(values) - width + 1
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    out = np.zeros(len(at), U64)
    for k in range(width):
        out = out * U64(_BASE) + values[at + k]
    return mix(out), at
