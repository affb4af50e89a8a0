"""Vectorised words and word n-grams over Arrow string columns.

A batch of texts is one byte buffer with offsets.  Words are maximal runs of
bytes of an alphabet; their 64-bit hashes come from prefix sums of a polynomial
hash, so no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes of rows that are worked on together, and of those whose words are hashed at once.
CHUNK_BYTES, HASH_BYTES = 1 << 20, 1 << 18


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, HASH_BYTES + 1)
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, U64), np.full(size, inverse, U64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.cumprod(up), np.cumprod(down))
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words and what each adds to a hash."""

    member: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(separators: bytes, lower: bool) -> Alphabet:
        member = np.ones(256, bool)
        member[list(separators)] = False
        value = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=U64)
        if lower:
            value[65:91] = value[97:123]
        return Alphabet(member, value)


#: Words are what ASCII white space separates.
SPACED = Alphabet.of(b" \t\n\x0b\x0c\r", lower=False)
SPACED_LOWER = Alphabet.of(b" \t\n\x0b\x0c\r", lower=True)
#: Words are ASCII letters, digits and all bytes beyond ASCII.
ALNUM_LOWER = Alphabet.of(bytes(b for b in range(128) if not chr(b).isalnum()), lower=True)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about limit bytes of text in a column."""
    for lo, hi in chunks(column_bytes(batch[column])[1], limit):
        yield batch.slice(lo, hi - lo)


@dataclass
class Words:
    """Words of some rows: byte spans, hashes, and first[d]..first[d + 1] for row d."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.hashes)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> Words:
    """Words of the rows that offsets delimit; spans are relative to offsets[0]."""
    text = data[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    n = len(text)
    member = alphabet.member[text]
    opens, closes = member.copy(), member.copy()
    if n:
        opens[1:] &= ~member[:-1]
        closes[:-1] &= ~member[1:]
        head, tail = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
        opens[head] = member[head]
        closes[tail] = member[tail]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BYTES, side="right")))
        a, b = starts[i], ends[j - 1]
        up, down = powers(_BASE, b - a + 1)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum(alphabet.value[text[a:b]] * up[: b - a], out=sums[1:])
        hashes[i:j] = (sums[ends[i:j] - a] - sums[starts[i:j] - a]) * down[starts[i:j] - a]
        i = j
    return Words(starts, ends, mix(hashes), np.searchsorted(starts, at))


def grams(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the size words from each position, and whether they lie in one row."""
    n = len(w)
    if n < size:
        return np.zeros(0, U64), np.zeros(0, bool)
    up, down = powers(_BASE2, n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(w.hashes * up[:n], out=sums[1:])
    m = n - size + 1
    hashes = mix((sums[size:] - sums[:m]) * down[:m])
    return hashes, np.arange(size, n + 1) <= np.repeat(w.first[1:], np.diff(w.first))[:m]


def join_words(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The given spans of text, joined by one space."""
    return b" ".join([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
