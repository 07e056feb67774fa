"""Vectorised text primitives for Arrow batches.

Everything works on the bytes of a whole batch at once: Arrow keeps the texts of
a column back to back, so tokens, rolling hashes and windows are NumPy passes
over one buffer. Hashes are polynomials modulo 2**64 over a table of random byte
values, finished by a bit mixer; users that need certainty verify their hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def splitmix(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit integers so that every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


with np.errstate(over="ignore"):
    BYTE = splitmix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * BASE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_LOWER = BYTE[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII digits, a-z after lower-casing, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if len(_powers["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about limit bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[i:j] * BASE**k, k counted from the start."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hash of each span, mixed with its length."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        h = (prefix[end] - prefix[start]) * down[start]
        return splitmix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that stay inside a row."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty_like(mask), np.empty_like(mask)
    before[0] = after[-1] = False
    before[1:], after[:-1] = mask[:-1], mask[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[edge] = False
    after[edge[1:] - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def row_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row that holds each byte position."""
    return np.searchsorted(offsets, positions, "right") - 1


def token_hashes(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of every word; word[b] tells whether byte b is in a word."""
    start, end = spans(word[raw], offsets)
    table = BYTE_LOWER if lower else BYTE
    return span_hash(prefix_hash(table[raw]), start, end), row_of(start, offsets), start, end


def ngram_hashes(tokens: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first token) of every n-gram inside a row."""
    m = len(tokens) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = tokens[:m].copy()
        for k in range(1, n):
            h = h * BASE + tokens[k : k + m]
    first = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return splitmix(h[first] + np.uint64(n)), first


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct hashes of its n-word shingles.

    Words are lower-cased (A-Z) runs of non-space bytes. A row of fewer words gives
    its whole word sequence as the only shingle, a row without words nothing.
    """
    tokens, rows, _, _ = token_hashes(raw, offsets, ~SPACE)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    grams, first = ngram_hashes(tokens, rows, n)
    at = np.searchsorted(rows[first], np.arange(len(offsets)))
    token_at = np.concatenate([[0], np.cumsum(count)])
    for r in range(len(offsets) - 1):
        if count[r] >= n:
            own = np.sort(grams[at[r] : at[r + 1]])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif count[r]:
            own = tokens[token_at[r] : token_at[r + 1]]
            yield ngram_hashes(own, np.zeros(len(own), np.int64), len(own))[0]
        else:
            yield grams[:0]
