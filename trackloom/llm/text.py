"""Vectorised text helpers that run inside Spark's Python workers.

Texts arrive in Arrow batches of any number of rows and bytes.  Everything here works on pieces of at most
``PIECE`` bytes (or one word, if a single word is longer), so a worker's memory depends on the piece, not on the
batch or on the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the hash base and of its inverse, grown on demand and kept by the worker."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE + 4096)
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return self.up, self.down


_TABLES = _Tables()


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, ``n`` of each at least."""
    return _TABLES.upto(n)


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text whose A-Z are lowered
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all other bytes alike
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)


def pieces(blob: bytes, table: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) pieces of a text that end between words."""
    data, at = np.frombuffer(blob, np.uint8), 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data):
            gaps = np.flatnonzero(~table[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(len(data), end + size)
        yield at, data[at:end]
        at = end


def spans(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``table`` marks."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = table[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs: a polynomial in the bytes modulo 2^64, then mixed."""
    up, down = _TABLES.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(blob: bytes, table: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """Hashes of one text's words, in order."""
    out = []
    for _, piece in pieces(blob, table[fold]):
        piece = fold[piece]
        out.append(hashed(piece, *spans(piece, table)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def blobs(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each row of a string column; a null is empty."""
    for x in column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column:
        yield x.as_py() or b""


def grouped(texts: Iterable[bytes], size: int = PIECE, rows: int = 512) -> Iterator[list[bytes]]:
    """Runs of at most ``rows`` texts and about ``size`` bytes together; a longer text comes alone."""
    run: list[bytes] = []
    held = 0
    for x in texts:
        if run and (held + len(x) > size or len(run) == rows):
            yield run
            run, held = [], 0
        run.append(x)
        held += len(x) + 1
    if run:
        yield run


def doc_hashes(texts: list[bytes], table: np.ndarray, fold: np.ndarray = LOWER) -> list[np.ndarray]:
    """Word hashes of each text of a run, made together."""
    if len(texts) == 1:
        return [word_hashes(texts[0], table, fold)]
    data = fold[np.frombuffer(b"\n".join(texts), np.uint8)]
    starts, ends = spans(data, table)
    words = hashed(data, starts, ends)
    cut = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts])[:-1])
    return np.split(words, cut)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle, an empty one has none."""
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total = mix(total * np.uint64(_BASE) + words[i : len(words) - k + 1 + i])
    return np.unique(total)
