"""Unsigned 32-bit hashes with wraparound, in NumPy: seeded token hashes, MinHash signatures, band keys and
rolling fingerprints. Tokens come as Arrow lists and are numbered by Arrow, so that none becomes a Python object but
the distinct ones of a run of documents, which are hashed once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..config import SHINGLE, SIGNATURE, WINDOW

U = np.uint32
# The constants of the hash family.
OFFSET, PRIME, GOLDEN, FINAL = U(2166136261), U(16777619), U(0x9E3779B9), U(0x85EBCA6B)
POSITION = U(17)
SEEDS = GOLDEN + np.arange(SIGNATURE, dtype=U) * FINAL
TOKENS_AT_ONCE = 300_000
ROWS_AT_ONCE = 256  # shingles; their hashes under all seeds stay in a core's cache
CELLS_AT_ONCE = 8_000_000


def _bytes_by_place(words: list[bytes]):
    """Yields (how many words reach this place, their bytes at it), words being sorted by falling length."""
    size = np.array([len(w) for w in words])
    flat = np.frombuffer(b"".join(words), np.uint8)
    start = np.cumsum(size) - size
    for place in range(int(size[0]) if len(size) else 0):
        reach = int(np.searchsorted(-size, -place, side="left"))
        yield reach, flat[start[:reach] + place].astype(U)


def _by_length(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    return np.array(order, np.int64), [words[i] for i in order]


def plain_hash(words: list[bytes]) -> np.ndarray:
    """FNV-1a of each word; 0 becomes 1."""
    order, falling = _by_length(words)
    h = np.full(len(words), OFFSET, U)
    for reach, byte in _bytes_by_place(falling):
        h[:reach] = (h[:reach] ^ byte) * PRIME
    out = np.empty_like(h)
    out[order] = np.where(h == 0, U(1), h)
    return out


def seeded_hash(words: list[bytes], seeds: np.ndarray) -> np.ndarray:
    """A row for each word, a column for each seed."""
    return _seeded_hashes(words, [seeds])[0]


def _seeded_hashes(words: list[bytes], families: list[np.ndarray]) -> list[np.ndarray]:
    """seeded_hash under several families of seeds; so many words at once that they stay in a core's cache."""
    order, falling = _by_length(words)
    out = [np.empty((len(words), len(seeds)), U) for seeds in families]
    for at in range(0, len(words), ROWS_AT_ONCE):
        part = falling[at : at + ROWS_AT_ONCE]
        places = [(reach, byte[:, None]) for reach, byte in _bytes_by_place(part)]
        for seeds, hashed in zip(families, out):
            h = np.tile(OFFSET ^ seeds, (len(part), 1))
            for reach, byte in places:
                h[:reach] ^= byte
                h[:reach] *= PRIME
            h ^= seeds * GOLDEN
            h ^= h >> U(16)
            h *= FINAL
            h ^= h >> U(13)
            hashed[order[at : at + ROWS_AT_ONCE]] = h
    return out


def _lists(documents: pa.ListArray | list[list[str]]) -> pa.ListArray:
    return documents if isinstance(documents, pa.Array) else pa.array(documents, pa.list_(pa.string()))


def _numbered(documents: pa.ListArray | list[list[str]]) -> tuple[list[bytes], list[np.ndarray]]:
    documents = _lists(documents)
    coded = documents.flatten().dictionary_encode()
    ends = np.cumsum(documents.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    return coded.dictionary.cast(pa.binary()).to_pylist(), np.split(coded.indices.to_numpy().astype(np.int64), ends[:-1]) if len(ends) else []


def runs(documents: pa.ListArray) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of documents of about TOKENS_AT_ONCE tokens together."""
    ends = np.cumsum(documents.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOKENS_AT_ONCE, side="right"))
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def signatures(documents: pa.ListArray | list[list[str]]) -> np.ndarray:
    """MinHash over runs of SHINGLE tokens (all tokens, if fewer); zeros without tokens. So many seeds at once that
    the words' hashes are bounded."""
    words, numbers = _numbered(documents)
    out = np.zeros((len(numbers), SIGNATURE), U)
    step = max(1, min(SIGNATURE, CELLS_AT_ONCE // max(1, len(words))))
    for first in range(0, SIGNATURE, step):
        _least(words, numbers, SEEDS[first : first + step], out[:, first : first + step])
    return out


def _least(words: list[bytes], numbers: list[np.ndarray], seeds: np.ndarray, out: np.ndarray) -> None:
    by_place = _seeded_hashes(words, [seeds + U(i) * POSITION for i in range(SHINGLE)])
    by_place[0] ^= OFFSET ^ seeds
    by_place[0] *= PRIME
    held, other = np.empty((2, ROWS_AT_ONCE, len(seeds)), U)
    for row, n in enumerate(numbers):
        width = min(SHINGLE, len(n))
        if not width:
            continue
        least = np.full(len(seeds), 0xFFFFFFFF, U)
        for at in range(0, len(n) - width + 1, ROWS_AT_ONCE):
            stop = min(at + ROWS_AT_ONCE, len(n) - width + 1)
            h, t = held[: stop - at], other[: stop - at]
            np.take(by_place[0], n[at:stop], axis=0, out=h, mode="clip")
            for i in range(1, width):
                np.take(by_place[i], n[at + i : stop + i], axis=0, out=t, mode="clip")
                h ^= t
                h *= PRIME
            np.right_shift(h, U(15), out=t)
            h ^= t
            np.minimum(least, h.min(axis=0), out=least)
        out[row] = np.maximum(least, U(1))  # 0 counts as 1


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each document and band."""
    h = np.tile(OFFSET ^ np.arange(bands, dtype=U), (len(signature), 1))
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    for i in range(rows):
        h ^= parts[:, :, i] + GOLDEN + (h << U(6)) + (h >> U(2))
    return h


def fingerprints(documents: pa.ListArray | list[list[str]]) -> list[np.ndarray]:
    """Sorted distinct polynomial hashes of all runs of WINDOW tokens."""
    words, numbers = _numbered(documents)
    hashed = plain_hash(words)
    out = []
    for n in numbers:
        count = len(n) - WINDOW + 1
        if count <= 0:
            out.append(np.empty(0, U))
            continue
        h = np.zeros(count, U)
        for i in range(WINDOW):
            h = h * PRIME + hashed[n[i : i + count]]
        out.append(np.unique(np.where(h == 0, U(1), h)))
    return out
