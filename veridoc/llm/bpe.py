"""Byte-level BPE: encoding and decoding (operator 1).

Pieces come from `pretokenize.pieces` (codepoint classes and an associative scan, no regex); each piece is
merged once and then found in a cache bounded in entries. Every id keeps its place: with `offsets=True` the
encoder also returns where in the text's UTF-8 bytes each id begins, so that decoding any slice of ids gives
the bytes of the matching slice of the text.

Defined results: null and empty texts give no ids, and decode to no bytes. Ties in rank go to the leftmost
pair. Rows are independent, so repeated rows and null ids pass through as they are; extra columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_text_size, read_table
from .pretokenize import pieces

CACHE_ENTRIES = 200_000  # of about 200 bytes
CHARS_AT_ONCE = 1_000_000  # about 100 bytes of arrays each; workers keep what they once took


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: the neighbouring pair of lowest rank is joined until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 200:
        return _merge_long(piece, ranks)
    get = ranks.get
    none = 1 << 60
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap, for pieces of any length in n log n."""
    from heapq import heapify, heappop, heappush

    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0: joined to the one before
    last = [-1, *range(n - 1)]  # start of the part before
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            last[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (k := last[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class PairTable:
    """Joinable pairs of ids and the id they give, open-addressed for lookups of whole arrays."""

    NONE = np.int32(1 << 30)
    FREE = np.uint64((1 << 64) - 1)

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys = np.array([p[0] for p in pairs], np.uint64)
        joined = np.array([p[1] for p in pairs], np.int32)
        self.bits = max(16, (4 * len(pairs)).bit_length())  # at most half full
        size = 1 << self.bits
        self.keys = np.full(size, self.FREE, np.uint64)
        self.joined = np.full(size, self.NONE, np.int32)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):  # those that come first to a free slot take it; the rest move on
            free = self.keys[slot[todo]] == self.FREE
            _, first = np.unique(slot[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[slot[placed]], self.joined[slot[placed]] = keys[placed], joined[placed]
            todo = np.setdiff1d(todo, placed)
            slot[todo] = (slot[todo] + 1) & (size - 1)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.joined[slot], self.NONE)
        more = np.flatnonzero((found != keys) & (found != self.FREE))
        while len(more):
            slot[more] = (slot[more] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[more]]
            hit = found == keys[more]
            out[more[hit]] = self.joined[slot[more[hit]]]
            more = more[~hit & (found != self.FREE)]
        return out

    def merge_all(self, words: list[bytes], width: int) -> list[bytes]:
        """The ids of words of 2 to `width` bytes, all merged together, a join in each word a round."""
        size = np.array([len(w) for w in words])
        ids = self.single[np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)]
        rank = np.full(ids.shape, self.NONE, np.int32)
        at, col = np.nonzero(np.arange(width - 1) < size[:, None] - 1)
        rank[at, col] = self.look_up(ids[at, col], ids[at, col + 1])
        done_ids, done_size = np.zeros_like(ids), np.zeros_like(size)
        rows, column = np.arange(len(words)), np.arange(width)
        while len(rows):
            best = rank.argmin(axis=1)
            value = rank[np.arange(len(rows)), best]
            live = value != self.NONE
            if not live.all():
                done_ids[rows[~live]], done_size[rows[~live]] = ids[~live], size[~live]
                rows, ids, rank, size, best, value = rows[live], ids[live], rank[live], size[live], best[live], value[live]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            move = column > best[:, None]
            ids[:, :-1] = np.where(move[:, :-1], ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(move[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = self.NONE
            ids[each, best] = value
            size -= 1
            rank[each, best] = self.NONE
            for column_of, some in ((best, best < size - 1), (best - 1, best > 0)):
                r, c = each[some], column_of[some]
                rank[r, c] = self.look_up(ids[r, c], ids[r, c + 1])
        done_ids = done_ids.astype("<u4")
        return [row[:n].tobytes() for row, n in zip(done_ids, done_size.tolist())]


class Merger:
    """Encodes lists of distinct pieces by ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, PairTable(ranks)

    def __call__(self, new: list[str]) -> list[bytes]:
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        out: list[bytes] = [b""] * len(raw)
        by_width: dict[int, list[int]] = {8: [], 16: [], 32: []}
        get = self.ranks.get
        for i, piece in enumerate(raw):
            whole, n = get(piece), len(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif n <= 32:
                by_width[8 if n <= 8 else 16 if n <= 16 else 32].append(i)
            else:
                out[i] = np.array(merge(piece, self.ranks), "<u4").tobytes()
        for width, some in by_width.items():
            for part in range(0, len(some), 20_000):
                at = some[part : part + 20_000]
                for i, ids in zip(at, self.pairs.merge_all([raw[i] for i in at], width)):
                    out[i] = ids
        return out


class PieceCache(dict):
    """Piece to its ids as little-endian unsigned 32-bit integers. Emptied when full, so bounded."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], entries: int = CACHE_ENTRIES):
        super().__init__()
        self.encode, self.entries = encode, entries

    def ids(self, found: list[str]) -> list[bytes]:
        out = list(map(self.get, found))
        new = list(dict.fromkeys(p for p, ids in zip(found, out) if ids is None))
        if new:
            encoded = dict(zip(new, self.encode(new)))
            out = [encoded[p] if ids is None else ids for p, ids in zip(found, out)]
            if len(self) + len(new) > self.entries:
                self.clear()
            if len(new) <= self.entries:
                self.update(encoded)
        return out


_POWER = np.cumprod(np.concatenate([[np.uint64(1)], np.full(255, 0x9E3779B97F4A7C15, np.uint64)]), dtype=np.uint64)


def _distinct(code: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first piece of each distinct kind, kind of each piece). Pieces are told apart by a hash of
    their codepoints, and each is then compared with the first of its kind, so the outcome is exact."""
    before = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(before, size)
    own = code[np.repeat(first, size) + place]
    mixed = (own.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    hashed = np.add.reduceat(mixed * _POWER[place & 255], before) + size.astype(np.uint64)
    kind, known = pd.factorize(hashed)
    lead = np.empty(len(known), np.int64)
    lead[kind[::-1]] = np.arange(len(kind) - 1, -1, -1)
    of = lead[kind]
    same = (size == size[of]).all() and (own == code[np.repeat(first[of], size) + place]).all()
    if not same:  # two pieces of one hash: every piece is its own kind
        return np.arange(len(first)), np.arange(len(first))
    return lead, kind


def encode_texts(texts: list[str], known: PieceCache, chars: int = CHARS_AT_ONCE) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    for run in by_text_size(texts, chars):
        joined, first, end, upto = pieces(texts[run.start : run.stop])
        if not len(first):
            yield from (b"" for _ in upto)
            continue
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lead, kind = _distinct(code, first, end - first)
        found = known.ids([joined[a:b] for a, b in zip(first[lead].tolist(), end[lead].tolist())])
        # Each piece takes its kind's ids: counts and places first, then one gather.
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        begin, count = (np.cumsum(size) - size)[kind], size[kind]
        stop = np.cumsum(count)
        ids = flat[np.repeat(begin - (stop - count), count) + np.arange(int(stop[-1]))]
        bounds = np.concatenate([[0], stop])[np.concatenate([[0], upto])].tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield ids[a:b].tobytes()


@cache
def _cache_for(path: str) -> PieceCache:
    return PieceCache(Merger(load_ranks(path)))


@cache
def _tokens(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encode(text: str | None, path: str, offsets: bool = False):
    """The ids of one text; with offsets also the byte at which each begins."""
    ids = np.frombuffer(next(encode_texts([text or ""], _cache_for(path))), "<u4")
    if not offsets:
        return ids
    sizes = np.array([len(_tokens(path)[i]) for i in ids.tolist()], np.int64)
    return ids, np.cumsum(sizes) - sizes


def decode(ids: np.ndarray, path: str) -> bytes:
    return b"".join(map(_tokens(path).__getitem__, ids.tolist()))


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>, offsets array<int>): ids of each whole text and the byte each begins at."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array([len(t) for t in _tokens(vocabulary)], np.int32)
        for batch in batches:
            packed = [np.frombuffer(x, "<u4").astype(np.int32) for x in encode_texts([t or "" for t in batch.column(text).to_pylist()], _cache_for(vocabulary))]
            begins = [np.cumsum(table[x], dtype=np.int32) - table[x] for x in packed]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(packed, pa.list_(pa.int32())), pa.array(begins, pa.list_(pa.int32()))], [key, "ids", "offsets"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>, offsets array<int>")


def bpe_decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """(key, decoded binary): the bytes of (key, ids)."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _tokens(vocabulary)
        for batch in batches:
            out = [b"".join(table[i] for i in ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.binary())], [key, "decoded"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, decoded binary")


def round_trip_digests(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode in one pass over each batch, so that ids are never shuffled or stored:
    (key, n_tokens, ids_sha256, decoded_sha256, lossless)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = _cache_for(vocabulary), _tokens(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            count, of_ids, of_bytes, same = [], [], [], []
            for source, packed in zip(texts, encode_texts(texts, known)):
                ids = np.frombuffer(packed, "<u4").tolist()
                back = b"".join(map(table.__getitem__, ids))
                count.append(len(ids))
                of_ids.append(hashlib.sha256(packed).hexdigest())
                of_bytes.append(hashlib.sha256(back).hexdigest())
                same.append(back == source.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string()), pa.array(same, pa.bool_())], [key, "n_tokens", "ids_sha256", "decoded_sha256", "lossless"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
