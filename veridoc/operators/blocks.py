"""Pairs within buckets, made and scored in blocks. A bucket is cut in chunks, and each two chunks meet as a block of
rows in one place, so that a document is sent once for each block and not once for each of its pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS, CHUNK_BYTES = 512, 4_000_000
NAME = ("band", "key", "i", "j")  # of a block: its bucket and its two chunks
COLUMNS = 4096
CELLS = 1 << 22


def chunked(bands: DataFrame) -> DataFrame:
    """(doc_id, band, key, chunk, chunks) of (doc_id, bytes, band, key), in buckets of at least two rows."""
    sizes = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).where("n > 1")
    chunks = F.ceil(F.greatest(F.col("n") / CHUNK_ROWS, F.least(F.col("bytes") / CHUNK_BYTES, F.col("n"))))
    met = bands.drop("bytes").join(sizes.select("band", "key", chunks.alias("chunks")), ["band", "key"])
    return met.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), "chunks"))


def paired(met: DataFrame) -> DataFrame:
    """A row for each block that its chunk is part of."""
    each = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return each.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).drop("chunks", "other")


def parts(df: DataFrame) -> int:
    """As many as the session shuffles to. Said outright, since few bytes can be much work, and are else put in one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def over_blocks(rows: DataFrame, function: Callable[[tuple, pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """function(name, rows) of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, table in _runs(batches):
            found = function(name, table)
            if found is not None:
                yield from found.to_batches(max_chunksize=50_000)

    return rows.repartition(parts(rows), *NAME).sortWithinPartitions(*NAME).mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Neighbouring rows of one name, which can go on in the next batch."""
    held, last = [], None
    for batch in batches:
        names = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in NAME], axis=1)
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1), len(names)] if len(names) else []
        for start, stop in zip(cuts[:-1], cuts[1:]):
            name = tuple(names[start].tolist())
            if held and name != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = name
            held.append(batch.slice(start, stop - start))
    if held:
        yield last, pa.Table.from_batches(held)


def lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All items of a column of lists without nulls, and the row of each."""
    parts = [c for c in column.chunks if len(c)]
    sizes = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in parts])
    return pa.concat_arrays([c.flatten() for c in parts]), np.repeat(np.arange(len(sizes)), sizes)


def pairs_of(name: tuple, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows (x, y) of a block that share no key of an earlier band; all where there are no keys."""
    band, _, i, j = name
    chunk = table.column("chunk").to_numpy()
    left = np.flatnonzero(chunk == i)
    right = left if i == j else np.flatnonzero(chunk == j)
    keys = None
    if "keys" in table.column_names and band:
        keys = lists(table.column("keys"))[0].to_numpy().reshape(len(chunk), -1)[:, :band].T.copy()
    found = []
    for start in range(0, len(left), 256):
        rows = left[start : start + 256]
        want = right[None, :] > rows[:, None] if i == j else np.ones((len(rows), len(right)), bool)
        if keys is not None:
            for one in keys:
                want &= one[rows][:, None] != one[right][None, :]
        x, y = np.nonzero(want)
        found.append((rows[x], right[y]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def products(item: np.ndarray, row: np.ndarray, value: np.ndarray, count: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The scalar product of rows x and y, for each such pair. Items (numbered) of one row alone are left out; the
    others stand in dense columns, so many at once that memory is bounded."""
    kinds, item = np.unique(item, return_inverse=True)
    shared = np.bincount(item, minlength=len(kinds)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[item]
    item, row, value = place[item[keep]], row[keep], value[keep]
    order = np.argsort(item, kind="stable")
    item, row, value = item[order], row[order], value[order]
    out = np.zeros(len(x))
    width = max(1, min(COLUMNS, CELLS // max(count, 1)))
    (left, at_x), (right, at_y) = (np.unique(side, return_inverse=True) for side in (x, y))
    whole = len(x) * 8 > len(left) * len(right)
    for first in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(item, (first, first + width))
        dense = np.zeros((count, width))
        dense[row[a:b], item[a:b] - first] = value[a:b]
        if whole:
            out += (dense[left] @ dense[right].T)[at_x, at_y]
        else:
            step = max(1, CELLS // width)
            for k in range(0, len(x), step):
                out[k : k + step] += np.einsum("ij,ij->i", dense[x[k : k + step]], dense[y[k : k + step]])
    return out
