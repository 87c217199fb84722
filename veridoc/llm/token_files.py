"""Token ids as Arrow files of equal-length sequences (operator 7).

Documents are ordered by range partitions on the key. Each task encodes its documents, runs their ids
together (an end id after each), and writes one Arrow IPC file whose record batches hold fixed-size lists:
`ids` (16 or 32 bits each, by the vocabulary) and `mask` (one bit each, 0 on the padding of the last
sequence). All batches but the last hold SEQUENCES_PER_BATCH sequences, so sequence i is found by division
and read from a memory map without a copy: ids as a NumPy view, the mask as an Arrow view of its bits (NumPy has
no arrays of bits, so turning one into such an array copies it). Beside it lies an index file (key, start, n_tokens), start counted
within the file. A manifest of a row for each file, in key order, gives each file's first id.

A file is written under a name of its own and then renamed, so a task that runs twice leaves one whole file.

Encoding uses the tokenizers library; as byte-level pieces are encoded independently, each distinct piece is
sent to it once and then found in a bounded cache (`bpe.PieceCache`). With `added_tokens=True`, as in the query, the
ids are those of the library's own call on the whole text (add_special_tokens=False, nothing else set): a text that
holds an added token of the tokenizer, like <|endoftext|>, goes to the library whole. Without, such strings are
encoded as plain text.

Defined results: null and empty texts hold the end id alone; null keys come first; repeated rows stay, in
the order of their texts; an empty table gives no files. Extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PieceCache, encode_texts
from .common import read_table, scratch_path, settle

SEQUENCE = 2048
SEQUENCES_PER_BATCH = 64
END_ID = 0
PIECES_AT_ONCE = 20_000
CACHE_ENTRIES = 600_000
CHARS_AT_ONCE = 2_000_000


@cache
def _library(path: str, added_tokens: bool = False):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if not added_tokens:
        tokenizer.encode_special_tokens = True
    return tokenizer


@cache
def _cache_for(path: str) -> PieceCache:
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    library.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)  # the pieces are cut already
    vocabulary = library.get_vocab()
    width = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        width[i] = len(token)  # a character for each byte

    def encode(new: list[str]) -> list[bytes]:
        """Many pieces go to the library as the words of one text. Its ids are cut where the bytes of the tokens
        add up to those of the pieces."""
        out: list[bytes] = []
        for at in range(0, len(new), PIECES_AT_ONCE):
            words = new[at : at + PIECES_AT_ONCE]
            ids = np.array(library.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            ends = (np.searchsorted(np.cumsum(width[ids]), np.cumsum([len(w.encode()) for w in words])) + 1) * 4
            raw, bounds = ids.tobytes(), [0, *ends.tolist()]
            out += [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        return out

    return PieceCache(encode, CACHE_ENTRIES)


def _encode(texts: list[str], tokenizer: str, added_tokens: bool) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    known = _cache_for(tokenizer)
    added = [t.content for t in _library(tokenizer).get_added_tokens_decoder().values()] if added_tokens else []
    whole = {i for i, t in enumerate(texts) if any(a in t for a in added)}
    for i, packed in enumerate(encode_texts(["" if i in whole else t for i, t in enumerate(texts)], known, CHARS_AT_ONCE)):
        if i in whole:
            packed = np.array(_library(tokenizer, True).encode_batch_fast([texts[i]], add_special_tokens=False)[0].ids, "<u4").tobytes()
        yield packed


class SequenceWriter:
    """Streams ids into a file of fixed-size-list batches; holds a batch at most."""

    def __init__(self, fs: pafs.FileSystem, path: str, kind: np.dtype, sequence: int = SEQUENCE):
        self.sequence, self.kind = sequence, kind
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.out = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= self.sequence * SEQUENCES_PER_BATCH:
            flat, full = np.concatenate(self.held), self.sequence * SEQUENCES_PER_BATCH
            whole = len(flat) // full * full
            for at in range(0, whole, full):
                self._batch(flat[at : at + full], full)
            self.held, self.waiting = [flat[whole:]], len(flat) - whole

    def _batch(self, ids: np.ndarray, real: int) -> None:
        lists = pa.FixedSizeListArray.from_arrays(pa.array(ids), self.sequence)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < real), self.sequence)
        self.file.write_batch(pa.RecordBatch.from_arrays([lists, mask], schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            flat = np.concatenate(self.held)
            self._batch(np.pad(flat, (0, -len(flat) % self.sequence)), len(flat))
        self.file.close()
        self.out.close()


class SequenceFile:
    """Random access to a file of SequenceWriter; sequences and masks are views of the mapped file, ids in NumPy, masks in Arrow."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.sequence = self.file.schema.field("ids").type.list_size

    def batch(self, i: int) -> np.ndarray:
        return self.file.get_batch(i).column("ids").flatten().to_numpy()

    def sequence_at(self, i: int) -> np.ndarray:
        k = i % SEQUENCES_PER_BATCH
        return self.batch(i // SEQUENCES_PER_BATCH)[k * self.sequence : (k + 1) * self.sequence]

    def mask_at(self, i: int) -> pa.BooleanArray:
        lists = self.file.get_batch(i // SEQUENCES_PER_BATCH).column("mask")
        return lists[i % SEQUENCES_PER_BATCH].values

    def ids(self, start: int, count: int) -> np.ndarray:
        """Any run of ids, over as many batches as it spans."""
        size = self.sequence * SEQUENCES_PER_BATCH
        parts = [self.batch(b)[max(0, start - b * size) : start + count - b * size] for b in range(start // size, (start + count - 1) // size + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, sequence: int = SEQUENCE, key: str = "doc_id", text: str = "text", added_tokens: bool = False) -> DataFrame:
    """Write the files under a folder that all executors see; return the manifest
    (part, file, first, n_tokens, n_docs) in key order."""
    spark = docs.sparkSession
    width = np.dtype("<u2") if _library(tokenizer).get_vocab_size() <= 65536 > end_id else np.dtype("<u4")
    fs, place = pafs.FileSystem.from_uri(folder)
    fs.create_dir(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = pafs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        own = f"{place}/.{uuid.uuid4().hex}"
        end = np.array([end_id], "<u4")
        writer = index = None
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                writer = SequenceWriter(fs, own, width, sequence)
                index_schema = pa.schema([("key", batch.schema.field(key).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index_out = fs.open_output_stream(f"{own}.index")
                index = pa.ipc.new_file(index_out, index_schema)
            starts, sizes = [], []
            for packed in _encode([t or "" for t in batch.column(text).to_pylist()], tokenizer, added_tokens):
                starts.append(writer.total)
                writer.add(np.concatenate([np.frombuffer(packed, "<u4"), end]))
                sizes.append(writer.total - starts[-1])
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(key), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=index_schema))
            count += batch.num_rows
        if writer is None:
            return
        writer.close()
        index.close()
        index_out.close()
        name = f"part-{part:06d}"
        fs.move(f"{own}.index", f"{place}/{name}.index")
        fs.move(own, f"{place}/{name}.arrow")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_tokens": pa.array([writer.total], pa.int64()), "n_docs": pa.array([count], pa.int64())})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(key, text).repartitionByRange(parts, F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first(), text)
    made = settle(ordered.mapInArrow(run, "part int, file string, n_tokens long, n_docs long"), "manifest")
    # A row for each file, not for each document.
    rows, first = [], 0
    for r in sorted(made.collect(), key=lambda r: r.part):
        rows.append((r.part, f"{folder}/{r.file}", first, r.n_tokens, r.n_docs))
        first += r.n_tokens
    return spark.createDataFrame(rows, "part int, file string, first long, n_tokens long, n_docs long")


def read_token_files(manifest: DataFrame, key_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files; start is global."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist()):
                fs, place = pafs.FileSystem.from_uri(name)
                ids = SequenceFile(fs, f"{place}.arrow")
                with fs.open_input_file(f"{place}.index") as file:
                    index = pa.ipc.open_file(file)
                    for i in range(index.num_record_batches):
                        rows = index.get_batch(i)
                        at = zip(rows.column("start").to_pylist(), rows.column("n_tokens").to_pylist())
                        crc = [zlib.crc32(ids.ids(s, n).astype("<u4").tobytes()) for s, n in at]
                        start = pa.compute.add(rows.column("start"), first)
                        yield pa.RecordBatch.from_arrays([rows.column("key"), start, rows.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part")
    return spread.mapInArrow(run, f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, scratch_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)
    return read_token_files(manifest, docs.schema["doc_id"].dataType.simpleString())
