"""Sources: a folder of text files, Parquet, stopwords, a model's corpus, and uploads to check."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, basename
from ..operators.ranks import numbered
from ..scratch import settle

MOST_FILES, MOST_BYTES = 200, 5 * 1024 * 1024
TEXT_FILES = "*.[tT][xX][tT]"
TASK_BYTES = 64 * 1024 * 1024


class SourceError(ValueError):
    """No documents, or a file that isn't acceptable."""


def from_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, path, filename, text, bytes) of the .txt files of a folder (not of folders in it), in any store that
    Spark reads; ids are the ranks of the paths, from 0. Names that begin with _ or . are hidden to Spark."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        raise SourceError(f"no folder {folder}")
    place = store.makeQualified(place)
    # The source has no rows for empty files; only these are kept of the listing.
    empty = [(f"{place.toString().rstrip('/')}/{name}", name) for name in _empty_files(store, place) if name.lower().endswith(".txt") and name[0] not in "_."]
    read = spark.read.format("binaryFile").option("pathGlobFilter", TEXT_FILES).load(folder)
    # Small files are put in tasks by a cost of opening, which makes a task of some dozens.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(str(read._jdf.queryExecution().analyzed().stats().sizeInBytes())) // TASK_BYTES)
    files = read.coalesce(tasks).select("path", basename(F.col("path")).alias("filename"), F.col("content").cast("string").alias("text"), F.col("length").alias("bytes"))
    files = files.unionByName(spark.createDataFrame(empty, "path string, filename string").select("*", F.lit("").alias("text"), F.lit(0).cast("long").alias("bytes")))
    # Each file is opened once: the order is that of the written paths alone.
    files = settle(files.where(F.length("filename") > len(".txt")), "files")
    if files.isEmpty():
        raise SourceError(f"no .txt files in {folder}")
    return files.join(numbered(files.select("path"), "doc_id", F.col("path")), "path").select("doc_id", "path", "filename", "text", "bytes")


def _empty_files(store, place) -> Iterator[str]:
    """Names of the empty files of a folder. A local one is listed here; of others each file is three calls to the JVM."""
    if place.toUri().getScheme() == "file":
        with os.scandir(place.toUri().getPath()) as listed:
            yield from (f.name for f in listed if f.is_file() and not f.stat().st_size)
        return
    listed = store.listStatusIterator(place)
    while listed.hasNext():
        file = listed.next()
        if not file.getLen() and file.isFile():
            yield file.getPath().getName()


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, filename, text, bytes) of a table with doc_id and text."""
    docs = spark.read.parquet(path)
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.lit(path).alias("path"), F.col("doc_id").cast("string").alias("filename"), text.alias("text"), F.octet_length(text).cast("long").alias("bytes"))


def read_stopwords(spark: SparkSession, path: str | None) -> tuple[str, ...]:
    """Trimmed, lower-case, without blanks, repeats and lines that start with #. None gives the default list; a
    file that can't be read gives none."""
    if path is None:
        return STOPWORDS
    try:
        lines = spark.read.text(path)
        word = F.lower(F.rtrim(F.regexp_replace("value", r"\s+$", "")))
        words = lines.select(word.alias("word")).where("word != '' AND word NOT LIKE '#%'").distinct().orderBy("word").collect()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return ()
        raise
    return tuple(w.word for w in words)


def read_corpus(spark: SparkSession, path: str | None) -> DataFrame | None:
    """(text) of a corpus file; None if there is no such file, so that the fallback text is used. A file that
    can be read but has no words is an error, raised when the model is checked."""
    if not path:
        return None
    try:
        corpus = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return corpus


def validate_uploads(files: Iterable[tuple[str, int]], most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> list[str]:
    """Base names of (name, size) in the order given; a name that comes twice is overwritten but counts."""
    files = list(files)
    if not files:
        raise SourceError("no files")
    if len(files) > most_files:
        raise SourceError(f"more than {most_files} files")
    names: list[str] = []
    for name, size in files:
        name = os.path.basename(name.replace("\\", "/"))
        if not name.lower().endswith(".txt") or len(name) <= len(".txt"):
            raise SourceError(f"{name} is no .txt file")
        if size > most_bytes:
            raise SourceError(f"{name} is larger than {most_bytes} bytes")
        if name not in names:
            names.append(name)
    return names


def merge_selection(held: Sequence[str], new: Sequence[str], most: int = MOST_FILES) -> tuple[list[str], bool]:
    """(files held afterwards, accepted): a batch that would pass the limit is refused as a whole."""
    both = [*held, *(n for n in new if n not in held)]
    return (both, True) if len(both) <= most else (list(held)[:most], False)
