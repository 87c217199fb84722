"""Benchmark decontamination with one Aho-Corasick automaton (operator 3).

Texts are normalised to words (A-Z lowered; runs of digits, a-z and all bytes from 0x80) parted by single
spaces. The automaton holds every window of 10 consecutive words of every item (an item of fewer words is one
window), fenced by spaces, so that one scan of a normalised document finds all windows at once. A hit's place
is counted in words and led back to the original text's code points.

The items are collected to build the automaton behind a check of their size; a worker process builds it once.
Beyond AUTOMATON_BYTES of normalised windows they are dealt to several automata, each below the bound, and the
documents are scanned once for each; the hit words are then united by document, and spans made of all of them.

Defined results: a null or empty text has no words and no hits; an item of null or wordless text has no windows;
an item of null id hits words like others but is in no list of items; repeated items count each, as they have
ids of their own; repeated rows each get a result; an empty table
of either kind gives no hits. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, settle

WINDOW = 10
AUTOMATON_BYTES = 48_000_000
# A-Z lowered, word bytes kept, all others a space.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normalised(text: str | None) -> list[bytes]:
    """The words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def windows(text: str | None, width: int = WINDOW) -> list[bytes]:
    words = normalised(text)
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def build_automaton(items: list[tuple[str | None, str | None]], width: int = WINDOW):
    """The automaton over (item id, text); a window's value is (its words, the ids of its items)."""
    import ahocorasick

    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for window in windows(text, width):
            owners.setdefault(window, set()).add(item)
    automaton = ahocorasick.Automaton()
    for window, ids in owners.items():
        automaton.add_word(f" {window.decode('utf-8', 'surrogatepass')} ", (window.count(b" ") + 1, sorted(i for i in ids if i is not None)))
    automaton.make_automaton()
    return automaton


_last: tuple | None = None


def _automaton_of(sent):
    """The automaton over a broadcast list, kept while a worker process goes on with the same one."""
    global _last
    items = sent.value
    if _last is None or _last[0] is not items:
        _last = items, build_automaton(items)
    return _last[1]


def scan(text: str | None, automaton) -> tuple[int, np.ndarray, set[str]]:
    """(number of words, sorted places of the hit words, ids of the items met)."""
    words = normalised(text)
    if not words or not len(automaton):
        return len(words), np.empty(0, np.int64), set()
    plain = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    met = list(automaton.iter(plain))
    if not met:
        return len(words), np.empty(0, np.int64), set()
    # The word that ends at the space at position p is the one with so many spaces before.
    spaces = np.flatnonzero(np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    hit = np.zeros(len(words) + 1, np.int64)
    items: set[str] = set()
    for place, (size, ids) in met:
        last = int(np.searchsorted(spaces, place))
        hit[last - size] += 1
        hit[last] -= 1
        items.update(ids)
    return len(words), np.flatnonzero(np.cumsum(hit)[:-1]), items


def word_spans(text: str, at: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans in the original text of the words at the given places."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(_TO_WORDS), np.uint8) != 32
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[edge[2 * i]]), int(before[edge[2 * i + 1]])) for i in at]


def hit_spans(text: str | None, places: np.ndarray) -> list[dict]:
    """Runs of neighbouring hit words as code-point spans of the original text."""
    if not len(places):
        return []
    runs = np.split(places, np.flatnonzero(np.diff(places) > 1) + 1)
    spans = word_spans(text or "", np.array([x for r in runs for x in (r[0], r[-1])]))
    return [{"start": spans[2 * i][0], "end": spans[2 * i + 1][1]} for i in range(len(runs))]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find_contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, n_words, n_hit, items array<string> sorted, spans array<struct<start,end>> in code points)."""
    dealt = _dealt(docs.sparkSession, items, item)
    many = len(dealt) > 1
    # Several automata scan rows numbered once, which are united by their number.
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id")).alias("key"), F.col(text).alias("text")) if many else docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = settle(rows, "contamination") if many else rows
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_words long, places array<int>, items array<string>, spans array<struct<start:int,end:int>>"

    def one(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton_of(sent)
            for batch in batches:
                texts = batch.column("text").to_pylist()
                out = [scan(t, automaton) for t in texts]
                spans = [[] if many else hit_spans(t, p) for t, (_, p, _) in zip(texts, out)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array([n for n, _, _ in out], pa.int64()), pa.array([p.astype(np.int32) for _, p, _ in out], pa.list_(pa.int32())), pa.array([sorted(i) for _, _, i in out], pa.list_(pa.string())), pa.array(spans, _SPANS)],
                    ["key", "n_words", "places", "items", "spans"],
                )

        return rows.mapInArrow(run, schema)

    found = one(dealt[0])
    if many:
        for sent in dealt[1:]:
            found = found.unionByName(one(sent))
        every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        united = settle(found.groupBy("key").agg(F.max("n_words").alias("n_words"), every("places"), every("items")), "places")

        def of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = [hit_spans(t, np.array(p)) for t, p in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(spans, _SPANS)], ["key", "n_words", "places", "items", "spans"])

        hit = united.where("size(places) > 0").join(rows, "key").select("key", "n_words", "places", "items", "text").mapInArrow(of_all, schema)
        clean = united.where("size(places) = 0").withColumn("spans", F.array().cast("array<struct<start:int,end:int>>"))
        found = hit.unionByName(clean).withColumn("key", F.col("key.id"))
    return found.select(F.col("key").alias(key), "n_words", F.size("places").cast("long").alias("n_hit"), "items", "spans")


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """docs without those that hold a window of an item; a pass for each automaton. All columns stay."""
    for sent in _dealt(docs.sparkSession, items, item):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = _automaton_of(sent)
            for batch in batches:
                clean = [not len(scan(t, automaton)[1]) for t in batch.column(text).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _dealt(spark: SparkSession, items: DataFrame, item: str) -> list:
    """Broadcast lists of (item id, text), one for each automaton."""
    found = items.select(F.col(item).cast("string").alias("item"), F.col(items_text(items)).alias("text")).where("text IS NOT NULL")
    # Windows overlap by all but a word: about ten times the text.
    volume = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-volume * WINDOW // AUTOMATON_BYTES))
    some = lambda part: found if parts == 1 else found.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
    return [spark.sparkContext.broadcast([(r.item, r.text) for r in some(part).collect()]) for part in range(parts)]


def items_text(items: DataFrame) -> str:
    return "text" if "text" in items.columns else next(f.name for f in items.schema if f.dataType.simpleString() == "string" and f.name != "item_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_CUT = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
# Spans are left out, as the SQL counts words alone.
SQL = f"""
WITH d AS (SELECT doc_id, {_CUT} AS w FROM documents),
b AS (SELECT item_id, {_CUT} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
runs AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, runs.k, item_id FROM runs JOIN win ON runs.x = win.x AND runs.k = win.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
