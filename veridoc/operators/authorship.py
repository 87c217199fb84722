"""An n-gram language model, perplexity, and the score made of it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed value: the text that the model is trained on without a corpus.
FALLBACK = "the quick brown fox jumps over the lazy dog. clear writing uses varied words and natural sentence rhythm. human essays often mix short sentences with longer reflective passages."
EMPTY_PERPLEXITY, SHORT_PERPLEXITY = 1000.0, 500.0
MOST_SENT = 200_000  # n-grams, and contexts, of a model that is sent to all workers
TOKENS_AT_ONCE = 500_000


@dataclass(frozen=True)
class Model:
    """Counts of n-grams and of their contexts (gram, cnt), and the vocabulary's size."""

    order: int
    ngrams: DataFrame
    contexts: DataFrame
    vocabulary: DataFrame  # (word, cnt)

    def size(self) -> DataFrame:
        return self.vocabulary.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("size"))


def train(spark: SparkSession, corpus: DataFrame | None = None, order: int = 3, stopwords: Sequence[str] = T.STOPWORDS) -> Model:
    """corpus: (text), one text a row; None trains on FALLBACK. Contexts are counted where an n-gram starts."""
    order = max(2, order)
    source = spark.createDataFrame([(FALLBACK,)], "text string") if corpus is None else corpus
    tokens = source.select(T.tokens(F.col("text"), stopwords).alias("tokens"))
    starts = tokens.select(F.explode(T.windows(F.col("tokens"), order)).alias("gram"))
    count = lambda df: df.groupBy("gram").agg(F.count(F.lit(1)).alias("cnt"))
    words = tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    return Model(order, count(starts), count(starts.select(F.slice("gram", 1, order - 1).alias("gram"))), words)


class Sent:
    """A model's counts as sorted numbers, to look up n-grams of whole columns of tokens. A run of words is numbered by
    the number of the run without its last word, and that word."""

    def __init__(self, order: int, ngrams: list[tuple[list[str], int]], contexts: list[tuple[list[str], int]], size: int):
        self.order, self.size = order, size
        self.words = pa.array(sorted({w for gram, _ in ngrams for w in gram}), pa.string())
        number = {w: i for i, w in enumerate(self.words.to_pylist())}
        grams = np.array([[number[w] for w in gram] for gram, _ in ngrams], np.int64).reshape(-1, order)
        self.levels, run = [], grams[:, 0] if len(grams) else np.empty(0, np.int64)
        for i in range(1, order):
            code = run * len(self.words) + grams[:, i]
            self.levels.append(np.unique(code))
            run = np.searchsorted(self.levels[-1], code)
        self.grams = np.zeros(max(len(grams), 1))
        self.grams[run] = [cnt for _, cnt in ngrams]
        starts = np.array([[number[w] for w in gram] for gram, _ in contexts], np.int64).reshape(-1, order - 1)
        self.contexts = np.zeros(max(len(self.levels[-2]) if order > 2 else len(self.words), 1))
        self.contexts[self._runs(starts.T)] = [cnt for _, cnt in contexts]

    def _runs(self, places) -> np.ndarray:
        run = places[0]
        for i, place in enumerate(places[1:]):
            run = self._next(i, run, place)
        return run

    def _next(self, level: int, run: np.ndarray, word: np.ndarray) -> np.ndarray:
        """-1 where there is no such run."""
        known = self.levels[level]
        if not len(known):
            return np.full(len(run), -1, np.int64)
        code = run * len(self.words) + word
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        return np.where((run >= 0) & (word >= 0) & (known[at] == code), at, -1)

    def log_chances(self, tokens: pa.Array) -> np.ndarray:
        """The negative logarithm of the chance of each run of neighbours in one column, whichever texts they are of."""
        number = pc.fill_null(pc.index_in(tokens, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        count = len(number) - self.order + 1
        if count <= 0:
            return np.empty(0)
        places = [number[i : i + count] for i in range(self.order)]
        context = self._runs(places[:-1])
        gram = self._next(self.order - 2, context, places[-1])
        seen = np.where(gram >= 0, self.grams[gram], 0.0)
        started = np.where(context >= 0, self.contexts[context], 0.0)
        return -np.log((seen + 1.0) / (started + self.size))

    def perplexities(self, chances: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of texts of so many tokens that start there."""
        out = np.full(len(sizes), EMPTY_PERPLEXITY)
        short = (sizes > 0) & (sizes < self.order)
        out[short] = SHORT_PERPLEXITY / sizes[short]
        long = sizes >= self.order
        if long.any():
            count = sizes[long] - self.order + 1
            each = np.repeat(starts[long] - np.cumsum(count) + count, count) + np.arange(count.sum())
            sums = np.bincount(np.repeat(np.arange(len(count)), count), chances[each])  # one after the other, as SQL adds them
            out[long] = np.exp(sums / count)
        return out


def _sent(model: Model) -> Sent | None:
    """None if the model is too large to be sent."""
    tables = [df.select("gram", "cnt").limit(MOST_SENT + 1).collect() for df in (model.ngrams, model.contexts)]
    if any(len(rows) > MOST_SENT for rows in tables):
        return None
    ngrams, contexts = ([(list(r.gram), r.cnt) for r in rows] for rows in tables)
    return Sent(model.order, ngrams, contexts, model.size().first()[0])


def _cut(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about TOKENS_AT_ONCE tokens."""
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOKENS_AT_ONCE, side="right")))
        yield start, stop
        start = stop


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def perplexity(rows: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """(keys, perplexity) of rows of (keys, tokens). The model is sent to the rows, so that nothing of them is shuffled;
    one of more than MOST_SENT n-grams is joined."""
    sent = _sent(model)
    if sent is None:
        return _joined_perplexity(rows, keys, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _cut(_sizes(batch.column("tokens"))):
                part = batch.slice(start, stop - start)
                sizes = _sizes(part.column("tokens"))
                found = sent.perplexities(sent.log_chances(part.column("tokens").flatten()), np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(found)], [*keys, "perplexity"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "tokens").mapInArrow(run, f"{kinds}, perplexity double")


def _joined_perplexity(rows: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """As perplexity. Each row's logarithms are summed under its keys, and its tokens are not joined again."""
    width, size = model.order, F.size("tokens")
    # A row of fewer tokens has one n-gram that is none.
    grams = rows.select(*keys, size.alias("count"), F.explode(F.when(size >= width, T.windows(F.col("tokens"), width)).otherwise(F.array(F.array().cast("array<string>")))).alias("gram"))
    looked = grams.join(model.ngrams.withColumnRenamed("cnt", "n"), "gram", "left")
    contexts = model.contexts.select(F.col("gram").alias("context"), F.col("cnt").alias("c"))
    looked = looked.withColumn("context", F.slice("gram", 1, width - 1)).join(contexts, "context", "left").crossJoin(F.broadcast(model.size().withColumnRenamed("size", "words")))
    chance = (F.coalesce("n", F.lit(0)) + 1.0) / (F.coalesce("c", F.lit(0)) + F.col("words"))
    scored = looked.groupBy(*keys, "count").agg(F.exp(F.avg(-F.log(chance))).alias("seen"))
    return scored.select(*keys, F.when(F.col("count") == 0, EMPTY_PERPLEXITY).when(F.col("count") < width, SHORT_PERPLEXITY / F.col("count")).otherwise(F.col("seen")).alias("perplexity"))


def pieces(docs: DataFrame, stopwords: Sequence[str] = T.STOPWORDS) -> DataFrame:
    """(doc_id, pieces): the tokens of each piece between marks. No token goes over a mark, so that together they are
    the document's tokens."""
    return docs.select("doc_id", F.transform(T.sentences(F.col("text")), lambda piece: T.tokens(piece, stopwords)).alias("pieces"))


def sentence_tokens(docs: DataFrame, stopwords: Sequence[str] = T.STOPWORDS) -> DataFrame:
    """(doc_id, sentence, tokens) of sentences with tokens."""
    each = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence", "piece"))
    return each.select("doc_id", "sentence", T.tokens(F.col("piece"), stopwords).alias("tokens")).where(F.size("tokens") > 0)


def sentence_variance(documents: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, variance): mean square of the sentences' distance from the document's own perplexity; 0 for
    fewer than two sentences."""
    each = sentences.select("doc_id", F.col("perplexity").alias("p")).join(documents.select("doc_id", "perplexity"), "doc_id")
    spread = each.groupBy("doc_id").agg(F.when(F.count(F.lit(1)) > 1, F.avg(F.pow(F.col("p") - F.col("perplexity"), 2))).otherwise(0.0).alias("variance"))
    return documents.select("doc_id").join(spread, "doc_id", "left").select("doc_id", F.coalesce("variance", F.lit(0.0)).alias("variance"))


def _both(docs: DataFrame, model: Model, stopwords: Sequence[str]) -> DataFrame:
    """(doc_id, perplexity, variance), both of one reading of the text, in its row."""
    sent = _sent(model)
    cut = pieces(docs, stopwords)
    if sent is None:
        whole = _joined_perplexity(cut.select("doc_id", F.flatten("pieces").alias("tokens")), ["doc_id"], model)
        parts = cut.select("doc_id", F.posexplode("pieces").alias("sentence", "tokens")).where(F.size("tokens") > 0)
        return whole.join(sentence_variance(whole, _joined_perplexity(parts, ["doc_id", "sentence"], model)), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _cut(_sizes(batch.column("pieces")) + _tokens_of(batch.column("pieces"))):
                yield _scored(sent, batch.slice(start, stop - start))

    return cut.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, perplexity double, variance double")


def _tokens_of(lists: pa.ListArray) -> np.ndarray:
    """The number of tokens of each row of lists of lists."""
    sums = np.append(0, np.cumsum(_sizes(lists.flatten())))
    ends = np.cumsum(_sizes(lists))
    return sums[ends] - sums[ends - _sizes(lists)]


def _scored(sent: Sent, batch: pa.RecordBatch) -> pa.RecordBatch:
    inside = batch.column("pieces").flatten()
    sizes, totals = _sizes(inside), _tokens_of(batch.column("pieces"))
    chances = sent.log_chances(inside.flatten())
    whole = sent.perplexities(chances, np.cumsum(totals) - totals, totals)
    row = np.repeat(np.arange(batch.num_rows), _sizes(batch.column("pieces")))
    held = sizes > 0
    row, starts, sizes = row[held], (np.cumsum(sizes) - sizes)[held], sizes[held]
    distance = (sent.perplexities(chances, starts, sizes) - whole[row]) ** 2
    number = np.bincount(row, minlength=batch.num_rows)
    variance = np.where(number > 1, np.bincount(row, distance, batch.num_rows) / np.maximum(number, 1), 0.0)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(whole), pa.array(variance)], ["doc_id", "perplexity", "variance"])


def authorship_scores(docs: DataFrame, tokens: DataFrame, model: Model, threshold: float = 50.0, stopwords: Sequence[str] = T.STOPWORDS) -> DataFrame:
    """(doc_id, mean_perplexity, perplexity_variance, ai_score, flagged). The document's tokens are those of its
    sentences, so tokens is not read."""
    both = _both(docs, model, stopwords)
    score = T.clamp(100.0 / (1.0 + F.col("perplexity") / 75.0) * (1.0 / (1.0 + F.sqrt("variance") / 100.0)))
    return both.select("doc_id", F.col("perplexity").alias("mean_perplexity"), F.col("variance").alias("perplexity_variance"), score.alias("ai_score"), (score >= threshold).alias("flagged"))
