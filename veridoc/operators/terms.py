"""Tokens, term counts and TF-IDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import settle

MOST_BROADCAST = 1_000_000  # terms, of at most 255 letters and a number


def tokenized(docs: DataFrame, stopwords: Sequence[str] = T.STOPWORDS) -> DataFrame:
    """(doc_id, tokens)."""
    return docs.select("doc_id", T.tokens(F.col("text"), stopwords).alias("tokens"))


def counted(tokens: DataFrame) -> DataFrame:
    """(doc_id, size, terms array<struct<term,cnt>>): size is the document's number of tokens. A document's tokens are
    sorted and counted in its row, so nothing is shuffled. Generators keep the steps apart, each computed once."""
    once = lambda df, name, value: df.select("*", F.explode(F.array(value)).alias(name))
    held = once(tokens.select("doc_id", F.size("tokens").alias("size"), "tokens"), "s", F.sort_array("tokens")).drop("tokens")
    first = F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    held = once(held, "starts", F.when(F.col("size") > 0, first).otherwise(F.array().cast("array<int>")))
    run = lambda a, k: F.struct(F.get("s", a).alias("term"), (F.coalesce(F.get("starts", k + 1), F.col("size")) - a).cast("long").alias("cnt"))
    return held.select("doc_id", "size", F.transform("starts", run).alias("terms"))


def _each(held: DataFrame) -> DataFrame:
    return held.select("doc_id", "size", F.explode("terms").alias("t")).select("doc_id", "size", "t.term", "t.cnt")


def term_counts(tokens: DataFrame) -> DataFrame:
    """(doc_id, size, term, cnt)."""
    return _each(counted(tokens))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tfidf_weights(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, tfidf). Counts are written once; only terms with their frequencies are shuffled. These are broadcast up to MOST_BROADCAST terms; beyond, both
    sides of the join are plain tables, so that adaptive execution splits terms that most documents hold."""
    held = settle(counted(tokens), "terms")
    return _weighted(held, _idf(held.select(F.explode("terms.term").alias("term")), held.count()))


def _idf(held: DataFrame, total: int) -> DataFrame:
    """(term, idf) of the terms (term) of all documents, each once a document."""
    idf = document_frequency(held).select("term", (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    idf = settle(idf, "idf")
    return F.broadcast(idf) if idf.count() <= MOST_BROADCAST else idf


def _weighted(held: DataFrame, idf: DataFrame) -> DataFrame:
    return _each(held).join(idf, "term").select("doc_id", "term", (F.col("cnt") / F.col("size") * F.col("idf")).alias("tfidf"))


def tfidf_lists(inside: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, terms, weights) of the documents inside, with the frequencies of all tokens."""
    idf = _idf(tokens.select(F.explode(F.array_distinct("tokens")).alias("term")), tokens.count())
    held = _weighted(counted(inside), idf).groupBy("doc_id").agg(F.collect_list(F.struct("term", "tfidf")).alias("t"))
    return held.select("doc_id", F.col("t.term").alias("terms"), F.col("t.tfidf").alias("weights"))


def tfidf_norms(weights: DataFrame) -> DataFrame:
    return weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("norm"))


def tfidf_lookup(tokens: DataFrame, weights: DataFrame, term: str) -> DataFrame:
    """The weight of one term in every document, 0 where it doesn't occur."""
    held = weights.where(F.col("term") == term).select("doc_id", "tfidf")
    return tokens.select("doc_id").join(held, "doc_id", "left").select("doc_id", F.lit(term).alias("term"), F.coalesce("tfidf", F.lit(0.0)).alias("tfidf"))


def token_totals(tokens: DataFrame) -> DataFrame:
    """(documents, tokens, vocabulary)."""
    sums = tokens.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("tokens"))
    return sums.crossJoin(tokens.select(F.explode("tokens").alias("t")).distinct().agg(F.count(F.lit(1)).alias("vocabulary")))
