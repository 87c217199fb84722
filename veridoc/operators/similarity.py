"""Pair scores: sparse cosine, fingerprint overlap, and what is made of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import WINDOW
from ..functions.text import severity
from ..scratch import settle
from . import blocks
from .candidates import band_lists, classes, expanded, fingerprints, own_pairs, spots
from .candidates import blocks as in_blocks
from .terms import MOST_BROADCAST, tfidf_lists

COSINE_SHARE, OVERLAP_SHARE = 0.6, 0.4
BYTES = 24  # of a token in a block, as a term with its weight and a fingerprint


PARTS = ("cosine", "rabin_karp")


def _vectors(spots: DataFrame, tokens: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """spots with terms and weights, and with fingerprints, which are made once for each of their documents."""
    only = settle(spots.select("doc_id").distinct(), "only")
    if only.count() <= MOST_BROADCAST:
        only = F.broadcast(only)
    inside = settle(tokens.select("doc_id", "tokens").join(only, "doc_id", "left_semi"), "inside")
    if "cosine" in parts:
        none = lambda name, kind: F.coalesce(name, F.array().cast(f"array<{kind}>")).alias(name)
        spots = spots.join(tfidf_lists(inside, tokens), "doc_id", "left").select(*spots.columns, none("terms", "string"), none("weights", "double"))
    return spots.join(fingerprints(inside), "doc_id") if "rabin_karp" in parts else spots


def _cosines(table: pa.Table, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    term, row = blocks.lists(table.column("terms"))
    weight = blocks.lists(table.column("weights"))[0].to_numpy()
    norm = np.sqrt(np.bincount(row, weight * weight, table.num_rows))
    dot = blocks.products(term.dictionary_encode().indices.to_numpy(), row, weight, table.num_rows, x, y)
    scale = norm[x] * norm[y]
    return np.divide(dot, scale, out=np.zeros(len(x)), where=scale > 0)


def _overlaps(table: pa.Table, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    mark, row = blocks.lists(table.column("fingerprints"))
    number = np.bincount(row, minlength=table.num_rows)
    common = blocks.products(mark.to_numpy(), row, np.ones(len(row)), table.num_rows, x, y)
    union = number[x] + number[y] - common
    return np.divide(common, union, out=np.zeros(len(x)), where=union > 0)


def _scored(spots: DataFrame, tokens: DataFrame, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """(left, right, first_band, first_key, parts) of the pairs of blocks."""
    kind = spots.schema["doc_id"].dataType.simpleString()

    def scores(name, table):
        x, y = blocks.pairs_of(name, table)
        if not len(x):
            return None
        ids = table.column("doc_id").combine_chunks()
        first = [pa.array(np.full(len(x), value, np.int64)) for value in name[:2]]
        found = [pa.array((_cosines if part == "cosine" else _overlaps)(table, x, y)) for part in parts]
        return pa.table([ids.take(pa.array(x)), ids.take(pa.array(y)), *first, *found], ["left", "right", "first_band", "first_key", *parts])

    return blocks.over_blocks(_vectors(spots, tokens, parts), scores, f"left {kind}, right {kind}, first_band bigint, first_key bigint, " + ", ".join(f"{part} double" for part in parts))


def _combined(scores: DataFrame) -> DataFrame:
    return scores.withColumn("combined", COSINE_SHARE * F.col("cosine") + OVERLAP_SHARE * F.col("rabin_karp"))


@dataclass(frozen=True)
class Candidates:
    """Documents with the same tokens as one class: classes, their rows in blocks, members of classes of several."""

    found: DataFrame
    spots: DataFrame
    members: DataFrame


@dataclass(frozen=True)
class ClassScores:
    """Scores of pairs of classes (left, right, first_band, first_key, and the scores), and the classes' members."""

    scores: DataFrame
    members: DataFrame

    def pairs(self, threshold: float | None = None) -> DataFrame:
        """(a, b, first_band, first_key, and the scores) of documents, from a threshold on."""
        return expanded(self.scores if threshold is None else flagged(self.scores, threshold), self.members)


def candidates_of(tokens: DataFrame, banding: tuple[int, int] = (20, 5)) -> Candidates:
    """tokens is read several times, and so should be settled or cached."""
    marked = tokens.select("doc_id", "tokens", F.unhex(F.sha2(F.array_join("tokens", " "), 256)).alias("digest"), (F.size("tokens") * BYTES).alias("bytes"))
    found, members = classes(settle(band_lists(marked, banding, ("digest", "bytes")), "bands"), "digest")
    return Candidates(found, settle(spots(in_blocks(found)), "spots"), members)


def candidate_scores(met: Candidates, tokens: DataFrame, parts: tuple[str, ...] = PARTS) -> ClassScores:
    """The scores of all candidate pairs, made in the blocks in which they meet, so that neither terms nor texts are
    repeated for each pair. Of equal documents both are 1, if there are tokens enough."""
    least = {"cosine": 1, "rabin_karp": WINDOW}
    own = own_pairs(met.found, *(F.when(F.col("bytes") >= least[part] * BYTES, 1.0).otherwise(0.0).alias(part) for part in parts))
    scores = settle(_scored(met.spots, tokens, parts).withColumn("first_band", F.col("first_band").cast("int")).unionByName(own), "scores")
    return ClassScores(_combined(scores) if parts == PARTS else scores, met.members)


def pair_scores(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(a, b, cosine, rabin_karp, combined) of pairs (a, b) given by hand; each is a block. Pairs without a term in
    common score 0."""
    pairs = settle(pairs.select("a", "b").distinct(), "by-hand")
    one = lambda side, chunk: pairs.select(F.col(side).alias("doc_id"), F.col("a").cast("long").alias("band"), F.col("b").cast("long").alias("key"), F.lit(chunk).alias("chunk"), F.lit(0).alias("i"), F.lit(1).alias("j"))
    scores = _combined(_scored(one("a", 0).unionByName(one("b", 1)), tokens))
    return scores.select(F.col("left").alias("a"), F.col("right").alias("b"), "cosine", "rabin_karp", "combined")


def flagged(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.where(F.col("combined") >= threshold)


def with_severity(scores: DataFrame) -> DataFrame:
    return scores.withColumn("severity", severity(F.col("combined")))


def similarity_long(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """(row, col, score): the cells that aren't 0 by rule, both ways, and the diagonal."""
    one = scores.select(F.col("a").alias("row"), F.col("b").alias("col"), F.col("combined").alias("score"))
    two = scores.select(F.col("b").alias("row"), F.col("a").alias("col"), F.col("combined").alias("score"))
    same = docs.select(F.col("doc_id").alias("row"), F.col("doc_id").alias("col"), F.lit(1.0).alias("score"))
    return one.unionByName(two).unionByName(same)


def matrix_block(long: DataFrame, docs: DataFrame, start: int, size: int = 20) -> DataFrame:
    """(row, col, score) of a block on the diagonal, zeros included: what one page of the heat map shows."""
    inside = docs.select("doc_id").where(F.col("doc_id").between(start, start + size - 1))
    grid = inside.select(F.col("doc_id").alias("row")).crossJoin(inside.select(F.col("doc_id").alias("col")))  # size squared cells
    long = long.where(F.col("row").between(start, start + size - 1) & F.col("col").between(start, start + size - 1))
    return grid.join(long, ["row", "col"], "left").select("row", "col", F.coalesce("score", F.lit(0.0)).alias("score"))
