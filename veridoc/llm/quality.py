"""Quality classifier: a linear-chain conditional random field over lines (operator 10).

Every line of a document is good or bad. A line's potentials come from its own features (shares of kinds of
characters, length, word length, shape of the ends, repeated words) and those of its neighbours; one matrix weighs the step
from a line to the next. Lines of labelled documents take their document's label, and the field is trained by
maximum likelihood with Adam. Forward-backward gives each line's marginal of being good; their mean weighted by
line length, passed through a logistic fitted on the training documents, is the document's score.

The field is fitted on at most SAMPLE_DOCUMENTS labelled documents of at most SAMPLE_LINES lines, the first by
a hash of their ids; scoring covers every whole text. A score sees the text alone.

Defined results: null and empty texts have one line of length 0 and so the score of that line; without labels,
or with labels of one kind only, every score is 0.5; null ids pass through; repeated rows score alike; several
labels for one id count as the largest. Columns named score or predicted are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text_size, read_table

SAMPLE_DOCUMENTS = 2000
SAMPLE_LINES = 200
THRESHOLD = 0.3
CHARS_AT_ONCE = 1_000_000

# Kinds of bytes: lower, upper, digit, space, bar, marks, shout, stops, quotes and brackets, other, lead, follow.
_KINDS = 12
_KIND = np.full(256, 9, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[32] = 0, 1, 2, 3
for _bytes, _kind in ((b"|\t", 4), (b"#$%&*@^~=+<>_\\/", 5), (b"!?", 6), (b".,;:", 7), (b"'\"()[]{}", 8)):
    _KIND[list(_bytes)] = _kind
_KIND[128:192], _KIND[192:] = 11, 10
OWN = 2 * _KINDS + 10
_WORD_VALUE = np.random.default_rng(7).integers(1, 1 << 52, 256)
_WORD_VALUE[[10, 32]] = 0
FEATURES = 3 * OWN + 3


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length in bytes, number of lines of each text)."""
    raw = "\n".join(texts).encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw + b"\n", np.uint8)
    lines = np.array([t.count("\n") + 1 for t in texts])
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    size = ends - begins
    kind = _KIND[data]
    of_line = np.repeat(np.arange(len(ends)), size + 1)
    count = np.bincount(of_line * _KINDS + kind, minlength=len(ends) * _KINDS).reshape(-1, _KINDS).astype(np.float64)
    count[:, 9] -= 1  # the line's end
    n = np.maximum(size, 1)[:, None]
    share = count / n
    words = count[:, 3] + 1
    letters = count[:, 0] + count[:, 1] + count[:, 10]
    some = size > 0
    first, last = data[np.where(some, begins, ends)], data[np.where(some, ends - 1, ends)]
    own = np.concatenate(
        [
            share,
            np.minimum(count[:, :_KINDS] / words[:, None], 4.0) / 4.0,
            np.stack([~some, np.log1p(size) / 8.0, np.minimum(letters / words, 20) / 10.0, count[:, 1] / np.maximum(letters, 1), (last == 46) & some, ((first >= 65) & (first <= 90)), np.minimum(words, 8) / 8.0, size > 2000], axis=1),
        ],
        axis=1,
    )
    own = np.concatenate([own, _repeats(data, ends, words)], axis=1)
    stop = np.cumsum(lines)
    at_first, at_last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    at_first[stop - lines], at_last[stop - 1] = True, True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[at_first], after[at_last] = 0, 0
    return np.concatenate([own, before, after, np.ones((len(own), 1)), at_first[:, None], at_last[:, None]], axis=1), size, lines


def _repeats(data: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Shares of a line's words that equal the word before or the one two before (by a sum over their bytes)."""
    gaps = np.flatnonzero((data == 32) | (data == 10))
    begins = np.concatenate([[0], gaps[:-1] + 1])
    value = np.add.reduceat(_WORD_VALUE[data], begins)
    line = np.searchsorted(ends, begins)
    out = []
    for back in (1, 2):
        same = np.zeros(len(value))
        same[back:] = (value[back:] == value[:-back]) & (line[back:] == line[:-back]) & (value[back:] != 0)
        out.append(np.bincount(line, same, len(ends)) / words)
    return np.stack(out, axis=1)


def _message(ratio: np.ndarray, step: np.ndarray) -> np.ndarray:
    """log-odds carried over a step, given the log-odds of the state before; step[from, to]."""
    return np.logaddexp(ratio + step[1, 1], step[0, 1]) - np.logaddexp(ratio + step[1, 0], step[0, 0])


def marginals(potential: np.ndarray, lines: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-odds of good for each line, forward log-odds, messages from behind), by forward-backward over all
    documents at once, a line of each a round. potential: a line's own log-odds of good."""
    start = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    start, length = start[order], lines[order]
    live = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    forward, back = np.zeros(len(potential)), np.zeros(len(potential))
    for t, k in enumerate(live):
        at = start[:k] + t
        forward[at] = potential[at] + (_message(forward[at - 1], step) if t else 0.0)
    turned = step.T
    for t in range(len(live) - 2, -1, -1):
        at = start[: live[t + 1]] + t
        back[at] = _message(potential[at + 1] + back[at + 1], turned)
    return forward + back, forward, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class LineField:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    step: np.ndarray  # log-weights [from, to]
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, features: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals."""
        odds, _, _ = marginals(((features - self.mean) / self.scale) @ self.weights, lines, self.step)
        start = np.cumsum(lines) - lines
        weight = size + 1.0
        return np.add.reduceat(_sigmoid(odds) * weight, start) / np.add.reduceat(weight, start)

    def scores(self, texts: list[str]) -> np.ndarray:
        parts = []
        for run in by_text_size(texts, CHARS_AT_ONCE):
            raw = np.clip(self.raw(*line_features(texts[run.start : run.stop])), 1e-6, 1 - 1e-6)
            parts.append(_sigmoid(self.slope * np.log(raw / (1 - raw)) + self.offset))
        return np.concatenate(parts) if parts else np.empty(0)


def fit(features: np.ndarray, size: np.ndarray, lines: np.ndarray, good: np.ndarray, rounds: int = 100, decay: float = 1e-3) -> LineField:
    """Maximum likelihood of the lines' labels (their documents'), each document of weight 1."""
    mean, scale = features.mean(axis=0), features.std(axis=0)
    mean[-3], scale[-3] = 0.0, 1.0  # the constant
    scale = np.where(scale > 1e-6, scale, 1.0)
    x = (features - mean) / scale
    label = np.repeat(good, lines).astype(int)
    balance = np.where(good, 0.5 / max(good.mean(), 1e-9), 0.5 / max(1 - good.mean(), 1e-9))
    weight = np.repeat(balance / lines, lines) / len(lines)
    start = np.cumsum(lines) - lines
    inner = np.ones(len(label), bool)
    inner[start] = False  # lines with one before
    theta, step = np.zeros(x.shape[1]), np.zeros((2, 2))
    moments = [np.zeros(x.shape[1] + 4) for _ in range(2)]
    at = np.flatnonzero(inner)
    for k in range(1, rounds + 1):
        potential = x @ theta
        odds, forward, back = marginals(potential, lines, step)
        slope = weight * (label - _sigmoid(odds))
        grad = x.T @ slope - decay * theta
        # Expected steps from the joint marginals of neighbouring lines.
        joint = np.zeros((len(at), 2, 2))
        f, b = forward[at - 1], potential[at] + back[at]
        for i in range(2):
            for j in range(2):
                joint[:, i, j] = step[i, j] + i * f + j * b
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        seen = np.zeros((2, 2))
        for i in range(2):
            for j in range(2):
                seen[i, j] = (weight[at] * (((label[at - 1] == i) & (label[at] == j)) - joint[:, i, j])).sum()
        full = np.concatenate([grad, (seen - 10 * decay * step).reshape(-1)])
        moments[0] = 0.9 * moments[0] + 0.1 * full
        moments[1] = 0.99 * moments[1] + 0.01 * full**2
        move = 0.1 * (moments[0] / (1 - 0.9**k)) / (np.sqrt(moments[1] / (1 - 0.99**k)) + 1e-9)
        theta = theta + move[:-4]
        step = np.clip(step + move[-4:].reshape(2, 2), -2.0, 2.0)
    field = LineField(mean, scale, theta, step)
    raw = np.clip(field.raw(features, size, lines), 1e-6, 1 - 1e-6)
    slope, offset = _logistic(np.log(raw / (1 - raw)), good)
    return LineField(mean, scale, theta, step, slope, offset)


def _logistic(x: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset of a logistic of one variable, by Newton's method with a small penalty."""
    x = np.stack([x, np.ones(len(x))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(x @ w)
        grad = x.T @ (good - p) - 0.1 * (w - [1.0, 0.0])
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), grad)
    return max(float(w[0]), 0.05), float(w[1])


def held_out(key: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> LineField | None:
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).alias("__good"))
    sample = known.orderBy(F.xxhash64(key), key).limit(SAMPLE_DOCUMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Lines are counted here, behind the join, and so only in texts of the sample.
            texts = [t or "" for t in batch.column(text).to_pylist()]
            short = [t.count("\n") < SAMPLE_LINES for t in texts]
            texts, good = [t for t, s in zip(texts, short) if s], batch.column("__good").filter(pa.array(short, pa.bool_()))
            if texts:
                features, size, lines = line_features(texts)
                stop = np.cumsum(lines)
                rows = [(features[b - n : b].astype(np.float32).tobytes(), size[b - n : b].astype(np.int64).tobytes()) for b, n in zip(stop, lines)]
                yield pa.RecordBatch.from_arrays([good, pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["good", "features", "size"])

    # The sample has a fixed bound, and so may be broadcast and its features collected.
    # Of repeated ids the least text counts, so that repeats don't pass the bound.
    chosen = F.broadcast(sample).join(docs.select(key, text), key).groupBy(key, "__good").agg(F.min(text).alias(text))
    rows = chosen.orderBy(key).select("__good", text).mapInArrow(run, "good int, features binary, size binary").collect()
    good = np.array([r.good > 0 for r in rows])
    if not len(rows) or good.all() or not good.any():
        return None
    features = np.concatenate([np.frombuffer(r.features, np.float32).reshape(-1, FEATURES) for r in rows]).astype(np.float64)
    sizes = [np.frombuffer(r.size, np.int64) for r in rows]
    return fit(features, np.concatenate(sizes), np.array([len(s) for s in sizes]), good)


def with_scores(docs: DataFrame, field: LineField | None, text: str = "text", score_name: str = "score", predicted_name: str = "predicted") -> DataFrame:
    """docs with score and predicted, which take the place of columns of these names."""
    docs = docs.drop(score_name, predicted_name)
    schema = docs.withColumns({score_name: F.lit(0.0), predicted_name: F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            score = field.scores(texts) if field else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], schema.names)

    return docs.mapInArrow(run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    field = train(docs, read_table(spark, sf_dir, "labels"))
    return with_scores(docs, field).select("doc_id", held_out().alias("held_out"), "score", "predicted")
