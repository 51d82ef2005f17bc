"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import bounded_batches, held_out, stored

# The classifier is fitted on at most this many labelled documents of each class.
SAMPLE_PER_CLASS = 2_000
GRAMS = (3, 4, 5)
# Hashed features: 2 ** BITS.
BITS = 18
SMOOTHING = 0.1
# Only features that speak for toxicity count: their log-count ratio is at least this, and so many
# documents of the sample have them.  What harmless words stand around an insult must not outweigh
# it, and what a few clean documents happen to share is no evidence for others.
LEAST_RATIO = 0.7
LEAST_DOCUMENTS = 3
STEPS = 100
PENALTY = 1e-5

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CHARS = 1 << 17  # characters of a text hashed at once


def _windows(text: str, grams: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams of a lower-cased text, a stretch of it at a time."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    longest = max(grams)
    for at in range(0, max(1, len(code)), _CHARS):
        part = code[at : at + _CHARS + longest - 1].astype(np.uint64)
        starts = min(_CHARS, len(code) - at)
        rolled = part
        for n in range(1, longest + 1):
            if n > 1:
                if len(part) < n:
                    break
                rolled = rolled[:-1] * _MULTIPLIER + part[n - 1 :]
            if n in grams:
                mixed = (rolled[:starts] + np.uint64(n)) * _MULTIPLIER
                mixed ^= mixed >> np.uint64(32)
                yield ((mixed * _MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64)


def _features(
    text: str | None, grams: tuple[int, ...], bits: int, active: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a text, ascending, with the square root of the share of its n-grams each has.

    The roots have a square sum of one, so long and short texts weigh alike, and a rare n-gram
    is not drowned by frequent ones.  With ``active`` only the features marked there are given.
    """
    total, kept = 0, [np.zeros(0, np.int64)]
    for stretch in _windows(text or "", grams, bits):
        total += len(stretch)
        kept.append(stretch if active is None else stretch[active[stretch]])
    index, count = np.unique(np.concatenate(kept), return_counts=True)
    return index, np.sqrt(count / max(total, 1)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Weights per feature, with the log-count ratio multiplied in, and a bias."""

    weights: np.ndarray
    bias: float
    grams: tuple[int, ...] = GRAMS
    bits: int = BITS

    @property
    def is_constant(self) -> bool:
        """Whether it tells no two texts apart."""
        return not self.weights.any()

    def scores(self, texts: list[str | None]) -> list[float]:
        active, out = self.weights != 0, []
        for text in texts:
            index, value = _features(text, self.grams, self.bits, active)
            margin = self.bias + float(np.dot(self.weights[index].astype(np.float64), value))
            out.append(float(1 / (1 + np.exp(-np.clip(margin, -60, 60)))))
        return out


def _constant(share: float) -> Model:
    """For labels of one class only, or none."""
    return Model(np.zeros(1 << BITS, np.float32), 60.0 if share > 0.5 else -60.0)


def _ratios(p: np.ndarray, q: np.ndarray, held: np.ndarray, toxic: int) -> np.ndarray:
    """Log-count ratios per feature; 0 for features that are left out.

    ``p`` and ``q`` are the features' sums over toxic and over clean documents, ``held`` how many
    documents have them.
    """
    unit = SMOOTHING / len(p)
    ratio = np.log((p / max(p.sum(), 1e-12) + unit) / (q / max(q.sum(), 1e-12) + unit))
    ratio[(ratio < LEAST_RATIO) | (held < min(LEAST_DOCUMENTS, toxic))] = 0.0
    return ratio


def _train(rows: np.ndarray, index: np.ndarray, value: np.ndarray, toxic: np.ndarray, ratio: np.ndarray) -> Model:
    """Logistic regression on (row, index, value) triples, each value scaled by its feature's ratio."""
    size = len(ratio)
    # features of equal scale: the mean square over rows is one
    x = value * ratio[index]
    scale = 1 / max(float(np.sqrt(np.bincount(rows, x * x, len(toxic)).mean())), 1e-12)
    x = x * scale
    weights, bias = np.zeros(size), 0.0
    sign = np.where(toxic > 0, 1.0, -1.0)
    share = np.where(toxic > 0, 0.5 / (toxic > 0).sum(), 0.5 / (toxic <= 0).sum())  # both classes weigh alike
    speed, memory = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):  # Adam over all rows
        margin = np.bincount(rows, x * weights[index], len(toxic)) + bias
        pull = -sign / (1 + np.exp(np.clip(sign * margin, -60, 60))) * share
        slope = np.append(np.bincount(index, x * pull[rows], size) + PENALTY * weights, pull.sum())
        speed = 0.9 * speed + 0.1 * slope
        memory = 0.99 * memory + 0.01 * slope * slope
        move = 0.1 * (speed / (1 - 0.9**step)) / (np.sqrt(memory / (1 - 0.99**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Model((weights * ratio * scale).astype(np.float32), float(bias))


def _sums(sample: DataFrame) -> DataFrame:
    """``feature`` with its sums ``p`` over toxic and ``q`` over clean texts, and texts that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS))
        held = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                index, value = _features(text.as_py(), GRAMS, BITS)
                sums[toxic, index] += value
                held[index] += 1
        found = np.flatnonzero(held)
        columns = [found, sums[1, found], sums[0, found], held[found]]
        yield pa.record_batch([pa.array(c) for c in columns], names=["feature", "p", "q", "held"])

    summed = sample.mapInArrow(run, "feature bigint, p double, q double, held bigint")
    return summed.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum("held").alias("held"))


def fit(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    sample_per_class: int = SAMPLE_PER_CLASS,
) -> Model:
    """A model of the labelled documents that are not held out.

    Of each class it sees the ``sample_per_class`` documents whose ids have the lowest hashes.
    Features are summed where the texts are; what reaches the driver are at most ``2 ** BITS``
    sums, and of the sample's texts the features that are kept.  An id with several labels has
    the highest; rows with a NULL id or label are left out.  With one class only, none, or no
    feature that tells them apart, the model is constant.
    """
    bounded_batches(documents.sparkSession)
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & ~held_out(F.col(id_column)))
    known = known.groupBy(F.col(id_column).alias("id")).agg((F.max(label_column) > 0).cast("int").alias("toxic"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = [known.where(F.col("toxic") == c).orderBy(*order).limit(sample_per_class) for c in (0, 1)]
    wanted = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * sample_per_class rows of two numbers
    read = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # one text per id, so that a repeated id doesn't grow the sample
    sample = read.join(wanted, "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    sample = stored(sample.select("toxic", "text"), "toxicity-sample")
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if positive in (0, n):
        return _constant(positive / n if n else 0.0)
    p, q, held = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    summed = _sums(sample).toArrow()
    at = summed.column("feature").to_numpy()
    for column, name in ((p, "p"), (q, "q"), (held, "held")):
        column[at] = summed.column(name).to_numpy()
    del summed
    ratio = _ratios(p, q, held, positive)
    if not ratio.any():
        return _constant(positive / n)
    active = ratio != 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_features(t.as_py(), GRAMS, BITS, active) for t in batch.column(1)]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()),
                    pa.array([v.tobytes() for _, v in found], pa.binary()),
                ],
                names=["toxic", "index", "value"],
            )

    read = sample.mapInArrow(run, "toxic int, index binary, value binary").toArrow()
    index = [np.frombuffer(b, "<i4") for b in read.column("index").to_pylist()]
    value = [np.frombuffer(b, "<f4") for b in read.column("value").to_pylist()]
    rows = np.repeat(np.arange(len(index), dtype=np.int32), [len(i) for i in index])
    return _train(rows, np.concatenate(index), np.concatenate(value), read.column("toxic").to_numpy(), ratio)


def score(documents: DataFrame, model: Model, text_column: str = "text", to: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1 of their whole text, higher where toxicity is likelier.

    NULL and empty texts are scored like texts without any feature.  Nothing is shuffled; the
    model (``2 ** BITS`` weights) is a broadcast variable.
    """
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts.to_pylist()), pa.float64())

    return documents.withColumn(to, run(F.col(text_column)))
