"""Quality by ordinal cumulative-link regression: one set of hashed-text weights, ordered thresholds between grades.

P(grade > j) = sigmoid(w . x - t_j) with t_0 < t_1 < ...; x are hashed counts of a text's lower-cased words, of its words'
shapes and of repeated words, scaled to shares of the text, so that a text's length doesn't count. The expected grade is
the sum of the tail probabilities; the probability of the highest grade selects documents.

Grades are ratings 0, 1, 2, ...; `grades` makes them of the labels: 0 for low quality, 1 for toxic text of good quality,
2 for good text that isn't toxic. Weights are fitted by gradient steps (Adam) in one task, on at most SAMPLE labelled documents, the
smallest by a hash of their id; all of a text counts, in fitting as in scoring, a long one piece by piece.

Defined results: a null or empty text has no features and is graded by the thresholds alone; a null label or doc_id is
not learned from; of labels that repeat for a doc_id the lowest grade counts; repeated rows are scored alike; without any
label every tail probability is one half; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, bounded_batches, materialize, mix, pieces, scratch, share, sliced, small, words

SAMPLE = 6_000
BITS = 17
#: Features of fewer sample documents keep weight 0.
LEAST_DOCS = 4
#: A document is selected from so high a probability of the highest grade.
SELECT = 0.5
_PLACES = np.arange(256)
#: For shapes: 1 lower, 2 upper, 4 digit, 8 mark, 16 other byte, 0 white space.
_KIND = np.select(
    [(_PLACES >= 97) & (_PLACES <= 122), (_PLACES >= 65) & (_PLACES <= 90), (_PLACES >= 48) & (_PLACES <= 57), _PLACES < 128],
    [1, 2, 4, 8], 16
).astype(np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0


def _blocks(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts with their numbers, about PIECE bytes at once; longer texts in pieces."""
    numbers, block, size = [], [], 0
    for i, text in enumerate(texts):
        for part in pieces(text):
            numbers.append(i)
            block.append(part)
            size += len(part)
            if size >= PIECE:
                yield numbers, block
                numbers, block, size = [], [], 0
    if block:
        yield numbers, block


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text's number, slot and value of every text's features, ascending; the occurrences of a slot in a text are added up."""
    keys, shares, flats, counts = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)], np.zeros(len(texts))
    mask, last = np.uint64((1 << BITS) - 1), (-1, np.uint64(0))
    for numbers, block in _blocks(texts):
        hashes, doc, starts, ends = words(block, bare=True)
        if not len(hashes):
            continue
        doc = np.array(numbers)[doc]
        counts += np.bincount(doc, minlength=len(texts))
        buf = np.frombuffer(b" ".join(block) + b" ", np.uint8)
        kinds = np.bitwise_or.reduceat(_KIND[buf], starts)
        marks = np.cumsum(_KIND[buf] == 8)
        tail = marks[ends - 1] - marks[starts] + (_KIND[buf[starts]] == 8)
        shape = mix(
            kinds.astype(np.uint64) * np.uint64(64) + np.minimum(tail, 7).astype(np.uint64) * np.uint64(8) + np.minimum(
                (ends - starts) // 4, 7
            ).astype(np.uint64)
        )
        again = np.zeros(len(hashes), np.uint64)
        again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        again[0] = last == (doc[0], hashes[0])
        last = (doc[-1], hashes[-1])
        slots = np.concatenate([hashes & mask, shape & mask, mix(again + np.uint64(99)) & mask]).astype(np.int64)
        key, which = np.unique(np.concatenate([doc, doc, doc]) << BITS | slots, return_inverse=True)
        keys.append(key)
        shares.append(np.bincount(which[: len(hashes)], minlength=len(key)).astype(float))
        flats.append(4.0 * np.bincount(which[len(hashes) :], minlength=len(key)))
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    doc = key >> BITS
    # a rare word still counts in a long text; shapes and repeats are shares of the text
    values = np.bincount(
        which, np.concatenate(shares), len(key)
    ) / np.sqrt(counts[doc]) + np.bincount(which, np.concatenate(flats), len(key)) / counts[doc]
    return doc, key & (1 << BITS) - 1, values.astype(np.float32)


@dataclass
class Ordinal:
    """Weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > j) of each text, for every j."""
        doc, slots, values = features(texts)
        z = np.bincount(doc, weights=self.weights[slots] * values, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds, -60, 60)))


def thresholds_of(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds of the free parameters: the first one and the logarithms of the gaps."""
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def slope(z: np.ndarray, grades: np.ndarray, weight: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the weighted mean log likelihood by the texts' z (times their number) and by the free parameters."""
    n, top, rows = len(z), len(free), np.arange(len(z))
    tail = 1 / (1 + np.exp(-np.clip(z[:, None] - thresholds_of(free), -60, 60)))
    above = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], 1)
    upper, lower = above[rows, grades], above[rows, grades + 1]
    p = np.maximum(upper - lower, 1e-12)
    d_upper, d_lower = weight * upper * (1 - upper) / p, -weight * lower * (1 - lower) / p
    dt = np.zeros(top)
    np.subtract.at(dt, (grades - 1)[grades > 0], d_upper[grades > 0])
    np.subtract.at(dt, grades[grades < top], d_lower[grades < top])
    tail_sum = np.cumsum(dt[::-1])[::-1]
    return d_upper + d_lower, np.concatenate([tail_sum[:1], tail_sum[1:] * np.exp(free[1:])]) / n


def fit(texts: list[bytes], grades: np.ndarray, steps: int = 200, rate: float = 0.05, ridge: float = 2e-4) -> Ordinal:
    """Maximum likelihood of the texts' grades, each grade weighing the same."""
    return _fit(*features(texts), grades, steps, rate, ridge)


def _fit(
    doc: np.ndarray, slots: np.ndarray, values: np.ndarray, grades: np.ndarray, steps: int = 200, rate: float = 0.05,
    ridge: float = 2e-4
) -> Ordinal:
    top, n = int(grades.max()) if len(grades) else 1, len(grades)
    if not n or top == 0:
        return Ordinal(np.zeros(1 << BITS), np.zeros(max(top, 1)))
    common = np.bincount(slots, minlength=1 << BITS)[slots] >= LEAST_DOCS
    doc, slots, values = doc[common], slots[common], values[common]
    used = np.unique(slots)
    local = np.searchsorted(used, slots).astype(np.int32)
    w, free = np.zeros(len(used)), np.zeros(top)
    state = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(free), np.zeros_like(free)]]
    weight = (n / (top + 1) / np.maximum(np.bincount(grades, minlength=top + 1), 1))[grades]
    for step in range(1, steps + 1):
        dz, g_free = slope(np.bincount(doc, weights=w[local] * values, minlength=n), grades, weight, free)
        g_w = np.bincount(local, weights=dz[doc] * values, minlength=len(used)) / n - ridge * w
        for (m, v), x, g in zip(state, (w, free), (g_w, g_free), strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    full = np.zeros(1 << BITS)
    full[used] = w
    return Ordinal(full, thresholds_of(free))


def grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade: one ordinal rating of the labels quality and toxic."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0))
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(
        F.col("doc_id").cast("long"), F.when(F.col("quality") == 0, 0).when(toxic == 1, 1).otherwise(2).alias("grade")
    )


def learn(docs: DataFrame, rated: DataFrame, size: int = SAMPLE) -> Ordinal:
    """Fits on `size` rated documents; rated: doc_id, grade. Executors make the features, and one task fits."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            doc, slots, values = features([x.encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()])
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            each = [(slots[a:b].astype(np.int32).tobytes(), values[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array([x for x, _ in each], pa.binary()),
                    pa.array([y for _, y in each], pa.binary())
                ],
                names=["doc_id", "grade", "slots", "shares"]
            )

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        slots = [np.frombuffer(x, np.int32) for x in frame["slots"]]
        model = _fit(
            np.repeat(np.arange(len(frame)), [len(x) for x in slots]), np.concatenate(slots).astype(np.int64),
            np.concatenate([np.frombuffer(x, np.float32) for x in frame["shares"]]), frame["grade"].to_numpy(np.int64)
        )
        return pd.DataFrame({"weights": [model.weights.astype(np.float64).tobytes()], "thresholds": [model.thresholds.tolist()]})

    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        chosen = rated.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        named = docs.where(F.col("text").isNotNull()).select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
        )
        texts = named.join(small(materialize(chosen, "rated")), "doc_id").groupBy("doc_id").agg(
            F.min("text").alias("text"), F.min("grade").alias("grade")
        )
        made = texts.mapInArrow(make, "doc_id long, grade int, slots binary, shares binary")
        told = made.groupBy(F.lit(0).alias("all")).applyInPandas(whole, "weights binary, thresholds array<double>").collect()
    return Ordinal(
        np.frombuffer(told[0]["weights"]), np.array(told[0]["thresholds"])
    ) if told else Ordinal(np.zeros(1 << BITS), np.zeros(1))


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the highest grade), selected of every document."""
    shared = share(docs.sparkSession, model)

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            tails = shared.value.tails([(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= SELECT)],
                names=["doc_id", "expected_grade", "tail_probability", "selected"]
            )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        grade, "doc_id long, expected_grade double, tail_probability double, selected boolean"
    )
