"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all documents, whatever they are, is the unlabelled set.
With class prior p and logistic loss l, a linear model minimises

    p * mean_P l(f) + max(0, mean_U l(-f) - p * mean_P l(-f)),

whose second term estimates the negatives' risk without a single negative. Where a step makes that estimate negative,
the model has begun to overfit the positives and the step is taken against it instead (the non-negative correction).

Features are words and the first bytes of words, hashed, each with its presence in the text and with its share of the
text's words, in a few levels; the model keeps those that set the positives apart from the unlabelled set most.
Fitting takes bounded samples to the driver; scoring is one pass over all texts.

Defined cases: null and empty texts have no features and get the model's intercept; without any confirmed positive
every score is 0; ids that are null or held out are scored but never learned from; columns besides id and text are
never read as features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from . import labelled
from .decontaminate import IS_WORD
from .scratch import column, mapped, prepare, without

BITS = 20
#: Lengths in bytes of the beginnings of words that are features; 0: whole words.
PARTS = (0, 3, 4, 5, 6, 7, 8)


#: A feature's level is the number of these shares of a text's words that it reaches, and counts as so much.
SHARES = (1 / 800, 1 / 400, 1 / 200, 1 / 100, 1 / 50)
VALUES = np.array([0.05, 0.2, 0.4, 0.75, 1.5, 3.0])
LEVEL_BITS, DENSE = 3, 3


#: A feature is looked at if so many positives have it, however many positives there are.
LEAST = 4


def hashed(data: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Hashed features of a text, with repeats, and its number of words. wanted: only features that are true there."""
    starts, ends, words = B.word_hashes(data, IS_WORD, B.SYMBOL_LOWER)
    out = []
    for part in PARTS:
        begin = starts[ends - starts > part]
        found = B.mix((B.hashes(data, begin, begin + part, B.SYMBOL_LOWER) if part else words) + B.U64(part * 0x51ED27 + 1))
        found = (found >> B.U64(64 - BITS)).astype(np.int32)
        out.append(found if wanted is None else found[wanted[found]])
    return np.concatenate(out), len(starts)


def levels(found: np.ndarray, n_words: int) -> np.ndarray:
    """Each feature once, ascending, with its level in the low bits."""
    ids, counts = np.unique(found, return_counts=True)
    return (ids << LEVEL_BITS) | np.searchsorted(SHARES, counts / max(1, n_words), "right").astype(np.int32)


@dataclass
class Model:
    present: np.ndarray  # weights by hashed feature
    dense: np.ndarray  # and times the level's value
    intercept: float

    def __post_init__(self):
        self.weighed = (self.present != 0) | (self.dense != 0)

    def score(self, data: np.ndarray) -> float:
        found = levels(*hashed(data, self.weighed))
        ids = found >> LEVEL_BITS
        return float(1 / (1 + np.exp(-(self.intercept + self.present[ids].sum() + (self.dense[ids] * VALUES[found & 7]).sum()))))


class Rows:
    """Sparse rows of numbers."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        self.value = np.concatenate([np.zeros(0), *values])

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column] * self.value, self.n)

    def transposed_times(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, values[self.row] * self.value, self.width)


def select(positives: list[np.ndarray], unlabelled: list[np.ndarray], deviations: float) -> np.ndarray:
    """Features, one after the other while any is left that stands out by `deviations`: each stands out most among the positives, by presence or by being
    dense, against the unlabelled set, of the documents that have none chosen before. So beginnings of a telling word
    that other words share, and words that only go along with it, aren't chosen besides it. Of a million hashed
    features some thousand stand out by three standard errors by chance, and copies of a text by more; hence
    `deviations`."""
    n_p, n_u = len(positives), len(unlabelled)
    # Twice the feature, plus one for the dense kind.
    both = [np.concatenate([x >> LEVEL_BITS << 1, (x[(x & 7) >= DENSE] >> LEVEL_BITS << 1) | 1]) for x in positives]
    usable = np.flatnonzero(np.bincount(np.concatenate(both), minlength=2 << BITS) >= LEAST)
    place = np.full(2 << BITS, -1, np.int32)
    place[usable] = np.arange(len(usable))
    rows = []
    for x in both:
        found = place[x]
        rows.append(found[found >= 0])
    for x in unlabelled:
        found = place[np.concatenate([x >> LEVEL_BITS << 1, (x[(x & 7) >= DENSE] >> LEVEL_BITS << 1) | 1])]
        rows.append(found[found >= 0])
    column = np.concatenate(rows)
    of_column = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])[np.argsort(column, kind="stable")]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=len(usable)))])
    p, u = (np.bincount(np.concatenate([np.zeros(0, np.int32), *x]), minlength=len(usable)).astype(float) for x in (rows[:n_p], rows[n_p:]))
    whole_p, whole_u = p.copy(), u.copy()
    left, chosen = np.ones(len(rows), bool), []
    while len(usable):
        share = (p + u) / (n_p + n_u)
        apart = (p / n_p - u / n_u) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n_p + 1 / n_u))
        best = int(apart.argmax())
        if apart[best] <= deviations or p[best] < LEAST:
            break
        chosen.append(usable[best] >> 1)
        gone = of_column[bounds[best] : bounds[best + 1]]
        gone = gone[left[gone]]
        left[gone] = False
        for count, some in ((p, gone[gone < n_p]), (u, gone[gone >= n_p])):
            count -= np.bincount(np.concatenate([np.zeros(0, np.int32), *(rows[r] for r in some.tolist())]), minlength=len(usable))
    # And what telling words go along with almost wherever it stands, if it stands in many positives: telling too.
    alone = u / np.maximum(whole_u, 1)
    more = np.flatnonzero((whole_p >= 0.05 * n_p) & (whole_p / n_p > 4 * whole_u / n_u) & (alone <= 0.1))
    return np.unique(np.array([*chosen, *(usable[more] >> 1)], np.int64))


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, deviations: float = 4.5, steps: int = 1500, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """positives, unlabelled: levels() of each document."""
    present, dense = np.zeros(1 << BITS), np.zeros(1 << BITS)
    if not positives or not unlabelled or prior <= 0:
        return Model(present, dense, -40.0)
    prior = min(prior, 0.95)
    n_p, n_u = len(positives), len(unlabelled)
    chosen = select(positives, unlabelled, deviations)
    k = len(chosen)
    number = np.full(1 << BITS, -1)
    number[chosen] = np.arange(k)

    def rows(found: list[np.ndarray]) -> Rows:
        at = [x[number[x >> LEVEL_BITS] >= 0] for x in found]
        columns = [number[x >> LEVEL_BITS] for x in at]
        return Rows([np.concatenate([c, c + k]) for c in columns], [np.concatenate([np.ones(len(x)), VALUES[x & 7]]) for x in at], 2 * k)

    p, u = rows(positives), rows(unlabelled)
    w, b = np.zeros(2 * k), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(2 * k + 1), np.zeros(2 * k + 1)
    for step in range(1, steps + 1):
        fp, fu = p.times(w) + b, u.times(w) + b
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        # d l(f) = s - 1 and d l(-f) = s.
        negative_risk = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        of_positive = (prior / n_p) * (sp - 1)
        of_negative_p, of_negative_u = (-prior / n_p) * sp, su / n_u
        if negative_risk >= 0:
            gp, gu = of_positive + of_negative_p, of_negative_u
        else:
            gp, gu = -of_negative_p, -of_negative_u
        grad = np.append(p.transposed_times(gp) + u.transposed_times(gu) + decay * w, gp.sum() + gu.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
    present[chosen], dense[chosen] = w[:k], w[k:]
    return Model(present, dense, b)


def train(docs: DataFrame, labels: DataFrame, most_positives: int = 2000, most_unlabelled: int = 8000, prior: float | None = None) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Fits on at most so many confirmed positives and unlabelled texts, of
    rows that aren't held out; prior: the share of toxic documents, if known, or else the labels' own."""
    known = labelled.label_of(labels, "toxic")
    if prior is None:
        prior = known.where(~labelled.held_out(F.col("doc_id"))).agg(F.avg((F.col("label") == 1).cast("double"))).first()[0] or 0.0
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = labelled.sample(known.where("label = 1"), most_positives).withColumn("positive", F.lit(True)).union(
        labelled.sample(docs.select("doc_id"), most_unlabelled).withColumn("positive", F.lit(False))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [levels(*hashed(x)).tobytes() for x in B.rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), pa.array(found, pa.binary())], names=["doc_id", "positive", "found"])

    rows = sorted(labelled.texts_of(docs, wanted).mapInArrow(B.released(run), "doc_id long, positive boolean, found binary").collect())
    found = {kind: [np.frombuffer(r.found, np.int32) for r in rows if r.positive is kind] for kind in (True, False)}
    return fit(found[True], found[False], prior)


def scored(docs: DataFrame, model: Model, threshold: float = 0.7, columns: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs' columns with the score and whether it reaches the threshold, under the names in columns."""
    prepare(docs.sparkSession)
    names = without(docs, *columns)
    docs = docs.select([column(c) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(x) for x in B.rows(batch.column(batch.schema.get_field_index("text")))], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*names, *columns])

    return mapped(docs, run, T.StructType([*docs.schema, T.StructField(columns[0], T.DoubleType()), T.StructField(columns[1], T.IntegerType())]))
