"""Quality by a generalised additive model with pairwise interactions.

The model is a sum of lookup tables: one for each feature over its bins, and one for each of the strongest pairs of
features over both's bins. Tables are learned by cyclic boosting: in turn for each feature a shallow tree (of at most
four leaves) is fitted to what the sum still misses and added, scaled down, to that feature's table; then likewise for
pairs, chosen by how much a tree over both would still gain. A score is as many additions as there are tables.

Fitting takes the features, not the texts, of a bounded sample to the driver; scoring is one pass over all texts.

Defined cases: null and empty texts have all-zero features and are scored like others; without labels every score is
0.5, and with one class only that class's share, drawn in by one row of each; ids that are null or held out are
scored but never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from . import labelled
from .scratch import column, mapped, prepare, without

#: A byte's kind: 0 lower-case letter, 1 upper-case letter, 2 digit, 3 space, 4 line feed, 5 other white space or
#: control, 6 mark of a sentence, 7 other sign, 8 first byte of a character beyond ASCII, 9 later byte of one.
KINDS = 10
KIND = np.full(256, 7, np.uint8)
KIND[:0x20] = 5
KIND[0x7F] = 5
KIND[0x20] = 3
KIND[0x0A] = 4
KIND[0x30:0x3A] = 2
KIND[0x41:0x5B] = 1
KIND[0x61:0x7B] = 0
for _sign in b".,;:?!'\"()-":
    KIND[_sign] = 6
KIND[0x80:0xC0] = 9
KIND[0xC0:] = 8

FEATURES = (
    "log_bytes", "log_words", "upper_share", "digit_share", "space_share", "line_share", "control_share", "mark_share", "sign_share", "beyond_share",
    "exclamation_share", "bar_share", "hash_share", "mean_word", "long_word", "distinct_words", "top_word", "two_byte_words", "signed_words", "upper_words", "entropy",
    "mean_line", "repeated_lines", "longest_run",
)


def features(data: np.ndarray) -> np.ndarray:
    """The FEATURES of a text."""
    out = np.zeros(len(FEATURES))
    n = len(data)
    if not n:
        return out
    of_byte = sum(np.bincount(data[a : a + B.STRETCH], minlength=256) for a in range(0, n, B.STRETCH))
    kinds = np.bincount(KIND, of_byte, KINDS)
    starts, ends, words = B.word_hashes(data, ~B.SPACE, B.SYMBOL)
    size = ends - starts
    n_words = max(1, len(words))
    counts = np.unique(words, return_counts=True)[1] if len(words) else np.zeros(1)
    share = of_byte[of_byte > 0] / n
    *lines, line_hashes = B.word_hashes(data, B.BYTES != 0x0A, B.SYMBOL)
    letters = kinds[0] + kinds[1]
    out[:] = (
        np.log1p(n), np.log1p(len(words)), kinds[1] / max(1, letters), kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n, kinds[8] / n,
        of_byte[0x21] / n, of_byte[0x7C] / n, (of_byte[0x23] + of_byte[0x24] + of_byte[0x25] + of_byte[0x26] + of_byte[0x2A]) / n,
        size.mean() if len(size) else 0, size.max() if len(size) else 0, len(counts) / n_words, counts.max() / n_words, (size <= 2).sum() / n_words,
        (KIND[data[ends - 1]] == 7).sum() / n_words, (KIND[data[starts]] == 1).sum() / n_words, -(share * np.log2(share)).sum(),
        np.log1p((lines[1] - lines[0]).mean()) if len(lines[0]) else 0, 1 - len(np.unique(line_hashes)) / max(1, len(line_hashes)), np.log1p(longest_run(data)),
    )
    return out


def longest_run(data: np.ndarray) -> int:
    """The most equal bytes in a row."""
    longest, before = 0, 0  # before: where the run that is open began
    for a in range(0, len(data), B.STRETCH):
        part = data[max(0, a - 1) : a + B.STRETCH]
        bounds = np.flatnonzero(part[1:] != part[:-1]) + max(1, a)
        starts = np.concatenate([[before], bounds])
        longest = max(longest, int(np.diff(np.append(starts, min(a + B.STRETCH, len(data)))).max()))
        before = int(starts[-1])
    return longest


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)  # of each feature's bins
    tables: list[np.ndarray] = field(default_factory=list)  # by feature and bin
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)  # by pair and both's bins

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for f, table in enumerate(self.tables):
            out += table[bins[:, f]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[bins[:, i], bins[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(self.bins(x))))


def _best_split(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Of bins with sums of gradients g and of weights h, along the last axis: the gain of the best cut, and where."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = np.where((left_h >= least) & (right_h >= least), left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1), -1.0)
    at = int(gain.argmax()) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) else (-1.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, least: float, depth: int = 2) -> np.ndarray:
    """The leaf values of a tree over the bins of one feature."""
    gain, at = _best_split(g, h, least) if depth else (-1.0, 0)
    if gain <= 0:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:at], h[:at], least, depth - 1), _tree(g[at:], h[at:], least, depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """A tree over the bins of two features, cut on the first and then in each part on the second, where the parts'
    gains add up to most: its gain and leaf values. Neither feature need tell anything alone."""

    def best(sum_g: np.ndarray, sum_h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each cut of the first feature (a row of running sums over the second): gain and place of the best cut."""
        all_g, all_h = sum_g[:, -1:], sum_h[:, -1:]
        left_g, left_h = sum_g[:, :-1], sum_h[:, :-1]
        fits = (left_h >= least) & (all_h - left_h >= least)
        gain = np.where(fits, left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1), 0.0)
        gain = np.hstack([all_g**2 / (all_h + 1), gain])  # the first place: no cut
        return gain.max(1), gain.argmax(1)

    sum_g, sum_h = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    above, below = best(sum_g, sum_h), best(sum_g[-1:] - sum_g, sum_h[-1:] - sum_h)
    at = int((above[0] + below[0]).argmax())
    out = np.empty_like(g)
    for part, cut in ((slice(0, at + 1), above[1][at]), (slice(at + 1, None), below[1][at])):
        for columns in (slice(0, cut), slice(cut, None)):
            out[part, columns] = g[part, columns].sum() / (h[part, columns].sum() + 1)
    return float((above[0] + below[0])[at] - g.sum() ** 2 / (h.sum() + 1)), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pairs: int = 10, pair_rounds: int = 40, rate: float = 0.15, least: float = 1.0) -> Model:
    """x: rows of features; y: 0 or 1."""
    if not len(y):
        return Model(0.0)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    wide = x.shape[1]
    model.edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="higher")) for f in range(wide)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = model.bins(x)
    margin = model.margin(at)

    def sums(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return np.bincount(code, y - p, n), np.bincount(code, p * (1 - p), n)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            step = rate * _tree(*sums(at[:, f], len(table)), least)
            table += step
            margin += step[at[:, f]]
    gains = []
    for i in range(wide):
        for j in range(i + 1, wide):
            n_i, n_j = len(model.tables[i]), len(model.tables[j])
            g, h = sums(at[:, i] * n_j + at[:, j], n_i * n_j)
            gains.append((-_pair_tree(g.reshape(n_i, n_j), h.reshape(n_i, n_j), least)[0], i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains)[:pairs]]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = sums(at[:, i] * table.shape[1] + at[:, j], table.size)
            step = rate * _pair_tree(g.reshape(table.shape), h.reshape(table.shape), least)[1]
            table += step
            margin += step[at[:, i], at[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Model:
    """docs: doc_id, text; labels: doc_id, quality. Fits on at most `most` labelled rows that aren't held out."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = labelled.sample(labelled.label_of(labels, "quality"), most, "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x).tobytes() for x in B.rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], names=["doc_id", "label", "found"])

    rows = sorted(labelled.texts_of(docs, wanted).mapInArrow(B.released(run), "doc_id long, label int, found binary").collect())
    x = np.array([np.frombuffer(r.found) for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([float(r.label == 1) for r in rows]))


def scored(docs: DataFrame, model: Model, threshold: float = 0.5, columns: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs' columns with the score and whether it reaches the threshold, under the names in columns."""
    prepare(docs.sparkSession)
    names = without(docs, *columns)
    docs = docs.select([column(c) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in B.rows(batch.column(batch.schema.get_field_index("text")))]).reshape(-1, len(FEATURES))
            scores = model.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*names, *columns])

    return mapped(docs, run, T.StructType([*docs.schema, T.StructField(columns[0], T.DoubleType()), T.StructField(columns[1], T.IntegerType())]))
