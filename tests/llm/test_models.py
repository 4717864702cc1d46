"""Classifiers: held-out accuracy, what they never see, awkward rows."""

import re
import zlib
from collections import Counter
from math import log1p, log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.llm import labelled, quality, toxicity

from .helpers import awkward, frame

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")


def counts(scored, labels, name):
    rows = scored.join(labels, "doc_id").where(labelled.held_out(F.col("doc_id"))).groupBy("predicted", name).count().collect()
    return {(r[0], r[1]): r["count"] for r in rows}


def test_held_out(spark):
    rows = spark.range(50).select("id", labelled.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_toxicity_of_held_out_rows(tables):
    docs, labels = tables
    found = counts(toxicity.scored(docs, toxicity.train(docs, labels)), labels, "toxic")
    # The rest of the labelled toxic rows are junk texts without any toxic word.
    assert found[1, 1] / (found[1, 1] + found[0, 1]) > 0.85 and found.get((1, 0), 0) / found[0, 0] < 0.01


def test_quality_of_held_out_rows(tables):
    docs, labels = tables
    found = counts(quality.scored(docs, quality.train(docs, labels)), labels, "quality")
    assert (found[1, 1] + found[0, 0]) / sum(found.values()) > 0.99


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_labels_are_never_learned(tables, module, label):
    docs, labels = tables
    docs = docs.where("doc_id < 1500")
    turned = labels.withColumn(label, F.when(labelled.held_out(F.col("doc_id")), 1 - F.col(label)).otherwise(F.col(label)))
    models = [module.train(docs, x) for x in (labels, turned)]
    text = np.frombuffer(b"some idiot trash text", np.uint8)
    if module is toxicity:
        assert models[0].score(text) == models[1].score(text)
    else:
        assert (models[0].score(quality.features(text)[None]) == models[1].score(quality.features(text)[None])).all()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_awkward_rows_and_no_labels(spark, tables, module):
    docs = frame(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, nulls):
        rows = module.scored(docs, module.train(docs, labels), columns=("s", "p")).collect()
        assert len(rows) == len(awkward()) and all(0 <= r.s <= 1 for r in rows) and all(r.score == "z" for r in rows)
    empty = docs.where("false")
    assert module.scored(empty, module.train(empty, none)).count() == 0


def test_nonnegative_risk_learns_from_unlabelled_rows():
    """Toxic words stand in a tenth of the unlabelled set: the score there approaches certainty, elsewhere nought."""
    rng = np.random.default_rng(0)
    as_levels = lambda words: toxicity.levels(toxicity.hashed(np.frombuffer(" ".join(words).encode(), np.uint8))[0], len(words))
    clean = lambda: list(rng.choice([f"w{i}" for i in range(200)], 40))
    toxic = lambda: [*clean(), "vile", "vile"]
    model = toxicity.fit([as_levels(toxic()) for _ in range(100)], [as_levels(toxic() if k < 30 else clean()) for k in range(300)], 0.1)
    score = lambda words: model.score(np.frombuffer(" ".join(words).encode(), np.uint8))
    assert score(toxic()) > 0.9 and score(clean()) < 0.1


def test_additive_model_finds_a_pair():
    """Neither feature tells anything alone."""
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000], pairs=1)
    assert model.pairs == [(0, 1)] and ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.95


def test_scores_are_sums_of_lookups():
    rng = np.random.default_rng(1)
    x, y = rng.random((300, 2)), rng.integers(0, 2, 300).astype(float)
    model = quality.fit(x, y, rounds=5, pairs=1, pair_rounds=5)
    at = model.bins(x[:1])[0]
    margin = model.base + sum(t[b] for t, b in zip(model.tables, at, strict=True)) + model.pair_tables[0][at[0], at[1]]
    assert model.score(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-margin)))
    assert quality.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2)))[0] == 0.5


TEXTS = ["", "a", "One two, THREE four!\nfive  6\n\nfive  6\n|#$ end.", "é日本 ñandú 😀 x" * 3, "aaaa\tbbbb" + "z" * 700 + " tail", " \n\n ", "w " * 400 + "\r\nQ? 'q' (r)-s;"]


@pytest.mark.parametrize("text", TEXTS)
def test_quality_features_by_plain_counting(text):
    b = text.encode()
    found = dict(zip(quality.FEATURES, quality.features(np.frombuffer(b, np.uint8)), strict=True))
    if not b:
        assert not any(found.values())
        return
    n, words, lines = len(b), [w for w in re.split(rb"[\x20\t-\r]+", b) if w], [x for x in b.split(b"\n") if x]
    some, n_words = [len(w) for w in words] or [0], max(1, len(words))
    upper, lower = sum(65 <= c <= 90 for c in b), sum(97 <= c <= 122 for c in b)
    mark, digit = b".,;:?!'\"()-", b"0123456789"
    plain = lambda c: 33 <= c <= 126 and c not in mark and c not in digit and not chr(c).isalpha()
    most = max((len(m[0]) for m in re.finditer(rb"(.)\1*", b, re.S)), default=0)
    wanted = {
        "log_bytes": log1p(n), "log_words": log1p(len(words)), "upper_share": upper / max(1, upper + lower), "digit_share": sum(c in digit for c in b) / n,
        "space_share": b.count(b" ") / n, "line_share": b.count(b"\n") / n, "control_share": sum((c < 32 and c != 10) or c == 127 for c in b) / n,
        "mark_share": sum(c in mark for c in b) / n, "sign_share": sum(map(plain, b)) / n, "beyond_share": sum(c >= 0xC0 for c in b) / n,
        "exclamation_share": b.count(b"!") / n, "bar_share": b.count(b"|") / n, "hash_share": sum(c in b"#$%&*" for c in b) / n,
        "mean_word": sum(some) / n_words, "long_word": max(some), "distinct_words": max(1, len(set(words))) / n_words, "top_word": max(Counter(words).values(), default=0) / n_words,
        "two_byte_words": sum(len(w) <= 2 for w in words) / n_words, "signed_words": sum(plain(w[-1]) for w in words) / n_words, "upper_words": sum(65 <= w[0] <= 90 for w in words) / n_words,
        "entropy": -sum(c / n * log2(c / n) for c in Counter(b).values()), "mean_line": log1p(sum(map(len, lines)) / len(lines)) if lines else 0,
        "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)), "longest_run": log1p(most),
    }
    assert wanted.keys() == found.keys()
    assert {k: found[k] for k in wanted} == pytest.approx(wanted)


@pytest.mark.parametrize("text", TEXTS)
def test_toxicity_features_by_plain_counting(text):
    """Each word and each beginning of a longer word is one feature, at the level of its share of the words."""
    low = "".join(c.lower() if c.isascii() else c for c in text).encode()
    words = re.findall(rb"[a-z0-9\x80-\xff]+", low)
    parts = [(p, w[:p] if p else w) for w in words for p in toxicity.PARTS if not p or len(w) > p]
    number = {}
    for p, x in set(parts):
        h, _ = toxicity.hashed(np.frombuffer(x + b"q" if p else x, np.uint8))
        # Of a word by itself: the whole word first, then its beginnings in the order of PARTS.
        number[p, x] = int(h[[q for q in toxicity.PARTS if not q or len(x) + bool(p) > q].index(p)])
    wanted = Counter(number[x] for x in parts)
    found, n_words = toxicity.hashed(np.frombuffer(text.encode(), np.uint8))
    assert n_words == len(words) and Counter(found.tolist()) == wanted
    got = {int(x) >> toxicity.LEVEL_BITS: int(x) & 7 for x in toxicity.levels(found, n_words)}
    assert got == {k: sum(c / max(1, n_words) >= s for s in toxicity.SHARES) for k, c in wanted.items()}


def test_risk_by_its_formula():
    """The score that fitting ends with has a lower non-negative risk than any score without features."""
    rng = np.random.default_rng(3)
    text = lambda *more: toxicity.levels(*toxicity.hashed(np.frombuffer(" ".join([*rng.choice([f"w{i}" for i in range(50)], 30), *more]).encode(), np.uint8)))
    positives, unlabelled, prior = [text("vile") for _ in range(60)], [text(*(["vile"] if k % 10 == 0 else [])) for k in range(200)], 0.1
    model = toxicity.fit(positives, unlabelled, prior)

    def risk(score):
        fp, fu = (np.array([score(x) for x in rows]) for rows in (positives, unlabelled))
        return prior * np.logaddexp(0, -fp).mean() + max(0.0, np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean())

    ids = lambda x: x >> toxicity.LEVEL_BITS
    fitted = risk(lambda x: model.intercept + model.present[ids(x)].sum() + (model.dense[ids(x)] * toxicity.VALUES[x & 7]).sum())
    assert fitted < 0.5 * min(risk(lambda x, b=b: b) for b in np.linspace(-6, 2, 33))


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_rows_are_those_of_their_texts(spark, module):
    """The query's scores against the model applied text by text."""
    if module is quality:
        rng = np.random.default_rng(0)
        x = np.array([quality.features(np.frombuffer(t.encode(), np.uint8)) for t in TEXTS * 20]) + rng.random((len(TEXTS) * 20, len(quality.FEATURES)))
        model = quality.fit(x, (x[:, 0] > 3).astype(float), rounds=5, pair_rounds=2)
        one = lambda d: float(model.score(quality.features(d)[None])[0])
    else:
        model = toxicity.Model(np.linspace(-1, 1, 1 << toxicity.BITS), np.linspace(1, -1, 1 << toxicity.BITS), -0.3)
        one = model.score
    found = module.scored(frame(spark, list(enumerate([*TEXTS, None])), False), model, 0.4).collect()
    for r in found:
        wanted = one(np.frombuffer((r.text or "").encode(), np.uint8))
        assert r.score == pytest.approx(wanted) and r.predicted == (wanted >= 0.4)
