"""Columns of any name beside the texts, and texts of many stretches, through every operator."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weir.llm import bytesops, decontaminate, jaccard, line_dedup, pieces, pretoken, quality, secrets, suffix_dedup, token_files, toxicity
from weir.llm.exact_dedup import DigestIndex
from weir.llm.queries import tokenizer_path
from weir.llm.scratch import unused

from .helpers import awkward, frame, prose

SF = "/root/testdata/sf0.001"
BPE, MODEL = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
#: Columns that operators add (those are replaced), columns of the names that they use within, and names to be quoted.
REPLACED = ("removed", "n_bytes", "KEPT_sha256", "piece_ids", "n_pieces", "pieces_crc32", "lossless", "secret_spans", "line_runs", "line_count", "line_kept", "bench_bits", "bench_items", "bench_hits", "bench_words", "score", "predicted")
OTHERS = ("weir_id", "weir_key", "weir_starts", "weir_text_hash", "weir_hash", "weir_runs", "weir_rest", "weir_found", "weir_row", "weir_digest", "weir_hits", "row", "digest", "node", "a.b", "a b", "doc_id.x", "block", "bucket")


def named(spark, rows):
    docs = frame(spark, rows, False)
    return docs.select("*", F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"), *(F.lit(f"z{k}").alias(c) for k, c in enumerate(REPLACED + OTHERS)))


def some_model(module):
    if module is quality:
        return quality.Model(0.5)
    return toxicity.fit([], [], 0.1)


OPERATORS = {
    "line_dedup": (lambda d: line_dedup.dedup(d, long_words=10), ("line_count", "line_runs", "line_kept")),
    "suffix_dedup": (lambda d: suffix_dedup.dedup(d, 30, 12), ("n_bytes", "removed", "kept_sha256")),
    "pieces": (lambda d: pieces.encode(d, MODEL), ("n_pieces", "pieces_crc32", "lossless")),
    "secrets": (lambda d: secrets.scan(d), ("secret_spans",)),
    "toxicity": (lambda d: toxicity.scored(d, some_model(toxicity)), ("score", "predicted")),
    "quality": (lambda d: quality.scored(d, some_model(quality)), ("score", "predicted")),
    "decontaminate": (lambda d: decontaminate.scan(d, items(d)), ("bench_words", "bench_hits", "bench_items")),
    "decontaminate in passes": (lambda d: decontaminate.scan(d, items(d), block_bytes=20), ("bench_words", "bench_hits", "bench_items")),
    "jaccard": (lambda d: jaccard.components_of(d), ("n_shingles", "component_id")),
    "jaccard's digest": (lambda d: jaccard.with_digest(d, "new"), ("new",)),
}


def items(docs):
    return docs.sparkSession.createDataFrame([("a", "one two"), ("b", "w1 w2"), ("c", "of the")], "item_id string, text string")


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name(spark, name):
    run, added = OPERATORS[name]
    rows = lambda df: sorted(repr(tuple(r)) for r in df.select("doc_id", *added).collect())
    found = run(named(spark, awkward()))
    assert rows(found) == rows(run(frame(spark, awkward(), False)))
    if len(found.columns) > 5:
        rest = found.select(*(f"`{c.replace('`', '``')}`" for c in OTHERS)).distinct().collect()
        assert [tuple(r) for r in rest] == [tuple(f"z{len(REPLACED) + k}" for k in range(len(OTHERS)))]


def test_files_and_index_read_only_id_and_text(spark, tmp_path):
    rows = lambda df: sorted(map(repr, df.collect()))
    both = []
    for k, docs in enumerate((named(spark, awkward()), frame(spark, awkward(), False))):
        token_files.write(docs, f"{tmp_path}/t{k}", BPE, shards=3)
        both.append((rows(token_files.documents(spark, f"{tmp_path}/t{k}")), rows(DigestIndex(spark, f"file://{tmp_path}/i{k}", 2).dedup(docs))))
    assert both[0] == both[1]


def test_pipeline_keeps_columns_of_any_name(spark):
    docs = named(spark, awkward())
    kept = [c for c in docs.columns if c not in pieces.ADDED.names]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "pieces":
            assert [c for c in out.columns if c not in pieces.ADDED.names] == kept
        else:
            assert out.columns == docs.columns
            assert out.where("`a.b` <> 'z31' OR weir_rest <> 'z23'").isEmpty()
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_unused_names():
    assert unused(["a", "weir_X"], "weir_x") == "weir_x_" and unused([], "x") == "x"


def long_text():
    rng = np.random.default_rng(11)
    return " ".join([prose(rng, 400), "é日本 " * 30, "x" * 900, "don't, O'Neil's;", "Token=abcdef123\n" * 20, prose(rng, 200)])


def test_stretches_change_nothing(monkeypatch):
    """What is computed of a text does not depend on the stretches that it is worked on in."""
    data = np.frombuffer(long_text().encode(), np.uint8)
    windows = decontaminate.Windows([("a", "one two"), ("b", " ".join(long_text().split()[50:70]))], 10)
    anchors = suffix_dedup.Anchors(30, 12)
    encoder = pretoken.Encoder(BPE)

    def everything():
        encoder._forget()
        words = bytesops.word_hashes(data, decontaminate.IS_WORD, bytesops.SYMBOL_LOWER)[2]
        return [
            words, bytesops.windows_of(words, 5), jaccard.shingles(data, 5)[0], np.sort(toxicity.hashed(data)[0]), quality.features(data), *anchors.find(data),
            encoder.encode(data, np.array([0, len(data)]), 7)[0], windows.hits(data)[0],
        ]

    whole = everything()
    for stretch in (64, 1000):
        monkeypatch.setattr(bytesops, "STRETCH", stretch)
        assert all(np.array_equal(x, y) for x, y in zip(whole, everything(), strict=True))


def test_longest_run(monkeypatch):
    runs = lambda b: quality.longest_run(np.frombuffer(b, np.uint8))
    for stretch in (2, 3, 100):
        monkeypatch.setattr(bytesops, "STRETCH", stretch)
        assert [runs(b) for b in (b"a", b"aab", b"abbbbbbba", b"abcc", b"aaaaaaa", b"abababaab")] == [1, 2, 7, 2, 7, 2]


def test_words_whose_polynomials_collide_are_told_apart():
    """Two strings of 2,048 bytes of which every polynomial modulo 2**64 is equal."""
    word, other = b"a", b"b"
    for _ in range(11):
        word, other = word + other, other + word
    data = np.frombuffer(word + b" " + other, np.uint8)
    starts, ends, found = bytesops.word_hashes(data, ~bytesops.SPACE, bytesops.SYMBOL)
    sums = bytesops.prefix_sums(bytesops.SYMBOL[data])
    assert len(set(bytesops.span(sums, starts, ends).tolist())) == 1 and len(set(found.tolist())) == 2


def test_a_text_of_several_megabytes(spark, tmp_path):
    rng = np.random.default_rng(6)
    part = prose(rng, 3000)
    text = " ".join(f"{k} " + prose(rng, 3000) for k in range(230)) + "\n" + part + "\n" + part
    docs = frame(spark, [(1, text), (2, part), (3, text + " end")], False)
    assert len(text) > 3 << 20
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    assert len({r.component_id for r in jaccard.components_of(docs).collect() if r.doc_id != 2}) == 1
    found = by_id(suffix_dedup.dedup(docs))
    assert found[1].removed[-1].end == len(text) and found[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert sum(x.end - x.start for x in found[3].removed) == len(text)
    assert by_id(line_dedup.dedup(docs, long_words=50))[3].line_kept.endswith(" end")
    assert all(r.lossless for r in pieces.encode(docs, MODEL).collect())
    token_files.write(docs, f"{tmp_path}/t", BPE)
    got = by_id(token_files.documents(spark, f"{tmp_path}/t"))
    ids = pretoken._tokenizer(BPE).encode(text, add_special_tokens=False).ids + [0]
    assert got[1].n_tokens == len(ids) and got[1].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    hit = by_id(decontaminate.scan(docs, spark.createDataFrame([("a", part[:200])], "item_id string, text string")))
    assert hit[1].bench_items == hit[2].bench_items == ["a"] and hit[1].bench_hits == 2 * hit[2].bench_hits
    assert by_id(secrets.scan(docs))[1].secret_spans == []
    for module in (quality, toxicity):
        assert len(module.scored(docs, some_model(module)).collect()) == 3
    assert pa.total_allocated_bytes() < 1 << 30
