"""Registered queries against their oracles, and the pipeline's stages against brute force."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.test_queries import SF, compare
from weir.llm import queries

from .helpers import awkward, frame
from .test_dedup import brute_lines, brute_links
from .test_text import brute_hits


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    compare(spark, name, queries.QUERIES, queries.ORACLES)


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (docs, out))
        assert after.keys() <= before.keys()
        if name == "quality":
            gone = before.keys() - after.keys()
            said = {r.doc_id: r.quality for r in labels.collect()}
            assert sum(said.get(i) == 0 for i in gone) > 0.8 * sum(v == 0 for v in said.values()) and not any(said.get(i) == 1 for i in gone)
        elif name == "line_dedup":
            assert after == {i: t for i, _, t in brute_lines(list(before.items()), 2)}
        elif name == "near_copies":
            assert after.keys() == {i for i, _, c in brute_links(list(before.items()), 5, 75) if i == c}
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            for i, t in before.items():
                n, hit, _ = brute_hits(t, items)
                assert (i in after) == (hit <= n / 2) and (hit or after[i] == t) and (not hit or i not in after or len(after[i]) < len(t))
        else:
            assert all(r.lossless and r.n_pieces for r in out.where("text <> ''").collect())
        assert out.columns[: len(columns)] == columns and (k == 4 or out.columns == columns)
        assert all(r.n_chars == r.n for r in out.select("n_chars", F.length("text").alias("n")).collect())
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_near_copies_go_row_by_row_where_an_id_repeats(spark):
    copied, own = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, copied), (2, copied + " end"), (2, own), (2, own), (2, ""), (3, None), (None, "no id")]
    found = corpus_pipeline.keep_one_of_near_copies(spark, frame(spark, rows), SF)
    assert found.columns == frame(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == sorted((r for r in rows if r[1] != copied + " end"), key=repr)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_awkward_tables(spark, empty):
    docs = frame(spark, awkward()).where("false" if empty else "true")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert not (empty and rows)
        if name != "pieces":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(rows, out.schema)


def test_no_other_module_imports_this_folder():
    from pathlib import Path

    import weir

    for path in Path(weir.__file__).parent.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"import .*\bllm\b|from .*\bllm\b", path.read_text())
