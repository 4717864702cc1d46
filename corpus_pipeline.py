"""A corpus pipeline over `documents`: quality, repeated lines, near duplicates, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and calls one operator of
weir.llm. All but the last return the columns of documents (a text that changes takes its n_chars along); the last
adds the sampled pieces. Stages never see columns but doc_id and text: the others travel beside them as one column.

No text is null after the second stage: null counts as empty. Rows that repeat id and text stay together. An empty
table goes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import decontaminate, jaccard, line_dedup, pieces, quality
from weir.llm.queries import tokenizer_path
from weir.llm.scratch import Scratch, column, quoted

REST = "weir_rest"
DIGEST = "weir_digest"


def _aside(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one."""
    others = [column(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(0).alias("none")])).alias(REST))


def _back(found: DataFrame, docs: DataFrame, *more: str, changed: bool = False) -> DataFrame:
    """docs' columns, from _aside's, and more of found's, which take the place of columns of their names. changed:
    texts have changed, so n_chars is counted anew."""

    def column(name: str):
        if name in ("doc_id", "text"):
            return F.col(name)
        if changed and name == "n_chars":
            return F.length("text").cast(docs.schema[name].dataType).alias(name)
        return F.col(f"{REST}.{quoted(name)}").alias(name)

    return found.select(*(column(c) for c in docs.columns if c not in more), *more)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.scored(_aside(docs), model, columns=("weir_score", "weir_good"))
    return _back(scored.where("weir_good = 1"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(_aside(docs))
    return _back(found.select("doc_id", F.col("line_kept").alias("text"), REST), docs, changed=True)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.components_of(docs, digest=DIGEST)
    copies = found.where("doc_id <> component_id").select("doc_id", DIGEST).distinct()
    keyed = jaccard.with_digest(_aside(docs), DIGEST)
    return _back(keyed.hint("merge").join(copies, ["doc_id", DIGEST], "left_anti"), docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scanned = decontaminate.scan(_aside(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _back(decontaminate.clean(scanned), docs, changed=True)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _back(pieces.encode(_aside(docs), tokenizer_path("piece_bpe_32k.model")), docs, *(f.name for f in pieces.ADDED))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", drop_benchmark),
    ("pieces", encode_pieces),
]

#: Trained scores and sampled pieces have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.keep(name)
    return docs
