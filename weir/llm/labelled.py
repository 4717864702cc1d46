"""What the classifiers share: which rows may be learned from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows kept for measuring: CRC-32 of the id as text leaves 1 modulo 3. A null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample(ids: DataFrame, most: int, *also: str) -> DataFrame:
    """The `most` rows of smallest id hash among those that aren't held out: the same rows wherever they lie."""
    order = F.xxhash64("doc_id", F.lit(17))
    return ids.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", *also).orderBy(order, "doc_id", *also).limit(most)


def label_of(labels: DataFrame, name: str) -> DataFrame:
    """One row per labelled id: doc_id, label (the larger, should rows differ). Null labels are none."""
    return labels.where(F.col(name).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(name).cast("int")).alias("label"))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs' rows of the wanted ids, a bounded sample, with the sample's columns: one scan, no shuffle of texts."""
    return docs.join(F.broadcast(wanted), "doc_id")
