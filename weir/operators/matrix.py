"""The transition matrix of a link graph in coordinate form, and its products with a vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """edges with src and dst replaced by their ids of the dictionary."""
    src, dst = (pages.select(F.col("page").alias(c), F.col("page_id").alias(f"{c}_id")) for c in ("src", "dst"))
    return edges.join(src, "src").join(dst, "dst").select("src_id", "dst_id")


def transition(ids: DataFrame) -> DataFrame:
    """(row_id, col_id, weight): from page col_id to page row_id, one over the page's links for each such link.
    Links are counted per pair first, so a page's links are added up from its pairs."""
    pairs = ids.groupBy("src_id", "dst_id").agg(F.count("*").alias("n"))
    out = ids.groupBy("src_id").agg(F.count("*").alias("links"))
    return pairs.join(out, "src_id").select(F.col("dst_id").alias("row_id"), F.col("src_id").alias("col_id"), (F.col("n") / F.col("links")).alias("weight"))


def rows(matrix: DataFrame) -> DataFrame:
    """(row_id, entries): a row's entries as an array, for writing; products use the coordinates."""
    return matrix.groupBy("row_id").agg(F.collect_list(F.struct("col_id", "weight")).alias("entries"))


def columns(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("col_id").agg(F.collect_list(F.struct("row_id", "weight")).alias("entries"))


def entries(packed: DataFrame) -> DataFrame:
    """Rows or columns as coordinates again."""
    own = "row_id" if "row_id" in packed.columns else "col_id"
    return packed.select(own, F.explode("entries").alias("e")).select(own, "e.*").select("row_id", "col_id", "weight")


def times(matrix: DataFrame, vector: DataFrame, small: bool = False) -> DataFrame:
    """(row_id, value) from a vector (col_id, value): products are joined by column and added up by row, first in
    each task. small: the vector is known to fit every executor, so it is sent to the matrix."""
    vector = F.broadcast(vector) if small else vector
    return matrix.join(vector, "col_id").groupBy("row_id").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
