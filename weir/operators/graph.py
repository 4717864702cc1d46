"""Link graphs: vertices, edges, degrees, and a dense numbering of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut


def edges_of(links: DataFrame) -> DataFrame:
    """From (page, links): an edge for each link, repeats and self-links too."""
    return links.select(F.col("page").alias("src"), F.explode("links").alias("dst"))


def merged_pages(links: DataFrame, how: str = "concat") -> DataFrame:
    """One row for each page. concat: all its records' links, smaller lists first; first: those of one record with links, if it has any
    (of several the smallest list, so that the outcome doesn't depend on order)."""
    if how == "concat":
        return links.groupBy("page").agg(F.flatten(F.array_sort(F.collect_list("links"))).alias("links"))
    rank = F.struct((F.size("links") == 0).alias("sink"), "links")
    return links.groupBy("page").agg(F.min(rank)["links"].alias("links"))


def vertices(links: DataFrame) -> DataFrame:
    """Every page that was crawled or linked to, once, with its links (none for pages never crawled)."""
    # A page is one row here however many link to it.
    linked = edges_of(links).select(F.col("dst").alias("page")).distinct()
    stubs = linked.join(links.select("page"), "page", "left_anti").select("page", F.array().cast("array<string>").alias("links"))
    return merged_pages(links).unionByName(stubs)


def nodes(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """(page, out_degree, in_degree, dangling) of all ends of edges; isolated: further pages."""
    ends = edges.select(F.col("src").alias("page"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    if isolated is not None:
        ends = ends.union(isolated.select("page", F.lit(0), F.lit(0)))
    counted = ends.groupBy("page").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return counted.withColumn("dangling", F.col("out_degree") == 0)


def dangling(graph: DataFrame) -> DataFrame:
    return graph.where("dangling").select("page")


def no_inlink(graph: DataFrame) -> DataFrame:
    return graph.where("in_degree = 0").select("page")


def dictionary(graph: DataFrame) -> DataFrame:
    """(page_id, page): ids from 0 in the order of names. Pages are range-partitioned and numbered within their
    partition; a partition's ids start at the number of pages before it, so no task sees all pages."""
    placed = cut(graph.select("page").distinct().repartitionByRange("page").withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    # One row for each partition: this window's single task has as few rows.
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    at = F.row_number().over(Window.partitionBy("part").orderBy("page"))
    return placed.withColumn("at", at).join(F.broadcast(starts), "part").select((F.col("start") + F.col("at") - 1).alias("page_id"), "page")
