"""PageRank: r' = (1 - d) / N + d * (D / N + the sum of r / outlinks over inlinks), D being the rank of pages without
links. All pages have a rank, those without inlinks too; ranks add up to 1.

The three forms give the same ranks: adjacency joins ranks to edges, row sends the rank vector to the matrix where it
is small enough and else joins, column joins the matrix by its columns. Ranks are written and read back after each
step, so the plan doesn't grow; the graph is written once. The rank of pages without links is observed while ranks are
written, which spares a job a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..runtime import cut
from .graph import dictionary
from .matrix import numbered, times, transition

DAMPING = 0.85
#: Ranks of up to so many pages are sent whole to executors, as (long, double) some 16 bytes each.
SMALL_VECTOR = 2_000_000


def dangling_mass(ranks: DataFrame) -> DataFrame:
    """(mass): the rank of pages without links. ranks: with dangling. 0 where no page is."""
    return ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("mass"))


def total(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.sum("rank").alias("total"))


def contributions(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """(page, value): what pages get from those that link to them. ranks: page, rank, out_degree; edges: src, dst and,
    if a row stands for several links, how many (links)."""
    share = ranks.select(F.col("page").alias("src"), (F.col("rank") / F.col("out_degree")).alias("share"))
    value = F.col("share") * F.col("links") if "links" in edges.columns else F.col("share")
    return edges.join(share.where("share IS NOT NULL"), "src").groupBy(F.col("dst").alias("page")).agg(F.sum(value).alias("value"))


def _next(ranks: DataFrame, got: DataFrame, key: str, n: int, damping: float, mass: float) -> tuple[DataFrame, float]:
    """ranks with the new rank, written, and the mass of pages without links then, which is added up on the way.
    got: (key, value); mass: the old one."""
    rest = [c for c in ranks.columns if c not in (key, "rank")]
    value = F.lit((1 - damping) / n + damping * mass / n) + damping * F.coalesce("value", F.lit(0.0))
    new = ranks.select(key, *rest).join(got, key, "left").select(key, value.alias("rank"), *rest)
    seen = Observation()
    new = cut(new.observe(seen, F.sum(F.when(F.col("dangling"), F.col("rank"))).alias("mass")))
    return new, seen.get["mass"] or 0.0


def pagerank(graph: DataFrame, edges: DataFrame, iterations: int = 10, damping: float = DAMPING, variant: str = "adjacency") -> DataFrame:
    """graph: nodes() of edges. Returns (page, rank). variant: adjacency, row, column, or lagged: the ranks of the
    last step before the links-less pages' share of it is given out."""
    graph = cut(graph.select("page", F.nullif("out_degree", F.lit(0)).alias("out_degree"), "dangling"))
    n, without = graph.agg(F.count("*"), F.count_if("dangling")).first()
    if not n:
        return graph.select("page", F.lit(0.0).alias("rank"))
    if variant in ("row", "column"):
        return _by_matrix(graph, edges, n, without / n, iterations, damping, variant)
    ranks, mass = graph.withColumn("rank", F.lit(1.0 / n)), without / n
    # Repeated links are one row. Rows are not pinned to their page: a hub's may be split among tasks at each join.
    edges = cut(edges.groupBy("src", "dst").agg(F.count("*").alias("links")))
    for step in range(iterations):
        got = contributions(ranks, edges)
        ranks, mass = _next(ranks, got, "page", n, damping, 0.0 if variant == "lagged" and step == iterations - 1 else mass)
    return ranks.select("page", "rank")


def _by_matrix(graph: DataFrame, edges: DataFrame, n: int, mass: float, iterations: int, damping: float, variant: str) -> DataFrame:
    pages = cut(dictionary(graph))
    matrix = cut(transition(numbered(edges, pages)))
    ranks = pages.join(graph, "page").select("page_id", "dangling", F.lit(1.0 / n).alias("rank"))
    for _ in range(iterations):
        vector = ranks.select(F.col("page_id").alias("col_id"), F.col("rank").alias("value"))
        got = times(matrix, vector, small=variant == "row" and n <= SMALL_VECTOR).withColumnRenamed("row_id", "page_id")
        ranks, mass = _next(ranks, got, "page_id", n, damping, mass)
    return ranks.join(pages, "page_id").select("page", "rank")
