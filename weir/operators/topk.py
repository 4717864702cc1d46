"""Top-k by rank: each task keeps its best k, one task merges those. Ties go to the later name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top(ranks: DataFrame, k: int = 100, by: str = "rank", tie: str = "page") -> DataFrame:
    return ranks.orderBy(F.desc(by), F.desc(tie)).limit(k)


def top_named(ranks: DataFrame, pages: DataFrame, k: int = 100) -> DataFrame:
    """From (page_id, rank): the k best ids, then their names, k rows being sent to the dictionary."""
    best = F.broadcast(top(ranks, k, tie="page_id"))
    return pages.join(best, "page_id").select("page_id", "page", "rank").orderBy(F.desc("rank"), F.desc("page_id"))
