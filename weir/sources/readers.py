"""Text sources: lines, readings in comma-separated lines, and crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fields, is_page_name, number, repaired


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """All lines of the files, blank ones too. Paths may be globs; compressed files (.bz2, .gz) are known by their
    endings, and bz2 is split among tasks."""
    return spark.read.text(list(paths))


def table(spark: SparkSession, *paths: str) -> DataFrame:
    """Intermediate results, as written by sinks.table."""
    return spark.read.parquet(*paths)


def readings(text: DataFrame, kind: str = "int", strict: bool = True) -> DataFrame:
    """From lines station,date,element,value[,...]: lines of fewer than four fields (trailing empty ones don't
    count) are left out. strict: a value that is no number fails the job; else it is null."""
    parts = text.select(fields(F.col("value")).alias("f")).where(F.size("f") >= 4)
    return parts.select(
        F.col("f")[0].alias("station"), F.col("f")[1].alias("date"), F.col("f")[2].alias("element"), number(F.col("f")[3], kind, strict).alias("value")
    )


def elements(rows: DataFrame, *wanted: str) -> DataFrame:
    """Readings of the wanted elements, by their exact names."""
    return rows.where(F.col("element").isin(*wanted))


def pages(text: DataFrame) -> DataFrame:
    """From lines name:html, split at the first colon: page and repaired html. A line without a colon fails the job;
    names that are empty or hold a tilde are left out."""
    colon = F.locate(":", F.col("value"))
    checked = F.when(colon > 0, colon).otherwise(F.raise_error(F.concat(F.lit("no colon in the line "), F.substring("value", 1, 80))).cast("int"))
    split = text.select(F.col("value"), checked.alias("at")).selectExpr("substring(value, 1, at - 1) AS page", "substring(value, at + 1) AS html")
    return split.where(is_page_name(F.col("page"))).select("page", repaired(F.col("html")).alias("html"))
