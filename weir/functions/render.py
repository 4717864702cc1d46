"""Rows as lines of text, as result files have them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named_rank(page: Column, rank: Column) -> Column:
    """page:rank with fifteen decimals."""
    return F.format_string("%s:%.15f", page, rank)


def rank_named(rank: Column, page: Column) -> Column:
    return F.concat(rank.cast("string"), F.lit(":"), page)


def pair(rank: Column, page: Column) -> Column:
    return F.concat(F.lit("("), rank.cast("string"), F.lit(","), page, F.lit(")"))


def or_null(value: Column) -> Column:
    """A number as text, and the word null for none."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def means_line(station: Column, tmin: Column, tmax: Column) -> Column:
    return F.concat_ws(", ", station, or_null(tmin), or_null(tmax))


def series_line(station: Column, series: Column) -> Column:
    """station, [(year, mean, mean), ...], where a missing mean is 0 but in the last year, which has null."""
    last = F.size(series) - 1

    def entry(x: Column, i: Column) -> Column:
        parts = [F.when(x[m].isNotNull(), x[m].cast("string")).when(i == last, "null").otherwise("0") for m in ("mean_tmin", "mean_tmax")]
        return F.concat(F.lit("("), F.concat_ws(", ", x["year"], *parts), F.lit(")"))

    return F.concat(station, F.lit(", ["), F.array_join(F.transform(series, entry), ", "), F.lit("]"))


def bar_line(station: Column, mean: Column) -> Column:
    return F.concat_ws("|", station, mean.cast("string"))


def adjacency_line(page: Column, links: Column) -> Column:
    """page~~a, b, c; split again by split_adjacency."""
    return F.concat(page, F.lit("~~"), F.array_join(links, ", "))


def split_adjacency(line: Column) -> tuple[Column, Column]:
    """Page and links. A link whose name holds a comma and a space comes back as two."""
    rest = F.substring_index(line, "~~", -1)
    return F.substring_index(line, "~~", 1), F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, ", "))
