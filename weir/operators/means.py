"""Counts, means and series of groups. Each is one declarative aggregation: rows are combined per task before the
shuffle, sums of integers are 64-bit, and a mean of nothing is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS, measure, year_of


def word_count(df: DataFrame, text: str = "value") -> DataFrame:
    """(word, cnt)."""
    # Empty words go after the explode: a filter over rows is compiled, one over an array is not.
    return df.select(F.explode(F.split(F.col(text), BLANKS)).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("cnt"))


def group_values(df: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """Each group's values as a list, in no order. For groups that fit a row; means need no list."""
    return df.groupBy(*keys).agg(F.collect_list(value).alias("values"))


def list_mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def group_mean(df: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"))


def conditional_means(df: DataFrame, *keys: str, of: dict[str, str], element: str = "element", value: str = "value") -> DataFrame:
    """of: for each result column the element that it is the mean of. Rows of other elements don't count, and groups
    of those alone are absent; a group without one of the elements has null there."""
    wanted = df.where(F.col(element).isin(*of.values()))
    return wanted.groupBy(*keys).agg(*(F.avg(measure(F.col(element), name, F.col(value))).alias(c) for c, name in of.items()))


def partial_means(df: DataFrame, *keys: str, of: dict[str, str], element: str = "element", value: str = "value") -> DataFrame:
    """What conditional_means adds up: for each column its sum and count. Results of several inputs, united, go
    through merged_means."""
    out = []
    for c, name in of.items():
        m = measure(F.col(element), name, F.col(value))
        out += [F.coalesce(F.sum(m), F.lit(0)).alias(f"{c}_sum"), F.count(m).alias(f"{c}_cnt")]
    return df.where(F.col(element).isin(*of.values())).groupBy(*keys).agg(*out)


def merged_means(partials: DataFrame, *keys: str, columns: tuple[str, ...]) -> DataFrame:
    return partials.groupBy(*keys).agg(*(F.try_divide(F.sum(f"{c}_sum").cast("double"), F.sum(f"{c}_cnt")).alias(c) for c in columns))


def yearly_means(df: DataFrame, of: dict[str, str], station: str = "station", year: Column | None = None, element: str = "element", value: str = "value") -> DataFrame:
    """(station, year, means): a row for each station and year."""
    year = year_of(F.col("date")) if year is None else year
    return conditional_means(df.withColumn("year", year), station, "year", of=of, element=element, value=value)


def series(yearly: DataFrame, station: str = "station") -> DataFrame:
    """(station, series): a station's years in order, as an array. Years are few, stations many."""
    rest = [c for c in yearly.columns if c != station]
    return yearly.groupBy(station).agg(F.array_sort(F.collect_list(F.struct("year", *(c for c in rest if c != "year")))).alias("series"))


def zero_filled(yearly: DataFrame, columns: tuple[str, ...], station: str = "station") -> DataFrame:
    """Missing means are 0 in every year but a station's last, where they stay null."""
    last = yearly.groupBy(station).agg(F.max("year").alias("last_year"))
    filled = [F.when((F.col("year") < F.col("last_year")) & F.col(c).isNull(), F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in columns]
    rest = [c for c in yearly.columns if c not in columns]
    return yearly.join(last, station).select(*rest, *filled)


def partitioned_by_station(df: DataFrame, parts: int, station: str = "station") -> DataFrame:
    """Rows of a station in one partition, by station and year: what readers of sorted groups need."""
    return df.repartition(parts, station).sortWithinPartitions(station, "year")
