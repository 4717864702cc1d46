"""Text and table sinks."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_text(df: DataFrame, key: Column, value: Column, path: str) -> None:
    """Lines of key, tab, value."""
    df.select(F.concat(key.cast("string"), F.lit("\t"), value.cast("string"))).write.text(path)


def value_text(df: DataFrame, line: Column, path: str, compression: str = "none") -> None:
    """One line for each row."""
    df.select(line.alias("value")).write.option("compression", compression).text(path)


def single_text(df: DataFrame, line: Column, path: str) -> None:
    """One file of lines, in df's order: for results that are small by their nature, such as a top-k."""
    df.select(line.alias("value")).coalesce(1).write.text(path)


def table(df: DataFrame, path: str) -> None:
    """An intermediate result, for readers.table."""
    df.write.parquet(path)


def many(tables: dict[str, DataFrame], folder: str) -> None:
    """Several named results side by side."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")


def log_name(now: datetime.datetime) -> str:
    """A name by the minute, with twelve hours."""
    return now.strftime("%Y_%m_%d_%I_%M")


def timing_lines(runs: list[float]) -> list[str]:
    """The mean, the least and the greatest of run times in milliseconds."""
    # The words of these lines.
    named = (("Average", sum(runs) / len(runs)), ("Minimum", min(runs)), ("Maximum", max(runs)))
    return [f"{name} Running Time:{float(value)} ms" for name, value in named]


def station_log(means: DataFrame, folder: str, now: datetime.datetime, runs: list[float] | None = None) -> str:
    """station|mean lines in a folder named by the time, and then, if run times are given, their three lines in a file
    of their own; returns the folder's path."""
    path = f"{folder}/{log_name(now)}"
    means.select(F.concat_ws("|", "station", F.col("mean").cast("string"))).write.text(path)
    if runs:
        lines = means.sparkSession.createDataFrame([(x,) for x in timing_lines(runs)], "value string")
        lines.coalesce(1).write.mode("append").text(path)
    return path
