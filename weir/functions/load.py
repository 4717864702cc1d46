"""A made-up load for benchmarks: it costs time for each row and changes no result."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship


def fibonacci(n: int) -> int:
    return n if n < 2 else fibonacci(n - 1) + fibonacci(n - 2)


def fib(spark: SparkSession, n: Column) -> Column:
    ship(spark)
    return F.pandas_udf(lambda s: s.map(fibonacci).astype("int64"), "long")(n)
