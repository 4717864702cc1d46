"""Row shapes that sources and operators agree on."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _shape(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


LINE = _shape(value=StringType())
#: A reading of a station: the day as yyyymmdd text, the element it measures and its value.
READING = _shape(station=StringType(), date=StringType(), element=StringType(), value=IntegerType())
PAGE_LINE = _shape(page=StringType(), html=StringType())
#: A crawled page and its outlinks, in document order and with repeats.
PAGE_LINKS = _shape(page=StringType(), links=ArrayType(StringType()))
#: A link; repeats are separate rows.
EDGE = _shape(src=StringType(), dst=StringType())
NODE = _shape(page=StringType(), out_degree=LongType(), dangling=BooleanType())
RANK = _shape(page=StringType(), rank=DoubleType())
DICTIONARY = _shape(page_id=LongType(), page=StringType())
#: An entry of a sparse matrix.
ENTRY = _shape(row_id=LongType(), col_id=LongType(), weight=DoubleType())
