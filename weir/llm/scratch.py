"""Written intermediate tables in the folder that the driver and every executor share.

Operators cut lineage by writing a table and reading it again: a lost executor then costs a re-read,
never a recomputation of the whole chain.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import remove, ship, work_dir
from . import bytesops as B

BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def prepare(spark: SparkSession) -> None:
    """For operators that run Python on executors: the package is sent there, and rows go to Python in batches of at
    most 8 MB, however long they are (a smaller bound of the session stays)."""
    ship(spark)
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH:
        spark.conf.set(BATCH_BYTES, str(BATCH))


def quoted(name: str) -> str:
    """The name of a column as an expression has it, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def columns(names: list[str]) -> list[Column]:
    return [column(c) for c in names]


def without(docs: DataFrame, *names: str) -> list[str]:
    """docs' columns but those of these names (in any case)."""
    gone = {n.lower() for n in names}
    return [c for c in docs.columns if c.lower() not in gone]


def unused(names: list[str], wanted: str) -> str:
    """A name for an inner column beside columns of these names: the wanted one, lengthened while it is taken."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def mapped(docs: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """docs.mapInArrow(run, schema) for columns of any name: they go to Python as the fields of one column."""
    names = docs.columns

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.column(0).flatten(), names=names)

    return docs.select(F.struct(*columns(names)).alias("row")).mapInArrow(B.released(lambda batches: run(unpacked(batches))), schema)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: one scan of their column, without Python."""
    return int(docs.agg(F.sum(F.octet_length(column(text_col).cast("string")))).first()[0] or 0)


class Scratch:
    """One run's folder of intermediate tables. Operators drop tables that nothing reads any more; what a result still
    reads stays until the application ends (runtime.work_dir)."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        prepare(spark)
        self.path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns the written table."""
        schema = df.schema
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        del df
        self._release()
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def save_by(self, df: DataFrame, name: str, keys: list[str]) -> DataFrame:
        """The same, dealt into buckets by keys, as many as the session's shuffle partitions: joins and aggregates by
        these keys read the table without shuffling it."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"weir_{uuid.uuid4().hex}"
        dealt = df.repartition(buckets, *columns(keys))
        del df
        dealt.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", f"{self.path}/{name}").saveAsTable(table)
        del dealt
        self._release()
        found = self.spark.table(table)
        found.schema  # resolved: what reads it needs the files and no longer the name
        self.spark.sql(f"DROP TABLE {table}")
        return found

    def _release(self) -> None:
        """What was shuffled for a table is garbage once the table is written. Executors keep those files until the
        driver's JVM has collected the plan that made them, so it is asked to."""
        gc.collect(0)
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Removes these tables, or else the whole folder."""
        for at in [f"{self.path}/{name}" for name in names] or [self.path]:
            remove(self.spark, at)

    def keep(self, *names: str) -> None:
        """Removes all tables but these, which a result that is not computed yet reads."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        found = [x.getPath().getName() for x in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)]
        if gone := set(found) - set(names):
            self.drop(*sorted(gone))
