"""Exact dedup against a persistent digest index, with DataFrame operations only.

The index is a Parquet table of one row per distinct text, bucketed and sorted by its SHA-256 digest, so a batch
joins it by sort-merge without shuffling the index. A batch costs one scan of its texts; only 32-byte digests are
shuffled, and copies are counted before the shuffle, so a group of any size arrives as one row per task.

The number of buckets is stored beside the index when it is made; who opens it later gets that number, whatever they
ask for. Readers take the smallest keep_id of a digest, so a digest that stands in it twice does no harm: a batch that
is run again after its append was cut short gives the same result and adds only what was missing. One writer at a time
sees all that came before; of two at once, both keep their own first copies, and later batches see the smaller id.
Each batch adds a file to each bucket it has new digests for; compacted() makes an index of one file a bucket again,
and of more buckets if they have become large.

Defined cases: a null text counts as empty; texts differing only in runs of ASCII white space are equal; a null id
sorts after every other id and is the keeper only where its group has no other; rows that repeat id and text are
copies like any others (each is returned, and counted in group_size); an empty table gives an empty result. Columns
besides the id and the text are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, column

#: Runs of white space that are not already one plain space.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), UNEVEN_SPACE, " ")


class DigestIndex:
    """Digests of all texts seen so far: (digest binary, keep_id bigint), bucketed and sorted by digest.

    path: a folder all executors share; an index already there is opened, with its own number of buckets, and goes on
    growing. buckets: of a new index, as the number of tasks that a merge with it takes; some million digests a bucket
    are fine (buckets_for).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path
        self.buckets = self._stored() or self._store(buckets)
        self.table = f"weir_digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet OPTIONS (path '{path}') "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )

    def _stored(self) -> int | None:
        """What _store() wrote: its name begins with a line, so it is no part of the table."""
        try:
            return self.spark.read.schema("buckets int").parquet(f"{self.path}/_buckets").first()[0]
        except AnalysisException:
            return None

    def _store(self, buckets: int) -> int:
        self.spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{self.path}/_buckets")
        return buckets

    def read(self) -> DataFrame:
        """One row for each digest; the buckets spare it the shuffle."""
        return self.spark.table(self.table).groupBy("digest").agg(F.min("keep_id").alias("keep_id"))

    def close(self) -> None:
        """Takes the index off the session's catalog; its files stay, to be opened again by their path."""
        self.spark.sql(f"DROP TABLE {self.table}")

    def compacted(self, path: str, buckets: int | None = None) -> DigestIndex:
        """A new index with the same digests, one file a bucket."""
        made = DigestIndex(self.spark, path, buckets or self.buckets)
        made._append(self.read())
        return made

    def _append(self, new: DataFrame) -> None:
        (
            new.select("digest", "keep_id")
            .repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .format("parquet")
            .option("path", self.path)
            .saveAsTable(self.table)
        )

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds docs' new texts to the index. Returns for each row of docs: doc_id, keep_id, group_size (rows of
        this batch with that text), kept, text_sha256."""
        scratch = Scratch(self.spark, "exact-dedup")
        digests = scratch.save(
            docs.select(
                column(id_col).cast("long").alias("doc_id"),
                F.unhex(F.sha2(normalised(column(text_col)), 256)).alias("digest"),
            ),
            "digests",
        )
        classes = scratch.save(
            digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")),
            "classes",
        )
        new = classes.hint("merge").join(self.read(), "digest", "left_anti")
        self._append(new.select("digest", F.col("first_id").alias("keep_id")))
        # Only texts with copies, here or in the index, need the join back.
        copied = scratch.save(
            classes.hint("merge")
            .join(self.read(), "digest")
            .where((F.col("group_size") > 1) | ~F.col("keep_id").eqNullSafe(F.col("first_id")))
            .select("digest", "keep_id", "group_size", F.lit(True).alias("copied")),
            "copied",
        )
        scratch.keep("digests", "copied")
        return (
            digests.join(copied, "digest", "left")
            .withColumn("keep_id", F.when(F.col("copied"), F.col("keep_id")).otherwise(F.col("doc_id")))
            .select(
                "doc_id",
                "keep_id",
                F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                F.lower(F.hex("digest")).alias("text_sha256"),
            )
        )


def buckets_for(spark: SparkSession, texts: int, a_bucket: int = 2_000_000) -> int:
    """So many that a bucket has no more digests than that, and each shuffle partition has one to work on."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-texts // a_bucket))


def dedup_in_batches(index: DigestIndex, batches: list[DataFrame]) -> DataFrame:
    """dedup() of one batch after the other, each against what the index has by then; group_size counts the rows of all
    batches. Where the batches' ids ascend, the smallest id of each text stays."""
    scratch = Scratch(index.spark, "exact-batches")
    found = [scratch.save(index.dedup(batch), f"batch-{k}") for k, batch in enumerate(batches)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    if len(found) == 1:
        return rows
    # Counted within each task before the shuffle; only texts with copies are joined back, one row against many.
    sizes = rows.groupBy("text_sha256").agg(F.count("*").alias("whole")).where("whole > 1")
    sizes = scratch.save(sizes, "sizes")
    return rows.join(sizes, "text_sha256", "left").select("doc_id", "keep_id", F.coalesce("whole", "group_size").alias("group_size"), "kept", "text_sha256")
