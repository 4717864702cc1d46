"""Token-id files: flat unsigned integers with 64-bit document offsets, read back through memory maps.

A set of files is a folder with, for each shard of ascending ids,

    shard-00000.ids    the token ids of its documents, one after the other, little-endian, 16 bits wide where the
                       vocabulary fits and else 32
    shard-00000.ends   for each document the ids up to and with it in this shard, 64 bits, little-endian
    shard-00000.docs   the documents' ids, 64 bits signed, little-endian

and manifest.json, which holds the width and each shard's name, number of documents and ids, and base: the number of
ids in all shards before it, from a prefix sum over the shards' counts. A document's place in the whole corpus is
its shard's base plus its local offset, so no shard is written twice.

Texts are range-partitioned and sorted by id, so shards follow each other in ascending id order. Each shard is
written under a name of the attempt and then renamed: a task that runs again or twice leaves one whole file.

Words are encoded once: the tokenizer's own pre-tokenizer never merges across the bounds that it sets, so a text's ids
are its words' ids in a row. Each worker finds the words of a batch as arrays and asks the tokenizer only for those
it has not met.

Defined cases: a null text counts as empty; each document, an empty one too, ends with `end_id`; rows that repeat an
id follow each other by text; a null id sorts first and is written as the smallest 64-bit number; an empty table
makes an empty set of files; columns besides id and text are not read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from . import pretoken
from .scratch import column, prepare

WIDTHS = {2: np.dtype("<u2"), 4: np.dtype("<u4")}
NO_ID = -(1 << 63)
#: Texts are encoded in groups of about this many bytes.
GROUP_BYTES = 1 << 20


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _put(fs: pafs.FileSystem, path: str, data: bytes | memoryview) -> None:
    with fs.open_output_stream(path) as out:
        out.write(data)


class ShardWriter:
    """Writes one shard under a temporary name; close() gives it its own."""

    def __init__(self, folder: str, name: str, width: int):
        self.fs, self.folder = open_fs(folder)
        self.name, self.kind = name, WIDTHS[width]
        self.attempt = f"{self.folder}/.{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{self.attempt}.ids")
        self.docs: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """ends: for each document the ids up to and with it, from the first of this call."""
        self.out.write(np.ascontiguousarray(ids, self.kind).data)
        self.docs.append(doc_ids.astype("<i8"))
        self.ends.append(ends.astype("<u8") + np.uint64(self.n))
        self.n += len(ids)

    def close(self) -> tuple[int, int]:
        self.out.close()
        docs = np.concatenate([np.zeros(0, "<i8"), *self.docs])
        _put(self.fs, f"{self.attempt}.ends", np.concatenate([np.zeros(0, "<u8"), *self.ends]).tobytes())
        _put(self.fs, f"{self.attempt}.docs", docs.tobytes())
        for kind in ("ids", "ends", "docs"):
            self.fs.move(f"{self.attempt}.{kind}", f"{self.folder}/{self.name}.{kind}")
        return len(docs), self.n


class Shard:
    """One shard, mapped into memory where its folder is a local one and else read."""

    def __init__(self, folder: str, name: str, width: int):
        fs, at = open_fs(folder)
        self.ids, self.ends, self.docs = (self._map(fs, f"{at}/{name}.{k}", d) for k, d in (("ids", WIDTHS[width]), ("ends", np.dtype("<u8")), ("docs", np.dtype("<i8"))))

    @staticmethod
    def _map(fs: pafs.FileSystem, path: str, kind: np.dtype) -> np.ndarray:
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read_buffer(), kind)

    def __len__(self) -> int:
        return len(self.docs)

    def bounds(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int64), self.ends.astype(np.int64)])


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encodes all texts and writes the set of files; returns its manifest. folder: one that all executors share.
    shards: at most so many (the session's shuffle partitions, if not given)."""
    spark = docs.sparkSession
    prepare(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, at = open_fs(folder)
    fs.create_dir(at, recursive=True)
    width = 2 if max(pretoken.vocabulary_size(tokenizer) - 1, end_id) < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = pretoken.encoder(tokenizer)
        part = TaskContext.get().partitionId()
        name, writer = f"shard-{part:05d}", None
        for batch in batches:
            doc_ids = batch.column(0).fill_null(NO_ID).to_numpy()
            data, offsets = B.utf8(batch.column(1))
            first = 0
            while first < len(doc_ids):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + GROUP_BYTES, "right")) - 1)
                writer = writer or ShardWriter(folder, name, width)
                writer.add(doc_ids[first:last], *encoder.encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], end_id))
                first = last
        if writer:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "shard": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    ordered = (
        docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
        .repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    # One row for each shard, of four small columns.
    counts = sorted(ordered.mapInArrow(B.released(run), "part long, shard string, n_docs long, n_ids long").collect(), key=lambda r: r.part)
    base, listed = 0, []
    for r in counts:
        listed.append({"shard": r.shard, "n_docs": r.n_docs, "n_ids": r.n_ids, "base": base})
        base += r.n_ids
    manifest = {"width": width, "n_ids": base, "shards": listed}
    _put(fs, f"{at}/manifest.json", json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    fs, at = open_fs(folder)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        return json.loads(f.read())


def documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, and
    with with_ids its ids."""
    prepare(spark)
    manifest = read_manifest(folder)
    width = manifest["width"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(folder, name, width)
                bounds = shard.bounds()
                for first in range(0, len(shard), 1000):
                    last = min(first + 1000, len(shard))
                    each = [shard.ids[a:b].astype("<u4") for a, b in zip(bounds[first:last].tolist(), bounds[first + 1 : last + 1].tolist(), strict=True)]
                    ids = shard.docs[first:last]
                    out = [pa.array(ids, mask=ids == NO_ID), pa.array(bounds[first:last] + base), pa.array(np.diff(bounds[first : last + 1])), pa.array([zlib.crc32(x.data) for x in each], pa.int64())]
                    if with_ids:
                        out.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    shards = spark.createDataFrame([(s["shard"], s["base"]) for s in manifest["shards"]], "shard string, base long")
    return shards.repartition(max(1, len(manifest["shards"]))).mapInArrow(B.released(run), schema)
