"""Which hashes of a corpus several places have, and how often: the exchange that the dedup operators share.

Documents are gathered into blocks. A block sends each of its distinct hashes once, with how often it has it, to the
bucket that counts that hash, and the bucket answers the block only for hashes that occur more than once. So a passage
that every document has costs a bucket one entry for each block, not one for each document, and an answer is as long
as what the block shares. Which places of the block have which of its hashes goes along with the block itself, to
where its answers are put together. All travels as packed arrays, never a row for each hash.

Hashes are compared by all their 64 bits. A bucket is a range of them: those that are sent are ascending, so their
high 16 bits are written as one bit for each hash and for each step, and only their low 48 bits in full. There are as
many buckets as the corpus needs for each to hold about BUCKET_HASHES, and one for each shuffle partition at least;
each is a partition by itself. Blocks are put together in as many partitions, so neither grows with the corpus.

Defined cases: documents without hashes have no bits; an empty table has no blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B

#: A block is closed when it has so many hashes; a longer document is a block by itself.
BLOCK_HASHES = 1 << 20
#: About so many hashes are counted in one task.
BUCKET_HASHES = 2 << 20
_LOW = np.uint64((1 << 48) - 1)
_ROWS = "block long, kind int, n int, start int, payload binary"


def buckets_of(spark: SparkSession, hashes: int) -> int:
    """For about so many hashes in all."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-hashes // BUCKET_HASHES))


def bounds_of(buckets: int) -> np.ndarray:
    """The least hash of each bucket but the first."""
    return np.array([-(-(b << 32) // buckets) << 32 for b in range(1, buckets)], np.uint64)


def pack(ascending: np.ndarray) -> bytes:
    """Ascending hashes: the high 16 bits of the first, a bit for each step of them and one for each hash, and the low
    48 bits of each."""
    high = (ascending >> np.uint64(48)).astype(np.int64)
    bits = np.zeros(int(high[-1] - high[0]) + len(high), np.uint8)
    bits[high - high[0] + np.arange(len(high))] = 1
    low = (ascending & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + ((ascending >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2").tobytes()
    return low + np.uint16(high[0]).tobytes() + np.packbits(bits).tobytes()


def unpack(data: memoryview, n: int) -> np.ndarray:
    first = int(np.frombuffer(data, "<u2", 1, 6 * n)[0])
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=6 * n + 2))
    high = np.flatnonzero(bits)[:n] - np.arange(n) + first
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | (np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)) | (high.astype(np.uint64) << np.uint64(48))


def _batch(rows: list[tuple], first: str) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    names = ["block", "kind", "n", "start", "payload"]
    if first:
        kinds, names = (pa.int32(), *kinds), [first, *names]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)


def _sent(number: int, header: bytes, hashes: np.ndarray, places: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """A block: itself (its header, which places are a hash's first, the places in the order of their hashes), and a
    row for each bucket that it has hashes of."""
    n = len(hashes)
    order = np.argsort(hashes, kind="stable").astype(np.uint32)
    ranked, places = hashes[order], places[order]
    del hashes, order
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if n else np.zeros(0, bool)
    first = np.flatnonzero(new)
    distinct, times = ranked[first], np.minimum(np.diff(np.append(first, n)), 255).astype(np.uint8)
    del ranked, first
    out = [(number % (len(bounds) + 1), number, 1, len(header), n, header + np.packbits(new).tobytes() + places.tobytes())]
    cut = np.concatenate([[0], np.searchsorted(distinct, bounds), [len(distinct)]])
    for b in np.flatnonzero(np.diff(cut)).tolist():
        x, y = int(cut[b]), int(cut[b + 1])
        out.append((b, number, 0, y - x, x, times[x:y].tobytes() + pack(distinct[x:y])))
    return _batch(out, "bucket")


def _counted(table: list[tuple[int, int, int, memoryview]], with_keys: bool) -> list[tuple]:
    """One bucket's rows: for each block a bit for each of its hashes, set where that occurs more than once, and
    with_keys how frequent those are, in eighths of doublings, and the hashes themselves."""
    keys = np.concatenate([np.zeros(0, np.uint64), *(unpack(p[n:], n) for _, n, _, p in table)])
    times = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(p, np.uint8, n) for _, n, _, p in table)])
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = np.add.reduceat(times[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    level = np.minimum(255, 1 + 8 * np.log2(np.maximum(total, 1))).astype(np.uint8) * (total > 1)
    levels = np.empty(len(keys), np.uint8)
    levels[order] = np.repeat(level, np.diff(np.append(first, len(keys))))
    out, at = [], 0
    for block, n, start, _ in table:
        some = levels[at : at + n] > 0
        if some.any():
            answer = np.packbits(some).tobytes()
            if with_keys:
                answer += levels[at : at + n][some].tobytes() + pack(keys[at : at + n][some])
            out.append((block, 0, n, start, answer))
        at += n
    return out


def exchanged(docs: DataFrame, hashes: int, blocks: Callable, place: str, with_keys: bool, settled: Callable, schema: str) -> DataFrame:
    """hashes: about how many there are in all. blocks: from batches of docs, an iterator of (header, hashes, places):
    bytes that the block needs in the end, its hashes, and for each its place, an array of numpy type `place`. settled: from a
    block's header and the places of its shared hashes (and with_keys the hash and frequency of each), an Arrow table
    of the schema."""
    bounds = bounds_of(buckets_of(docs.sparkSession, hashes))
    kind = np.dtype(place)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        for block in blocks(batches):
            yield _sent(number, *block, bounds)
            number += 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: list[tuple] = []
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(1, 5)), (memoryview(x.as_buffer()) for x in batch.column(5)), strict=True))
            table += [(block, n, start, p) for block, kind_, n, start, p in rows if not kind_]
            if through := [(block, 1, n, start, bytes(p)) for block, kind_, n, start, p in rows if kind_]:
                yield _batch(through, "")
        yield _batch(_counted(table, with_keys), "")

    def settle(table: pa.Table) -> pa.Table:
        header, first, places = b"", np.zeros(0, np.int64), np.zeros(0, kind)
        at, keys, levels = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for kind_, n, start, payload in zip(*(table[c].to_pylist() for c in ("kind", "n", "start")), table["payload"], strict=True):
            p = memoryview(payload.as_buffer())
            if kind_:
                header, size = bytes(p[:n]), -(-start // 8)
                first = np.flatnonzero(np.unpackbits(np.frombuffer(p, np.uint8, size, n), count=start))
                places = np.frombuffer(p[n + size :], kind)
            else:
                size = -(-n // 8)
                at.append(np.flatnonzero(np.unpackbits(np.frombuffer(p, np.uint8, size), count=n)) + start)
                if with_keys:
                    levels.append(np.frombuffer(p, np.uint8, len(at[-1]), size))
                    keys.append(unpack(p[size + len(at[-1]) :], len(at[-1])))
        shared, key, level = np.concatenate(at), np.concatenate(keys), np.concatenate(levels)
        times = np.diff(np.append(first, len(places)))[shared] if len(shared) else shared
        source = np.repeat(first[shared] - (np.cumsum(times) - times), times) + np.arange(times.sum()) if len(shared) else shared
        return settled(header, places[source], np.repeat(key, times) if with_keys else None, np.repeat(level, times) if with_keys else None)

    return (
        docs.mapInArrow(B.released(deal), f"bucket int, {_ROWS}")
        .repartitionById(len(bounds) + 1, F.col("bucket"))
        .mapInArrow(B.released(count), _ROWS)
        .repartition(len(bounds) + 1, "block")
        .groupBy("block")
        .applyInArrow(B.released_group(settle), schema)
    )


def shared(docs: DataFrame, hashes_of: Callable[[np.ndarray], np.ndarray], hashes: int) -> DataFrame:
    """docs: two long columns that name a document, and its text. hashes_of: a text's hashes, in order; hashes: about
    how many all texts have. Returns the two columns and bits, for each document with a shared hash: one bit for each
    hash, packed, first hash first."""
    names = docs.columns[:2]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids: list[tuple[int, int]] = []
        found: list[np.ndarray] = []
        total = 0

        def closed() -> tuple:
            header = np.array(ids, np.int64).tobytes() + np.array([len(x) for x in found], np.int32).tobytes()
            return header, np.concatenate(found), np.arange(total, dtype=np.uint32)

        for batch in batches:
            for a, b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), B.rows(batch.column(2)), strict=True):
                here = hashes_of(data)
                if len(here):
                    ids.append((a, b))
                    found.append(here)
                    total += len(here)
                    if total >= BLOCK_HASHES:
                        block = closed()
                        ids, found, total = [], [], 0
                        yield block
                        del block
        if ids:
            yield closed()

    def settled(header: bytes, places: np.ndarray, *_) -> pa.Table:
        n = len(header) // 20
        named, sizes = np.frombuffer(header, np.int64, 2 * n).reshape(-1, 2), np.frombuffer(header, np.int32, n, 16 * n)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        bits = np.zeros(bounds[-1], bool)
        bits[places] = True
        some = np.flatnonzero(np.add.reduceat(bits, bounds[:-1])) if n else np.zeros(0, int)
        packed = [np.packbits(bits[bounds[r] : bounds[r + 1]]).tobytes() for r in some.tolist()]
        return pa.Table.from_arrays([pa.array(named[some, 0]), pa.array(named[some, 1]), pa.array(packed, pa.binary())], names=[*names, "bits"])

    return exchanged(docs, hashes, blocks, "<u4", False, settled, f"{names[0]} long, {names[1]} long, bits binary")
