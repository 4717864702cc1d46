"""Suffix-array dedup: bytes covered by a string of `length` bytes that starts earlier in the corpus are removed.

Suffix arrays of a whole corpus would hold `length` bytes of context for every place, or need every shard of text to
meet every other. Here texts meet only where they share something, and arrays are built of those stretches:

1. Of every window of `length` bytes the leftmost smallest hash of its substrings of `gram` bytes is its anchor, so
   equal windows have equal anchors at equal places. Documents learn which of their anchors are shared (sharing.py).
2. A shared anchor's stretch is the text of all windows that have it. Equal stretches of one anchor are one class;
   every stretch but the class's first repeats it as a whole.
3. The classes of an anchor with several are dealt to shards by anchor. A shard's text gets a suffix array by induced
   sorting and its permuted common prefixes; a run of suffixes with `length` bytes in common is one string, and of its
   windows all but the earliest are repeats.
4. Repeats cover their bytes, overlaps and all; the rest of each text stays.

Every window has one anchor, and thus one stretch, so each is judged once, against all its equals. Texts are dealt
once into buckets that all steps read; what is shuffled after that are anchors' hashes, digests of stretches, and the
bytes of the first stretch of each class of those anchors that have several. Classes are dealt to shards of about
`shard_bytes`. An anchor with more
than `most_classes` classes (a common line in ever new surroundings) is not put into one shard: each of its windows is
keyed by its own digest, and the smallest place of each key found by an aggregate, which no hot anchor can overload.

Matches never cross documents, "earlier" is the smaller document id, or in one document the earlier start, and
windows are judged on the input, not on what is left.

Defined cases: null counts as empty; texts shorter than `length` lose nothing; rows that repeat id and text are one
document (each gets its result, none counts as earlier than another); rows that repeat an id with other texts are
ordered by a hash of the text; a null id sorts first. Removal is of bytes, so what is left of a text need not be UTF-8.
Columns that the operator adds replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .scratch import Scratch, column, columns, text_bytes, without
from .sharing import shared
from .suffix_array import common_prefixes, suffix_array

ID, HASH = "weir_id", "weir_hash"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
#: Places in a stretch of bytes fit in so many bits.
PLACE_BITS = 20
assert B.STRETCH < 1 << PLACE_BITS
#: Bytes of the text, the removed runs of them, and what is left.
ADDED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("removed", SPANS), T.StructField("kept_sha256", T.StringType())])


class Anchors:
    """The anchors of a text's windows of `length` bytes."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchors' hashes, and each anchor's first and last window."""
        n = len(data) - self.length + 1
        least, at, first = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, n, B.STRETCH):
            for found, part in zip((least, at, first), self._stretch(data[a : min(n, a + B.STRETCH) + self.length - 1]), strict=True):
                found.append(part if found is least else part + a)
        where = np.concatenate(at)
        new = np.flatnonzero(np.diff(where, prepend=-1))  # an anchor may go on in the next stretch
        starts = np.concatenate(first)[new]
        return np.concatenate(least)[new], starts, np.append(starts[1:], n)[: len(starts)] - 1

    def _stretch(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hash, place and first window of each anchor of a stretch of bytes."""
        grams = B.windows(B.prefix_sums(B.SYMBOL[data]), self.gram)
        # The hash's high bits and the place as one number: the smallest is the leftmost of the smallest hashes.
        bits = np.uint64(PLACE_BITS)  # the same in every stretch, so that equal windows have equal anchors
        least, have = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), 1
        width = self.length - self.gram + 1
        while have < width:
            step = min(have, width - have)
            least, have = np.minimum(least[: len(least) - step], least[step:]), have + step
        at = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        return grams[at[first]], at[first], first

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Anchors are the smallest hashes of their windows; mixed anew, they lie evenly among all."""
        return B.mix(self.find(data)[0])


def _runs_of(places: np.ndarray) -> list[tuple[int, int]]:
    """Ascending places as (first, how many) of their runs."""
    if not len(places):
        return []
    first = np.flatnonzero(np.diff(places, prepend=places[0] - 2) != 1)
    return list(zip(places[first].tolist(), np.diff(np.append(first, len(places))).tolist(), strict=True))


def _index(anchors: Anchors):
    """From ID, HASH, text, bits: a row for each stretch of a shared anchor, with a digest of its bytes. Windows that
    the same text has earlier repeat them for certain; their rows have no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = anchors.length
        for batch in batches:
            anchor, digests, start, windows, counts = [], [], [], [], []
            for data, bits in zip(B.rows(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                keys, first, last = anchors.find(data)
                live = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(keys)))
                raw, met, before = data.tobytes(), set(), len(start)
                open_ = -1  # where the run of repeats that the last row has would go on
                for key, a, b in zip(keys[live].view(np.int64).tolist(), first[live].tolist(), last[live].tolist(), strict=True):
                    digest = blake2b(raw[a : b + length], digest_size=16).digest()
                    if digest not in met:
                        met.add(digest)
                        open_ = -1
                    elif open_ == a:
                        windows[-1] += b - a + 1
                        open_ = b + 1
                        continue
                    else:
                        key = digest = None
                        open_ = b + 1
                    anchor.append(key)
                    digests.append(digest)
                    start.append(a)
                    windows.append(b - a + 1)
                counts.append(len(start) - before)
            named = [pa.array(np.repeat(batch.column(i).to_numpy(), counts)) for i in (0, 1)]
            rest = [pa.array(x, k) for x, k in ((anchor, pa.int64()), (digests, pa.binary()), (start, pa.int32()), (windows, pa.int32()))]
            yield pa.RecordBatch.from_arrays(named + rest, names=[ID, HASH, "anchor", "digest", "start", "windows"])

    return run


def _fetch(length: int):
    """From ID, HASH, text, wanted: the bytes of each stretch wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for doc_id, text_hash, data, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), B.rows(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                raw = data.tobytes()
                for w in wanted:
                    row = (doc_id, text_hash, w["anchor"], raw[w["start"] : w["start"] + w["windows"] + length - 1], w["start"], w["windows"], w["classes"])
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=[ID, HASH, "anchor", "stretch", "start", "windows", "classes"])

    return run


def repeats_in(stretches: list[bytes], doc_rank: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """One shard: which windows of the stretches repeat an earlier one, as the bytes' places in the joined text.
    doc_rank: the order of the stretches' documents; start: the place of a stretch's first window in its document."""
    text = np.frombuffer(b"".join(stretches), np.uint8)
    sizes = np.array([len(s) for s in stretches])
    begin = np.cumsum(sizes) - sizes
    within = np.arange(len(text)) - np.repeat(begin, sizes)
    is_window = within < np.repeat(windows, sizes)
    place = (np.repeat(doc_rank, sizes) << 32) | (np.repeat(start, sizes) + within)
    array = suffix_array(text)
    same = common_prefixes(text, array)[array] >= length
    group = np.cumsum(~same)[is_window[array]]
    mine = array[is_window[array]]
    if not len(mine):
        return mine
    first = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(place[mine], first)
    return np.sort(mine[place[mine] > np.repeat(least, np.diff(np.append(first, len(mine))))])


def _sorted_shard(length: int):
    """All rows of a shard's partition: their windows that repeat an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows := [batch for batch in batches if len(batch)]:
            yield repeated(pa.Table.from_batches(rows))

    def repeated(table: pa.Table) -> pa.RecordBatch:
        ids, hashes = table[ID].to_numpy(), table[HASH].to_numpy()
        _, rank = np.unique(np.stack([ids, hashes], 1), axis=0, return_inverse=True)
        stretches = table["stretch"].to_pylist()
        start, windows = table["start"].to_numpy().astype(np.int64), table["windows"].to_numpy()
        found = repeats_in(stretches, rank.ravel().astype(np.int64), start, windows, length)
        sizes = np.array([len(s) for s in stretches])
        begin = np.cumsum(sizes) - sizes
        of = np.searchsorted(begin, found, "right") - 1
        out: list[tuple] = []
        bounds = np.searchsorted(of, np.arange(len(stretches) + 1))
        for r in np.flatnonzero(np.diff(bounds)).tolist():
            places = found[bounds[r] : bounds[r + 1]] - begin[r] + start[r]
            out += [(ids[r], hashes[r], a, k) for a, k in _runs_of(places)]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=[ID, HASH, "start", "windows"])

    return run


def _each_window(length: int):
    """A row for each window, by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text_hash, stretch, start, windows in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for i in range(windows):
                    for column, x in zip(out, (blake2b(stretch[i : i + length], digest_size=16).digest(), doc_id, text_hash, start + i), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["window", ID, HASH, "start"])

    return run


def repeats(docs: DataFrame, live: DataFrame, anchors: Anchors, scratch: Scratch, shard_bytes: int, most_classes: int) -> DataFrame:
    """docs: ID, HASH, text, in buckets by the two; live: shared()'s bits of them. Returns ID, HASH, start, windows:
    the runs of windows that repeat an earlier one (a window may be in several rows)."""
    length = anchors.length
    place = F.struct(ID, HASH, "start")
    index = scratch.save(
        docs.hint("merge").join(live, [ID, HASH]).select(ID, HASH, "text", "bits").mapInArrow(B.released(_index(anchors)), f"{ID} long, {HASH} long, anchor long, digest binary, start int, windows int"),
        "index",
    )
    classes = scratch.save(
        index.where("digest IS NOT NULL").groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("windows").alias("windows"), F.max("anchor").alias("anchor")),
        "classes",
    )
    of_anchor = scratch.save(classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.sum(F.col("windows") + F.lit(length)).alias("bytes")).where("classes > 1"), "several")
    total = of_anchor.where(F.col("classes") <= most_classes).agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    wanted = (
        classes.join(of_anchor, "anchor")
        .select(f"first.{ID}", f"first.{HASH}", F.struct("anchor", "first.start", classes["windows"], "classes").alias("one"))
        .groupBy(ID, HASH)
        .agg(F.collect_list("one").alias("wanted"))
    )
    several = scratch.save(
        docs.hint("merge").join(wanted, [ID, HASH]).select(ID, HASH, "text", "wanted")
        .mapInArrow(B.released(_fetch(length)), f"{ID} long, {HASH} long, anchor long, stretch binary, start int, windows int, classes long"),
        "stretches",
    )
    sorted_ = scratch.save(
        several.where(F.col("classes") <= most_classes)
        .repartitionById(shards, F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
        .mapInArrow(B.released(_sorted_shard(length)), f"{ID} long, {HASH} long, start int, windows int"),
        "sorted",
    )
    # The rest, window by window.
    each = scratch.save(
        several.where(F.col("classes") > most_classes)
        .select(ID, HASH, "stretch", "start", "windows")
        .mapInArrow(B.released(_each_window(length)), f"window binary, {ID} long, {HASH} long, start int"),
        "each",
    )
    earliest = scratch.save(each.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("window", "first"), "earliest")
    of_hot = each.join(earliest, "window").where(~place.eqNullSafe(F.col("first"))).select(ID, HASH, "start", F.lit(1).alias("windows"))
    # Stretches that repeat their class's first one, in other texts and in their own.
    copied = scratch.save(classes.where("first <> last").select("digest", "first"), "copied")
    of_class = index.where("digest IS NOT NULL").join(copied, "digest").where(~place.eqNullSafe(F.col("first"))).select(ID, HASH, "start", "windows")
    of_self = index.where("digest IS NULL").select(ID, HASH, "start", "windows")
    return sorted_.union(of_hot).union(of_class).union(of_self)


def dedup(docs: DataFrame, length: int = 100, gram: int = 40, shard_bytes: int = 1 << 19, most_classes: int = 2000, id_col: str = "doc_id", text_col: str = "text", kept_bytes: bool = False) -> DataFrame:
    """docs with the columns of ADDED: the text's length in bytes, the removed runs as [start, end), and the SHA-256
    of the bytes that are left; with kept_bytes those themselves too, as kept."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    anchors = Anchors(length, gram)
    added = T.StructType([*ADDED, T.StructField("kept", T.BinaryType())]) if kept_bytes else ADDED
    names = without(docs, *added.names)
    given = docs.select(columns(names)).schema
    # The columns travel as one, so that none of them clashes with the keys beside it.
    keyed = docs.select(
        F.struct(*columns(names)).alias("row"),
        F.coalesce(column(id_col).cast("long"), F.lit(-(1 << 63))).alias(ID),
        F.xxhash64(F.coalesce(column(text_col).cast("string"), F.lit(""))).alias(HASH),
    )
    keyed = scratch.save_by(keyed, "texts", [ID, HASH])
    texts = keyed.select(ID, HASH, F.col("row").getField(text_col).cast("string").alias("text"))
    live = scratch.save(shared(texts, anchors.hashes, 2 * text_bytes(texts) // (length - gram + 1)), "live")
    runs = repeats(texts, live.dropDuplicates([ID, HASH]), anchors, scratch, shard_bytes, most_classes)
    by_doc = scratch.save(runs.groupBy(ID, HASH).agg(F.collect_set(F.struct("start", "windows")).alias("weir_runs")), "runs")
    scratch.keep("texts", "runs")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = batch.column(0).flatten()
            out: list[list] = [[], [], [], []]
            for data, found in zip(B.rows(fields[names.index(text_col)]), batch.column(1).to_pylist(), strict=True):
                gone: list[dict] = []
                left, upto = [], 0
                for a, b in sorted((r["start"], r["start"] + r["windows"] + length - 1) for r in found or ()):
                    if gone and a <= gone[-1]["end"]:
                        gone[-1]["end"] = max(gone[-1]["end"], b)
                    else:
                        gone.append({"start": a, "end": b})
                for r in gone:
                    left.append(data[upto : r["start"]].tobytes())
                    upto = r["end"]
                kept = b"".join([*left, data[upto:].tobytes()])
                for column, x in zip(out, (len(data), gone, sha256(kept).hexdigest(), kept), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string(), pa.binary()]
            arrays = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)][: len(added)]
            yield pa.RecordBatch.from_arrays(fields + arrays, names=names + added.names)

    return keyed.hint("merge").join(by_doc, [ID, HASH], "left").select("row", "weir_runs").mapInArrow(B.released(remove), T.StructType([*given, *added]))
