"""Line dedup: runs of lines that occur earlier in the corpus are deleted from later places, by winnowing.

A unit is a line that is not blank, compared without the ASCII white space at its ends, by a 128-bit hash. Of every
`window` consecutive units the one with the smallest hash (the leftmost of several) is selected; two equal runs of
`window` units select the same place of theirs, so every repeated run of that length shares a fingerprint.

1. Selected fingerprints are counted; those that occur once drop out, which most of a corpus does.
2. Matches at the others are extended both ways: a fingerprint's place brings its neighbours' hashes along, and each
   window that selected it is keyed by all of its units.
3. Each key's first place (smallest document id, then smallest start) stays; every other place is a repeat.
   Overlapping and adjoining repeats merge into maximal runs, which are deleted.

So exactly those units go that a window covers which also starts earlier; overlaps count, and windows are judged on
the input, not on what is left. With `long_words`, a unit of more words than that is a run by itself too: it goes
where it stands earlier, whatever stands beside it. Places are never paired: a key's smallest place is found by an aggregate that is
partial before the shuffle, and the joins carry one row per place against one per key, which adaptive execution can
split when a key is hot.

Defined cases: null and empty texts have no units; a text of fewer units than the window stays; rows that repeat id
and text are one document (all of them get its result, none counts as earlier than another); rows that repeat an id
with other texts are told apart by a hash of the text, which also orders them; a null id sorts first. Blank lines
stay, unless all units go, which leaves an empty text. Columns that the operator adds replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .scratch import Scratch, column, columns, mapped, unused, without

BLANK = b" \t\r\f\v"
SIZE = 16
RUNS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
#: The number of units, the deleted runs of them as [start, end), and the text that is left.
ADDED = T.StructType([T.StructField("line_count", T.IntegerType()), T.StructField("line_runs", RUNS), T.StructField("line_kept", T.StringType())])
KEY, ROW = "weir_text_hash", "weir_row"


def units(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and the places among them of those that are not blank."""
    lines = text.split(b"\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(BLANK)]


def hashes(lines: list[bytes], places: list[int]) -> list[bytes]:
    return [blake2b(lines[i].strip(BLANK), digest_size=SIZE).digest() for i in places]


def selected(found: list[bytes], window: int) -> list[int]:
    """The places that some window selects, ascending."""
    out: list[int] = []
    for s in range(len(found) - window + 1):
        at = min(range(s, s + window), key=found.__getitem__)
        if not out or at != out[-1]:
            out.append(at)
    return out


def long_units(lines: list[bytes], places: list[int], words: int) -> list[int]:
    """The units of more than so many words."""
    return [k for k, i in enumerate(places) if len(lines[i]) > 2 * words and len(lines[i].split()) > words]


def repeats(docs: DataFrame, window: int, long_words: int | None, scratch: Scratch) -> DataFrame:
    """docs: doc_id, KEY, text. Returns doc_id, KEY, found: the start and size of the windows, and of the long units,
    that also start earlier, for each document that has any."""

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, key, data in zip(ids, keys, B.rows(batch.column(2)), strict=True):
                lines, where = units(data.tobytes())
                found = hashes(lines, where)
                for at in selected(found, window):
                    first = max(0, at - window + 1)
                    row = (doc_id, key, at, int.from_bytes(found[at][:8], "big", signed=True), at - first, b"".join(found[first : at + window]))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                for at in long_units(lines, where, long_words) if long_words is not None else ():
                    # A lead of -1 marks a unit by itself; its fingerprint is another than that of the same unit in windows.
                    row = (doc_id, key, at, ~int.from_bytes(found[at][:8], "big", signed=True), -1, found[at])
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", KEY, "at", "fingerprint", "lead", "around"])

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, key, at, _, lead, around in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                found = [around[i : i + SIZE] for i in range(0, len(around), SIZE)]
                size, lead = (1, 0) if lead < 0 else (window, lead)
                for s in range(max(0, lead - size + 1), min(lead, len(found) - size) + 1):
                    if min(range(s, s + size), key=found.__getitem__) == lead:
                        row = (doc_id, key, at - lead + s, size, blake2b(b"".join(found[s : s + size]), digest_size=SIZE).digest())
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", KEY, "start", "size", "run"])

    places = scratch.save(
        docs.mapInArrow(B.released(fingerprints), f"doc_id long, {KEY} long, at int, fingerprint long, lead int, around binary"), "places"
    )
    shared = scratch.save(places.groupBy("fingerprint").count().where("count > 1").select("fingerprint"), "shared")
    runs = scratch.save(
        places.join(shared, "fingerprint", "left_semi")
        .select("doc_id", KEY, "at", "fingerprint", "lead", "around")
        .mapInArrow(B.released(extended), f"doc_id long, {KEY} long, start int, size int, run binary"),
        "runs",
    )
    place = F.struct("doc_id", KEY, "start")
    firsts = scratch.save(
        runs.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("run", "first"),
        "firsts",
    )
    return (
        runs.join(firsts, "run")
        .where(~place.eqNullSafe(F.col("first")))
        .groupBy("doc_id", KEY)
        .agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("found"))
    )


def dedup(docs: DataFrame, window: int = 2, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None) -> DataFrame:
    """docs with the columns of ADDED. long_words: units of more words are runs by themselves (none, if not given)."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    names = without(docs, *ADDED.names)
    docs = docs.select(columns(names))
    text_hash = F.xxhash64(F.coalesce(column(text_col).cast("string"), F.lit("")))
    row, found_name = (unused(names, x) for x in (ROW, "weir_found"))
    found = scratch.save(
        repeats(docs.select(column(id_col).cast("long").alias("doc_id"), text_hash.alias(KEY), column(text_col).alias("text")), window, long_words, scratch),
        "repeats",
    )
    scratch.keep("repeats")

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = dict(zip(batch.schema.names, batch.columns, strict=True))
            count, runs, kept = [], [], []
            for data, found in zip(B.rows(given[text_col]), given[found_name].to_pylist(), strict=True):
                text = data.tobytes()
                lines, places = units(text)
                count.append(len(places))
                if not found:
                    runs.append([])
                    kept.append(text.decode())
                    continue
                gone = np.zeros(len(places), bool)
                for size in {r["size"] for r in found}:
                    gone |= B.covered(np.array([r["start"] for r in found if r["size"] == size]), size, len(places))
                runs.append([{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in B.runs(gone)), strict=True)])
                drop = {places[i] for i in np.flatnonzero(gone).tolist()}
                kept.append("" if len(drop) == len(places) else b"\n".join(x for i, x in enumerate(lines) if i not in drop).decode())
            added = [pa.array(count, pa.int32()), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([given[n] for n in names] + added, names=names + ADDED.names)

    # The row's own key beside all its columns, under a name that none of them has.
    here = docs.select(*columns(names), F.struct(column(id_col).cast("long").alias("id"), text_hash.alias("hash")).alias(row))
    there = found.select(F.struct(F.col("doc_id").alias("id"), F.col(KEY).alias("hash")).alias(row), F.col("found").alias(found_name))
    same = here[row]["id"].eqNullSafe(there[row]["id"]) & (here[row]["hash"] == there[row]["hash"])
    return mapped(here.hint("merge").join(there, same, "left").select(*columns(names), found_name), delete, T.StructType([*docs.schema, *ADDED]))
