"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over every document's windows.

Words are the runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. An item's
windows are its runs of `window` consecutive words; an item of fewer words, but not none, is one window. Documents are
scanned as byte arrays with rolling hashes; a hash that some window has is then verified on the words themselves, so
the result is exact. No document is shuffled.

The item set is broadcast as sorted arrays, some four times its text, in blocks of at most `block_bytes` of item text,
whose sizes are summed beforehand. A larger benchmark takes one pass over the texts per block, of which only the hits
are written; they are joined to the documents once, by a digest of the text.

Defined cases: null texts and texts without words have no hits; a null item_id is left out of the item list but its
windows count; repeated items and repeated ids count once in the list; an empty table of items hits nothing; other
columns of the documents ride along untouched, and columns that the scan adds replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .scratch import Scratch, column, columns, mapped, prepare, text_bytes, unused, without

IS_WORD = (B.BYTES >= 0x80) | ((B.LOWER >= 0x61) & (B.LOWER <= 0x7A)) | ((B.BYTES >= 0x30) & (B.BYTES <= 0x39))
FILTER_BITS = 20

#: What the scan adds: bench_bits has one bit for each word, packed, first word first.
ADDED = T.StructType(
    [
        T.StructField("bench_words", T.LongType()),
        T.StructField("bench_hits", T.LongType()),
        T.StructField("bench_bits", T.BinaryType()),
        T.StructField("bench_items", T.ArrayType(T.StringType())),
    ]
)


class Windows:
    """The windows of a block of items, as arrays: the items' words in one run of bytes, and for each length of window
    the hashes, ascending, with the place of their first word and their item."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.ids = [i for i, _ in items]
        words, starts, ends = [], [], []
        by_length: dict[int, list[np.ndarray]] = {}
        n_bytes = n_words = 0
        for number, (_, text) in enumerate(items):
            data = np.frombuffer((text or "").encode(), np.uint8)
            first, last, hashes = B.word_hashes(data, IS_WORD, B.SYMBOL_LOWER)
            k = min(window, len(first))
            if not k:
                continue
            here = B.windows_of(hashes, k)
            by_length.setdefault(k, []).append(np.stack([here, np.arange(len(here), dtype=B.U64) + B.U64(n_words), np.full(len(here), number, B.U64)]))
            words.append(B.LOWER[data])
            starts.append(first + n_bytes)
            ends.append(last + n_bytes)
            n_bytes, n_words = n_bytes + len(data), n_words + len(first)
        self.words, self.starts, self.ends = (np.concatenate([np.zeros(0, x), *y]) for x, y in ((np.uint8, words), (np.int64, starts), (np.int64, ends)))
        self.known, self.filters = {}, {}
        for k, parts in by_length.items():
            every = np.concatenate(parts, 1)
            every = every[:, np.argsort(every[0], kind="stable")]
            self.known[k] = every[0].copy(), every[1].astype(np.int32), every[2].astype(np.int32)
            self.filters[k] = np.zeros(1 << FILTER_BITS, bool)
            self.filters[k][every[0] >> B.U64(64 - FILTER_BITS)] = True

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items that hit them."""
        starts, ends, hashes = B.word_hashes(data, IS_WORD, B.SYMBOL_LOWER)
        hit, found = np.zeros(len(starts), bool), set()
        low = None
        for k, (known, first, item) in self.known.items():
            if len(starts) < k:
                continue
            here = B.windows_of(hashes, k)
            maybe = np.flatnonzero(self.filters[k][here >> B.U64(64 - FILTER_BITS)])
            a, b = np.searchsorted(known, here[maybe]), np.searchsorted(known, here[maybe], "right")
            on = np.flatnonzero(b > a)
            for i, x, y in zip(maybe[on].tolist(), a[on].tolist(), b[on].tolist(), strict=True):
                low = B.LOWER[data] if low is None else low
                words = words_between(low, starts, ends, i, k)
                for e in range(x, y):
                    if (not hit[i : i + k].all() or self.ids[item[e]] not in found) and words_between(self.words, self.starts, self.ends, first[e], k) == words:
                        hit[i : i + k] = True
                        found.add(self.ids[item[e]])
        found.discard(None)
        return hit, found


def words_between(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: int, k: int) -> bytes:
    return b" ".join(low[a:b].tobytes() for a, b in zip(starts[i : i + k].tolist(), ends[i : i + k].tolist(), strict=True))


def scan(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = 8 << 20, text_col: str = "text") -> DataFrame:
    """docs with the columns of ADDED: the number of words, of words inside an occurring window, one bit for each
    word (packed, first word first), and the ids of the items with occurring windows, as sorted strings."""
    spark = docs.sparkSession
    prepare(spark)
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-text_bytes(items) // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    names = without(docs, *ADDED.names)
    docs = docs.select(columns(names))
    if blocks == 1:
        return _found(docs, names, text_col, None, spark.sparkContext.broadcast(Windows([tuple(r) for r in items.collect()], window)))
    scratch, digest, hits = Scratch(spark, "decontaminate"), unused(names, "weir_digest"), unused(names, "weir_hits")
    keyed = docs.select(*columns(names), F.md5(F.coalesce(column(text_col).cast("string"), F.lit(""))).alias(digest))
    texts = keyed.select(column(digest).alias("digest"), column(text_col).alias("text"))
    passes = []
    for b in range(blocks):
        known = spark.sparkContext.broadcast(Windows([tuple(r) for r in items.where(block == b).collect()], window))
        # Copies of a text have the same hits: one row for each text that has any.
        passes.append(scratch.save(texts.mapInArrow(B.released(_hits(known)), "digest string, bits binary, items array<string>").dropDuplicates(["digest"]), f"pass-{b}"))
        known.destroy()
    of_text = scratch.save(reduce(DataFrame.union, passes).groupBy(F.col("digest").alias(digest)).agg(F.collect_list(F.struct("bits", "items")).alias(hits)), "hits")
    scratch.keep("hits")
    return _found(keyed.join(of_text, digest, "left").select(*columns(names), hits), names, text_col, hits, None)


def _hits(known):
    """From digest, text: the bits and items of those with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for digest, data in zip(batch.column(0).to_pylist(), B.rows(batch.column(1)), strict=True):
                hit, found = known.value.hits(data)
                if hit.any():
                    out.append((digest, np.packbits(hit).tobytes(), sorted(found)))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.string(), pa.binary(), pa.list_(pa.string())), strict=True)], names=["digest", "bits", "items"])

    return run


def _found(docs: DataFrame, names: list[str], text_col: str, hits: str | None, known) -> DataFrame:
    """docs' columns of these names with those of ADDED, by looking for known windows, or from the hits of all passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = dict(zip(batch.schema.names, batch.columns, strict=True))
            n_words, n_hit, bits, ids = [], [], [], []
            for r, data in enumerate(B.rows(given[text_col])):
                if hits is None:
                    hit, found = known.value.hits(data)
                else:
                    hit, found = np.zeros(len(B.runs(IS_WORD[data])[0]), bool), set()
                    for x in given[hits][r].as_py() or []:
                        hit |= np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=len(hit)).view(bool)
                        found |= set(x["items"])
                n_words.append(len(hit))
                n_hit.append(int(hit.sum()))
                bits.append(np.packbits(hit).tobytes())
                ids.append(sorted(found))
            added = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(bits, pa.binary()), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([given[n] for n in names] + added, names=names + ADDED.names)

    schema = [f for f in docs.schema if f.name in names]
    return mapped(docs, run, T.StructType([*schema, *ADDED]))


def clean(scanned: DataFrame, max_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """From scan()'s result the documents without what was hit: a hit word goes with what stands between it and the
    next hit word of its run; a document of which more than max_share of the words were hit goes as a whole. The
    columns of ADDED go, the order and the names of the others stay."""
    kept = scanned.where(F.col("bench_hits") <= F.lit(max_share) * F.col("bench_words"))
    given = [f for f in scanned.schema if f.name not in {a.name for a in ADDED}]
    names = [f.name for f in given]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(batch.schema.get_field_index(name)) for name in batch.schema.names}
            texts = columns[text_col].to_pylist()
            n_hit = columns["bench_hits"].to_numpy()
            for r in np.flatnonzero(n_hit).tolist():
                data = np.frombuffer(texts[r].encode(), np.uint8)
                starts, ends = B.runs(IS_WORD[data])
                hit = np.unpackbits(np.frombuffer(columns["bench_bits"][r].as_py(), np.uint8), count=len(starts)).view(bool)
                first, last = B.runs(hit)
                keep = np.ones(len(data), bool)
                for a, b in zip(starts[first].tolist(), ends[last - 1].tolist(), strict=True):
                    keep[a:b] = False
                texts[r] = data[keep].tobytes().decode()
            columns[text_col] = pa.array(texts, columns[text_col].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return mapped(kept, run, T.StructType(given))
