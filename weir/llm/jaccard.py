"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters, and the
components of its links.

A document's set is its distinct shingles of `size` words (with fewer words the whole sequence as one; with none, an
empty set, which links with nothing). Two documents link when 100 * intersection >= percent * union.

1. Every shingle is hashed, and each block of documents asks the bucket of a hash, once, how many documents have it
   (sharing.py). Buckets answer only for shingles of two documents or more. A document's block then has its sets'
   shared part in rare-first order; the rest, in one document each, stands before it without being known. A document
   whose prefix is made of such shingles can have no partner and is done.
2. Documents of equal word sequences are one class; its smallest id stands for it from here on.
3. Prefixes are joined by shingle in two rounds. The first pairs each posting list's pivot with the rest of the list,
   which finds large groups of near copies in as many pairs as there are postings. The second takes only pairs whose
   documents are not yet known to be connected: in each list, documents outside its largest component against all,
   with a finer suffix filter (a lower bound from the parities of the counts in 256 ranges).
   Pairs pass the length filter, the positional filter (what can follow the shared place in both) and the suffix
   filter (a lower bound of the Hamming distance from counts in eight ranges of hashes, which postings bring along)
   before any set travels. Each pair is then verified once, by a finer suffix filter and the intersection of the
   shared parts.
4. Components of the links, by contraction; copies get their class's.

No link between different components' texts is missed: a pair is left out only if a filter proves it too far apart,
or if its documents are already connected. Words and shingles are compared by 64 bits of hash, whatever the session's
settings: a wrong link needs two shingles of one hash in two documents that are one shingle short of a link.

Defined cases: null texts and texts of white space only are empty sets, each a component of its own; rows that repeat
id and text are copies; rows that repeat an id with other texts are separate nodes; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .components import components
from .scratch import Scratch, column, mapped, prepare, text_bytes
from .sharing import exchanged

#: A block has at most so many documents (their places take 16 bits) and, but for its last, so many shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 1 << 16, 1 << 20
#: A word and the space after it take about so many bytes, from which the number of shingles is guessed.
WORD_BYTES = 6
IS_WORD = ~B.SPACE
#: The bounds of sixteen ranges of hashes.
EDGES = np.array([i << 60 for i in range(1, 16)], np.uint64)
#: Ranges whose parities the second round compares.
ODD = 256
SIGNATURES = "node long, doc_id long, n int, digest binary, alone int, prefix binary, shared binary, sketch long, odd array<long>"


def shingles(data: np.ndarray, size: int) -> tuple[np.ndarray, bytes | None]:
    """The distinct hashes of a text's shingles, and a digest of its word sequence (None without words)."""
    _, _, words = B.word_hashes(data, IS_WORD, B.SYMBOL_LOWER)
    if not len(words):
        return words, None
    found = B.windows_of(words, min(size, len(words)))
    return np.unique(found), blake2b(words.tobytes(), digest_size=16).digest()


def parities(shared: np.ndarray) -> np.ndarray:
    """A bit for each of ODD ranges of hashes, set where an odd number of the set's lie in it: sets differ by as many
    hashes at least as their parities differ by bits."""
    counts = np.bincount((shared >> np.uint64(32)).astype(np.int64) & (ODD - 1), minlength=ODD)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _needed(n: int | np.ndarray, percent: int):
    """The least intersection of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """docs: doc_id, text. For each row: node (a number of its own), doc_id, n (the size of its set), digest; and for
    those that can have partners alone (shingles that no other document has), prefix (the shared shingles of its
    prefix, rare first), shared (all shared shingles, ascending), sketch (how many of them lie in each eighth of
    all hashes, eight bits each) and odd (parities())."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        ids: list[int | None] = []
        sets: list[np.ndarray] = []
        digests: list[bytes] = []

        def closed() -> tuple:
            sizes = np.array([len(x) for x in sets], np.int32)
            known = np.array([x is not None for x in ids], np.uint8)
            header = np.int64(number).tobytes() + np.array([x or 0 for x in ids], np.int64).tobytes() + sizes.tobytes() + b"".join(digests) + known.tobytes()
            return header, np.concatenate(sets), np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)

        total = 0
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), B.rows(batch.column(1)), strict=True):
                found, digest = shingles(data, size)
                ids.append(doc_id)
                sets.append(found)
                digests.append(digest or b"\0" * 16)
                total += len(found)
                if len(ids) == BLOCK_DOCS or total >= BLOCK_SHINGLES:
                    block = closed()
                    number, total = number + 1, 0
                    ids, sets, digests = [], [], []
                    yield block
                    del block
        if ids:
            yield closed()

    def settled(header: bytes, at: np.ndarray, key: np.ndarray, level: np.ndarray) -> pa.Table:
        """One block: its documents with what the buckets say of their shingles."""
        n_docs = (len(header) - 8) // 29
        number = int(np.frombuffer(header, np.int64, 1)[0])
        ids, sizes = np.frombuffer(header, np.int64, n_docs, 8), np.frombuffer(header, np.int32, n_docs, 8 + 8 * n_docs)
        digests, known = header[8 + 12 * n_docs : 8 + 28 * n_docs], np.frombuffer(header, np.uint8, n_docs, 8 + 28 * n_docs)
        order = np.argsort(at, kind="stable")
        key, level = key[order], level[order]
        n_shared = np.bincount(at, minlength=n_docs)
        bounds = np.concatenate([[0], np.cumsum(n_shared)])
        alone = sizes - n_shared
        length = np.where(sizes > 0, sizes - _needed(sizes, percent) + 1 - alone, 0)
        prefix: list[bytes | None] = [None] * n_docs
        shared: list[bytes | None] = [None] * n_docs
        sketch: list[int | None] = [None] * n_docs
        odd: list[np.ndarray | None] = [None] * n_docs
        for r in np.flatnonzero(length > 0).tolist():
            k, v = key[bounds[r] : bounds[r + 1]], level[bounds[r] : bounds[r + 1]]
            prefix[r] = k[np.lexsort((k, v))[: length[r]]].tobytes()
            shared[r] = np.sort(k).tobytes()
            sketch[r] = int.from_bytes(np.minimum(np.bincount((k >> np.uint64(61)).astype(np.int64), minlength=8), 255).astype(np.uint8).tobytes(), "little", signed=True)
            odd[r] = parities(k)
        return pa.Table.from_arrays(
            [
                pa.array((np.int64(number) << 16) + np.arange(n_docs)),
                pa.array(ids, mask=known == 0),
                pa.array(sizes),
                pa.array([digests[16 * r : 16 * r + 16] for r in range(n_docs)], pa.binary()),
                pa.array(alone.astype(np.int32)),
                pa.array(prefix, pa.binary()),
                pa.array(shared, pa.binary()),
                pa.array(sketch, pa.int64()),
                pa.array(odd, pa.list_(pa.int64())),
            ],
            names=["node", "doc_id", "n", "digest", "alone", "prefix", "shared", "sketch", "odd"],
        )

    return exchanged(docs, text_bytes(docs) // WORD_BYTES, blocks, "<u2", True, settled, SIGNATURES)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A posting for each shingle of the prefixes."""
    for batch in batches:
        keys = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("prefix")]
        sizes = [len(k) for k in keys]
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, a + k) for a, k in zip(batch.column("alone").to_pylist(), sizes, strict=True))])
        rest = [pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in ("node", "n", "alone", "sketch")]
        yield pa.RecordBatch.from_arrays([pa.array(key), *rest, pa.array(at.astype(np.int32))], names=["key", "node", "n", "alone", "sketch", "at"])


def _near(percent: int, x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """Whether two postings of one shingle can belong to linked documents. Length filter; positional filter at the
    shared place (it and what follows it in both must suffice), which holds at the first shared place of every linked
    pair, so one of a pair's places passes at least; suffix filter by the sketches: sets differ by as much as their
    counts in each range, and by all shingles that stand alone."""
    total, after = x("n") + y("n"), F.least(x("n") - x("at"), y("n") - y("at"))
    eighth = lambda side, i: F.shiftrightunsigned(side("sketch"), 8 * i).bitwiseAND(F.lit(255))
    apart = reduce(Column.__add__, (F.abs(eighth(x, i) - eighth(y, i)) for i in range(8))) + x("alone") + y("alone")
    # An intersection of i leaves total - 2 * i apart, and (100 + percent) * i >= percent * total is needed.
    return (
        (100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n")))
        & ((100 + percent) * after >= percent * total)
        & ((100 + percent) * apart <= (100 - percent) * total)
    )


def _finer(percent: int, x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """The suffix filter by the parities of 256 ranges, whose bits say more than few counts do while sets are small."""
    apart = reduce(Column.__add__, (F.bit_count(x("odd")[i].bitwiseXOR(y("odd")[i])) for i in range(ODD // 64))) + x("alone") + y("alone")
    return (100 + percent) * apart <= (100 - percent) * (x("n") + y("n"))


def linked(n1: int, n2: int, shared1: np.ndarray, shared2: np.ndarray, percent: int, edges: np.ndarray = EDGES) -> bool:
    """The suffix filter on the counts between edges, then the intersection itself."""
    least = -(-percent * (n1 + n2) // (100 + percent))
    ranges = [np.diff(np.searchsorted(x, edges), prepend=0, append=len(x)) for x in (shared1, shared2)]
    apart = int(np.abs(ranges[0] - ranges[1]).sum()) + n1 - len(shared1) + n2 - len(shared2)
    if apart > n1 + n2 - 2 * least:
        return False
    both = np.concatenate([shared1, shared2])
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= least


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that link. sets: node, n, shared."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [batch.column(i) for i in range(6)]
            n1, n2 = c[2].to_pylist(), c[4].to_pylist()
            ok = [linked(x, y, np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for x, y, p, q in zip(n1, n2, c[3], c[5], strict=True)]
            yield pa.RecordBatch.from_arrays([c[0], c[1]], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a, b = (sets.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("shared").alias(f"{x}_shared")) for x in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "a_n", "a_shared", "b_n", "b_shared").mapInArrow(B.released(check), "a long, b long")


def with_digest(docs: DataFrame, name: str, size: int = 5, text_col: str = "text") -> DataFrame:
    """docs with the digest that components_of gives with `digest`, as a column of that name."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(data, size)[1] for data in B.rows(batch.column(batch.schema.get_field_index(text_col)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, name])

    return mapped(docs, run, T.StructType([*docs.schema, T.StructField(name, T.BinaryType())]))


def components_of(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", digest: str | None = None) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links). digest: the
    name of a column for the digest of the row's words (null without words), which tells rows of one id apart."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    signed = scratch.save(signatures(docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")), size, percent), "signatures")
    classes = scratch.save(
        signed.where("n > 0").groupBy("digest").agg(F.min("node").alias("node"), F.min("doc_id").alias("doc_id"), (F.count("*") > 1).alias("copied")), "classes"
    )
    sets = scratch.save(signed.where("prefix IS NOT NULL").join(classes.select("node"), "node", "left_semi"), "sets")
    postings = scratch.save(sets.select("node", "n", "alone", "sketch", "prefix").mapInArrow(B.released(_explode), "key long, node long, n int, alone int, sketch long, at int"), "postings")

    # First round: each list's pivot against the list. It is the document with the smallest share of shingles that no
    # other has: among copies that were each edited in other places, the one that all of them are near to.
    pivot = F.struct((F.col("alone") / F.col("n")).alias("apart"), F.xxhash64("node").alias("rank"), "node", "n", "alone", "sketch", "at")
    pivots = scratch.save(postings.groupBy("key").agg(F.min(pivot).alias("pivot"), F.max("node").alias("top"), F.min("node").alias("low")).where("top <> low").select("key", "pivot"), "pivots")
    pairs = scratch.save(
        postings.join(pivots, "key")
        .where((F.col("node") != F.col("pivot.node")) & _near(percent, F.col, lambda c: F.col(f"pivot.{c}")))
        .select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b"))
        .distinct(),
        "pairs",
    )
    links = scratch.save(verified(pairs, sets, percent), "links")
    roots = components(links, scratch, "first")

    # Second round: what the first left unconnected in a list.
    named = scratch.save(
        postings.join(pivots.select("key"), "key", "left_semi").join(roots, "node", "left").select("key", "node", "n", "alone", "sketch", "at", F.coalesce("root", "node").alias("root")), "named"
    )
    of_key = named.groupBy("key", "root").count().groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("count", "root")).alias("most"))
    mixed = scratch.save(of_key.where("roots > 1").select("key", F.col("most.root").alias("main")), "mixed")
    met = scratch.save(named.join(mixed, "key").join(sets.select("node", "odd"), "node"), "met")
    outside = scratch.save(met.where("root <> main").select("key", *(F.col(c).alias(f"{c}_2") for c in ("node", "n", "alone", "sketch", "odd", "at", "root"))), "outside")
    second = lambda c: F.col(f"{c}_2")
    rest = scratch.save(
        met.join(outside, "key")
        .where((F.col("root") != F.col("root_2")) & _near(percent, F.col, second) & _finer(percent, F.col, second))
        .select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b"))
        .distinct()
        .join(pairs, ["a", "b"], "left_anti"),
        "rest",
    )
    more = scratch.save(verified(rest, sets, percent), "more-links")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), scratch, "second")

    placed = scratch.save(classes.join(roots, "node", "left").select("digest", "doc_id", "copied", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked")), "placed")
    of_root = scratch.save(placed.where("linked").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    of_class = scratch.save(
        placed.where("linked OR copied").join(of_root, "root", "left").select("digest", F.coalesce("least", "doc_id").alias("component_id")), "components"
    )
    scratch.keep("signatures", "components")
    return (
        signed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
        .join(of_class, "digest", "left")
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *([F.col("digest").alias(digest)] if digest else []))
    )
