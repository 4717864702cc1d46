"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

A text's segmentations are the paths of a lattice whose edges are the vocabulary's pieces; a path's probability is
proportional to exp(alpha * the sum of its pieces' scores). Forward filtering sums, for each place, the weights of all
paths up to it; backward sampling then draws the last piece in proportion, the one before it, and so on, which is a
draw from all segmentations, exact to double precision. The random numbers are a hash of the seed, the row's key and the place in its text:
a row gets the same pieces in whatever batch, partition or attempt it is encoded.

The lattice falls apart wherever two bytes meet that no piece holds next to each other: before most spaces and signs,
and around characters that have no piece (which are written byte by byte). Forward filtering is done once for each
distinct chunk that a worker meets, and backward sampling for all chunks of a batch, in array steps over all of them.

As the model does, a text gets one space before it, spaces are written as U+2581 in pieces, and characters without a
piece fall back to their bytes. U+2581 itself, where a text has it, is written in bytes, so decoding gives every text
back exactly.

Defined cases: null and empty texts have no pieces and decode to the empty text; rows that repeat key and text get
the same pieces; a null key counts as 0; columns that are added replace columns of that name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bytesops as B
from .scratch import columns, mapped, prepare, without

#: Chunks that a worker remembers, and their bytes; beyond either, it starts afresh.
REMEMBERED, REMEMBERED_BYTES = 100_000, 3 << 18
#: Texts are encoded in groups of about so many bytes.
GROUP_BYTES = 1 << 19
#: Chunks are sampled in stretches of at most so many bytes; a longer chunk is sampled by itself.
STRETCH = 1 << 17
#: Stretches of a longer chunk, whose places are Python objects.
LONG_STRETCH = 1 << 13
FILTER_BITS = 20
SPACE = "▁"

ADDED = T.StructType(
    [
        T.StructField("piece_ids", T.ArrayType(T.IntegerType())),
        T.StructField("n_pieces", T.LongType()),
        T.StructField("pieces_crc32", T.LongType()),
        T.StructField("lossless", T.BooleanType()),
    ]
)


class Vocabulary:
    """The pieces of a model file, as bytes in which a space is a space."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.ids: dict[bytes, int] = {}
        self.scores = np.array([model.get_score(i) for i in range(n)])
        self.byte_ids = np.full(256, -1)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = piece.replace(SPACE, " ").encode()
                self.ids[self.bytes[i]] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes])])

    def spells(self, ids: np.ndarray, text: np.ndarray) -> bool:
        """Whether the pieces, without the space before them, are this text; a stretch at a time."""
        at = -1 if len(ids) else 0
        for k in range(0, len(ids), STRETCH):
            part = self.decode(ids[k : k + STRETCH], np.zeros(1, np.int64))[0]
            if not np.array_equal(part[max(0, -at) :], text[max(0, at) : at + len(part)]):
                return False
            at += len(part)
        return at == len(text)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of several texts' pieces and each text's bounds in them, the space before each still there."""
        lengths = self.ends[ids + 1] - self.ends[ids]
        done = np.concatenate([[0], np.cumsum(lengths)])
        source = np.arange(done[-1]) + np.repeat(self.ends[ids] - done[:-1], lengths)
        return self.flat[source], done[bounds]


class Sampler:
    """Encodes batches. Each chunk met is a stretch of nodes (its places), each node a stretch of edges into it."""

    def __init__(self, path: str, alpha: float, seed: int):
        self.vocabulary = Vocabulary(path)
        # What the model never merges is no edge, but single characters always are: they and bytes that stand for
        # themselves weigh as the rarest piece at least.
        scores = self.vocabulary.scores
        least = scores[scores > -1e8].min()
        self.usable = usable = {piece: i for piece, i in self.vocabulary.ids.items() if scores[i] > -1e8 or len(piece.decode()) == 1}
        self.log_weights = alpha * np.maximum(scores, least)
        self.log_weights[self.vocabulary.byte_ids] = alpha * least
        self.seed = B.U64(seed)
        #: Neighbouring bytes that some piece holds; between others, every segmentation has a bound.
        self.joined = np.zeros((256, 256), bool)
        #: For each length in bytes the pieces' hashes, ascending, and their ids.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        for k in sorted({len(piece) for piece in usable}):
            same = [piece for piece in usable if len(piece) == k]
            flat = np.frombuffer(b"".join(same), np.uint8).reshape(-1, k)
            for i in range(k - 1):
                self.joined[flat[:, i], flat[:, i + 1]] = True
            at = np.arange(len(same)) * k
            hashes = B.mix(B.span(B.prefix_sums(B.SYMBOL[flat.ravel()]), at, at + k) + B.U64(k))
            order = np.argsort(hashes)
            self.by_length[k] = hashes[order], np.array([usable[piece] for piece in same])[order]
            self.maybe[hashes >> B.U64(64 - FILTER_BITS)] = True
        # A character's own bytes stay together, so that byte fallback sees all of it.
        self.joined[:, 0x80:0xC0] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.n_bytes = 0
        self.last = np.zeros(1 << 12, np.int64)  # of each chunk, its last node
        self.first_edge = np.zeros(1 << 14, np.int32)  # of each node; its first node has none
        self.piece = np.zeros(1 << 15, np.int32)  # of each edge
        self.size = np.zeros(1 << 15, np.uint8 if max(self.by_length) < 256 else np.int32)  # its length in bytes
        self.upto = np.zeros(1 << 15)  # the probability of it and the edges before it, 1 at a node's last
        self.n_nodes = self.n_edges = 0

    def _edges(self, text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All edges of some chunks as (start, length, piece). left: for each byte, how many its chunk has from it."""
        sums = B.prefix_sums(B.SYMBOL[text])
        starts, sizes, pieces = [], [], []
        lead = np.flatnonzero((text & 0xC0) != 0x80)
        length = np.diff(np.append(lead, len(text)))  # of characters
        alone = np.ones(len(lead), bool)
        number = np.full(len(text), -1)
        number[lead] = np.arange(len(lead))
        for k, (hashes, ids) in self.by_length.items():
            at = np.flatnonzero(left >= k)
            here = B.mix(B.span(sums, at, at + k) + B.U64(k))
            on = np.flatnonzero(self.maybe[here >> B.U64(64 - FILTER_BITS)])
            at, here = at[on], here[on]
            place = np.minimum(np.searchsorted(hashes, here), len(hashes) - 1)
            on = np.flatnonzero(hashes[place] == here)
            at, place = at[on], place[on]
            starts.append(at)
            sizes.append(np.full(len(at), k))
            pieces.append(ids[place])
            of_one = number[at]
            alone[of_one[(of_one >= 0) & (length[of_one] == k)]] = False
        # Characters without a piece, byte by byte.
        own = np.repeat(alone, length)
        at = np.flatnonzero(own)
        starts.append(at)
        sizes.append(np.ones(len(at), np.int64))
        pieces.append(self.vocabulary.byte_ids[text[at]])
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(pieces)

    def _learn(self, keys: list[int], text: np.ndarray, lengths: np.ndarray) -> None:
        """Forward filtering of new chunks, whose bytes are text, for all of them one place after the other."""
        begin = np.cumsum(lengths) - lengths
        chunk = np.repeat(np.arange(len(lengths)), lengths)
        left = (begin + lengths)[chunk] - np.arange(len(text))
        start, size, piece = self._edges(text, left)
        of = chunk[start]
        # A chunk of n bytes has n + 1 nodes.
        node_from = start + of
        offset = start - begin[of] + size
        order = np.lexsort((size, node_from + size, offset))
        node_from, size, piece, offset = node_from[order], size[order], piece[order], offset[order]
        node_to = node_from + size
        n_nodes = len(text) + len(lengths)
        total = np.full(n_nodes, -np.inf)
        total[begin + np.arange(len(lengths))] = 0.0
        upto = np.zeros(len(size))
        bounds = np.searchsorted(offset, np.arange(1, int(offset.max()) + 2)) if len(offset) else []
        weights = self.log_weights[piece]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            to = node_to[a:b]
            first = np.flatnonzero(np.diff(to, prepend=-1))
            count = np.diff(np.append(first, b - a))
            mass = total[node_from[a:b]] + weights[a:b]
            top = np.maximum.reduceat(mass, first)
            reached = np.where(np.isfinite(top), top, 0.0)
            part = np.exp(mass - np.repeat(reached, count))
            done = np.cumsum(part)
            before = np.repeat(done[first] - part[first], count)
            whole = done[first + count - 1] - (done[first] - part[first])
            with np.errstate(divide="ignore"):
                total[to[first]] = reached + np.log(whole)
            share = (done - before) / np.repeat(np.where(whole > 0, whole, 1.0), count)
            share[first + count - 1] = 1.0
            upto[a:b] = share
        order = np.lexsort((size, node_to))
        first_edge = self.n_edges + np.searchsorted(node_to[order], np.arange(n_nodes))
        n = len(self.known)
        last = self.n_nodes + np.cumsum(lengths + 1) - 1
        for name, values, at in (("last", last, n), ("first_edge", first_edge, self.n_nodes), ("piece", piece[order], self.n_edges), ("size", size[order], self.n_edges), ("upto", upto[order], self.n_edges)):
            old = getattr(self, name)
            if len(old) < at + len(values):
                more = np.zeros(max(at + len(values), len(old) + len(old) // 4) - len(old), old.dtype)
                old = np.concatenate([old, more])
            old[at : at + len(values)] = values
            setattr(self, name, old)
        self.n_nodes += n_nodes
        self.n_edges += len(order)
        self.n_bytes += len(text)
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: the bytes of several texts, offsets: their n + 1 bounds, keys: their rows' 64-bit keys. Returns all
        pieces and the texts' n + 1 bounds in them."""
        sizes = np.diff(offsets)
        some = sizes > 0
        # A space before each text that isn't empty.
        begin = offsets[:-1] - offsets[0] + np.cumsum(some) - some
        total = int(sizes.sum() + some.sum())
        if not total:
            return np.zeros(0, np.int32), np.zeros(len(sizes) + 1, np.int64)
        text = np.full(total, 0x20, np.uint8)
        own = np.ones(total, bool)
        own[begin[some]] = False
        text[own] = data[offsets[0] : offsets[-1]]
        del own
        cut = np.zeros(total, bool)
        for a in range(1, total, STRETCH):
            b = min(total, a + STRETCH)
            cut[a:b] = ~self.joined.ravel()[(text[a - 1 : b - 1].astype(np.int32) << 8) | text[a:b]]
        cut[begin[some]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], total)
        salts = B.mix(keys[some].astype(B.U64) * B.U64(B.BASE) + self.seed)
        bounds, found, n_done, first = np.zeros(len(sizes) + 1, np.int64), [], 0, 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + STRETCH, "right")))
            low, high = int(starts[first]), int(ends[last - 1])
            row = np.searchsorted(begin[some], starts[first:last], "right") - 1
            # Places count from the text's own beginning, so that a row's numbers don't depend on its batch.
            before = low - begin[some][row]
            if high - low > STRETCH:
                slot = self._sample_long(text[low:high], salts[row[0]], int(before[0]))
            else:
                slot = self._sample(text[low:high], starts[first:last] - low, ends[first:last] - low, salts[row], before)
            here = slot >= 0
            a, b = np.searchsorted(begin, [low, high])
            bounds[a:b] = n_done + np.concatenate([[0], np.cumsum(here)])[begin[a:b] - low]
            found.append(slot[here])
            n_done += len(found[-1])
            first = last
        bounds[np.searchsorted(begin, total) :] = n_done
        return np.concatenate(found), bounds

    def _sample(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray, before: np.ndarray) -> np.ndarray:
        """For each byte of some chunks the piece that ends with it, or -1. salt and before: for each chunk its row's
        salt, and how many bytes of its text stand before this stretch of bytes (fewer than none, if it begins in it)."""
        hashes = B.hashes(text, starts, ends, B.SYMBOL)
        codes, distinct = pd.factorize(hashes)
        entry = self._known(distinct)
        missing = np.flatnonzero(entry < 0)
        first = np.zeros(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        lengths = (ends - starts)[first]
        if len(self.known) + len(missing) > REMEMBERED or self.n_bytes + int(lengths[missing].sum()) > REMEMBERED_BYTES:
            self._forget()
            missing = np.arange(len(distinct))
        if len(missing):
            n = lengths[missing]
            entry[missing] = np.arange(len(self.known), len(self.known) + len(missing))
            source = np.arange(n.sum()) + np.repeat(starts[first[missing]] - (np.cumsum(n) - n), n)
            self._learn(distinct[missing].tolist(), text[source], n)
        node = self.last[entry[codes]]
        first_node = node - (ends - starts)
        at = ends.copy()
        slot = np.full(len(text), -1, np.int32)
        while len(node):
            u = uniform(salt, at + before)
            edge = self.first_edge[node].astype(np.int64)
            more = np.flatnonzero(self.upto[edge] <= u)
            while len(more):  # a node's last edge has 1, which no u reaches
                edge[more] += 1
                more = more[self.upto[edge[more]] <= u[more]]
            slot[at - 1] = self.piece[edge]
            size = self.size[edge].astype(np.int64)
            node, at = node - size, at - size
            if len(on := np.flatnonzero(node > first_node)) < len(node):
                node, first_node, at, salt, before = node[on], first_node[on], at[on], salt[on], before[on]
        return slot

    def _known(self, keys: np.ndarray) -> np.ndarray:
        get = self.known.get
        return np.array([get(k, -1) for k in keys.tolist()], np.int64)

    def _sample_long(self, text: np.ndarray, salt: np.uint64, before: int) -> np.ndarray:
        """The same of one chunk of any length, which isn't remembered: its places are filtered stretch by stretch,
        keeping only what the next stretch needs, and filtered again on the way back, when they are drawn."""
        n, slot = len(text), np.full(len(text), -1, np.int32)
        bounds = [0]
        while bounds[-1] < n:
            end = min(n, bounds[-1] + LONG_STRETCH)
            while end < n and text[end] & 0xC0 == 0x80:
                end += 1
            bounds.append(end)
        totals, carried = {0: 0.0}, []
        for a, b in zip(bounds, bounds[1:], strict=False):
            carried.append(totals)
            totals = self._filtered(text, a, b, totals, None)
        node = n
        for a, b, totals in zip(bounds[-2::-1], bounds[:0:-1], carried[::-1], strict=True):
            edges: dict[int, list[tuple[float, int, int]]] = {}
            self._filtered(text, a, b, totals, edges)
            u = uniform(np.full(b - a, salt), np.arange(a + 1, b + 1) + before).tolist()
            while node > a:
                whole, drawn = sum(e[0] for e in edges[node]), 0.0
                for part, size, piece in edges[node]:
                    drawn += part
                    if drawn > u[node - a - 1] * whole:
                        break
                slot[node - 1] = piece
                node -= size
        return slot

    def _filtered(self, text: np.ndarray, a: int, b: int, totals: dict[int, float], edges: dict | None) -> dict[int, float]:
        """Forward filtering of places a + 1 to b. totals: of the places up to a that an edge can start from. Returns
        those for the next stretch. edges: gets (weight, size, piece) of the edges into each place, short ones first."""
        low = max(0, a - max(self.by_length))
        while text[low] & 0xC0 == 0x80:
            low -= 1
        start, size, piece = self._edges(text[low:b], b - low - np.arange(b - low))
        on = np.flatnonzero(start + size + low > a)
        on = on[np.lexsort((size[on], start[on] + size[on]))]
        to = start[on] + size[on] + low
        rows = list(zip(size[on].tolist(), piece[on].tolist(), self.log_weights[piece[on]].tolist(), strict=True))
        ends = np.searchsorted(to, np.arange(a + 1, b + 2)).tolist()
        totals = dict(totals)
        for k, place in enumerate(range(a + 1, b + 1)):
            into = [(totals.get(place - n, -math.inf) + w, n, i) for n, i, w in rows[ends[k] : ends[k + 1]]]
            top = max((x[0] for x in into), default=-math.inf)
            if top > -math.inf:
                parts = [(math.exp(w - top), n, i) for w, n, i in into]
                totals[place] = top + math.log(sum(x[0] for x in parts))
                if edges is not None:
                    edges[place] = parts
        return {place: total for place, total in totals.items() if place >= b - max(self.by_length)}


def uniform(salt: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number from 0 to below 1 for each place of a row."""
    return (B.mix(salt + place.astype(B.U64) * B.U64(0xD6E8FEB86659FD93)) >> B.U64(11)).astype(np.float64) * 2.0**-53


@lru_cache(1)
def sampler(path: str, alpha: float, seed: int) -> Sampler:
    return Sampler(path, alpha, seed)


def encode(docs: DataFrame, model: str, alpha: float = 5e-4, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the columns of ADDED: the sampled pieces, how many, their CRC-32 as little-endian 32-bit integers,
    and whether decoding them gives the text back."""
    prepare(docs.sparkSession)
    names = without(docs, *ADDED.names)
    docs = docs.select(columns(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = sampler(model, alpha, seed)
        for batch in batches:
            data, offsets = B.utf8(batch.column(batch.schema.get_field_index(text_col)))
            keys = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64()).fill_null(0).to_numpy()
            first = 0
            while first < len(keys):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + GROUP_BYTES, "right")) - 1)
                given, bounds = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                ids, at = encoder.encode(given, bounds, keys[first:last])
                each = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                lossless = [encoder.vocabulary.spells(x, given[a:b]) for x, a, b in zip(each, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                crcs = [zlib.crc32(x.astype("<i4", copy=False).data) for x in each]
                added = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(np.diff(at)), pa.array(crcs, pa.int64()), pa.array(lossless)]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, *added], names=names + ADDED.names)
                first = last
        encoder._forget()  # idle workers hold nothing

    return mapped(docs, run, T.StructType([*docs.schema, *ADDED]))


def decode(encoded: DataFrame, model: str, ids_col: str = "piece_ids") -> DataFrame:
    """encoded with decoded_text, from the pieces alone; null pieces decode to the empty text."""
    prepare(encoded.sparkSession)
    names = without(encoded, "decoded_text")
    encoded = encoded.select(columns(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sampler(model, 0.0, 0).vocabulary
        for batch in batches:
            texts = []
            for ids in batch.column(batch.schema.get_field_index(ids_col)):
                ids = np.array(ids.as_py() or [], np.int64)
                texts.append(vocabulary.decode(ids, np.array([0, len(ids)]))[0].tobytes()[1:].decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded_text"])

    return mapped(encoded, run, T.StructType([*encoded.schema, T.StructField("decoded_text", T.StringType())]))
