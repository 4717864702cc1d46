"""Secret scans: known shapes, and strings whose characters are too even for language.

Three kinds have a fixed shape: an assignment to a name such as `password`, an access key, and a long hexadecimal
string. The method adds a fourth, `entropy`: candidates are maximal runs of the characters that keys are written in;
over a window that slides along a candidate, the Shannon entropy of its characters is kept up to date by two changes
of counts a step. The class is each window's own: one of hexadecimal digits alone has their threshold also where a
prefix or a separator makes its candidate base 64. The places of windows at or above their threshold are merged into
spans by class. A span goes if an allowed shape explains all of it, or all of its candidate: a UUID, words joined
by signs, a stretch of one repeated piece; and if a span of a fixed shape overlaps it. An alphabet or digits in order
and a placeholder explain only the windows that they overlap. What is left of a candidate's spans is merged where it
overlaps.

Spans are in code points, ends exclusive. Defined cases: null and empty texts have no spans; overlapping matches of one
kind are leftmost first; columns that the scan adds replace columns of that name.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .scratch import columns, mapped, prepare, without

KINDS = ("assign", "access", "hex", "entropy")
_letters = lambda word: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)
_names = "|".join((*map(_letters, ("password", "passwd", "secret", "token")), _letters("api") + "_?" + _letters("key")))
ASSIGN = re.compile(rf"""({_names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: These two match the same runs as with a plus and a later look at the length: a run's start is its only match.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a character: the least entropy of a window for each class. 20 characters have log2(20) = 4.32 at most.
HEX_BITS, BASE64_BITS = 3.1, 3.9
HEX_CLASS = frozenset("0123456789abcdefABCDEF")

ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    # Words, joined by signs; each place can match in one way only, so a long failing run costs no more than its length.
    re.compile(r"[A-Z]?[a-z]*(?:[-_/=+][A-Z]?[a-z]*)*|[A-Z]+(?:[-_/=+][A-Z]+)*"),
    re.compile(r"(.{1,8}?)\1+.{0,7}"),
)
PLACEHOLDER = re.compile(r"(?i:example|placeholder|changeme|your[-_]|xxxx+|0000+)")
ORDERED = ("abcdefghijklmnopqrstuvwxyz", "01234567890123456789")

_terms = [0.0] + [c * log2(c) for c in range(1, WINDOW + 1)]


def even_windows(run: str) -> list[tuple[int, int]]:
    """The merged places of a candidate's windows of high entropy, by class: those of hexadecimal digits alone, and
    unless the whole candidate is one of them, those of any characters."""
    return [span for a, b in unexplained(run) for span in _even_windows(run[a:b], a, HEX_CLASS.issuperset(run))]


def _even_windows(run: str, at: int, whole: bool) -> list[tuple[int, int]]:
    most_hex, most = (WINDOW * (log2(WINDOW) - bits) + 1e-9 for bits in (HEX_BITS, BASE64_BITS))  # sums of c log2 c at those entropies
    counts: dict[str, int] = {}
    total, other = 0.0, -1  # other: the last place of a sign that is no hexadecimal digit
    of_hex: list[tuple[int, int]] = []
    of_any: list[tuple[int, int]] = []
    for i, c in enumerate(run):
        if i >= WINDOW:
            n = counts[gone := run[i - WINDOW]]
            counts[gone] = n - 1
            total += _terms[n - 1] - _terms[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _terms[n + 1] - _terms[n]
        if c not in HEX_CLASS:
            other = i
        if i >= WINDOW - 1:
            start = i - WINDOW + 1
            if total <= most_hex and other < start:
                _extend(of_hex, start, i + 1)
            if total <= most and not whole:
                _extend(of_any, start, i + 1)
    return sorted((a + at, b + at) for a, b in of_hex + of_any)


def _extend(spans: list[tuple[int, int]], start: int, end: int) -> None:
    """Adds a span that starts at or after the last one's start, or merges it with that."""
    if spans and start <= spans[-1][1]:
        spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
    else:
        spans.append((start, end))


def unexplained(run: str) -> list[tuple[int, int]]:
    """The stretches of a candidate between placeholders and ordered characters that have room for a window."""
    low = run.lower()
    cut = [m.span() for m in PLACEHOLDER.finditer(run)]
    for x in {x[i : i + 12] for x in ORDERED for i in range(len(x) - 11)}:
        at = low.find(x)
        while at >= 0:
            cut.append((at, at + 12))
            at = low.find(x, at + 1)
    out, done = [], 0
    for a, b in [*sorted(cut), (len(run), len(run))]:
        if a - done >= WINDOW:
            out.append((done, a))
        done = max(done, b)
    return out


def allowed(run: str) -> bool:
    return any(p.fullmatch(run) for p in ALLOWED)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), by start and kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """base: by start."""
    out: list[tuple[int, int]] = []
    taken: list[tuple[int, int]] = []
    for s, _, e in base:
        _extend(taken, s, e)
    ends = [e for _, e in taken]
    for m in CANDIDATE.finditer(text):
        if allowed(m[0]):
            continue
        for a, b in even_windows(m[0]):
            a, b = a + m.start(), b + m.start()
            at = bisect_right(ends, a)  # the first stretch of base spans that ends after a
            if (at == len(taken) or taken[at][0] >= b) and not allowed(text[a:b]):
                _extend(out, a, b)
    return [(a, 3, b) for a, b in out]


ADDED = T.StructType([T.StructField("secret_spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with secret_spans: kind, start and end of each, by start and then as KINDS has them."""
    prepare(docs.sparkSession)
    names = without(docs, *ADDED.names)
    docs = docs.select(columns(names))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                base = base_spans(text or "")
                found.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + entropy_spans(text or "", base))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*names, "secret_spans"])

    return mapped(docs, run, T.StructType([*docs.schema, *ADDED]))


def written(spans, kinds: tuple[str, ...] = KINDS):
    """A column of spans as text, kind:start:end joined by commas, of the given kinds."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
