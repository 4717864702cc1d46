"""Suffix arrays by induced sorting, and permuted common prefixes, in array steps.

Suffixes are classified as S (smaller than the next one) or L; the leftmost of a run of S suffixes begins a leftmost-
smaller substring. Those substrings are sorted by inducing from their first characters, named, and the string of names
is sorted in turn; from the order it gives, all suffixes are induced in linear time. An induction walks the buckets of
first characters; all of a bucket's entries that are known induce their left neighbours at once, and neighbours that
fall into the same bucket form its next wave.

The string of names has an alphabet about as large as itself, whose buckets hold one or two places each: there an
array step for each bucket would cost more than a plain step for each place. It is sorted by the same method, recursively,
in such plain steps over lists.

Common prefixes come in text order: where a suffix and its predecessor in the array have equal characters before them,
the length is one less than that of the suffix one to the left; only the others are compared, eight bytes a step.
"""

from __future__ import annotations

import numpy as np

from . import bytesops as B


def _types(text: np.ndarray) -> np.ndarray:
    """For each place, whether its suffix is of type S. The end counts as smaller than any character."""
    n = len(text)
    step = np.flatnonzero(text[:-1] != text[1:])  # the type is decided there, for all equal characters before
    rises = text[step] < text[step + 1]
    out = np.zeros(n, bool)
    if len(step):
        out[: step[-1] + 1] = np.repeat(rises, np.diff(step, prepend=-1))
    return out


class _Induction:
    def __init__(self, text: np.ndarray):
        self.text, self.is_s = text, _types(text)
        self.counts = np.bincount(text, minlength=256)
        self.heads = np.cumsum(self.counts) - self.counts
        self.tails = self.heads + self.counts
        self.leftmost = np.flatnonzero(self.is_s[1:] & ~self.is_s[:-1]) + 1

    def _put(self, array: np.ndarray, suffixes: np.ndarray, heads: np.ndarray, forward: bool) -> None:
        """Appends suffixes, in order, to their buckets' heads, or else before their tails."""
        first = self.text[suffixes]
        order = np.argsort(first, kind="stable")
        first = first[order]
        counts = np.bincount(first, minlength=256)
        rank = np.arange(len(first)) - (np.cumsum(counts) - counts)[first]
        if forward:
            array[heads[first] + rank] = suffixes[order]
            heads += counts
        else:
            array[heads[first] - 1 - rank] = suffixes[order]
            heads -= counts

    def run(self, leftmost: np.ndarray) -> np.ndarray:
        """All suffixes in order, from the leftmost-smaller ones in order."""
        n, text, is_s = len(self.text), self.text, self.is_s
        array = np.full(n, -1, np.int64)
        # Leftmost-smaller suffixes stand at their buckets' ends.
        tails = self.tails.copy()
        self._put(array, leftmost[::-1], tails, False)
        first_s = tails.copy()
        heads = self.heads.copy()
        self._put(array, np.array([n - 1]), heads, True)  # the end induces the last suffix
        for c in np.flatnonzero(self.counts).tolist():
            done = int(self.heads[c])
            while done < heads[c]:
                wave = array[done : heads[c]]
                done = int(heads[c])
                self._left(array, wave, heads, True)
            self._left(array, array[first_s[c] : self.tails[c]], heads, True)
        # The S suffixes anew, from the L ones.
        tails = self.tails.copy()
        for c in np.flatnonzero(self.counts).tolist()[::-1]:
            done = int(self.tails[c])
            while done > tails[c]:
                wave = array[tails[c] : done][::-1]
                done = int(tails[c])
                self._left(array, wave, tails, False)
            self._left(array, array[self.heads[c] : heads[c]][::-1], tails, False)
        return array

    def _left(self, array: np.ndarray, wave: np.ndarray, heads: np.ndarray, forward: bool) -> None:
        left = wave - 1
        left = left[left >= 0]
        left = left[self.is_s[left] != forward]
        if len(left):
            self._put(array, left, heads, forward)


def sorted_names(text: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffixes of a string of names below `alphabet`, in order: classified, their leftmost-smaller substrings
    sorted (recursively, where two are equal), and all induced from those."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    is_s = _types(text)
    leftmost = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    order = leftmost
    if len(leftmost) > 1:
        names = _substring_names(text, leftmost)
        most = int(names.max()) + 1
        order = leftmost[np.argsort(names) if most == len(leftmost) else sorted_names(names, most)]
    return _induced(text, is_s, order, alphabet)


def _substring_names(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings, equal for equal ones: those still tied are told apart by their next
    place, a place a step. One that has ended is larger than one that goes on (there the other one falls further); the
    last one, which ends with the text, is smaller."""
    sizes = np.append(places[1:] + 1, len(text)) - places
    rank = np.zeros(len(places), np.int64)
    tied, k = np.arange(len(places)), 0
    while len(tied):
        at = places[tied] + k
        over = k >= sizes[tied]
        here = np.where(over, np.iinfo(np.int32).max, text[np.minimum(at, len(text) - 1)])
        here[over & (tied == len(places) - 1)] = -1
        order = np.lexsort((here, rank[tied]))
        group, value = rank[tied][order], here[order]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new = new_group | np.concatenate([[True], value[1:] != value[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(tied)))
        # A rank is the number of substrings before: that of the group, and of its parts before this one.
        begin = np.maximum.accumulate(np.where(new_group, np.arange(len(tied)), 0))
        part = np.cumsum(new) - 1
        rank[tied[order]] = group + (first[part] - begin)
        # Tied still: parts of several, of which some go on.
        open_ = np.add.reduceat((~over[order]).astype(np.int64), first) > 0
        tied = tied[order][((size > 1) & open_)[part]]
        k += 1
    return np.unique(rank, return_inverse=True)[1].ravel()


def _induced(names: np.ndarray, types: np.ndarray, leftmost: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order, a place a step."""
    n = len(names)
    ends = np.cumsum(np.bincount(names, minlength=alphabet))
    starts = ends - np.bincount(names, minlength=alphabet)
    array = [-1] * n
    # Leftmost-smaller suffixes stand at their buckets' ends, in order.
    by_name = leftmost[np.argsort(names[leftmost], kind="stable")]
    of = names[by_name]
    counts = np.bincount(of, minlength=alphabet)
    slots = ends[of] - counts[of] + (np.arange(len(of)) - (np.cumsum(counts) - counts)[of])
    for slot, i in zip(slots.tolist(), by_name.tolist(), strict=True):
        array[slot] = i
    before = np.concatenate([[-1], names[:-1]])
    is_s = np.concatenate([[False], types[:-1]])
    # For each place the name of the one before, where a pass is to induce that, or else -1.
    of_l = np.where(is_s, -1, before).tolist()
    of_s = np.where(is_s, before, -1).tolist()
    at = starts.tolist()
    c = int(names[n - 1])
    array[at[c]] = n - 1
    at[c] += 1
    for i in array:  # grows ahead of itself
        if i > 0:
            c = of_l[i]
            if c >= 0:
                array[at[c]] = i - 1
                at[c] += 1
    at = ends.tolist()
    for k in range(n - 1, -1, -1):
        i = array[k]
        c = of_s[i]  # the first place has no place before it
        if c >= 0:
            at[c] -= 1
            array[at[c]] = i - 1
    return np.array(array)


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b, as many as sizes has, are equal."""
    if not len(a):
        return np.zeros(0, bool)
    first = np.cumsum(sizes) - sizes
    step = np.arange(sizes.sum()) - np.repeat(first, sizes)
    return ~np.logical_or.reduceat(text[np.repeat(a, sizes) + step] != text[np.repeat(b, sizes) + step], first)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """text: bytes. Its suffixes' places, in order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    induction = _Induction(text)
    places = induction.leftmost
    if not len(places):
        return induction.run(places)
    order = induction.run(places)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[places] = True
    order = order[is_leftmost[order]]
    # A substring reaches to the next one's first character; the last one to the text's end.
    ends = np.append(places[1:] + 1, n)
    number = np.empty(n, np.int64)
    number[places] = np.arange(len(places))
    hashes = B.span(B.prefix_sums(B.SYMBOL[text]), places, ends)
    at = number[order]
    sizes = ends - places
    differs = (hashes[at[1:]] != hashes[at[:-1]]) | (sizes[at[1:]] != sizes[at[:-1]])
    alike = np.flatnonzero(~differs)  # by hash: the bytes decide
    differs[alike] = ~_equal(text, order[alike], order[alike + 1], sizes[at[alike]])
    # The last substring ends with the text, which counts as smaller than any byte.
    is_last = at == len(places) - 1
    differs |= is_last[1:] | is_last[:-1]
    names = np.empty(len(places), np.int64)
    names[at] = np.concatenate([[0], np.cumsum(differs)])
    if names[at[-1]] + 1 < len(places):
        order = places[sorted_names(names, int(names[at[-1]]) + 1)]
    return induction.run(order)


def common_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """In text order: how many bytes each suffix has in common with its predecessor in the array (0 for the first)."""
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    here = np.arange(n)
    follows = np.zeros(n, bool)  # one less than the suffix to the left
    at = here[1:][(before[1:] > 0) & (before[:-1] >= 0)]
    follows[at] = text[at - 1] == text[before[at] - 1]
    own = np.flatnonzero(~follows & (before >= 0))
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", padded, 0, (1,))
    length, open_ = np.zeros(len(own), np.int64), np.arange(len(own))
    other = before[own]
    top = n - np.maximum(own, other)
    while len(open_):
        k = length[open_]
        apart = words[np.minimum(own[open_] + k, n)] ^ words[np.minimum(other[open_] + k, n)]
        # Equal low bytes come first: the lowest set bit's byte.
        low = apart & (~apart + np.uint64(1))
        same = np.where(apart == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)) // 8).astype(np.int64))
        length[open_] = np.minimum(k + same, top[open_])
        open_ = open_[(same == 8) & (length[open_] < top[open_])]
    out[own] = length
    anchor = np.zeros(n, np.int64)
    anchor[own] = own
    anchor = np.maximum.accumulate(np.where(follows, 0, here))
    out[follows] = out[anchor[follows]] - (here[follows] - anchor[follows])
    return out
