"""Suffix arrays by induced sorting and permuted longest common prefixes.

The text's own level, of bytes, is induced with numpy over whole buckets at a time. The levels of names below it have about as many
buckets as suffixes, so they are induced suffix by suffix. Both take time in proportion to the length.
"""

from __future__ import annotations

from array import array

import numpy as np


def _classes(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one. The last value is the only smallest."""
    step = np.sign(np.diff(t.astype(np.int32)))
    change = np.where(step != 0, np.arange(len(step), dtype=np.int32), np.int32(len(step)))
    following = np.minimum.accumulate(change[::-1])[::-1]
    out = np.ones(len(t), bool)
    out[:-1] = step[following] > 0
    return out


class _Buckets:
    def __init__(self, t: np.ndarray, k: int, smaller: np.ndarray, lms: np.ndarray):
        self.t, self.k, self.smaller = t, k, smaller
        counts = np.bincount(t, minlength=k)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.larger = np.bincount(t[~smaller], minlength=k)
        self.lms = np.bincount(t[lms], minlength=k)
        self.used = np.flatnonzero(counts)

    def _spread(self, places: np.ndarray, want: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Predecessors of the wanted class with their characters, number within each character, and counts."""
        p = places[places > 0] - 1
        p = p[self.smaller[p] == want]
        c = self.t[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        counts = np.bincount(c, minlength=self.k)
        return p, c, np.arange(len(p)) - (np.cumsum(counts) - counts)[c], counts

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """The order of all suffixes from that of the leftmost-smaller ones: larger ones upwards, then smaller ones downwards."""
        sa = np.full(len(self.t), -1, np.int32)
        c = self.t[lms]
        order = np.argsort(c, kind="stable")
        c = c[order]
        begin = np.cumsum(self.lms) - self.lms
        sa[(self.ends - self.lms)[c] + np.arange(len(lms)) - begin[c]] = lms[order]
        head = self.starts.copy()

        def put(places: np.ndarray) -> None:
            p, c, k, counts = self._spread(places, False)
            sa[head[c] + k] = p
            np.add(head, counts, out=head)

        for x in self.used:
            low = self.starts[x]
            while low < head[x]:  # runs of one character go on within the bucket
                high = head[x]
                put(sa[low:high])
                low = high
            if self.lms[x]:
                put(sa[self.ends[x] - self.lms[x] : self.ends[x]])
        tail = self.ends.copy()

        def put_down(places: np.ndarray) -> None:
            p, c, k, counts = self._spread(places, True)
            sa[tail[c] - 1 - k] = p
            np.subtract(tail, counts, out=tail)

        for x in self.used[::-1]:
            high = self.ends[x]
            while tail[x] < high:
                low = tail[x]
                put_down(sa[low:high][::-1])
                high = low
            if self.larger[x]:
                put_down(sa[self.starts[x] : self.starts[x] + self.larger[x]][::-1])
        sa[0] = len(self.t) - 1
        return sa


def _plain(x: np.ndarray) -> array:
    return array("i", x.astype(np.int32).tobytes())


class _Singly:
    """As _Buckets, suffix by suffix."""

    def __init__(self, t: np.ndarray, k: int, smaller: np.ndarray):
        self.t, self.ends = t, np.cumsum(np.bincount(t, minlength=k))
        self.starts = np.append(0, self.ends[:-1])
        # For each place the character before it if that begins a larger (smaller) suffix, else -1; at the end one more for -1.
        none = np.full(len(t) + 1, -1, np.int32)
        self.larger, self.less = none, none.copy()
        self.larger[1:-1] = np.where(smaller[:-1], -1, t[:-1])
        self.less[1:-1] = np.where(smaller[:-1], t[:-1], -1)

    def induce(self, lms: np.ndarray) -> np.ndarray:
        sa = np.full(len(self.t), -1, np.int32)
        c = self.t[lms]
        order = np.argsort(c, kind="stable")
        c = c[order]
        counts = np.bincount(c, minlength=len(self.ends))
        sa[(self.ends - counts)[c] + np.arange(len(c)) - (np.cumsum(counts) - counts)[c]] = lms[order]
        # Arrays of plain numbers take a sixth of a list's memory, and Python reads them as they stand.
        out, before, at = _plain(sa), _plain(self.larger), _plain(self.starts)
        for p in out:  # grows as it is read
            x = before[p]
            if x >= 0:
                k = at[x]
                out[k] = p - 1
                at[x] = k + 1
        before, at = _plain(self.less), _plain(self.ends)
        for p in reversed(out):
            x = before[p]
            if x >= 0:
                k = at[x] - 1
                out[k] = p - 1
                at[x] = k
        return np.frombuffer(out, np.int32)


def suffix_array(t: np.ndarray, k: int, top: bool = True) -> np.ndarray:
    """Order of the suffixes of t, whole numbers below k whose last one is 0 and the only 0. top: the text's own level."""
    if len(t) == 1:
        return np.zeros(1, np.int32)
    smaller = _classes(t)
    is_lms = np.zeros(len(t), bool)
    is_lms[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    induce = (_Buckets(t, k, smaller, lms) if top else _Singly(t, k, smaller)).induce
    # A first induction from the text's order sorts the leftmost-smaller substrings.
    sa = induce(lms)
    ordered = sa[is_lms[sa]]
    size = np.zeros(len(t), np.int32)
    size[lms] = np.append(np.diff(lms), 1)
    a, b = ordered[:-1], ordered[1:]
    same = np.zeros(len(a), bool)
    open_ = np.flatnonzero(size[a] == size[b])
    at = 0
    while len(open_):
        open_ = open_[t[a[open_] + at] == t[b[open_] + at]]
        done = size[a[open_]] == at
        same[open_[done]] = True
        open_ = open_[~done]
        at += 1
        if len(open_):
            open_ = open_[np.maximum(a[open_], b[open_]) + at < len(t)]
    names = np.concatenate(([0], np.cumsum(~same))).astype(np.int32)
    del sa, size, a, b, same, open_
    if names[-1] < len(lms) - 1:
        by_place = np.empty(len(t), np.int32)
        by_place[ordered] = names
        ordered = lms[suffix_array(by_place[lms], int(names[-1]) + 1, top=False)]
    return induce(ordered)


def _common(raw: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of raw[a:] and raw[b:], at most `most`; eight bytes a step."""
    padded = np.concatenate((raw, np.zeros(16, np.uint8)))
    eight = np.ndarray((len(raw) + 8,), "<u8", padded.data, strides=(1,))
    out = np.zeros(len(a), np.int32)
    open_ = np.flatnonzero(most > 0)
    at = 0
    while len(open_):
        x = eight[a[open_] + at] ^ eight[b[open_] + at]
        equal = x == 0
        differ = ~equal
        first = np.bitwise_count((x[differ] & (~x[differ] + np.uint64(1))) - np.uint64(1)).astype(np.int32) // 8
        out[open_[differ]] = at + first
        open_ = open_[equal]
        at += 8
        over = most[open_] <= at
        out[open_[over]] = most[open_[over]]
        open_ = open_[~over]
    return np.minimum(out, most)


def shared_windows(raw: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """For several byte strings, one after another in raw: at which places `size` bytes begin, within one string, that also begin
    elsewhere."""
    n = len(raw)
    if not n:
        return np.zeros(0, bool)
    ends = np.cumsum(lengths)
    # Bytes from 2, 1 after each string, and 0 at the end.
    number = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    place = np.arange(n, dtype=np.int32) + number
    t = np.ones(n + len(lengths) + 1, np.int16)
    t[place] = raw.astype(np.int16) + 2
    t[-1] = 0
    sa = suffix_array(t, 258)
    # Back to places in raw: suffixes that begin with a separator drop out, they are the first ones.
    to_raw = np.full(len(t), -1, np.int32)
    to_raw[place] = np.arange(n)
    order = to_raw[sa]
    order = order[order >= 0]
    del sa, to_raw, t, place
    phi = np.full(n, -1, np.int32)
    phi[order[1:]] = order[:-1]
    left = (ends[number] - np.arange(n)).astype(np.int32)
    starts = np.zeros(n, bool)
    starts[(ends - lengths)[lengths > 0]] = True
    # A prefix is reducible if the places before also agree: then it is one shorter than theirs.
    i = np.arange(n, dtype=np.int32)
    before = np.maximum(phi - 1, 0)
    reducible = ~starts & (phi > 0) & ~starts[np.maximum(phi, 0)]
    reducible[1:] &= raw[:-1] == raw[before[1:]]
    # The place before must have the place before phi as its neighbour.
    reducible[1:] &= phi[:-1] == phi[1:] - 1
    reducible[0] = False
    own = np.flatnonzero(~reducible & (phi >= 0))
    base = np.zeros(n, np.int32)
    base[own] = _common(raw, own, phi[own], np.minimum(left[own], left[phi[own]]))
    last = np.maximum.accumulate(np.where(~reducible, i, 0))
    plcp = base[last] - (i - last)
    out = np.zeros(n, bool)
    hit = np.flatnonzero((plcp >= size) & (phi >= 0))
    out[hit] = True
    out[phi[hit]] = True
    return out
