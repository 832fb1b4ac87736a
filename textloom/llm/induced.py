"""Suffix order and common prefixes of a byte shard by induced sorting, in arrays that live on disk once they are large.

Suffixes are of type S (smaller than the next one) or L. Those S suffixes that follow an L one, the S* suffixes, are sorted first: the
pieces between them are named by rank, and the string of names is sorted by the same method, until names are unique. From the S*
suffixes an ascending scan induces all L suffixes, and from those a descending scan induces all S ones.

A scan reads a priority queue in order: the next smallest suffix is taken, and the suffix one place to the left, if it is of the type in question, is put in.
Since what is put in is never smaller than what is taken, and comes in order for every first character, the queue is one file of slots
with a write head for each character. It is read in runs that end before the first slot which the run itself fills, so
runs are long and are worked on as whole arrays.

With every suffix goes the length of its common prefix with the one before it, up to a limit. That of an induced suffix is one more than the least of those
between the two suffixes that induced it and its neighbour. Only where L and S suffixes of one character meet, and between S* suffixes,
are texts compared.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Bytes of an array from which on it is kept in a file, entries that a scan takes at a time, and entries that are sorted in memory.
IN_MEMORY, RUN, SORTED = 64 << 20, 1 << 17, 1 << 24


class Scratch:
    """Arrays in memory or, from ``limit`` bytes on, in unnamed files of the folder that Spark gives its workers for spilling.

    The files belong to one task and go with it."""

    def __init__(self, limit: int = IN_MEMORY, run: int = RUN, most: int = SORTED) -> None:
        self.limit, self.run, self.most, self.on_disk = limit, run, most, 0
        self.folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None

    def zeros(self, n: int, dtype: type) -> np.ndarray:
        if n * np.dtype(dtype).itemsize < self.limit or not n:
            return np.zeros(n, dtype)
        self.on_disk += 1
        with tempfile.TemporaryFile(dir=self.folder) as f:
            f.truncate(n * np.dtype(dtype).itemsize)
            return np.memmap(f, dtype, "r+", shape=(n,))

    def argsort(self, key: np.ndarray) -> np.ndarray:
        """Stable order of non-negative keys. Many keys are dealt by value to ranges that are sorted one by one."""
        if len(key) <= self.most:
            return np.argsort(key, kind="stable")
        out, filled = self.zeros(len(key), np.int64), 0
        low, high = int(key.min()), int(key.max())
        if low == high:
            for lo in range(0, len(key), self.run):
                out[lo : lo + self.run] = np.arange(lo, min(len(key), lo + self.run))
            return out
        width = max(1, -(-(high - low + 1) // 1024))
        count = np.zeros(1024, np.int64)
        for lo in range(0, len(key), self.run):
            count += np.bincount((key[lo : lo + self.run] - low) // width, minlength=1024)
        first = 0
        while first < 1024:
            last = first + 1
            while last < 1024 and count[first : last + 1].sum() <= self.most:
                last += 1
            a, b = low + first * width, low + last * width
            rows = np.concatenate([np.flatnonzero((key[lo : lo + self.run] >= a) & (key[lo : lo + self.run] < b)) + lo for lo in range(0, len(key), self.run)])
            out[filled : filled + len(rows)] = rows[self.argsort(key[rows])] if len(rows) < len(key) else rows[np.argsort(key[rows], kind="stable")]
            filled, first = filled + len(rows), last
        return out


def types(chars: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S. The last character is the only one of its value and the smallest; its suffix counts as S."""
    n = len(chars)
    step = np.flatnonzero(chars[1:] != chars[:-1])  # the last place of each run of equal characters
    rises = chars[step] < chars[step + 1]
    return np.r_[np.repeat(rises, np.diff(np.r_[-1, step])), np.ones(n - 1 - (step[-1] if len(step) else -1), bool)]


def named(chars: np.ndarray, starts: np.ndarray, top: int, scratch: Scratch) -> np.ndarray:
    """The rank, among distinct ones, of the piece of ``chars`` from each start to the next start included. Of two of which one begins the other, the longer is smaller."""
    bits = int(top + 1).bit_length()
    width, pad = 63 // bits, (1 << bits) - 1
    length = np.diff(np.r_[starts, starts[-1]]) + 1

    def word(rows: np.ndarray, r: int) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        p, n = starts[rows], length[rows]
        for t in range(r * width, (r + 1) * width):
            out = out << bits | np.where(t < n, chars[np.minimum(p + t, len(chars) - 1)].astype(np.int64), pad)
        return out

    every = np.arange(len(starts))
    first = word(every, 0)
    order = scratch.argsort(first)
    first = first[order]
    new = np.r_[True, first[1:] != first[:-1]]
    # A word without padding leaves its piece open, unless no other has it.
    open_ = np.flatnonzero((first & pad) != pad)
    r = 0
    while len(open_):
        group = np.cumsum(new)[open_]
        size = np.bincount(group)
        open_, group = open_[size[group] > 1], group[size[group] > 1]
        if not len(open_):
            break
        r += 1
        w = word(order[open_], r)
        by = np.lexsort((w, group))
        order[open_] = order[open_][by]
        w = w[by]
        new[open_[1:]] |= (w[1:] != w[:-1]) & (group[1:] == group[:-1])
        open_ = open_[(w & pad) != pad]
    names = np.zeros(len(starts), np.uint16 if new.sum() <= 1 << 16 else np.int32 if len(new) < 1 << 31 else np.int64)
    names[order] = np.cumsum(new) - 1
    return names


def words(chars: np.ndarray, limit: int, scratch: Scratch) -> np.ndarray:
    """At every place the next four characters (of 16 bits) as one number, with zeros behind the end."""
    padded = scratch.zeros(len(chars) + limit + 4, np.uint16)
    padded[: len(chars)] = chars
    return np.ndarray(len(padded) - 3, np.dtype("<u8"), padded, strides=(2,))


def common(words: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, up to ``limit``, four characters at a time."""
    out = np.full(len(a), limit, np.uint8)
    left = np.arange(len(a))
    for d in range(0, limit, 4):
        differ = words[a + d] ^ words[b + d]
        ended = differ != 0
        x = differ[ended]
        out[left[ended]] = np.minimum(d + ((np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))) >> 4), limit)
        a, b, left = a[~ended], b[~ended], left[~ended]
        if not len(left):
            break
    return out


def _least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of ``values[lo : hi + 1]`` for each pair, by a table of doubling widths."""
    tables = [values]
    longest = int((hi - lo).max()) + 1
    while 2 << (len(tables) - 1) <= longest:
        t, step = tables[-1], 1 << (len(tables) - 1)
        doubled = t.copy()
        np.minimum(t[:-step], t[step:], out=doubled[:-step])
        tables.append(doubled)
    k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    flat, n = np.concatenate(tables), len(values)
    return np.minimum(flat[k * n + lo], flat[k * n + hi - (1 << k) + 1])


def _groups(c: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters in order, where each one's group begins, its size, and the place of every entry in its group."""
    sorted_c = c[by]
    new = np.ones(len(by), bool)
    np.not_equal(sorted_c[1:], sorted_c[:-1], out=new[1:])
    firsts = new.nonzero()[0]
    counts = np.empty(len(firsts), np.int64)
    if len(firsts):
        counts[:-1], counts[-1] = firsts[1:] - firsts[:-1], len(by) - firsts[-1]
    return sorted_c, firsts, counts, np.arange(len(by)) - firsts.repeat(counts)


class _Queue:
    """Slots in order of suffixes: for each character, those that the scan fills and those that are given, in the order of the scan."""

    def __init__(self, filled: np.ndarray, given: np.ndarray, order: np.ndarray, filled_first: bool, scratch: Scratch, limit: int) -> None:
        """``filled``, ``given``: slots by character; ``order``: characters in the order of the scan."""
        self.scratch, self.limit = scratch, limit
        both = np.zeros(2 * len(order), np.int64)
        a, b = (0, 1) if filled_first else (1, 0)
        both[a::2], both[b::2] = filled[order], given[order]
        starts = np.r_[0, np.cumsum(both)]
        self.head, self.given_at = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        self.head[order], self.given_at[order] = starts[:-1][a::2], starts[:-1][b::2]
        self.base = self.head.copy()
        self.n = int(starts[-1])
        self.at = scratch.zeros(self.n, np.int32 if self.n < 1 << 31 else np.int64)
        self.prefix = scratch.zeros(self.n, np.uint8) if limit else None
        self.edges = np.unique(starts) if limit else np.array([0, self.n])
        #: Second parts of a character whose first part isn't empty: there the texts are compared.
        self.meets = set(starts[1::2][(both[0::2] > 0) & (both[1::2] > 0)].tolist()) if limit else set()

    def scan(self, chars: np.ndarray, wanted: np.ndarray, ahead: np.ndarray | None) -> None:
        """Fill the slots: the suffix left of each one taken goes to the queue of its first character, if it is ``wanted``."""
        carry = np.full(len(self.head), 255, np.uint8)
        for start, end in zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True):
            if start in self.meets:
                self.prefix[start] = common(ahead, self.at[start - 1 : start].astype(np.int64), self.at[start : start + 1].astype(np.int64), self.limit)[0]
            i, size = start, self.scratch.run
            while i < end:
                before = np.asarray(self.at[i : min(end, i + size)]) - 1  # before the first suffix comes the last, which is never wanted
                took = wanted[before].nonzero()[0]
                c = chars[before[took]]
                by = np.argsort(c, kind="stable")
                sorted_c, firsts, counts, place = _groups(c, by)
                slot = np.empty(len(by), np.int64)
                slot[by] = self.head[sorted_c] + place
                # The run ends before the first slot that it fills itself.
                n = len(before)
                if len(slot):
                    least = np.minimum.accumulate(slot) - i
                    after = np.empty(len(took), np.int64)
                    after[:-1], after[-1] = took[1:], n
                    bad = (least < after).argmax()
                    if least[bad] < after[bad]:
                        n = int(min(n, max(took[bad] + 1, least[bad])))
                keep = len(took) if n == len(before) else int(np.searchsorted(took, n))
                took, slot, c = took[:keep], slot[:keep], c[:keep]
                if keep:
                    self.at[slot] = before[took]
                if self.prefix is not None:
                    if keep < len(by):
                        by = by[by < keep]
                        sorted_c, firsts, counts, _ = _groups(c, by)
                    self._prefixes(i, n, took, by, sorted_c, firsts, counts, slot, carry)
                self.head[c] = slot + 1  # of several of one character the last, which has the last slot
                i += n
                size = min(self.scratch.run, max(256, 2 * n))

    def _prefixes(self, i: int, n: int, took: np.ndarray, by: np.ndarray, sorted_c: np.ndarray, firsts: np.ndarray, counts: np.ndarray, slot: np.ndarray, carry: np.ndarray) -> None:
        own = np.asarray(self.prefix[i : i + n])
        running = np.minimum.accumulate(own)
        if len(by):
            ordered = took[by]
            value = np.empty(len(by), np.uint8)
            value[firsts] = np.minimum(carry[sorted_c[firsts]], running[ordered[firsts]])
            later = np.ones(len(by), bool)
            later[firsts] = False
            later = np.flatnonzero(later)
            if len(later):
                value[later] = _least_between(own, ordered[later - 1] + 1, ordered[later])
            value = np.minimum(value.astype(np.int64) + 1, self.limit).astype(np.uint8)
            value[firsts[self.head[sorted_c[firsts]] == self.base[sorted_c[firsts]]]] = 0
            self.prefix[slot[by]] = value
        np.minimum(carry, running[-1], out=carry)
        if len(by):
            last = ordered[firsts + counts - 1]
            rest = np.r_[np.minimum.accumulate(own[::-1])[::-1], np.uint8(255)]
            carry[sorted_c[firsts]] = rest[last + 1]


def suffixes(chars: np.ndarray, scratch: Scratch, limit: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """(suffixes in order, common prefix of each with the one before, up to ``limit``; none if it is 0).

    ``chars`` are non-negative, with a limit 16-bit numbers; the last is 0, and the only 0. Suffixes that agree beyond ``limit`` are in order all the same.
    """
    n = len(chars)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.uint8) if limit else None
    top = int(chars.max())
    ahead = words(chars, limit, scratch) if limit else None
    small = types(chars)
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names = named(chars, stars, top, scratch)
    if int(names.max()) + 1 == len(stars):
        order = np.empty(len(stars), np.int64)
        order[names] = np.arange(len(stars))
    else:
        order, _ = suffixes(names, scratch)
    del names
    stars = stars[order]
    count = lambda x: np.bincount(x, minlength=top + 1)
    large, own = count(chars[~small]), count(chars[small])
    up = np.arange(top + 1)
    queue = _Queue(large, count(chars[stars]), up, True, scratch, limit)
    # S* suffixes are sorted by their first character: each goes to the slots given to it.
    first = chars[stars].astype(np.int64)
    begins = np.searchsorted(first, up)
    given = queue.given_at[first] + np.arange(len(stars)) - begins[first]
    queue.at[given] = stars
    if limit:
        prefix = np.zeros(len(stars), np.uint8)
        prefix[1:] = common(ahead, stars[:-1], stars[1:], limit)
        queue.prefix[given] = prefix
    queue.scan(chars, ~small, ahead)
    bases, sizes = queue.base, large
    # The L suffixes, character by character, from the last one down.
    source = np.repeat(bases - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))
    at_l = queue.at[source]
    prefix_l = queue.prefix[source] if limit else None
    del queue
    down = up[::-1].copy()
    queue = _Queue(own, large, down, True, scratch, limit)
    first = chars[at_l].astype(np.int64)
    ends = np.cumsum(sizes)
    slot = queue.given_at[first] + ends[first] - 1 - np.arange(len(at_l))
    queue.at[slot] = at_l
    if limit:  # a common prefix goes with the smaller one of two, which the scan meets later
        queue.prefix[slot[:-1]] = prefix_l[1:]
        queue.prefix[queue.given_at[up[sizes > 0]]] = 0
    # The last suffix is the smallest of all and comes from no other.
    queue.at[queue.head[0]] = n - 1
    queue.head[0] += 1
    small[-1] = False
    queue.scan(chars, small, ahead)
    order = queue.at[::-1]
    if not limit:
        return np.ascontiguousarray(order).astype(np.int64), None
    prefix = scratch.zeros(n, np.uint8)
    prefix[1:] = queue.prefix[:0:-1]
    return order, prefix
