"""Exact substring dedup over windows of 50 bytes, by suffix order and common prefixes of shards.

Shards are made so that equal windows meet. A window's key is the smallest hash of its ``GRAM``-byte grams; consecutive windows of one
key travel as one string.

1. Documents are packed into chunks, which are written once, bucketed by their number, so that later joins don't shuffle texts.
2. Chunks send their distinct keys, as few bytes each, to be counted; a key of a single document can't hold a repeat. Chunks get back which of their keys
   are shared, and, for very common keys, to how many blocks their strings are dealt.
3. Chunks send the strings of shared keys to shards, distinct ones once each, with the smallest and largest document that has them.
4. A shard orders the suffixes of its strings by external induced sorting (see ``induced``). Neighbours with a common prefix of a window's length
   form a class, whose smallest document is the answer for all its windows.
5. Windows of strings that were dealt to blocks are compared across shards by 128-bit digests.
6. Answers return to chunks as runs of windows of a string, and each chunk cuts its texts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir, table, texts_of
from .induced import Scratch, suffixes

WINDOW, GRAM = 50, 20
#: Bytes of a chunk's texts, of a shard's strings and of a shard of keys, on average; bytes of texts that are hashed at a time.
CHUNK, SHARD, KEYS, SLICE = 4 << 20, 8 << 20, 16 << 20, 256 << 10
#: Strings of a key from which on they are dealt to blocks of as many: about a shard of them.
HOT = 50_000
#: Bytes of an Arrow batch of packed rows.
BATCH_BYTES = 32 << 20
MOST_BUCKETS = 100_000

_MIX, _MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _pack_steps(x: np.ndarray) -> bytes:
    """Numbers that mostly rise, by their differences."""
    return _pack(np.diff(x, prepend=0))


def _unpack(b: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def _unpack_steps(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.int64))


class _Rows:
    """Rows of one schema, given out as Arrow batches."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows = schema, []

    def add(self, *row: object) -> None:
        self.rows.append(row)

    def full(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield table(self.schema, list(map(list, zip(*self.rows, strict=True))))
            self.rows = []


# --- chunks and their keys

_CHUNK = pa.schema([("part", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64())), ("ends", pa.binary()), ("data", pa.binary())])


def _chunk_batches(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) in; a row for each chunk of whole documents out."""
    task, made = TaskContext.get().partitionId(), 0
    ids: list = []
    texts: list[bytes] = []
    n = 0

    def chunk() -> pa.RecordBatch:
        data = b"".join(texts)
        return table(_CHUNK, [[task << 32 | made], [n], [ids], [np.cumsum([len(t) for t in texts], dtype=np.int64).tobytes()], [zstandard.compress(data, 3)]])

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids.append(doc)
            texts.append(text.as_py())
            n += len(texts[-1])
            if n >= size:
                yield chunk()
                made, n, ids, texts = made + 1, 0, [], []
    if ids:
        yield chunk()


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every run of ``gram`` bytes, by doubling."""
    p, size, power = b.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1), 1, int(_MIX)
    out, done, left = None, 0, gram
    while left:
        if left & 1:
            if out is None:
                out, done = p, size
            else:
                n = len(b) - (done + size) + 1
                out, done = out[:n] * np.uint64(power) + p[done : done + n], done + size
        left >>= 1
        if left:
            n = len(b) - 2 * size + 1
            p, size, power = p[:n] * np.uint64(power) + p[size : size + n], 2 * size, power * power % (1 << 64)
    out = (out ^ out >> np.uint64(29)) * _MIX_2
    return out ^ out >> np.uint64(32)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x, done = np.minimum(x[:-done], x[done:]), done * 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def strings_of(data: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM, slice_bytes: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, windows) of the strings of concatenated documents: the longest runs of windows of one document with one key."""
    gram = min(gram, window)
    keys, starts, counts = [], [], []
    begins = np.r_[0, ends[:-1]]
    lo = 0
    while lo < len(ends):  # a slice of whole documents
        hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + slice_bytes, "right")))
        base, own = int(begins[lo]), data[begins[lo] : ends[hi - 1]]
        if len(own) >= window:
            key = _sliding_min(gram_hashes(own, gram), window - gram + 1)
            first, last = begins[lo:hi] - base, ends[lo:hi] - base - window + 1
            whole = last > first
            edge = np.zeros(len(key) + 1, np.int8)
            edge[first[whole]] += 1
            np.subtract.at(edge, last[whole], 1)
            inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
            new = np.ones(len(key), bool)
            np.not_equal(key[1:], key[:-1], out=new[1:])
            new[first[whole]] = True
            at = np.flatnonzero(inside & new)
            end = np.flatnonzero(inside & np.r_[new[1:] | ~inside[1:], True])
            keys.append(key[at])
            starts.append(at + base)
            counts.append(end - at + 1)
        lo = hi
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(keys, np.uint64), join(starts, np.int64), join(counts, np.int64)


class _Chunk:
    """A chunk's documents and the strings of those that have an id."""

    def __init__(self, ids: list, ends: bytes, data: bytes) -> None:
        self.ids, self.ends = ids, np.frombuffer(ends, np.int64)
        self.raw = zstandard.decompress(data)
        self.data = np.frombuffer(self.raw, np.uint8)

    def strings(self, bits: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key of so many bits, start, windows, doc_id)."""
        key, start, count = strings_of(self.data, self.ends, window, gram)
        doc = np.searchsorted(self.ends, start, "right")
        known = np.array([i is not None for i in self.ids], bool)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        own = known[doc] if len(doc) else np.zeros(0, bool)
        return (key[own] * _MIX) >> np.uint64(64 - bits), start[own], count[own], ids[doc[own]]


def _shard_of(key: np.ndarray, bits: int, shards: int) -> np.ndarray:
    return ((key >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _narrow(key: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : bits // 8]).tobytes()


def _wide(b: bytes, bits: int) -> np.ndarray:
    out = np.zeros((len(b) * 8 // bits, 8), np.uint8)
    out[:, : bits // 8] = np.frombuffer(b, np.uint8).reshape(-1, bits // 8)
    return out.view("<u8").ravel()


_KEY = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("several", pa.binary()), ("often", pa.binary())])


def _key_batches(bits: int, shards: int, window: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in; their distinct keys out, sorted, with those that several of the chunk's documents have and those that it has often (place, times)."""
    for b in batches:
        for row in b.to_pylist():
            out = _Rows(_KEY)
            key, _, _, doc = _Chunk(row["ids"], row["ends"], row["data"]).strings(bits, window, gram)
            if len(key):
                order = np.argsort(key, kind="stable")
                key, doc = key[order], doc[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                times = np.diff(np.r_[first, len(key)])
                several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
                key = key[first]
                shard = _shard_of(key, bits, shards)
                cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(key)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    often = np.flatnonzero(times[lo:hi] > 1)
                    out.add(int(shard[lo]), row["part"], _narrow(key[lo:hi], bits), np.packbits(several[lo:hi]).tobytes(), _pack(np.stack([often, times[lo:hi][often]]).astype(np.int32)))
            yield from out.full()


_SHARED = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("hot", pa.binary()), ("blocks", pa.binary())])


def _shared_batches(bits: int, hot: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys sorted by shard in; for each chunk its shared keys out, and of very common ones the number of blocks."""
    for rows in _groups(batches):
        keys = [_wide(r["keys"], bits) for r in rows]
        several = [np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(k)).astype(bool) for r, k in zip(rows, keys, strict=True)]
        times = [np.ones(len(k), np.int64) for k in keys]
        for r, t in zip(rows, times, strict=True):
            place, n = _unpack(r["often"], np.int32).reshape(2, -1)
            t[place] = n
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        chunks = np.bincount(at, minlength=len(distinct))
        load = np.bincount(at, np.concatenate(times), len(distinct)).astype(np.int64)
        shared = chunks > 1
        shared[at[np.concatenate(several)]] = True
        blocks = np.where(load > hot, -(-load // hot), 1)
        out = _Rows(_SHARED)
        lo = 0
        for r, k, t in zip(rows, keys, times, strict=True):
            own = at[lo : lo + len(k)]
            lo += len(k)
            keep = shared[own]
            if keep.any():
                often = keep & (blocks[own] > 1)
                out.add(r["part"], int(t[keep].sum()), _narrow(k[keep], bits), _narrow(k[often], bits), blocks[own][often].astype(np.int32).tobytes())
        yield from out.full()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each shard, from rows sorted by shard."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and row["shard"] != held[0]["shard"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


# --- strings

_STRING = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("least", pa.binary()), ("more", pa.binary()), ("text", pa.binary()), ("hot", pa.binary())])
_STRING_DDL = "shard long, part long, a binary, b binary, least binary, more binary, text binary, hot binary"


def _string_batches(bits: int, shards: int, window: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their shared keys in. Out: for shards, distinct strings with their number in the chunk and least and most document; and
    for the chunk itself (shard -1), where its strings are and their numbers."""
    for b in batches:
        for row in b.to_pylist():
            chunk, out = _Chunk(row["ids"], row["ends"], row["data"]), _Rows(_STRING)
            key, start, count, doc = chunk.strings(bits, window, gram)
            shared = np.sort(np.concatenate([_wide(w["keys"], bits) for w in row["wanted"]]))
            keep = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, key), len(shared) - 1)] == key)
            key, start, count, doc = key[keep], start[keep], count[keep], doc[keep]
            numbers: dict[bytes, int] = {}
            raw, tail = chunk.raw, window - 1
            number = np.array([numbers.setdefault(raw[i:j], len(numbers)) for i, j in zip(start.tolist(), (start + count + tail).tolist(), strict=True)], np.int64)
            texts = list(numbers)
            order = np.argsort(number, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(number[order]) > 0])
            least, most = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
            own = key[order[first]]
            blocks = np.ones(len(texts), np.int64)
            common = np.concatenate([_wide(w["hot"], bits) for w in row["wanted"]])
            if len(common):
                n = np.concatenate([np.frombuffer(w["blocks"], np.int32) for w in row["wanted"]])
                by = np.argsort(common)
                common, n = common[by], n[by]
                at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                blocks = np.where(common[at] == own, n[at], 1)
            block = np.array([xxhash.xxh3_64_intdigest(t) % m if m > 1 else 0 for t, m in zip(texts, blocks.tolist(), strict=True)], np.uint64)
            mixed = (own + block * _MIX_2) * _MIX
            shard = _shard_of(mixed ^ mixed >> np.uint64(32), 64, shards)
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            by = np.argsort(shard, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(shard[by])) + 1).tolist(), len(by)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                at = by[lo:hi]
                text = zstandard.compress(b"".join([texts[i] for i in at.tolist()]), 3)
                out.add(int(shard[at[0]]), row["part"], _pack_steps(at), _pack(size[at].astype(np.int32)), _pack_steps(least[at]), _pack(most[at] - least[at]), text, np.packbits(blocks[at] > 1).tobytes())
            out.add(-1, row["part"], _pack_steps(start), _pack_steps(number), b"", b"", b"", b"")
            yield from out.full()


# --- shards

_ANSWER = pa.schema([("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("w1", pa.int64()), ("w2", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("number", pa.int32()), ("at", pa.int32())])
_ANSWER_DDL = "part long, a binary, b binary, w1 long, w2 long, least long, most long, number int, at int"


def least_of_windows(chars: np.ndarray, begin: np.ndarray, size: np.ndarray, least: np.ndarray, window: int, scratch: Scratch) -> np.ndarray:
    """At every place of concatenated strings (each followed by a separator) the least document of the class of its window; -1 where no window starts."""
    order, prefix = suffixes(chars, scratch, window)
    n, run = len(chars), scratch.run
    doc = scratch.zeros(n, np.int64)
    _by_string(lambda lo, hi: np.repeat(least[lo:hi], size[lo:hi] + 1), doc, begin, size, run)
    classes = sum(int((prefix[lo : lo + run] < window).sum()) for lo in range(0, n, run))
    best, seen = scratch.zeros(classes, np.int64), 0
    best[:] = np.iinfo(np.int64).max
    for lo in range(0, n, run):  # the class that goes on from the run before has number seen - 1
        new = prefix[lo : lo + run] < window
        number = np.cumsum(new) + seen - 1
        first = np.flatnonzero(np.r_[True, new[1:]])
        best[number[first]] = np.minimum(best[number[first]], np.minimum.reduceat(doc[order[lo : lo + run]], first))
        seen = int(number[-1]) + 1
    out, seen = doc, 0
    for lo in range(0, n, run):
        number = np.cumsum(prefix[lo : lo + run] < window) + seen - 1
        out[order[lo : lo + run]] = best[number]
        seen = int(number[-1]) + 1
    # Where fewer bytes than a window's are left, none starts.
    tail = begin + np.maximum(size - window + 1, 0)
    for lo in range(0, len(begin), run):
        short = (begin + size + 1 - tail)[lo : lo + run]
        places = np.repeat(tail[lo : lo + run] - (np.cumsum(short) - short), short) + np.arange(int(short.sum()))
        out[places] = -1
    out[n - 1] = -1
    return out


def _by_string(values, out: np.ndarray, begin: np.ndarray, size: np.ndarray, run: int) -> None:
    """Fill ``out``, place by place, with ``values`` of ranges of strings, a run at a time."""
    lo = 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + run, "right")))
        out[begin[lo] : begin[hi - 1] + size[hi - 1] + 1] = values(lo, hi)
        lo = hi


def _runs(answer: np.ndarray, begin: np.ndarray, size: np.ndarray, most: np.ndarray, window: int, run: int) -> tuple[np.ndarray, ...]:
    """(string, first window, windows, least document) of runs whose answer is smaller than the string's largest document."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    lo = 0
    while lo < len(begin):  # whole strings, as many as fit a run
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + run, "right")))
        a = np.asarray(answer[begin[lo] : begin[hi - 1] + size[hi - 1] + 1])
        owner = np.repeat(np.arange(lo, hi), size[lo:hi] + 1)
        good = (a >= 0) if a.min(initial=0) >= -1 else np.ones(len(a), bool)
        hit = good & (a < most[owner])
        new = hit & np.r_[True, (a[1:] != a[:-1]) | (owner[1:] != owner[:-1]) | ~hit[:-1]]
        first = np.flatnonzero(new)
        end = np.flatnonzero(hit & np.r_[new[1:] | ~hit[1:], True])
        for f, x in zip(found, (owner[first], first + begin[lo] - begin[owner[first]], end - first + 1, a[first]), strict=True):
            f.append(x)
        lo = hi
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)


def _shard_batches(window: int, limits: tuple[int, int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings sorted by shard in. Out: runs of windows (chunk; string's number, first window, windows; least document), and single windows of strings that were dealt."""
    for rows in _groups(batches):
        yield from _shard_answers(rows, window, Scratch(*limits))


def _shard_answers(rows: list[dict], window: int, scratch: Scratch) -> Iterator[pa.RecordBatch]:
    # Equal strings of several chunks count once.
    strings: dict[bytes, int] = {}
    owner_part, owner_number, owner_string, owner_most, least, hot = [], [], [], [], [], []
    for r in rows:
        number, size, low = _unpack_steps(r["a"]), _unpack(r["b"], np.int32), _unpack_steps(r["least"])
        high = low + _unpack(r["more"], np.int64)
        dealt = np.unpackbits(np.frombuffer(r["hot"], np.uint8), count=len(size)).tolist()
        text, ends = zstandard.decompress(r["text"]), np.cumsum(size).tolist()
        for i, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            k = strings.setdefault(text[lo:hi], len(strings))
            if k == len(least):
                least.append(int(low[i]))
                hot.append(dealt[i])
            elif low[i] < least[k]:
                least[k] = int(low[i])
            owner_string.append(k)
        owner_part.append(np.full(len(size), r["part"]))
        owner_number.append(number)
        owner_most.append(high)
    texts = list(strings)
    del strings
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.r_[0, np.cumsum(size + 1)[:-1]]
    chars = scratch.zeros(int((size + 1).sum()) + 1, np.uint16)
    at = 0
    for lo in range(0, len(texts), 10_000):  # bytes from 2 on, 1 behind each string, 0 at the end
        part = texts[lo : lo + 10_000]
        x = np.frombuffer(b"\0".join(part) + b"\0", np.uint8).astype(np.uint16) + 2
        x[np.cumsum(size[lo : lo + 10_000] + 1) - 1] = 1
        chars[at : at + len(x)] = x
        at += len(x)
    least_of = np.array(least, np.int64)
    bottom = int(least_of.min())
    answer = least_of_windows(chars, begin, size, least_of - bottom, window, scratch)
    string, part, number, high = np.array(owner_string, np.int64), np.concatenate(owner_part), np.concatenate(owner_number), np.concatenate(owner_most)
    by = np.argsort(string, kind="stable")
    string, part, number, high = string[by], part[by], number[by], high[by]
    first = np.searchsorted(string, np.arange(len(texts) + 1))
    most = np.maximum.reduceat(high, first[:-1])
    k, place, n, smallest = _runs(answer, begin, size, most - bottom, window, scratch.run)
    smallest = smallest + bottom
    # Every run for every chunk that has the string.
    times = first[k + 1] - first[k]
    which = np.repeat(np.arange(len(k)), times)
    owner = np.repeat(first[k] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    good = smallest[which] < high[owner]
    which, owner = which[good], owner[good]
    by = np.argsort(part[owner], kind="stable")
    which, owner = which[by], owner[by]
    own = part[owner]
    out = _Rows(_ANSWER)
    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else [0]
    none = (None,) * 6
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        w = which[lo:hi]
        out.add(int(own[lo]), _pack(np.stack([number[owner[lo:hi]], place[w], n[w]]).astype(np.int32)), _pack(smallest[w]), *none)
    for s in np.flatnonzero(np.array(hot, bool)).tolist():
        for j in range(int(size[s]) - window + 1):
            d = xxhash.xxh3_128_digest(texts[s][j : j + window])
            w1, w2 = int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)
            for o in range(first[s], first[s + 1]):
                out.add(int(part[o]), None, None, w1, w2, int(answer[begin[s] + j]) + bottom, int(high[o]), int(number[o]), j)
        yield from out.full(20_000)
    yield from out.full()


# --- cutting

_SUMMARY = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.binary()), ("text_sha256", pa.string())])
_SUMMARY_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text binary, text_sha256 string"


def _gone(chunk: _Chunk, found: list[dict], window: int) -> np.ndarray:
    """Which bytes of a chunk lie in a window that a smaller document has."""
    edge = np.zeros(len(chunk.data) + 1, np.int32)
    owners = [f for f in found if f["kind"] == 0]
    if owners:
        start, number = _unpack_steps(owners[0]["a"]), _unpack_steps(owners[0]["b"])
        by = np.argsort(number, kind="stable")
        start, number = start[by], number[by]
        ids = np.array([i if i is not None else 0 for i in chunk.ids], np.int64)
        doc = ids[np.searchsorted(chunk.ends, start, "right")]
        for f in found:
            if f["kind"] == 1:
                k, at, n = _unpack(f["a"], np.int32).astype(np.int64).reshape(3, -1)
                least = _unpack(f["b"], np.int64)
            elif f["kind"] == 2:
                k, at, least = (np.array([x[c] for x in f["dealt"]], np.int64) for c in ("number", "at", "first"))
                n = np.ones(len(k), np.int64)
            else:
                continue
            lo, hi = np.searchsorted(number, k, "left"), np.searchsorted(number, k, "right")
            which = np.repeat(np.arange(len(k)), hi - lo)
            own = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(int((hi - lo).sum()))
            good = doc[own] > least[which]
            which, own = which[good], own[good]
            first = start[own] + at[which]
            np.add.at(edge, first, 1)
            np.subtract.at(edge, first + n[which] + window - 1, 1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def _cut_batches(window: int, with_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            chunk, out = _Chunk(row["ids"], row["ends"], row["data"]), _Rows(_SUMMARY)
            gone = _gone(chunk, row["found"] or [], window)
            lo = 0
            for doc, hi in zip(chunk.ids, chunk.ends.tolist(), strict=True):
                cut, text = gone[lo:hi], chunk.raw[lo:hi]
                removed = int(cut.sum())
                kept = chunk.data[lo:hi][~cut].tobytes() if removed else text
                spans = int(cut[:1].sum()) + int((cut[1:] & ~cut[:-1]).sum()) if removed else 0
                out.add(doc, hi - lo, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text and removed else None, hashlib.sha256(text).hexdigest() if with_text else None)
                lo = hi
            yield from out.full()


def _bucketed(chunks: DataFrame, buckets: int) -> DataFrame:
    """Write a table bucketed by ``part`` to the shared folder and return a reader of it; its name doesn't stay in the catalogue."""
    spark = chunks.sparkSession
    name = f"textloom_chunks_{uuid.uuid4().hex}"
    chunks.write.bucketBy(buckets, "part").option("path", f"{shared_dir(spark)}/{name}").option("compression", "none").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False, chunk: int = CHUNK, shard: int = SHARD, hot: int = HOT, limits: tuple[int, int, int] | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the cut text (binary, for a cut need not respect characters; null if uncut) and
    text_sha256 of the text before.

    A byte is removed if it is covered by a ``window``-byte string of its text that also starts in a document with a smaller doc_id. A null or empty text has
    no byte. A null doc_id can't be ordered: such a row is neither cut nor cuts. Rows that repeat a doc_id never cut each other, and each
    is cut by the strings of its own text. Equal rows are cut alike. An empty table gives no rows; other columns are ignored.
    ``limits`` are those of a shard's arrays in memory (see ``induced.Scratch``).
    """
    spark = docs.sparkSession
    texts = texts_of(docs)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // chunk))
    chunks = _bucketed(texts.mapInArrow(partial(_chunk_batches, chunk), "part long, n_bytes long, ids array<long>, ends binary, data binary"), buckets)
    n_bytes = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    # Keys are so long that few of unequal grams are equal; such would only travel for nothing.
    bits = min(64, max(40, -(-(n_bytes.bit_length() + 6) // 8) * 8))
    scratch = limits or (Scratch().limit, Scratch().run, Scratch().most)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("shard").sortWithinPartitions("shard")

    keys = chunks.mapInArrow(partial(_key_batches, bits, max(1, n_bytes // (4 * KEYS)), window, gram), "shard long, part long, keys binary, several binary, often binary")
    shared = materialise(dealt(keys).mapInArrow(partial(_shared_batches, bits, hot), "part long, n long, keys binary, hot binary, blocks binary"), "shared")
    n_strings = shared.agg(F.sum("n")).first()[0] or 0
    wanted = shared.groupBy("part").agg(F.collect_list(F.struct("keys", "hot", "blocks")).alias("wanted"))
    strings = chunks.join(wanted, "part").select("part", "ids", "ends", "data", "wanted")
    shards = max(1, n_strings * (window + gram) // shard)
    strings = materialise(strings.mapInArrow(partial(_string_batches, bits, shards, window, gram), _STRING_DDL), "strings")
    answers = materialise(dealt(strings.where("shard >= 0")).mapInArrow(partial(_shard_batches, window, scratch), _ANSWER_DDL), "answers")
    single = answers.where("number is not null")
    first = single.groupBy("w1", "w2").agg(F.min("least").alias("first"), F.max("least").alias("last")).where("first < last").select("w1", "w2", "first")
    elsewhere = single.join(first, ["w1", "w2"]).where("first < least and first < most").groupBy("part").agg(F.collect_list(F.struct("number", "at", "first")).alias("dealt"))
    none = F.lit(None)
    found = [
        strings.where("shard < 0").select("part", F.lit(0).alias("kind"), "a", "b", none.cast("array<struct<number:int,at:int,first:bigint>>").alias("dealt")),
        answers.where("number is null").select("part", F.lit(1).alias("kind"), "a", "b", none.cast("array<struct<number:int,at:int,first:bigint>>").alias("dealt")),
        elsewhere.select("part", F.lit(2).alias("kind"), none.cast("binary").alias("a"), none.cast("binary").alias("b"), "dealt"),
    ]
    by_part = found[0].unionByName(found[1]).unionByName(found[2]).groupBy("part").agg(F.collect_list(F.struct("kind", "a", "b", "dealt")).alias("found"))
    out = chunks.join(by_part, "part", "left").select("part", "ids", "ends", "data", "found").mapInArrow(partial(_cut_batches, window, with_text), _SUMMARY_DDL)
    return out if with_text else out.drop("text", "text_sha256")
