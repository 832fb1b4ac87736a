"""Exact substring dedup over windows of 50 words, by super-k-mer partitioning.

A window's minimiser is the smallest hash of its ``GRAM``-word grams. Consecutive windows of a document that share a minimiser form
a super-k-mer. Equal windows have equal minimisers, so all copies of a window meet in its minimiser's bucket.

1. Each document emits its super-k-mers as bare numbers: minimiser, document, first window, windows, and a 128-bit digest of the
   super-k-mer's words. A minimiser that only one document has can't hold a repeat, so its super-k-mers stop here.
2. Super-k-mers of equal words are one string, however many documents have it: an aggregation keeps its smallest document. Each
   string travels once, packed, from that document to its bucket.
3. A bucket is dealt to blocks of about ``BUCKET`` windows by the string's digest, one block for all but the largest. A block sorts
   the windows of its strings by their words, and equal neighbours give each window's smallest document.
4. Blocks of one bucket exchange distinct windows, as 128-bit digests with the smallest document; a block gets back those
   that a smaller document has elsewhere. So a passage that very many documents share costs a row a block, not a row a copy. Where
   it meets text of their own, most windows are left out first: the minimisers of a window's halves must be in another block too.
5. Runs of windows return to the super-k-mers that have the string, and from there to their documents, whose words are then cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, table, texts_of, words_of

WINDOW = 50
GRAM = 8
#: Windows that one block of a bucket gathers in a task.
BUCKET = 50_000
#: Windows that a super-k-mer counts for at least, so that a block's rows are bounded too (by BUCKET / TYPICAL).
TYPICAL = 50
#: Windows of one super-k-mer; a longer run (repetitive text) is cut.
LONGEST = 256
#: Distinct words whose hashes a worker remembers.
MEMO = 1 << 17

_MIX = 0x9E3779B97F4A7C15


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` entries, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def minimisers(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The minimiser (unsigned 64 bits) of each window of ``words``; none if there are fewer words than a window has."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.uint64)
    gram = min(gram, window)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    g = np.zeros(n - gram + 1, np.uint64)
    for i in range(gram):
        g = g * np.uint64(_MIX) + h[i : i + len(g)]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    return _sliding_min(g, window - gram + 1)


def super_kmers(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of each super-k-mer of a document, in order."""
    m = minimisers(words, window, gram)
    if not len(m):
        none = np.zeros(0, np.int64)
        return none, none, none
    starts = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
    at = np.arange(len(m)) - np.repeat(starts, np.diff(np.r_[starts, len(m)]))
    starts = np.flatnonzero(at % LONGEST == 0)
    return m[starts].view(np.int64), starts, np.diff(np.r_[starts, len(m)])


def digests(words: list[bytes], start: np.ndarray, count: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """128-bit digests of the words of super-k-mers, as two signed columns."""
    text = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    lo = np.r_[0, ends][start].tolist()
    hi = (ends[start + count + window - 2] - 1).tolist() if len(start) else []
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[x:y]) for x, y in zip(lo, hi, strict=True)), ">i8").reshape(-1, 2)


_NUMBERS = pa.schema([("mini", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])


def _number_batches(window: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        parts: list[list[np.ndarray]] = [[] for _ in _NUMBERS]
        for doc, text, version in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            words = words_of(text)
            mini, start, count = super_kmers(words, window, gram)
            if len(mini):
                same = digests(words, start, count, window)
                for p, x in zip(parts, (mini, same[:, 0], same[:, 1], np.full(len(mini), doc), np.full(len(mini), version), start, count), strict=True):
                    p.append(x)
        yield table(_NUMBERS, [np.concatenate(p).astype(f.type.to_pandas_dtype()) if p else [] for p, f in zip(parts, _NUMBERS, strict=True)])


_PACKED = pa.schema([("mini", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("packed", pa.binary())])
_PACKED_DDL = "mini long, block int, blocks int, s1 long, s2 long, least long, most long, packed binary"


def _packed_batches(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the numbers of the strings that they are the first to have in; packed strings out."""
    for b in slices(batches, 1, 2 << 20):
        rows = []
        for doc, text, wanted in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            words = words_of(text)
            for x in wanted:
                lo = x["start"]
                rows.append((x["mini"], x["block"], x["blocks"], x["s1"], x["s2"], doc, x["most"], b" ".join(words[lo : lo + x["windows"] + window - 1])))
            if len(rows) > 5000:
                yield table(_PACKED, list(map(list, zip(*rows, strict=True))))
                rows = []
        if rows:
            yield table(_PACKED, list(map(list, zip(*rows, strict=True))))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each block, from rows sorted by (mini, block)."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
            if row[:2] != key:
                if rows:
                    yield rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield rows


def _windows(packed: bytes, window: int) -> list[bytes]:
    spaces = [-1, *(i for i, c in enumerate(packed) if c == 32), len(packed)]
    return [packed[spaces[j] + 1 : spaces[j + window]] for j in range(len(spaces) - window)]


def _least(strings: list[tuple[int, list[bytes]]]) -> Iterator[tuple[bytes, int, list[tuple[int, int]]]]:
    """Each distinct window of strings (least document, windows) with its least document and (string, position) places, by sorting."""
    entries = sorted((text, least, k, j) for k, (least, windows) in enumerate(strings) for j, text in enumerate(windows))
    lo = 0
    for hi in range(1, len(entries) + 1):
        if hi == len(entries) or entries[hi][0] != entries[lo][0]:
            yield entries[lo][0], entries[lo][1], [e[2:] for e in entries[lo:hi]]
            lo = hi


def _window_digest(text: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(text)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


_HALVES = pa.schema([("mini", pa.int64()), ("halves", pa.int64()), ("block", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("at", pa.int32()), ("windows", pa.int32())])


def _half_batches(window: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings (mini, block, s1, s2, packed) in; runs of their windows out whose first halves share a minimiser, and whose last halves do."""
    half = max(1, window // 2)
    for b in slices(batches, 4):
        rows = []
        for mini, block, s1, s2, packed in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            m = minimisers(packed.split(b" "), half, gram)
            n = len(m) - (window - half)
            both = (m[:n] * np.uint64(_MIX) + m[window - half :]).view(np.int64)
            starts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
            rows += [(mini, h, block, s1, s2, at, k) for h, at, k in zip(both[starts].tolist(), starts.tolist(), np.diff(np.r_[starts, n]).tolist(), strict=True)]
        if rows:
            yield table(_HALVES, list(map(list, zip(*rows, strict=True))))


_SEEN = pa.schema([("mini", pa.int64()), ("block", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("least", pa.int64())])


def _seen_batches(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings with runs of their windows, sorted by block, in; the distinct windows of each block's runs with their least document out."""
    for rows in _blocks(batches):
        strings = [(r[4], [w for run in r[7] for w in _windows(r[6], window)[run["at"] : run["at"] + run["windows"]]]) for r in rows]
        out = [(*rows[0][:2], *_window_digest(text), least) for text, least, _ in _least(strings)]
        yield table(_SEEN, list(map(list, zip(*out, strict=True))))


_RUNS = pa.schema([("mini", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("at", pa.int32()), ("windows", pa.int32()), ("least", pa.int64())])


def _answers(rows: list[tuple], window: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Runs (minimiser, string, position, windows, least document) of a block's windows that a smaller document may have than some owner of the string."""
    elsewhere = {(r[2], r[3]): r[4] for r in rows if r[6] is None}
    strings = list({(r[2], r[3]): r for r in rows if r[6] is not None}.values())
    least = [[r[4]] * (r[6].count(b" ") + 2 - window) for r in strings]
    if len(strings) > 1 or elsewhere:
        for text, first, places in _least([(r[4], _windows(r[6], window)) for r in strings]):
            if elsewhere:
                first = min(first, elsewhere.get(_window_digest(text), first))
            for k, j in places:
                least[k][j] = first
    for (mini, _, s1, s2, _, most, _), of in zip(strings, least, strict=True):
        lo = 0
        for hi in range(1, len(of) + 1):
            if hi == len(of) or of[hi] != of[lo]:
                if of[lo] < most:
                    yield mini, s1, s2, lo, hi - lo, of[lo]
                lo = hi


def _answer_batches(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings, and windows that other blocks have from a smaller document, sorted by block in; runs out."""
    out: list[tuple] = []
    for rows in _blocks(batches):
        out += _answers(rows, window)
        if len(out) > 5000:
            yield table(_RUNS, list(map(list, zip(*out, strict=True))))
            out = []
    if out:
        yield table(_RUNS, list(map(list, zip(*out, strict=True))))


def _versions(docs: DataFrame) -> DataFrame:
    """(doc_id, text, version): the version tells apart different texts under one doc_id, which alone orders documents."""
    return texts_of(docs).withColumn("version", F.xxhash64("text"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """Runs (doc_id, version, start, windows) of windows whose words also start a window of a document with a smaller doc_id."""
    texts = _versions(docs.where("doc_id is not null"))
    numbers = materialise(texts.mapInArrow(partial(_number_batches, window, gram), "mini long, s1 long, s2 long, doc_id long, version long, start int, windows int"), "superkmers")
    load = F.greatest(F.sum("windows"), F.count("*") * TYPICAL)
    shared = numbers.groupBy("mini").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.ceil(load / bucket).cast("int").alias("blocks")).where("least < most")
    kept = materialise(numbers.join(shared.select("mini", "blocks"), "mini"), "kept")
    strings = kept.groupBy("mini", "s1", "s2", "windows", "blocks").agg(F.min(F.struct("doc_id", "version", "start")).alias("first"), F.max("doc_id").alias("most"))
    block = F.pmod("s1", F.col("blocks").cast("long")).cast("int").alias("block")
    wanted = strings.select("first.*", F.struct("mini", block, "blocks", "s1", "s2", "most", "first.start", "windows").alias("string")).groupBy("doc_id", "version").agg(F.collect_list("string").alias("wanted"))
    packed = materialise(texts.join(wanted, ["doc_id", "version"]).select("doc_id", "text", "wanted").mapInArrow(partial(_packed_batches, window), _PACKED_DDL), "packed")

    def dealt(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select("mini", "block", "s1", "s2", "least", "most", "packed", *more).repartition("mini", "block").sortWithinPartitions("mini", "block")

    large = packed.where("blocks > 1")
    halves = materialise(large.select("mini", "block", "s1", "s2", "packed").mapInArrow(partial(_half_batches, window, gram), "mini long, halves long, block int, s1 long, s2 long, at int, windows int"), "halves")
    across = halves.groupBy("mini", "halves").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi").select("mini", "halves")
    runs = halves.join(across, ["mini", "halves"]).groupBy("mini", "s1", "s2").agg(F.collect_list(F.struct("at", "windows")).alias("runs"))
    seen = materialise(dealt(large.join(runs, ["mini", "s1", "s2"]), "runs").mapInArrow(partial(_seen_batches, window), "mini long, block int, w1 long, w2 long, least long"), "seen")
    first = seen.groupBy("w1", "w2").agg(F.min("least").alias("first"), F.count("*").alias("n")).where("n > 1")
    elsewhere = seen.join(first, ["w1", "w2"]).where("first < least").select("mini", "block", F.col("w1").alias("s1"), F.col("w2").alias("s2"), F.col("first").alias("least"), F.lit(None).cast("long").alias("most"), F.lit(None).cast("binary").alias("packed"))
    answers = dealt(packed.drop("blocks").unionByName(elsewhere)).mapInArrow(partial(_answer_batches, window), "mini long, s1 long, s2 long, at int, windows int, least long")
    owners = kept.select("mini", "s1", "s2", "doc_id", "version", "start")
    return owners.join(answers, ["mini", "s1", "s2"]).where("doc_id > least").select("doc_id", "version", (F.col("start") + F.col("at")).alias("start"), "windows")


def covered(runs: list[dict], n: int, window: int = WINDOW) -> np.ndarray:
    """Which of ``n`` words lie in a removed window."""
    edge = np.zeros(n + 1, np.int64)
    for r in runs:
        edge[r["start"]] += 1
        edge[min(n, r["start"] + r["windows"] + window - 1)] -= 1
    return np.cumsum(edge[:n]) > 0


def cut_text(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the covered words; kept words stay with the white space before them."""
    out, at, i = [], 0, 0
    for w in words_of(text):
        lo = text.index(w, at)
        if not gone[i]:
            out.append(text[at : lo + len(w)])
        at, i = lo + len(w), i + 1
    out.append(text[at:])
    return b"".join(out)


_SUMMARY = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.binary()), ("text_sha256", pa.string())])


def _cut_batches(window: int, with_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        rows = []
        for doc, text, runs in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            words, n_removed = words_of(text), 0
            n_words, kept = len(words), words
            if runs:
                gone = covered(runs, n_words, window)
                n_removed = int(gone.sum())
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            cut = None
            if with_text and n_removed:
                cut = cut_text(text, gone)
            rows.append((doc, n_words, n_removed, hashlib.sha256(b" ".join(kept)).hexdigest(), cut, hashlib.sha256(text).hexdigest() if with_text else None))
        yield table(_SUMMARY, list(map(list, zip(*rows, strict=True))) if rows else [[]] * len(_SUMMARY))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket: int = BUCKET, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the cut text (binary; null if uncut) and text_sha256 of the text before.

    A null or empty text has no word. A null doc_id can't be ordered: such a row is returned uncut. Rows that repeat a doc_id
    count as one document's: none of their windows removes another of the same doc_id, and each row is cut by the runs of its own
    text alone. An empty table gives no rows; other columns are ignored.
    """
    runs = repeated_windows(docs, window, gram, bucket).groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    out = _versions(docs).join(runs, ["doc_id", "version"], "left").select("doc_id", "text", "runs").mapInArrow(partial(_cut_batches, window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, text binary, text_sha256 string")
    return out if with_text else out.drop("text", "text_sha256")
