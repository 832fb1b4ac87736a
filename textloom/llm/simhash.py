"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 bits over 4-word shingles. Two fingerprints within ``MAX_BITS`` differing bits link. For the search each
fingerprint is cut into segments (three, or two for very many fingerprints); by the pigeonhole principle, one segment of a linked
pair differs in at most ``MAX_BITS`` // segments bits. Each distinct fingerprint is stored in one table for each segment under that segment's exact
value, and probes every value in the small Hamming ball around its own. Matches are verified on the whole 64 bits.

A bucket is never expanded into its pairs: a task verifies its bucket in blocks and passes on a spanning forest of the links it
found, which has fewer edges than members. Buckets with more than ``BLOCK`` stored fingerprints, or very many probes, are dealt to a
grid of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, materialise, slices, table, texts_of, words_of
from .components import connected_components

SHINGLE = 4
MAX_BITS = 4
#: Segments of a fingerprint, and the distinct fingerprints up to which so many serve: shorter segments have fewer probes, but
#: beyond that a bucket of a segment's value holds over ``BLOCK`` on average. Either number finds all links.
SEGMENTS, MOST_DISTINCT, FEWER_SEGMENTS = 3, 1 << 32, 2
#: Stored fingerprints of a bucket that one task compares with a block of probes.
BLOCK = 2048
#: Probes of a bucket that one task verifies.
PROBE_BLOCK = 1 << 16
#: Comparisons that are held in memory at once, and rows that are looked at together.
CHUNK, GATHERED = 1 << 20, 1 << 14

_xxh64 = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes | None) -> int:
    """SimHash of UTF-8 text, as a signed 64-bit integer; 0 for a text with no word."""
    words = words_of((text or b"").lower())
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)))
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(shingles), 1 << 16):
        h = np.fromiter(map(_xxh64, shingles[lo : lo + (1 << 16)]), ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles)).view(">i8")[0])


_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_sha256", pa.string())])


def _fingerprint_batches(keyed: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        texts = b.column(1).to_pylist()
        yield table(_FINGERPRINTS, [b.column(0), [fingerprint(t) for t in texts], [hashlib.sha256(t).hexdigest() if keyed else None for t in texts]])


def fingerprints(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """(doc_id, fp) and, if ``keyed``, text_sha256 of documents with columns doc_id and text. A null text is empty; its fingerprint is 0."""
    out = texts_of(docs).mapInArrow(partial(_fingerprint_batches, keyed), "doc_id long, fp long, text_sha256 string")
    return out if keyed else out.drop("text_sha256")


def segment_bounds(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(shift, width) of the segments of 64 bits, widths as equal as can be."""
    widths = [64 // segments + (i < 64 % segments) for i in range(segments)]
    return [(64 - sum(widths[: i + 1]), w) for i, w in enumerate(widths)]


def ball(width: int, radius: int) -> list[int]:
    """Masks of up to ``radius`` flipped bits among ``width``."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _keys(fps: DataFrame, segments: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Stored rows and probe rows (seg, key, fp, rep)."""
    value = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in segment_bounds(segments)]
    stored = F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), v.alias("key")) for i, v in enumerate(value)]))
    out = fps.select("fp", "rep", stored.alias("s")).select("s.seg", "s.key", "fp", "rep")
    balls = F.array(*[F.array(*[F.lit(m).cast("long") for m in ball(w, radius)]) for _, w in segment_bounds(segments)])
    probes = out.select("seg", "key", "fp", "rep", F.explode(F.element_at(balls, F.col("seg") + 1)).alias("mask")).select("seg", F.col("key").bitwiseXOR(F.col("mask")).alias("key"), "fp", "rep")
    return out, probes


class _Forest:
    """Union-find over the nodes that one task sees; keeps the edges that joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        path = []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def join(self, pairs: np.ndarray) -> None:
        nodes, at = np.unique(pairs, return_inverse=True)
        at = at.reshape(pairs.shape)
        label = np.arange(len(nodes))
        while True:  # smallest label of each pair, then shortcuts, until nothing moves
            before = label.copy()
            least = np.minimum(label[at[:, 0]], label[at[:, 1]])
            np.minimum.at(label, at[:, 0], least)
            np.minimum.at(label, at[:, 1], least)
            label = label[label]
            if np.array_equal(before, label):
                break
        for a, b in zip(nodes.tolist(), nodes[label].tolist(), strict=True):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.edges.append((a, b))


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_KEY = ("seg", "key", "tb", "pb")


def _verify(change: np.ndarray, probe: np.ndarray, fp: np.ndarray, rep: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Linked (rep, rep) pairs among whole buckets. ``change`` marks a bucket's first row; its stored rows come before its probes."""
    starts = np.flatnonzero(change)
    sizes = np.diff(np.r_[starts, len(change)])
    stored = np.add.reduceat((~probe).astype(np.int64), starts)
    of = np.repeat(np.arange(len(starts)), sizes)
    rows = np.flatnonzero(probe)
    width = stored[of[rows]]
    rows, width = rows[width > 0], width[width > 0]
    first, ends = starts[of[rows]], np.cumsum(width)
    lo = 0
    while lo < len(rows):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        w = width[lo:hi]
        left = np.repeat(rows[lo:hi], w)
        right = np.repeat(first[lo:hi] - (np.cumsum(w) - w), w) + np.arange(w.sum())
        near = (np.bitwise_count(fp[left] ^ fp[right]) <= limit) & (rep[left] < rep[right])
        if near.any():
            yield np.stack([rep[left[near]], rep[right[near]]], axis=1)
        lo = hi


def _link_batches(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (seg, key, tb, pb, probe) in; forest edges out.

    A bucket may span batches: its stored rows, of which a block has no more than some thousand, are kept until its last row; probes
    are verified as they come."""
    stored: list[np.ndarray] | None = None
    forest = _Forest()

    def check(part: list[np.ndarray]) -> list[np.ndarray] | None:
        """Links among the rows; the stored rows of the last bucket, which may go on."""
        new = np.ones(len(part[0]), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in part[: len(_KEY)]])
        probe, fp, rep = part[len(_KEY) :]
        for pairs in _verify(new, probe.astype(bool), fp.view(np.uint64), rep, limit):
            forest.join(pairs)
        last = int(np.flatnonzero(new)[-1])
        n = int((probe[last:] == 0).sum())
        return [x[last : last + n] for x in part]

    for b in gathered(batches, GATHERED):
        part = [c.to_numpy() for c in b.columns]
        if stored is not None:
            part = [np.concatenate([x, y]) for x, y in zip(stored, part, strict=True)]
        stored = check(part)
        if len(forest.edges) > 1 << 16:
            yield table(_EDGES, list(map(list, zip(*forest.edges, strict=True))))
            forest.edges = []
        if len(forest.up) > 1 << 20:
            forest.up = {}
    if forest.edges:
        yield table(_EDGES, list(map(list, zip(*forest.edges, strict=True))))


def dealt_keys(stored: DataFrame, max_bits: int, segments: int, block: int, probe_block: int) -> DataFrame:
    """(seg, key, tb, pb): into how many blocks the stored rows and the probes of a large bucket are dealt.

    Probes aren't counted one by one: a bucket has many only if a key in the ball around its own is stored often. At most 3 n / block
    keys are, each with the ball of a segment.
    """
    counts = stored.groupBy("seg", "key").count().where(F.col("count") > block)
    balls = F.array(*[F.array(*[F.lit(m).cast("long") for m in ball(w, max_bits // segments)]) for _, w in segment_bounds(segments)])
    around = counts.select("seg", "key", "count", F.explode(F.element_at(balls, F.col("seg") + 1)).alias("mask"))
    around = around.select("seg", F.col("key").bitwiseXOR(F.col("mask")).alias("key"), F.when(F.col("mask") == 0, F.col("count")).otherwise(0).alias("own"), "count")
    sums = around.groupBy("seg", "key").agg(F.sum("own").alias("own"), F.sum("count").alias("probes"))
    return sums.select("seg", "key", F.greatest(F.ceil(F.col("own") / block), F.lit(1)).cast("int").alias("tblocks"), F.ceil(F.col("probes") / probe_block).cast("int").alias("pblocks"))


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int | None = None, block: int = BLOCK, probe_block: int = PROBE_BLOCK) -> DataFrame:
    """Edges (a, b) between ``rep`` values of distinct fingerprints (columns fp, rep), with the same components as all links have.

    ``segments`` is chosen by the number of fingerprints unless it is given."""
    if segments is None:
        segments = SEGMENTS if fps.count() <= MOST_DISTINCT else FEWER_SEGMENTS
    stored, probes = _keys(fps, segments, max_bits // segments)
    hot = materialise(dealt_keys(stored, max_bits, segments, block, probe_block), "hot")
    # Only a list of proven size is broadcast.
    small = hot.limit(100_001).count() <= 100_000
    dealt = []
    for rows, probe in ((stored, 0), (probes, 1)):
        rows = rows.join(F.broadcast(hot) if small else hot, ["seg", "key"], "left").na.fill(1, ["tblocks", "pblocks"])
        own, others = ("tb", "pb") if probe == 0 else ("pb", "tb")
        mine = F.pmod(F.xxhash64("fp"), F.col(f"{own}locks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col(f"{others}locks") - 1))
        rows = rows.select("seg", "key", mine.alias(own), other.alias(others), F.lit(probe).cast("byte").alias("probe"), "fp", "rep")
        dealt.append(rows.select(*_KEY, "probe", "fp", "rep"))
    rows = dealt[0].unionByName(dealt[1]).repartition(*_KEY).sortWithinPartitions(*_KEY, "probe")
    return rows.mapInArrow(partial(_link_batches, max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, segments: int | None = None, keyed: bool = False) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable over links of at most ``max_bits`` bits) and, if ``keyed``, text_sha256.

    Fingerprints link, so rows that repeat a doc_id with other texts are reached each by its own fingerprint alone; each comes back. Null and empty texts have
    fingerprint 0 and link like any other. Rows with a null doc_id keep a null component of their own. Columns besides doc_id and text
    are ignored. An empty table gives no rows.
    """
    marked = materialise(fingerprints(docs, keyed), "fingerprints")
    distinct = materialise(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(near_links(distinct.select("fp", F.col("fp").alias("rep")), max_bits, segments))
    named = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(named.join(least, "component").select("fp", "component_id"), "named")
    out = marked.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), *["text_sha256"] * keyed)
