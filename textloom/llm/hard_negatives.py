"""Hard-negative mining by distributed radix selection.

Every anchor meets all rows, block by block; a score is an integer inner product. What is wanted are the first k rows of many windows:
an anchor's best rows of its own label, then, for each of these positives, the best rows of other labels within a range of scores.

No window is ever sorted. A pass counts the rows of each window by the highest digit of their scores' distance from the window's top;
the counts, summed over all blocks, say which digit the kth row has. The window shrinks to that digit, and the next pass counts its next digit, until
few rows are left in it. If a single score is left with too many rows, their ids are searched in the same way. At last one pass
gathers the rows at or above the bounds that were found, and only these are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Shares of a positive's score, in percent, between which a negative's lies.
LOWEST, HIGHEST = 30, 90
EVERY, RELABEL, LABELS = 100, 7, 10
#: Bits of a digit.
DIGIT = 11
#: A window's bucket of the kth row is gathered as it is once it has so many times k rows at most.
ENOUGH = 4
#: Rows of a candidate block, of one packed row of it, and of a block of anchors.
CANDIDATE_BLOCK, PACK, ANCHOR_BLOCK = 16_384, 512, 8192
#: Bytes of an Arrow batch of packed rows.
BATCH_BYTES = 32 << 20

_GRID = pa.schema([("tb", pa.int32()), ("qb", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("rows", pa.binary()), ("x", pa.binary())])
_WINDOW = "w int, lo long, hi long, shift int, need long, score long"
_STATE = ("w", "lo", "hi", "shift", "need", "score")


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): rows that take part, labels moved on where they are to be, components as integers."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = F.when(vec_id % RELABEL == 0, (label + 1) % LABELS).otherwise(label)
    return vectors.where(good).select(vec_id.alias("vec_id"), moved.alias("label"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _pack_batches(blocks: int, size: int, pack: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, row, v) in; packed rows out, each part of the block that its first row falls in. Short vectors end in zeros."""

    def packed(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(part).combine_chunks()
        ids, labels, rows = (t.column(i).to_numpy() for i in range(3))
        v = t.column(3).combine_chunks()
        x = np.zeros((len(ids), size), np.int64)
        if (v.value_lengths().to_numpy() == size).all():
            x[:] = v.flatten().to_numpy().reshape(-1, size)
        else:
            for i, own in enumerate(v.to_pylist()):
                x[i, : len(own)] = own
        block = int(rows[0] // len(ids) % blocks)
        return table(_GRID, [[block], [0], [0], *([y.tobytes()] for y in (ids, labels, rows, x.astype(np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int64)))])

    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, pack - n)
            held, n, b = [*held, part], n + part.num_rows, b.slice(part.num_rows)
            if n == pack:
                yield packed(held)
                held, n = [], 0
    if n:
        yield packed(held)


def _matrix(packed: list[bytes], counts: list[int], size: int) -> np.ndarray:
    parts = [np.frombuffer(p, np.int16 if len(p) == 2 * n * size else np.int64).reshape(n, size).astype(np.int64) for p, n in zip(packed, counts, strict=True)]
    return np.concatenate(parts) if parts else np.zeros((0, size), np.int64)


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products, exactly: in floating point where every partial sum fits its digits."""
    bound = float(np.abs(anchors).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * anchors.shape[1]
    for kind, most in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if bound < most:
            return (anchors.astype(kind) @ candidates.T.astype(kind)).astype(np.int64)
    return anchors @ candidates.T


def counted(window: dict, s: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digits, rows) of a window among rows of one block, down to the digit in which the block alone has all that are needed."""
    if window["score"] is None:
        u = window["hi"] - s[(s >= window["lo"]) & (s <= window["hi"])]
    else:
        u = ids[(s == window["score"]) & (ids >= window["lo"]) & (ids <= window["hi"])] - window["lo"]
    n = np.bincount(u >> window["shift"])
    digits = np.flatnonzero(n)
    n = n[digits]
    last = int(np.searchsorted(np.cumsum(n), window["need"])) + 1
    return digits[:last], n[:last]


def best_rows(window: dict, s: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the rows of a settled window among rows of one block: at most as many as are needed, best first."""
    at = np.flatnonzero((s >= window["lo"]) & (s <= window["hi"]))
    if window["score"] is not None:
        at = at[(s[at] > window["lo"]) | (ids[at] <= window["score"])]
    if len(at) > (most := window["need"]):
        at = at[s[at] >= np.partition(s[at], len(at) - most)[len(at) - most]]
    return at[np.lexsort((ids[at], -s[at]))[:most]]


_COUNTS = pa.schema([("row", pa.int64()), ("w", pa.int32()), ("digit", pa.int64()), ("n", pa.int64())])
_FOUND = pa.schema([("row", pa.int64()), ("w", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _grid_batches(size: int, same: bool, gather: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tb, qb, kind): packed candidates, then anchors, each with its windows; counts or rows of the windows out."""
    key, held = None, []
    schema = _FOUND if gather else _COUNTS

    def run() -> Iterator[pa.RecordBatch]:
        packed, asked = [r for r in held if r["kind"] == 0], [r for r in held if r["kind"] == 1]
        if not packed or not asked:
            return
        ids, labels, rows = (np.concatenate([np.frombuffer(r[c], np.int64) for r in packed]) for c in ("ids", "labels", "rows"))
        x = _matrix([r["x"] for r in packed], [len(r["ids"]) // 8 for r in packed], size)
        order = np.argsort(labels, kind="stable")
        ids, labels, rows, x = ids[order], labels[order], rows[order], x[order]
        out: list[tuple] = []
        for lo in range(0, len(asked), 64):
            part = asked[lo : lo + 64]
            all_scores = scores(np.array([a["v"] for a in part], np.int64), x)
            for a, s in zip(part, all_scores, strict=True):
                first, end = np.searchsorted(labels, a["label"], "left"), np.searchsorted(labels, a["label"], "right")
                if same:
                    others = np.flatnonzero(rows[first:end] != a["row"]) + first
                else:
                    others = np.r_[0:first, end : len(labels)]
                s, own = s[others], ids[others]
                for window in a["windows"]:
                    if gather:
                        at = best_rows(window, s, own)
                        out += zip([a["row"]] * len(at), [window["w"]] * len(at), own[at].tolist(), s[at].tolist(), strict=True)
                    else:
                        digits, n = counted(window, s, own)
                        out += zip([a["row"]] * len(n), [window["w"]] * len(n), digits.tolist(), n.tolist(), strict=True)
            if len(out) > 20_000:
                yield table(schema, list(map(list, zip(*out, strict=True))))
                out = []
        if out:
            yield table(schema, list(map(list, zip(*out, strict=True))))

    for b in batches:
        for i, here in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            if here != key:
                yield from run()
                key, held = here, []
            held.append({c: b.column(c)[i].as_py() for c in b.schema.names})
    yield from run()


class Selection:
    """The anchors, the blocks of candidates, and passes over both."""

    def __init__(self, vectors: DataFrame, scale: int = SCALE, every: int = EVERY, candidate_block: int = CANDIDATE_BLOCK, anchor_block: int = ANCHOR_BLOCK, digit: int = DIGIT) -> None:
        self.spark = vectors.sparkSession
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        self.digit = digit
        # Numbers of rows are fixed by being written.
        self.rows = materialise(usable(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
        n, size, square, self.least_id, self.most_id, n_anchors = self.rows.agg(
            F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)), F.min("vec_id"), F.max("vec_id"), F.count_if(F.col("vec_id") % every == 0)
        ).first()
        self.size, self.n_anchors = size or 0, n_anchors
        #: No score is beyond it, by Cauchy and Schwarz.
        self.bound = math.ceil((square or 0.0) * (1 + 1e-9))
        if self.bound >= 1 << 56:
            raise ValueError("squared lengths of 2**56 or more after scaling: a hundredfold score doesn't fit 64 bits")
        blocks = max(1, -(-n // candidate_block))
        self.anchor_blocks = max(1, -(-n_anchors // anchor_block), min(4, -(-n_anchors // 128)))
        pack = min(PACK, candidate_block)
        packed = self.rows.select("vec_id", "label", "row", "v").mapInArrow(partial(_pack_batches, blocks, self.size, pack), "tb int, qb int, kind int, ids binary, labels binary, rows binary, x binary")
        self.blocks, self.candidates = blocks, materialise(packed.drop("qb", "kind"), "candidates")
        padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(self.size) - F.size("v")))
        anchors = self.rows.where(F.col("vec_id") % every == 0)
        self.anchors = materialise(anchors.select("row", "vec_id", "label", padded.alias("v"), F.pmod(F.xxhash64("row"), F.lit(self.anchor_blocks)).cast("int").alias("qb")), "anchors")

    def over(self, windows: DataFrame, same: bool, gather: bool) -> DataFrame:
        """One pass: counts (row, w, digit, n) or rows (row, w, vec_id, score) of windows (row, w and others)."""
        asked = windows.groupBy("row").agg(F.collect_list(F.struct(*_STATE)).alias("windows"))
        asked = self.anchors.join(asked, "row")
        none = F.lit(None)
        left = self.candidates.select("tb", F.explode(F.sequence(F.lit(0), F.lit(self.anchor_blocks - 1))).alias("qb"), F.lit(0).alias("kind"), "ids", "labels", "rows", "x", none.cast("long").alias("row"), none.cast("long").alias("label"), none.cast("array<long>").alias("v"), none.cast(f"array<struct<{_WINDOW.replace(' ', ':')}>>".replace(",:", ",")).alias("windows"))
        right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("tb"), "qb", F.lit(1).alias("kind"), *[none.cast("binary").alias(c) for c in ("ids", "labels", "rows", "x")], "row", "label", "v", "windows")
        grid = left.unionByName(right).repartition("tb", "qb").sortWithinPartitions("tb", "qb", "kind")
        return grid.mapInArrow(partial(_grid_batches, self.size, same, gather), "row long, w int, vec_id long, score long" if gather else "row long, w int, digit long, n long")

    def _shift(self, lo: F.Column, hi: F.Column) -> F.Column:
        return F.greatest(F.lit(0), F.length(F.bin(hi - lo)) - self.digit).cast("int")

    def windows(self, asked: DataFrame, k: int) -> DataFrame:
        """Open windows of (row, w, lo, hi) of scores: ``top`` is the best score of the whole window, ``need`` what is left of k."""
        return asked.select("row", "w", F.col("hi").alias("top"), "lo", "hi", self._shift(F.col("lo"), F.col("hi")).alias("shift"), F.lit(k).cast("long").alias("need"), F.lit(None).cast("long").alias("score"))

    def narrowed(self, open_: DataFrame, counts: DataFrame, k: int) -> DataFrame:
        """Windows with a further digit, and what settles them: ``settled``, ``bound`` (least score) and ``last`` (largest id at that score, null for any).

        A window without rows is gone."""
        summed = counts.groupBy("row", "w", "digit").agg(F.sum("n").alias("n"))
        by_digit = Window.partitionBy("row", "w").orderBy("digit")
        places = summed.withColumn("before", F.sum("n").over(by_digit) - F.col("n")).withColumn("later", F.lead("digit").over(by_digit).isNotNull())
        joined = places.join(open_, ["row", "w"])
        # The digit of the kth row, or the last one there is.
        joined = joined.where((F.col("before") < F.col("need")) & ((F.col("before") + F.col("n") >= F.col("need")) | ~F.col("later")))
        start, width = F.expr("shiftleft(digit, shift)"), F.expr("shiftleft(1L, shift)")
        by_id = F.col("score").isNotNull()
        hi = F.when(by_id, F.least("hi", F.col("lo") + start + width - 1)).otherwise(F.col("hi") - start)
        lo = F.when(by_id, F.col("lo") + start).otherwise(F.greatest("lo", F.col("hi") - start - width + 1))
        left = F.col("need") - F.col("before")
        few = (F.col("n") <= ENOUGH * k) | (F.col("n") <= left)
        last_digit = F.col("shift") == 0
        settled = few | (by_id & last_digit)
        tied = ~settled & ~by_id & last_digit
        out = joined.select("row", "w", "top", hi.alias("hi"), lo.alias("lo"), left.alias("need"), "score", settled.alias("settled"), tied.alias("tied"))
        out = out.withColumn("bound", F.coalesce("score", "lo")).withColumn("last", F.when(F.col("score").isNotNull(), F.col("hi")))
        ids = (F.lit(self.least_id).cast("long"), F.lit(self.most_id).cast("long"))
        for c, value in (("score", F.col("lo")), ("hi", ids[1]), ("lo", ids[0])):
            out = out.withColumn(c, F.when(F.col("tied"), value).otherwise(F.col(c)))
        return out.withColumn("shift", self._shift(F.col("lo"), F.col("hi"))).drop("tied")

    def first(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """(row, w, place, vec_id, score): the first ``k`` rows of each window (row, w, lo, hi), of the anchor's label or of other labels."""
        open_ = materialise(self.windows(asked, k), "windows")
        settled: list[DataFrame] = []
        while True:
            now = materialise(self.narrowed(open_, self.over(open_, same, False), k), "narrowed")
            settled.append(now.where("settled").select("row", "w", F.col("bound").alias("lo"), F.col("top").alias("hi"), F.lit(0).alias("shift"), F.lit(k).cast("long").alias("need"), F.col("last").alias("score")))
            open_ = now.where(~F.col("settled")).select("row", "w", "top", "lo", "hi", "shift", "need", "score")
            if open_.isEmpty():
                break
        bounds = settled[0]
        for s in settled[1:]:
            bounds = bounds.unionByName(s)
        order = Window.partitionBy("row", "w").orderBy(F.desc("score"), "vec_id")
        return self.over(bounds, same, True).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, every: int = EVERY, **sizes: int) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score of the hardest negatives of each anchor and positive.

    ``vectors`` has columns vec_id, embedding and label; other columns are ignored. Rows with a null id, label or vector, or with a null, NaN or infinite
    component take no part. Ties go to the smaller vec_id. Rows that repeat a vec_id each count, as anchors, positives and negatives;
    only the anchor's own row is no other row. Vectors of unlike lengths are compared as if the shorter one ended in zeros. A positive of a negative
    score has no negatives. An empty table gives no rows. Squared lengths of 2**56 or more after scaling are an error.
    """
    made = Selection(vectors, scale, every, **sizes)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not made.n_anchors:
        return made.spark.createDataFrame([], schema)
    whole = made.anchors.select("row", F.lit(0).alias("w"), F.lit(-made.bound).cast("long").alias("lo"), F.lit(made.bound).cast("long").alias("hi"))
    found = materialise(made.first(whole, positives, True).select("row", F.col("place").cast("int").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    p = F.col("positive_score")
    share = found.where(p >= 0).select("row", "w", F.expr(f"({LOWEST} * positive_score + 99) div 100").alias("lo"), F.expr(f"({HIGHEST} * positive_score) div 100").alias("hi")).where("lo <= hi")
    hard = made.first(share, negatives, False).select("row", "w", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = made.anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return hard.join(found, ["row", "w"]).join(named, "row").select(*[c.split()[0] for c in schema.split(", ")])
