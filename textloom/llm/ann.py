"""Nearest neighbours by largest inner product, with additive quantisation.

A vector's direction is coded as a sum of one codeword from each of ``BOOKS`` full-dimensional codebooks, found by beam search; its
norm and the length of what the code misses are stored beside the code. A query's inner products with all codewords form lookup
tables, from which every candidate is scored. Candidates whose score, allowing for what their code misses, can still reach the best
found are scored again on the original vectors.

Candidates and queries meet in a grid of blocks, each of bounded size: no cell or bucket can become hot. Equal vectors are searched
once, and of equal candidates only as many stay as a result can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import materialise, small_batches, table

#: Codebooks, codewords in each, hypotheses of the beam.
BOOKS, WORDS, BEAM = 8, 256, 4
#: Vectors on which codebooks are fitted; every vector is coded with them.
SAMPLE_ROWS, ROUNDS, SEED = 8192, 6, 7
#: Rows of a block of candidates, and the most of a block of queries.
CANDIDATE_BLOCK, QUERY_BLOCK = 16384, 8192
#: Candidates that are scored exactly at first, and standard deviations that are allowed for a code's error after that.
FIRST, SLACK = 100, 2.5


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(1) - 2 * x @ book.T, axis=1)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS) -> np.ndarray:
    """Codebooks (books, words, dimension) from directions: k-means on residuals, then a joint least-squares update."""
    draw = np.random.default_rng(SEED)
    words = max(1, min(words, len(x)))
    out, rest, codes = [], x.copy(), []
    for _ in range(books):
        book = rest[draw.choice(len(rest), words, replace=False)].copy()
        for _ in range(ROUNDS):
            near = _nearest(rest, book)
            n = np.bincount(near, minlength=words)
            sums = np.zeros_like(book)
            np.add.at(sums, near, rest)
            book[n > 0] = sums[n > 0] / n[n > 0, None]
        near = _nearest(rest, book)
        rest = rest - book[near]
        out.append(book)
        codes.append(near)
    used = np.zeros((books * words, books * words))
    target = np.zeros((books * words, x.shape[1]))
    at = np.stack(codes, 1) + words * np.arange(books)
    for i in range(books):
        np.add.at(target, at[:, i], x)
        for j in range(books):
            np.add.at(used, (at[:, i], at[:, j]), 1)
    first = np.concatenate(out)
    joint = first + np.linalg.solve(used + np.eye(len(used)), target - used @ first)
    return joint.reshape(books, words, -1).astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes, length of the error) of directions, by beam search."""
    n, (m, k, d) = len(x), books.shape
    rest = x[:, None, :].astype(np.float32)
    codes = np.zeros((n, 1, 0), np.uint8)
    for i in range(m):
        size = rest.shape[1]
        cost = (rest * rest).sum(2)[:, :, None] + (books[i] * books[i]).sum(1) - 2 * (rest.reshape(-1, d) @ books[i].T).reshape(n, size, k)
        cost = cost.reshape(n, -1)
        best = np.argpartition(cost, min(beam, cost.shape[1]) - 1, axis=1)[:, : min(beam, cost.shape[1])]
        parent, word = best // k, best % k
        rows = np.arange(n)[:, None]
        rest = rest[rows, parent] - books[i][word]
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
    left = np.sqrt((rest * rest).sum(2))
    best = left.argmin(1)
    return codes[np.arange(n), best], left[np.arange(n), best]


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k].astype(np.float64) * float(q[k])
    return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _coded_schema(number: pa.DataType) -> pa.Schema:
    return pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(number)), ("code", pa.binary()), ("norm", pa.float32()), ("miss", pa.float32())])


def _code_batches(books: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            part = b.slice(lo, 1024)
            x = _matrix(part.column(1), books.shape[2])
            norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
            codes, miss = encode(x / norm[:, None], books)
            yield table(_coded_schema(part.column(1).type.value_type), [part.column(0), part.column(1), [c.tobytes() for c in codes], norm.astype(np.float32), miss.astype(np.float32)])


_FOUND = pa.schema([("rep", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search_block(books: np.ndarray, top: int, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, miss: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the (ids, scores) of its best ``top`` in one block, best first, ties to the smaller id."""
    d, n = x.shape[1], len(ids)
    for lo in range(0, len(queries), 64):
        part = queries[lo : lo + 64].astype(np.float32)
        approx = np.zeros((len(part), n), np.float32)
        for m in range(len(books)):
            approx += np.take(part @ books[m].T, codes[:, m], axis=1)
        approx *= norm
        slack = SLACK * miss * norm / np.sqrt(d)
        for i, q in enumerate(queries[lo : lo + 64]):
            first = np.argpartition(-approx[i], min(FIRST, n) - 1)[:FIRST] if n > FIRST else np.arange(n)
            score = np.full(n, -np.inf)
            score[first] = exact(x[first], q)
            if n > FIRST:
                bar = np.partition(score[first], -min(top, len(first)))[-min(top, len(first))]
                more = np.flatnonzero((approx[i] + slack * np.linalg.norm(q) >= bar) & (score == -np.inf))
                score[more] = exact(x[more], q)
            scored = np.flatnonzero(score > -np.inf)
            best = scored[np.lexsort((ids[scored], -score[scored]))[:top]]
            yield ids[best], score[best]


def _search_batches(books: np.ndarray, top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tb, qb, kind): a block of candidates, then its block of queries."""
    d = books.shape[2]
    held: list[pa.RecordBatch] = []

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = rows.column("kind").to_numpy()
        if not (kind == 0).any() or not (kind == 1).any():
            return
        split = int(np.searchsorted(kind, 1))
        c, q = rows.slice(0, split).combine_chunks(), rows.slice(split).combine_chunks()
        ids, x = c.column("vec_id").to_numpy(), _matrix(c.column("embedding").combine_chunks(), d)
        codes = np.frombuffer(b"".join(c.column("code").to_pylist()), np.uint8).reshape(-1, len(books))
        reps = q.column("vec_id").to_numpy()
        queries = _matrix(q.column("embedding").combine_chunks(), d)
        found = search_block(books, top, ids, x, codes, c.column("norm").to_numpy(), c.column("miss").to_numpy(), queries)
        for rep, (best, score) in zip(reps, found, strict=True):
            yield table(_FOUND, [np.full(len(best), rep), best, score])

    last = None
    for b in batches:
        key = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi == lo:
                continue
            if last is not None and tuple(key[lo]) != last:
                yield from run(pa.Table.from_batches(held))
                held = []
            last = tuple(key[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield from run(pa.Table.from_batches(held))


def number_type(vectors: DataFrame) -> str:
    """float for vectors of floats, else double, which holds every other number that vectors are made of."""
    element = vectors.schema["embedding"].dataType.elementType
    return "float" if isinstance(element, FloatType) else "double"


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, embedding) that take part: not null or zero, all components finite, of the commonest dimension.

    Floats stay floats; vectors of any other numbers are doubles, so that exact scores are those of the original vectors.
    """
    v = F.col("embedding")
    good = v.isNotNull() & F.col("vec_id").isNotNull() & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast(f"array<{number_type(vectors)}>").alias("embedding")).where(good)
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (size["d"] if size else 0)).dropDuplicates()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest vectors of each query row, its own vec_id excepted, nearest first.

    ``vectors`` has columns vec_id and embedding, ``queries`` is a part of its rows. Vectors that are null, zero or hold null or
    non-finite components take no part on either side, nor do null ids; repeated rows count once. Ties go to the smaller vec_id. Fewer
    candidates give fewer rows, an empty table none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = materialise(usable(vectors), "vectors")
    asked = materialise(rows.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi"), "queries")
    n, n_queries = rows.count(), asked.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n_queries:
        return spark.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("embedding").toArrow().column(0).combine_chunks()
    x = _matrix(sample, len(sample[0])).astype(np.float64)
    books = fit(x / np.linalg.norm(x, axis=1, keepdims=True))
    # Of equal vectors, k + 1 with the smallest ids can be in a result (one may be the query's own).
    same = Window.partitionBy("embedding").orderBy("vec_id")
    kept = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).drop("place")
    coded = kept.mapInArrow(partial(_code_batches, books), f"vec_id long, embedding array<{number_type(vectors)}>, code binary, norm float, miss float")
    distinct = materialise(asked.groupBy("embedding").agg(F.min("vec_id").alias("rep")), "distinct-queries")
    blocks = -(-n // CANDIDATE_BLOCK)
    query_blocks = max(-(-n_queries // QUERY_BLOCK), min(4, -(-n_queries // 128)))

    def every(n: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = coded.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("tb"), every(query_blocks).alias("qb"), F.lit(0).alias("kind"), "vec_id", "embedding", "code", "norm", "miss")
    none = F.lit(None)
    right = distinct.select(every(blocks).alias("tb"), F.pmod(F.xxhash64("rep"), F.lit(query_blocks)).cast("int").alias("qb"), F.lit(1).alias("kind"), F.col("rep").alias("vec_id"), "embedding", none.cast("binary").alias("code"), none.cast("float").alias("norm"), none.cast("float").alias("miss"))
    grid = left.unionByName(right).repartition(2 * blocks * query_blocks, "tb", "qb").sortWithinPartitions("tb", "qb", "kind")
    found = grid.mapInArrow(partial(_search_batches, books, k + 1), "rep long, vec_id long, score double")
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    found = materialise(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place"), "found")
    named = asked.join(distinct, "embedding").select(F.col("vec_id").alias("query_id"), "rep")
    out = named.join(found, "rep").where("vec_id <> query_id")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.select("query_id", F.row_number().over(own).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
