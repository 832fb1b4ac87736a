"""Helpers that the training-data operators share: word splitting, shared storage, Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Latin letters, of which each is a letter to every tokenizer and stays itself under NFC; marks that may follow them.
LATIN, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,!?;:"
#: Unicode White_Space, as characters of a class.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 bytes. ``bytes.split()`` splits at 0x20 and 0x09-0x0D, which is exactly ``WORD``."""
    return text.split() if text else []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, else one of our own, which only a run on a single machine can share."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a reader of it: lineage ends there and any executor may be lost."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(column: str, parts: int) -> F.Column:
    """``crc32`` of an id as decimal text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores where their source has less than half as many splits as there are cores: a few small files, or one row
    group. Larger inputs are read as they are, without a shuffle."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if 2 * size < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else rows


def binary_text(column: str = "text") -> F.Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("text")


def text_digest(text: F.Column) -> F.Column:
    """SHA-256 of a text's UTF-8 bytes, as hexadecimal; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256)


def one_each(texts: DataFrame, *keep: str) -> DataFrame:
    """One row (doc_id, digest, text and columns that the id decides) for each id of (doc_id, text): that of the smallest digest. Partial results meet, not all rows of an id."""
    digested = texts.withColumn("digest", F.sha2("text", 256))
    return digested.groupBy("doc_id", *keep).agg(F.min(F.struct("digest", "text")).alias("row")).select("doc_id", *keep, "row.digest", "row.text")


class Memo(dict):
    """Remembers what ``compute`` gave for recent keys: two generations of ``size`` keys, so that common ones stay and memory is bounded."""

    def __init__(self, compute: Callable, size: int = 1 << 18, longest: int = 64) -> None:
        self.compute, self.size, self.longest = compute, size, longest
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.old = self.copy()
                self.clear()
            self[key] = value
        return value


#: Rows of the Arrow batches that Python workers get; whole texts make rows large.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, on both sides of the worker's socket."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text as UTF-8 bytes) of documents, in small batches for Python."""
    small_batches(docs.sparkSession)
    return spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), binary_text())


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the bytes of one binary column stay near ``limit`` in each (a longer single value stays whole)."""
    for batch in batches:
        n, lo, size = batch.num_rows, 0, 0
        if batch.nbytes <= limit:
            yield batch
            continue
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        for i, length in enumerate(lengths):
            size += length or 0
            if size > limit:
                yield batch.slice(lo, i + 1 - lo)
                lo, size = i + 1, 0
        if lo < n:
            yield batch.slice(lo)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of at least so many rows, but for the last."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def table(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
