"""Incremental corpus refresh (an extension): a stream of file versions merged into the latest version of each path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.writing import last_write

#: Parts of the table by hash of the key. A batch rewrites the parts that it touches.
BUCKETS = 256


def _current(spark: SparkSession, target: str, n: int) -> dict[int, int]:
    """Which batch wrote each part of the table last, after batch ``n``: a row for each part."""
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{target}/current/n={n}").collect()} if n >= 0 else {}


def _paths(target: str, current: dict[int, int]) -> list[str]:
    return [f"{target}/data/v={v}/bucket={b}" for b, v in sorted(current.items())]


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def latest(spark: SparkSession, target: str, n: int) -> DataFrame:
    """The table after batch ``n``, which must be the last or the one before."""
    return spark.read.parquet(*_paths(target, _current(spark, target, n)))


def refresh(versions: DataFrame, target: str, checkpoint: str, key: str = "path", order: str = "version", buckets: int = BUCKETS) -> StreamingQuery:
    """Each micro-batch N writes the parts that it touches to ``target``/data/v=N and then the list of valid parts to ``target``/current/n=N.

    A batch that is run again reads the list of the batch before and writes the same folders again. What a batch has replaced is
    deleted by the batch after the next, when nothing can need it any more. A target that was written with another checkpoint is refused.
    """
    values = [c for c in versions.columns if c not in (key, order)]
    spark = versions.sparkSession
    if _exists(spark, f"{target}/current") and not _exists(spark, f"{checkpoint}/offsets"):
        raise ValueError(f"{target} holds a table that {checkpoint} knows nothing of: batch numbers would begin again over its folders")

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = last_write(batch, key, order, *values)
        schema = new.schema
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = {r["bucket"] for r in new.select(bucket.alias("bucket")).distinct().collect()}  # at most ``buckets``
        before = _current(spark, target, n - 1)
        if old := _paths(target, {b: v for b, v in before.items() if b in touched}):
            new = last_write(spark.read.schema(schema).parquet(*old).unionByName(new), key, order, *values)
        new.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/v={n}")
        current = before | dict.fromkeys(touched, n)
        spark.createDataFrame(list(current.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{target}/current/n={n}")
        replaced = _current(spark, target, n - 2).items() - before.items()
        _remove(spark, _paths(target, dict(replaced)))

    return versions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
