"""Chunks of many projects' files, kept in a table (project, ord, path, content): ``python examples/token_chunks_of_a_table.py IN OUT``."""

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import corpus_entry, whitespace_compressed
from textloom.operators.chunks import ChunkConfig, token_chunks

spark = SparkSession.builder.appName("example").getOrCreate()
files = spark.read.parquet(sys.argv[1]).withColumn("entry", corpus_entry(F.col("path"), whitespace_compressed(F.col("content"))))
token_chunks(files, "project", "ord", "entry", ChunkConfig(20_000)).write.parquet(sys.argv[2])
