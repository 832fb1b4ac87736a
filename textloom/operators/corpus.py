"""Corpus tables and their totals: files in, metadata, histograms, top lists and cost estimates out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cost, text


def compressed(files: DataFrame, structural: Column | None = None, compress: Column | bool = True) -> DataFrame:
    """``files`` (ord, path, language, original_content) with compressed text, its method and both sizes in bytes.

    ``structural`` gives the structurally compressed text of known languages, null where that failed; white space is the fallback. Where
    ``compress`` is false the text stays as it is, with method none.
    """
    wanted = compress if isinstance(compress, Column) else F.lit(compress)
    first = F.lit(None).cast("string") if structural is None else F.when(wanted, structural)
    out = files.withColumn("structural", first)
    method = F.when(~wanted, "none").when(F.col("structural").isNotNull(), "structural").otherwise("whitespace")
    content = F.when(~wanted, F.col("original_content")).otherwise(F.coalesce("structural", text.whitespace_compressed(F.col("original_content"))))
    out = out.withColumn("compressed_content", content).withColumn("compression_method", method)
    return out.drop("structural").withColumn("original_size", text.byte_size(F.col("original_content"))).withColumn("compressed_size", text.byte_size(F.col("compressed_content")))


def metadata(files: DataFrame) -> DataFrame:
    """One row: files, sizes, ratio (0 for an empty corpus). Only integers are summed."""
    out = files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("original_size"), F.lit(0)).cast("long").alias("total_original_size"), F.coalesce(F.sum("compressed_size"), F.lit(0)).cast("long").alias("total_compressed_size"))
    return out.withColumn("compression_ratio", F.when(F.col("total_original_size") == 0, F.lit(0.0)).otherwise(F.col("total_compressed_size") / F.col("total_original_size")))


def language_histogram(files: DataFrame) -> DataFrame:
    return files.where("language is not null").groupBy("language").agg(F.count("*").alias("files"))


def method_breakdown(files: DataFrame) -> DataFrame:
    return files.groupBy("compression_method").agg(F.count("*").alias("files"), F.sum("original_size").cast("long").alias("original_size"), F.sum("compressed_size").cast("long").alias("compressed_size"))


def by_language(files: DataFrame, top: int = 3) -> DataFrame:
    """language (unknown for null), files, tokens, and as text its ``top`` largest files and how many more there are.

    The ranking window keeps a partial top list in each task before the shuffle, so a language that holds most rows costs no more.
    """
    tokens = files.select(F.coalesce("language", F.lit("unknown")).alias("language"), "path", text.tokens_up(F.col("compressed_content")).alias("tokens"))
    totals = tokens.groupBy("language").agg(F.count("*").alias("files"), F.sum("tokens").cast("long").alias("tokens"))
    best = top_files(tokens, top).groupBy("language").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path", "tokens"))), lambda r: F.concat(r["path"], F.lit(":"), r["tokens"].cast("string"))), ",").alias("top_files"))
    return totals.join(best, "language").withColumn("more", F.greatest(F.col("files") - top, F.lit(0)).cast("long"))


def top_files(tokens: DataFrame, top: int = 3) -> DataFrame:
    """language, rank, path, tokens of the largest files of each language; ties go to the smaller path."""
    order = Window.partitionBy("language").orderBy(F.desc("tokens"), "path")
    return tokens.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("language", "rank", "path", "tokens")


def top_languages(histogram: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` languages by files and the sum of the others as ``other``. The input has one row for each language."""
    ranked = histogram.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("files"), "language")))
    name = F.when(F.col("rank") <= top, F.col("language")).otherwise("other")
    return ranked.groupBy(name.alias("language")).agg(F.sum("files").cast("long").alias("files"))


def language_list(histogram: DataFrame, *keys: str) -> DataFrame:
    """For each value of ``keys`` the text "a (2), b (1)" of its languages (language, files), sorted as text. One entry for each language."""
    entry = F.concat("language", F.lit(" ("), F.col("files").cast("string"), F.lit(")"))
    return histogram.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(entry)), ", ").alias("languages"))


def dry_run(files: DataFrame, formats: int, price_in: float, price_out: float) -> DataFrame:
    """The dry-run report: for each language files, bytes, tokens and the estimated cost of analysing it alone."""
    out = files.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(
        F.count("*").alias("files"),
        F.sum("original_size").cast("long").alias("original_size"),
        F.sum("compressed_size").cast("long").alias("compressed_size"),
        F.sum(text.tokens_up(F.col("compressed_content"))).cast("long").alias("tokens"),
    )
    out = out.withColumn("reduction_percent", cost.reduction_percent(F.col("compressed_size") / F.col("original_size")))
    return out.withColumn("estimated_cost", cost.dry_run_cost(F.col("tokens"), formats, F.lit(price_in), F.lit(price_out)))


def token_totals(files: DataFrame, *keys: str, tokens: Callable[[Column], Column] = text.tokens_up) -> DataFrame:
    """corpus_tokens (paths and compressed contents) and original_tokens (contents before compression) of all files, or of each key's."""
    grouped = files.groupBy(*keys) if keys else files
    own = F.sum(tokens(F.col("path")) + tokens(F.col("compressed_content"))), F.sum(tokens(F.col("original_content")))
    return grouped.agg(*[F.coalesce(x, F.lit(0)).cast("long").alias(n) for x, n in zip(own, ("corpus_tokens", "original_tokens"), strict=True)])


def formatted_corpus(files: DataFrame, key: str) -> DataFrame:
    """The formatted corpus of each value of ``key``, in file order. A value's corpus is one cell, so keys should be projects, not all of a lake."""
    entry = text.corpus_entry(F.col("path"), F.col("compressed_content"))
    return files.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))), lambda r: r["e"]), "").alias("corpus"))
