"""Ledgers of model calls: running cost, deltas, summaries, roll-ups. Tokens are summed as integers and priced once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cost import ANALYSIS_TOKENS, FORMAT_TOKENS, MERGE_INPUT, cost


def running_cost(ledger: DataFrame, key: str, order: str, price_in: float, price_out: float) -> DataFrame:
    """Each call of a ledger with the cost so far, its own cost as the difference, and its place: "n of m"."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ledger.withColumn("running_in", F.sum("input_tokens").over(so_far)).withColumn("running_out", F.sum("output_tokens").over(so_far))
    total = cost(F.col("running_in"), F.col("running_out"), F.lit(price_in), F.lit(price_out))
    before = cost(F.col("running_in") - F.col("input_tokens"), F.col("running_out") - F.col("output_tokens"), F.lit(price_in), F.lit(price_out))
    place = F.concat(F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("string"), F.lit(" of "), F.count("*").over(Window.partitionBy(key)).cast("string"))
    return out.select(key, order, F.col("running_in").cast("long"), F.col("running_out").cast("long"), total.alias("running_cost"), (total - before).alias("cost_delta"), place.alias("place"))


def summary(ledger: DataFrame, price_in: float, price_out: float, *keys: str) -> DataFrame:
    """Totals, count, cost and average cost (0 if there was no call) of a ledger, or of each of its keys."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens")]
    out = (ledger.groupBy(*keys) if keys else ledger).agg(*sums, F.count("*").alias("operations"))
    out = out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn("total_cost", cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(price_in), F.lit(price_out)))
    return out.withColumn("average_cost", F.when(F.col("operations") == 0, F.lit(0.0)).otherwise(F.col("total_cost") / F.col("operations")))


def rollup(ledger: DataFrame, price_in: float, price_out: float, *keys: str) -> DataFrame:
    """Totals of a ledger at every level of ``keys``: of each combination, of all values of the last key together, and so on to the whole ledger.

    ``level`` counts the keys that are summed over; these are null, and a key's own null is "none". Calls are summed once, by all keys; levels are made of the sums.
    """
    named = ledger.select(*[F.coalesce(F.col(k).cast("string"), F.lit("none")).alias(k) for k in keys], "input_tokens", "output_tokens")
    sums = named.groupBy(*keys).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("operations"))
    out = sums.rollup(*keys).agg(F.bit_count(F.grouping_id()).cast("int").alias("level"), *[F.sum(c).cast("long").alias(c) for c in ("operations", "input_tokens", "output_tokens")])
    return out.withColumn("total_cost", cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(price_in), F.lit(price_out)))


def pre_run(chunks: DataFrame, key: str, formats: int, price_in: float, price_out: float) -> DataFrame:
    """Expected tokens and cost before a run: each chunk's analysis, the merge if there are several chunks, each format."""
    return expected(chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.sum("token_count").cast("long").alias("chunk_tokens")), formats, price_in, price_out)


def expected(totals: DataFrame, formats: int, price_in: float, price_out: float) -> DataFrame:
    """``pre_run`` of totals that are known: chunks and chunk_tokens."""
    several = F.when(F.col("chunks") > 1, F.lit(1)).otherwise(F.lit(0))
    out = totals.withColumn("input_tokens", (F.col("chunk_tokens") + several * MERGE_INPUT + formats * FORMAT_TOKENS).cast("long"))
    out = out.withColumn("output_tokens", (F.col("chunks") * ANALYSIS_TOKENS + several * ANALYSIS_TOKENS + formats * FORMAT_TOKENS).cast("long"))
    return out.withColumn("estimated_cost", cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(price_in), F.lit(price_out)))
