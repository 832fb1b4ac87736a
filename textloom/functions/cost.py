"""Money, budgets and delays as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import PROVIDERS

ANALYSIS_TOKENS, FORMAT_TOKENS, MERGE_INPUT = 4096, 500, 10_000
MAX_RETRIES, FIRST_DELAY_MS, MOST_DELAY_MS = 3, 1000, 60_000


def _long(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def cost(tokens_in, tokens_out, price_in: Column, price_out: Column) -> Column:
    """in / 1000 * price + out / 1000 * price, in doubles and in this order."""
    return _long(tokens_in) / F.lit(1000.0) * price_in + _long(tokens_out) / F.lit(1000.0) * price_out


def estimate(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Struct of the input's, the output's and the whole cost."""
    parts = cost(tokens_in, 0, price_in, price_out), cost(0, tokens_out, price_in, price_out)
    return F.struct(parts[0].alias("input_cost"), parts[1].alias("output_cost"), cost(tokens_in, tokens_out, price_in, price_out).alias("total_cost"))


def merge_estimate(existing_bytes: Column, new_bytes: Column, price_in: Column, price_out: Column) -> Column:
    """Expected cost of merging new rules with existing ones: both are read, and about as much as the longer one is written."""
    down = lambda b: F.floor(b / 4).cast("long")
    return estimate(down(existing_bytes) + down(new_bytes), F.greatest(down(existing_bytes), down(new_bytes)), price_in, price_out)


def dry_run_cost(tokens: Column, formats, price_in: Column, price_out: Column) -> Column:
    """Cost of an analysis and of each format, before any call."""
    return tokens / F.lit(1000.0) * price_in + (F.lit(ANALYSIS_TOKENS) + F.lit(FORMAT_TOKENS) * _long(formats)) / F.lit(1000.0) * price_out


def reduction_percent(ratio: Column) -> Column:
    """Whole percent saved, truncated; null unless 0 < ratio < 1."""
    return F.when((ratio > 0) & (ratio < 1), ((F.lit(1.0) - ratio) * 100).cast("int"))


def backoff_ms(attempt: Column, first=FIRST_DELAY_MS, most=MOST_DELAY_MS) -> Column:
    """Delay before jitter: doubles with each attempt up to the tenth, within a cap."""
    return F.least(F.lit(first) * F.pow(F.lit(2.0), F.least(attempt, F.lit(10))), F.lit(float(most))).cast("long")


def fix_temperature(attempt: Column) -> Column:
    return F.least(F.round(F.lit(0.7) + F.lit(0.1) * (attempt - 1), 6), F.lit(0.9))


def state_valid(ratio: Column, spent: Column) -> Column:
    return ratio.between(0.0, 1.0) & (spent >= 0)


def pricing(spark: SparkSession) -> DataFrame:
    """provider, context_limit, price_in, price_out: a fixed table of four rows."""
    return spark.createDataFrame([(k, v[0], v[1], v[2]) for k, v in PROVIDERS.items()], "provider string, context_limit long, price_in double, price_out double")
