"""Finalising rendered formats: normal form and a metadata header with the ledger's real totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised


def with_header(format_: Column, content: Column, header: Column) -> Column:
    """The header before the content, after frontmatter if there is any; JSON has none."""
    front = F.regexp_extract(content, r"(?s)^(---\n.*?\n---\n)", 1)
    rest = F.substr(content, F.char_length(front) + 1)
    return F.when(format_ == "json", content).otherwise(F.concat(front, header, rest))


def finalised(rules: DataFrame, provider: str, model: str, timestamp: str, totals: tuple[int, int, float], normalise: bool = True, header: bool = True) -> DataFrame:
    """``totals`` are the input tokens, output tokens and cost of all calls that the rules rest on."""
    line = F.lit(f"<!-- generated {timestamp} by {provider} {model}; {totals[0]} + {totals[1]} tokens, ${totals[2]:.4f} -->\n")
    content = normalised(F.col("content")) if normalise else F.col("content")
    return rules.select("format", (with_header(F.col("format"), content, line) if header else content).alias("content"))
