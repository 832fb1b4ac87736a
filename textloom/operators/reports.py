"""Reports of a run as tables, and as the lines that a terminal shows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ledger


def cost_by_operation(calls: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """operation, operations, input_tokens, output_tokens, total_tokens, total_cost, average_cost of a ledger of calls."""
    return ledger.summary(calls, price_in, price_out, "operation")


def cost_levels(calls: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """What a run cost: in all, by operation, and by attempt of each operation."""
    return ledger.rollup(calls, price_in, price_out, "operation", "attempt")


def validation(results: DataFrame, found: DataFrame) -> DataFrame:
    """format, passed, severity, layer, message, location: a row for each finding, and one with nulls for a format without any."""
    return results.select("format", "passed").join(found.select("format", "severity", "layer", "message", "location"), "format", "left")


def size(n: float) -> str:
    return f"{n / 1024**2:.1f} MB" if n >= 1024**2 else f"{n / 1024:.1f} KB" if n >= 1024 else f"{n:.0f} B"


def duration(seconds: float) -> str:
    tenths = int(seconds * 10 + 0.5)
    rest = f"{tenths % 600 // 10}.{tenths % 10}s"
    return f"{tenths // 600}m {rest}" if tenths >= 600 else rest


def cost_lines(expected, files: int, languages: str, original_tokens: int, provider: str) -> list[str]:
    """What a run will cost, before it is asked for. ``expected`` is a row of ``ledger.pre_run``."""
    return [
        f"Files: {files:,} ({languages})",
        f"Tokens: {expected['chunk_tokens']:,} in {expected['chunks']} chunk{'s' * (expected['chunks'] != 1)} (before compression: {original_tokens:,})",
        f"Calls: {expected['input_tokens']:,} tokens in, {expected['output_tokens']:,} out",
        f"Expected cost with {provider}: ${expected['estimated_cost']:.4f}",
    ]


def validation_lines(report: DataFrame) -> list[str]:
    """Findings by format; there are seven formats at most."""
    by: dict[str, list] = {}
    for r in sorted(report.collect(), key=lambda r: (r["format"], r["severity"] or "", r["message"] or "", r["location"] or "")):
        by.setdefault(r["format"], []).append(r)
    out = []
    for name, rows in by.items():
        out.append(f"{name}: {'passed' if rows[0]['passed'] else 'FAILED'}")
        out += [f"  {r['severity']} [{r['layer']}] {r['message']}" + (f": {r['location']}" if r["location"] else "") for r in rows if r["severity"]]
    failed = sum(not rows[0]["passed"] for rows in by.values())
    return [*out, f"{failed} of {len(by)} failed validation" if failed else f"all {len(by)} passed validation"]


def success_lines(written: Iterable[tuple[str, str, str, int]], files: int, tokens: int, ratio: float, cost: float, seconds: float, left_out: int = 0) -> list[str]:
    """``written``: (format, path, status, bytes); ``left_out``: files that were listed but hold no text that can be read."""
    out = [f"{status:10} {path} ({format_}, {size(n)})" for format_, path, status, n in written]
    out += [f"Files: {files:,}", f"Tokens: {tokens:,}"]
    if left_out:
        out.append(f"Left out: {left_out:,} that aren't readable text")
    if 0 < ratio < 1:
        out.append(f"Compression: {int((1 - ratio) * 100)} %")
    return [*out, f"Cost: ${cost:.4f}", f"Time: {duration(seconds)}"]
