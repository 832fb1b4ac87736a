"""Column functions over texts: compression, normalisation, sizes, token estimates, redaction. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whitespace_compressed(text: Column) -> Column:
    """Lines trimmed, empty ones dropped, runs of blanks and tabs one blank, a newline after each line."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")), " +", " ")), lambda x: x != "")
    return F.concat(F.array_join(lines, "\n"), F.when(F.size(lines) > 0, F.lit("\n")).otherwise(F.lit("")))


def normalised(text: Column) -> Column:
    """LF line ends, lines without trailing blanks, one of several final newlines taken off and at least one present; empty stays empty."""
    out = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?m)[ \t]+$", "")
    return F.when(out == "", out).when(out.endswith("\n\n"), F.substring(out, F.lit(1), F.char_length(out) - 1)).when(out.endswith("\n"), out).otherwise(F.concat(out, F.lit("\n")))


def byte_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def tokens_up(text: Column) -> Column:
    """Estimate for reports: bytes / 4, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def tokens_down(size: Column) -> Column:
    """Estimate for merging and deconfliction: bytes / 4, rounded down, of a size that is summed first."""
    return F.floor(size / 4).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def corpus_entry(path: Column, content: Column) -> Column:
    """A file as it stands in the formatted corpus."""
    return F.concat(F.lit("--- "), path, F.lit(" ---\n"), content, F.lit("\n\n"))


#: Redaction rules in order: API keys, tokens, bearer headers (any case), keys that start with sk-.
REDACTIONS = (
    (r"(api[_-]?key\s*[:=]\s*)[\"']?[A-Za-z0-9_\-]{8,}[\"']?", "$1[REDACTED]"),
    (r"(token\s*[:=]\s*)[\"']?[A-Za-z0-9_\-\.]{8,}[\"']?", "$1[REDACTED]"),
    (r"(?i)(bearer\s+)[A-Za-z0-9_\-\.]{8,}", "$1[REDACTED]"),
    (r"sk-[A-Za-z0-9_\-]{8,}", "[REDACTED]"),
)


def redacted(text: Column) -> Column:
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def size_text(size: Column) -> Column:
    """B, KB or MB with one decimal."""
    return (
        F.when(size >= 1024 * 1024, F.format_string("%.1f MB", F.bround(size / (1024.0 * 1024.0), 1)))
        .when(size >= 1024, F.format_string("%.1f KB", F.bround(size / 1024.0, 1)))
        .otherwise(F.format_string("%d B", size.cast("long")))
    )


def duration_text(milliseconds: Column) -> Column:
    """Seconds with one decimal (half a tenth counts up), with minutes before them from a minute on."""
    tenths = F.floor((milliseconds + 50) / 100).cast("long")
    seconds = lambda t: F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit("s"))
    return F.when(tenths >= 600, F.concat(F.floor(tenths / 600).cast("string"), F.lit("m "), seconds(tenths % 600))).otherwise(seconds(tenths))


def fence_unbalanced(text: Column) -> Column:
    return F.regexp_count(text, F.lit("```")) % 2 == 1
