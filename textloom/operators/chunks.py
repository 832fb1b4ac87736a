"""Splitting texts into overlapping chunks of bounded token counts, in closed form.

With chunk size C, overlap O and step E = C - O, a text of n tokens is one chunk if n <= C, else ceil(n / E) chunks: the first is
[0, C), chunk i is [i * E - O, (i + 1) * E). The first two share twice the overlap.

``chunked`` cuts single texts by characters. ``token_chunks`` cuts whole corpora by tokens and never holds one in a cell: files get
their place from prefix sums of their sizes, and a chunk is put together from the parts of files that lie in its window. Its count is that
of its own text, and it ends with the last character that fits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.text import corpus_entry

LEAST_SIZE = 1000
#: Files whose sums are summed first.
RUN = 4096


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 100_000
    overlap: int | None = None

    def __post_init__(self) -> None:
        if self.size < LEAST_SIZE:
            raise ValueError(f"chunk size {self.size} is under {LEAST_SIZE}")
        if self.shared >= self.size:
            raise ValueError(f"overlap {self.shared} is not under the chunk size {self.size}")
        if 2 * self.shared > self.size:
            raise ValueError(f"overlap {self.shared} is over half the chunk size {self.size}")

    @property
    def shared(self) -> int:
        return self.size // 10 if self.overlap is None else self.overlap


def windows(n: Column, config: ChunkConfig) -> Column:
    """Array of (chunk_id, start, end) over ``n`` positions; an empty text is one empty chunk."""
    size, overlap = F.lit(config.size).cast("long"), F.lit(config.shared).cast("long")
    step = size - overlap
    count = F.when(n <= size, F.lit(1).cast("long")).otherwise(F.ceil(n / step).cast("long"))
    return F.transform(
        F.sequence(F.lit(0).cast("long"), count - 1),
        lambda i: F.struct(
            i.cast("int").alias("chunk_id"),
            F.when(i == 0, F.lit(0).cast("long")).otherwise(i * step - overlap).alias("start"),
            F.when(i == 0, F.least(n, size)).otherwise(F.least(n, (i + 1) * step)).alias("end"),
        ),
    )


def chunked(texts: DataFrame, key: str, content: str, config: ChunkConfig, newline_within: int = 0) -> DataFrame:
    """key, chunk_id, start, end, content, token_count, overlap_token_count, one token a character. Rows carry their part of a text only.

    With ``newline_within`` a chunk that ends inside the text ends after the last newline of its final so many characters, if there
    is one; the next chunk's overlap still covers what was given up, provided that it is no longer than the overlap.
    """
    if newline_within > config.shared:
        raise ValueError("a newline snap beyond the overlap would leave a gap")
    n = F.char_length(content).cast("long")

    def part(w: Column) -> Column:
        end = w["end"]
        if newline_within:
            lo = F.greatest(end - newline_within, w["start"])
            back = F.locate("\n", F.reverse(F.substring(content, lo + 1, end - lo)))
            end = F.when((end < n) & (back > 0), end - back + 1).otherwise(end).cast("long")
        return F.struct(w["chunk_id"].alias("chunk_id"), w["start"].alias("start"), end.alias("end"), F.substring(content, w["start"].cast("int") + 1, (end - w["start"]).cast("int")).alias("content"))

    out = texts.select(key, F.explode(F.transform(windows(n, config), part)).alias("w")).select(key, "w.*")
    overlap = F.when(F.col("chunk_id") == 0, F.lit(0)).otherwise(F.least(F.lit(config.shared), F.col("end") - F.col("start"))).cast("long")
    return out.select(key, "chunk_id", "start", "end", "content", (F.col("end") - F.col("start")).alias("token_count"), overlap.alias("overlap_token_count"))


def prefix_sums(totals: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, order, before, all: the sum of ``value`` over a key's rows of a smaller (whole, unique) ``order``, and over all of them.

    Runs of ``RUN`` order values are summed first, so that a key of very many rows is one task's only as a row for each run.
    """
    rows = totals.withColumn("run", F.floor(F.col(order) / RUN))
    runs = rows.groupBy(key, "run").agg(F.sum(value).alias("held"))
    whole = Window.partitionBy(key)
    runs = runs.select(key, "run", (F.sum("held").over(whole.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).alias("base"), F.sum("held").over(whole).alias("all"))
    inside = F.sum(value).over(Window.partitionBy(key, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return rows.select(key, "run", order, inside.alias("inside")).join(runs, [key, "run"]).select(key, order, (F.col("base") + F.col("inside")).cast("long").alias("before"), F.col("all").cast("long").alias("all"))


def _floor(raw: Column, at: Column) -> Column:
    """The last start of a character up to byte ``at`` of UTF-8 text."""
    inside = lambda p: F.hex(F.substr(raw, p + 1, F.lit(1))).between("80", "BF")
    return F.when(~inside(at), at).when(~inside(at - 1), at - 1).when(~inside(at - 2), at - 2).otherwise(at - 3)


def _windows(before: Column, n: Column, whole: Column, size: int, shared: int, step: int, slack: int) -> Column:
    """Numbers of the chunks whose window, and ``slack`` more, meets positions from ``before`` on, ``n`` of them."""
    start = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(i * step - shared)
    first, last = F.greatest(F.floor((before - size - slack) / step), F.lit(0)), F.floor((before + n + shared) / step)
    meets = lambda i: (start(i) < before + n) & (before < start(i) + size + slack) & ((i == 0) | ((whole > size) & (i * step < whole)))
    return F.filter(F.sequence(first, last), meets)


def _start(i: Column, step: int, shared: int) -> Column:
    return F.when(i == 0, F.lit(0).cast("long")).otherwise(i * step - shared)


def byte_chunks(files: DataFrame, key: str, order: str, entry: str, config: ChunkConfig) -> DataFrame:
    """``token_chunks`` for tokens of four bytes: two passes over the texts, one for their sizes."""
    size, shared = 4 * config.size, 4 * config.shared
    # Without overlap a chunk ends where the next begins, so windows are shorter by what a character may reach beyond.
    step = size - shared if shared else size - 3
    sizes = files.select(key, order, F.octet_length(entry).cast("long").alias("n")).where("n > 0")
    rows = files.select(key, order, F.col(entry).cast("binary").alias("raw")).join(prefix_sums(sizes, key, order, "n"), [key, order])
    n = F.octet_length("raw").cast("long")
    rows = rows.select("*", n.alias("n"), F.explode(_windows(F.col("before"), n, F.col("all"), size, shared, step, 3)).alias("chunk_id"))
    nominal = _start(F.col("chunk_id"), step, shared)
    rows = rows.withColumn("lo", F.greatest(nominal - F.col("before"), F.lit(0))).withColumn("hi", F.least(nominal + (size if shared else step) - F.col("before"), "n"))
    raw, lo, hi, n = (F.col(c) for c in ("raw", "lo", "hi", "n"))
    # The start moves on to a character, and so does the end where the next chunk begins there.
    ceiling = lambda at: F.when(at >= n, n).otherwise(F.when(_floor(raw, at) == at, at).otherwise(F.when(_floor(raw, at + 1) == at + 1, at + 1).when(_floor(raw, at + 2) == at + 2, at + 2).otherwise(at + 3)))
    rows = rows.withColumn("from", F.when(lo == 0, F.lit(0).cast("long")).otherwise(F.least(ceiling(lo), n)))
    to = F.when(hi >= n, n).otherwise(F.greatest(F.when(hi < 0, F.lit(0)).otherwise(_floor(raw, F.greatest(hi, F.lit(0))) if shared else ceiling(F.greatest(hi, F.lit(0)))), "from"))
    rows = rows.withColumn("to", to.cast("long"))
    part = lambda a, b: F.substr(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    # Up to three bytes more, in case the start moved on: whole characters of them.
    more = F.least(hi + 3, n)
    extra = F.when(more > F.col("to"), part(F.col("to"), F.greatest(F.when(more >= n, n).otherwise(_floor(raw, more)), F.col("to")))).otherwise("") if shared else F.lit("")
    rows = rows.select(key, "chunk_id", order, (F.col("before") + F.col("from")).alias("s"), part(F.col("from"), F.col("to")).alias("core"), extra.alias("extra"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c]), "")
    out = rows.groupBy(key, "chunk_id").agg(F.min(F.when(F.col("core") != "", F.col("s"))).alias("start"), joined("core").alias("core"), joined("extra").alias("extra"))
    left = size - F.octet_length("core")
    fits = F.when(F.octet_length("extra") <= left, F.col("extra"))
    for k in (3, 2, 1):
        fits = F.coalesce(fits, F.when(F.octet_length(F.substring("extra", 1, k)) <= left, F.substring("extra", 1, k)))
    out = out.withColumn("content", F.concat("core", F.coalesce(fits, F.lit("")))).where("content <> ''")
    length = F.octet_length("content").cast("long")
    out = out.withColumn("end", F.col("start") + length)
    # What lies before the chunk's own step is shared with the chunk before.
    before = F.when(F.col("chunk_id") == 0, F.lit(0)).otherwise(F.greatest(F.least(F.col("chunk_id") * step, "end") - F.col("start"), F.lit(0)))
    up = lambda b: F.floor((b + 3) / 4).cast("long")
    return out.select(key, F.col("chunk_id").cast("int").alias("chunk_id"), "start", "end", "content", up(length).alias("token_count"), (up(before) if shared else F.lit(0).cast("long")).alias("overlap_token_count"))


#: Tokens beyond a window that are put together with it, since a text's tokens aren't quite those of its files.
SLACK = 64


def tokenizer_chunks(files: DataFrame, key: str, order: str, entry: str, config: ChunkConfig, tokenizer: str, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``token_chunks`` for a tokenizer's tokens. Files are tokenised once for an index of token ends; a chunk is put together by it, with some tokens
    more, then counted itself and cut after the last token that fits. Where tokens of the cut text differ so much that the next
    chunk begins behind its end, what lies between is a chunk of its own."""
    size, shared = config.size, config.shared
    step = size - shared
    index = stage(tokens.indexed(files.select(key, order, F.col(entry).alias("entry")), key, order, tokenizer))
    rows = index.join(prefix_sums(index.select(key, order, "n").where("n > 0"), key, order, "n"), [key, order])
    n = F.col("n").cast("long")
    rows = rows.select("*", F.explode(_windows(F.col("before"), n, F.col("all"), size, shared, step, SLACK)).alias("chunk_id"))
    nominal = _start(F.col("chunk_id"), step, shared)
    after = F.col("chunk_id") * step + step - shared  # where the next one starts
    at = lambda p: F.when(p - F.col("before") <= 0, F.lit(0)).when(p - F.col("before") >= n, F.char_length("entry")).otherwise(F.element_at("begins", (p - F.col("before") + 1).cast("int")))
    rows = rows.withColumn("lo", at(nominal)).withColumn("hi", at(nominal + size + SLACK)).withColumn("next", F.when(after < F.col("all"), at(after)).otherwise(F.col("hi")))
    rows = rows.select(key, "chunk_id", order, F.substr("entry", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("part"), F.greatest(F.least("next", "hi") - F.col("lo"), F.lit(0)).alias("must"), F.greatest(F.least(at(F.col("chunk_id") * step), "hi") - F.col("lo"), F.lit(0)).alias("own"), (F.col("chunk_id") * step + step - shared >= F.col("all")).alias("last"), F.greatest(nominal, "before").alias("start"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "part"))), lambda x: x["part"]), "")
    grouped = rows.groupBy(key, "chunk_id").agg(F.min("start").alias("start"), joined.alias("content"), F.sum("must").alias("must"), F.sum("own").alias("own"), F.max("last").alias("last"))
    cut = tokens.cut(grouped, key, tokenizer, size)
    place = F.row_number().over(Window.partitionBy(key).orderBy("chunk_id", "sub")) - 1
    return cut.select(key, place.cast("int").alias("chunk_id"), "start", (F.col("start") + F.col("token_count")).alias("end"), "content", "token_count", "overlap_token_count")


def token_chunks(files: DataFrame, key: str, order: str, entry: str, config: ChunkConfig, tokenizer: str | None = None, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """key, chunk_id, start, end, content, token_count, overlap_token_count of the corpora that files (key, order, entry) make.

    Tokens are estimated, four bytes each and the last one rounded up, or those of a ``tokenizer`` file. ``token_count`` is the count of the chunk's own
    content and never over the size; with the estimate, one character more would be too many, but for a corpus's last chunk and chunks without
    overlap. Positions are bytes, or tokens with a tokenizer. Nothing is left out; empty entries have no chunk. ``stage`` may write and reread the
    tokenizer's index, which is used twice.
    """
    if tokenizer is None:
        return byte_chunks(files, key, order, entry, config)
    return tokenizer_chunks(files, key, order, entry, config, tokenizer, stage)


def text_chunks(texts: DataFrame, key: str, content: str, size: int, tokenizer: str | None = None, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``token_chunks`` of single texts (key, content), each a corpus of one file named "content", with the overlap that goes with ``size``."""
    files = texts.select(key, F.lit(0).alias("ord"), corpus_entry(F.lit("content"), F.coalesce(content, F.lit(""))).alias("entry"))
    return token_chunks(files, key, "ord", "entry", ChunkConfig(size), tokenizer, stage)
