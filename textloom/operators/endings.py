"""Which names end with which others, without making a row of every end.

Read backwards, an end is a beginning, and whatever begins with a string stands right behind it in sorted order. So both tables are sorted once by
their reversed text, dealt to ranges, and read in order with a stack of the strings that the current one begins with. A string of an
earlier range that is open at a border begins that range's lower bound; bounds are few, so their beginnings are looked up and put at the
head of their range. Every string moves once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings of the sample that bounds are taken from, for each range.
SAMPLED = 32
HELD, NAME = 0, 1


def _bounds(strings: DataFrame, ranges: int) -> list[str]:
    """Lower bounds of the ranges but the first, from a bounded sample by hash."""
    sample = sorted(r["text"] for r in strings.select("text").orderBy(F.xxhash64("text"), "text").limit(SAMPLED * ranges).collect())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)} if len(sample) >= ranges else set())


def _numbered(bounds: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        part = [bisect_right(bounds, t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("text"), b.column("kind"), pa.array(part, pa.int32())], names=["text", "kind", "part"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, text) in; the names out that begin with a held string or begin one, as far as this range can tell."""
    part = None
    open_: list[str] = []  # strings that the current one begins with
    held: list[bool] = []  # whether it or one below it is held
    waiting: list[str] = []  # open names that no held string has met
    for b in batches:
        found: list[str] = []
        for here, text, kind in zip(*(b.column(c).to_pylist() for c in ("part", "text", "kind")), strict=True):
            if here != part:
                part, open_, held, waiting = here, [], [], []
            while open_ and not text.startswith(open_[-1]):
                gone = open_.pop()
                held.pop()
                if waiting and waiting[-1] == gone:
                    waiting.pop()
            if kind == HELD:
                found += waiting
                waiting = []
            elif held and held[-1]:
                found.append(text)
            else:
                waiting.append(text)
            open_.append(text)
            held.append(kind == HELD or bool(held) and held[-1])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["text"])


def met(names: DataFrame, held: DataFrame, name: str, path: str, ranges: int | None = None) -> DataFrame:
    """The distinct ``name`` of ``names`` that equal a ``path`` of ``held``, end with one or are the end of one. Empty and null strings meet nothing."""
    spark = names.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    side = lambda df, c, kind: df.where(f"{c} <> ''").select(F.reverse(c).alias("text"), F.lit(kind).alias("kind")).distinct()
    strings = side(names, name, NAME).unionByName(side(held, path, HELD))
    bounds = _bounds(strings, ranges)
    rows = strings.mapInArrow(partial(_numbered, bounds), "text string, kind int, part int")
    if bounds:
        begins = spark.createDataFrame([(b[:n], i) for i, b in enumerate(bounds, 1) for n in range(1, len(b))], "text string, part int")
        # Some beginnings of at most ``ranges`` strings, all smaller than the bound and so of earlier ranges.
        rows = rows.unionByName(strings.join(F.broadcast(begins), "text").select("text", "kind", "part"))
    rows = rows.repartition("part").sortWithinPartitions("part", "text", "kind")
    return rows.mapInArrow(_met, "text string").distinct().select(F.reverse("text").alias(name))
