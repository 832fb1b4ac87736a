"""Packed corpora read in byte ranges: one pack is many tasks' work, and no cell is larger than a file of it.

What a byte means depends on what came before: it may be inside a fence, a CDATA section or a string. So ranges are read three times. First each
says, for every state in which it may begin, in which one it ends; folding these in order gives the state at the start of each range. Then each range counts the files that
begin in it, reading on behind its end for the last one, and says whether all are valid; these counts give every file's place in its pack. At last each range gives its
files. So what is shuffled or staged is a few numbers for each range, and no text.

    Markdown  0 text, 1 after a file's heading, 2 in its fence; ranges are moved to the next line
    XML       0 elements and text, 1 CDATA, 2 comment
    JSON      0 outside, 1 inside a string; and how deep it is nested

Paths are opened by workers with pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import packed_format

RANGE = 32 << 20
#: Bytes that are read on behind a range at first; twice as many each time.
MORE = 1 << 16
STATES = 3
_HEADING = re.compile(rb"## File: ([^\n]+)\n+```[^\n]*\n")
_OPEN_HEADING = re.compile(rb"## File: [^\n]+\n+\Z")
_FENCE_AFTER = re.compile(rb"\n*```[^\n]*\n")
_MARKUP = re.compile(rb"<!\[CDATA\[|<!--|<file(?=[\s/>])")
_CLOSERS = {1: b"]]>", 2: b"-->"}
_EDGE = re.compile(rb"<!\[CDATA\[|<!--|</file\s*>")
_TAG = re.compile(rb"<file((?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>")
_STRING_REST = re.compile(rb"[^\"\\]*(?:\\.[^\"\\]*)*\"", re.DOTALL)
_TOKEN = re.compile(rb"\"[^\"\\]*(?:\\.[^\"\\]*)*\"|[{}\[\],:]", re.DOTALL)
_BETWEEN = re.compile(rb"[^\"{}\[\],:]*")
_KEY_END = re.compile(rb"\s*:\s*")


class Span:
    """The bytes of a file from ``start`` on: first those up to ``end``, more when they are asked for."""

    def __init__(self, file: pa.NativeFile, start: int, end: int, size: int) -> None:
        self.file, self.start, self.size = file, start, size
        self.limit = min(end, size) - start
        self.data, self.step = b"", MORE
        self._read(self.limit)

    def _read(self, n: int) -> None:
        self.file.seek(self.start + len(self.data))
        self.data += self.file.read(n)

    def more(self) -> bool:
        if self.start + len(self.data) >= self.size:
            return False
        self._read(self.step)
        self.step *= 2
        return True

    def found(self, look: Callable[[bytes], object]) -> object:
        """What ``look`` finds in the bytes, of which more are read until it does."""
        while not (hit := look(self.data)) and self.more():
            pass
        return hit


def _opened(path: str) -> pa.NativeFile:
    system, name = pyarrow.fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:"))
    return system.open_input_file(name)


def _line_start(file: pa.NativeFile, at: int, size: int) -> int:
    """The first start of a line from ``at`` on."""
    if at == 0 or at >= size:
        return min(at, size)
    file.seek(at - 1)
    place = at - 1
    while block := file.read(1 << 16):
        if (i := block.find(b"\n")) >= 0:
            return place + i + 1
        place += len(block)
    return size


def _span(file: pa.NativeFile, kind: str, start: int, end: int, size: int) -> Span:
    if kind == "markdown":
        start, end = _line_start(file, start, size), _line_start(file, end, size)
    return Span(file, start, end, size)


# --- the state at the end of a range


def _markdown_end(data: bytes, state: int) -> int:
    at = 0
    if state == 1:
        if m := _FENCE_AFTER.match(data):
            at, state = m.end(), 2
        elif data.strip(b"\n"):
            state = 0
        else:
            return 1
    while True:
        if state == 2:
            if (i := data.find(b"```", at)) < 0:
                return 2
            at, state = i + 3, 0
        if not (m := _HEADING.search(data, at)):
            return 1 if _OPEN_HEADING.search(data, max(at, data.rfind(b"## File: "))) else 0
        at, state = m.end(), 2


def _xml_end(data: bytes, limit: int, state: int) -> int:
    """``data`` goes some bytes beyond ``limit``, so that what begins before it is seen whole."""
    at = 0
    while True:
        if state:
            if not 0 <= (i := data.find(_CLOSERS[state], at)) < limit:
                return state
            at, state = i + 3, 0
        m = _MARKUP.search(data, at)
        if not m or m.start() >= limit:
            return 0
        at = m.end()
        state = 1 if m[0].startswith(b"<![") else 2 if m[0] == b"<!--" else 0


def _escaped(file: pa.NativeFile, start: int) -> bool:
    """Whether the byte at ``start`` comes after an odd number of backslashes."""
    n, at = 0, start
    while at:
        step = min(at, 1024)
        file.seek(at - step)
        block = file.read(step)
        run = len(block) - len(block.rstrip(b"\\"))
        n += run
        if run < step:
            break
        at -= step
    return n % 2 == 1


def _json_end(data: bytes) -> tuple[int, tuple[int, int]]:
    """Quotes that begin or end a string, and how much deeper it gets outside of strings if the range begins outside or inside of one."""
    parts = re.sub(rb"\\.", b"", data, flags=re.DOTALL).split(b'"')
    deeper = lambda text: text.count(b"{") + text.count(b"[") - text.count(b"}") - text.count(b"]")
    return len(parts) - 1, (deeper(b"".join(parts[::2])), deeper(b"".join(parts[1::2])))


_SCANNED = "pack string, size long, i long, start long, end long, kind string, marks int, ends array<long>, deeper array<long>"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges in. ``marks``: 1 if something like an XML file, 2 if a Markdown heading begins in it, 4 if its first character is JSON's. For a pack of
    unknown kind there is a row for each kind that it may be."""
    for b in batches:
        out = []
        for r in b.itertuples():
            with _opened(r.pack) as file:
                for kind in [r.kind] if r.kind else ["xml", "json", "markdown"]:
                    span = _span(file, kind, r.start, r.end, r.size)
                    limit = max(0, span.limit)
                    marks, deeper = 0, (0, 0)
                    if kind == "markdown":
                        data = span.data
                        marks, ends = 2 * (b"## File:" in data), [_markdown_end(data, s) if data else s for s in range(STATES)]
                    elif kind == "xml":
                        span._read(16)
                        marks, ends = 1 * (b"<file path=" in span.data), [_xml_end(span.data, limit, s) for s in range(STATES)]
                    else:
                        data = span.data[1:] if _escaped(file, span.start) else span.data
                        quotes, deeper = _json_end(data)
                        marks, ends = 4 * (r.i == 0 and span.data.lstrip()[:1] in (b"{", b"[")), [quotes % 2, 1 - quotes % 2]
                    out.append((r.pack, r.size, r.i, r.start, r.end, kind, marks, list(map(int, ends)), list(map(int, deeper))))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCANNED.split(", ")])


_PLACED = "pack string, size long, i long, start long, end long, kind string, state long, depth long"


def _folded(rows: pd.DataFrame) -> pd.DataFrame:
    """The ranges of one pack with the state that each begins in: a few numbers for each range. A pack of no known kind has none."""
    marks = {k: 0 for k in ("xml", "json", "markdown")} | rows.groupby("kind")["marks"].max().to_dict()
    kinds = set(rows["kind"])
    kind = next(iter(kinds)) if len(kinds) == 1 else next((k for k in ("xml", "json", "markdown") if marks[k]), None)
    out, state, depth = [], 0, 0
    for r in rows[rows["kind"] == kind].sort_values("i").itertuples():
        out.append((r.pack, r.size, r.i, r.start, r.end, kind, state, depth))
        depth += int(r.deeper[state]) if kind == "json" else 0
        state = int(r.ends[state])
    return pd.DataFrame(out, columns=[c.split()[0] for c in _PLACED.split(", ")])


# --- the files of a range


def _markdown_files(span: Span, state: int) -> Iterator[tuple[int, str | None, str | None]]:
    at = 0
    if state == 1:
        m = span.found(_FENCE_AFTER.match) if not span.data.strip(b"\n") else _FENCE_AFTER.match(span.data)
        at, state = (m.end(), 2) if m else (0, 0)
    if state == 2:
        i = span.data.find(b"```", at)
        if i < 0:
            return
        at = i + 3
    while True:
        m = _HEADING.search(span.data, at)
        if not m:  # a heading whose fence is behind the end
            last = _OPEN_HEADING.search(span.data[: span.limit], max(at, span.data.rfind(b"## File: ", 0, span.limit)))
            m = last and span.found(lambda d, lo=last.start(): _HEADING.match(d, lo) or (len(d.rstrip(b"\n")) > span.limit + 3 and b"\n" in d[span.limit :].lstrip(b"\n")))
            m = m if isinstance(m, re.Match) else None
        if not m or m.start() >= span.limit:
            return
        end = span.found(lambda d, lo=m.end(): (d.find(b"```", lo) + 1)) - 1
        if end < 0:
            return
        yield span.start + m.start(), m[1].decode("utf-8", "replace").strip(), span.data[m.end() : end].decode("utf-8", "replace")
        at = end + 3


def _edge(at: int) -> Callable[[bytes], tuple[int, bool] | None]:
    """Where the next CDATA section, comment or end of a file ends, and whether it was the end. A section that isn't whole yet is none."""

    def look(data: bytes) -> tuple[int, bool] | None:
        m = _EDGE.search(data, at)
        if not m or m[0].startswith(b"</"):
            return m and (m.end(), True)
        i = data.find(_CLOSERS[1 if m[0] == b"<![CDATA[" else 2], m.end())
        return (i + 3, False) if i >= 0 else None

    return look


def _xml_files(span: Span, state: int) -> Iterator[tuple[int, str | None, str | None]]:
    at = 0
    while True:
        if state:
            i = span.found(lambda d, lo=at, s=state: d.find(_CLOSERS[s], lo) + 1) - 1
            if i < 0 or i >= span.limit:
                return
            at, state = i + 3, 0
        m = _MARKUP.search(span.data, at)
        if not m and len(span.data) <= span.limit + 16:
            span.more()
            m = _MARKUP.search(span.data, at)
        if not m or m.start() >= span.limit:
            return
        at = m.end()
        if m[0] != b"<file":
            state = 1 if m[0].startswith(b"<![") else 2
            continue
        lo = m.start()
        tag = span.found(lambda d, lo=lo: _TAG.match(d, lo))
        if not tag:
            yield span.start + lo, None, None
            return
        end = tag.end()
        closed = bool(tag[2])
        while not closed:
            edge = span.found(_edge(end))
            if not edge:
                yield span.start + lo, None, None
                return
            end, closed = edge
        try:
            element = ElementTree.fromstring(span.data[lo:end])
            yield span.start + lo, element.get("path"), "".join(element.itertext())
        except ElementTree.ParseError:
            yield span.start + lo, None, None
        at = end


def _token(at: int) -> Callable[[bytes], re.Match | None]:
    """The next token from ``at`` on; a string that isn't whole yet is none, and nothing in it is."""
    return lambda data: _TOKEN.match(data, _BETWEEN.match(data, at).end())


def _json_files(span: Span, state: int, depth: int, escaped: bool, array: bool) -> Iterator[tuple[int, str | None, str | None]]:
    at = int(escaped)
    if state:
        m = span.found(lambda d: _STRING_REST.match(d, at))
        if not m:
            return
        at = m.end()
    while True:
        m = span.found(_token(at))
        if not m or m.start() >= span.limit:
            return
        token, lo, at = m[0], m.start(), m.end()
        if token in (b"{", b"["):
            depth += 1
            if array and token == b"{" and depth == 2:  # one file
                while depth > 1:
                    m = span.found(_token(at))
                    if not m:
                        yield span.start + lo, None, None
                        return
                    at = m.end()
                    depth += (m[0] in (b"{", b"[")) - (m[0] in (b"}", b"]"))
                try:
                    value = json.loads(span.data[lo:at])
                except ValueError:
                    value = {}
                path, content = value.get("path"), value.get("content")
                yield span.start + lo, path if isinstance(path, str) else None, content if isinstance(content, str) or content is None else json.dumps(content)
        elif token in (b"}", b"]"):
            depth -= 1
        elif not array and depth == 2 and token[:1] == b'"':
            if not (colon := span.found(lambda d, p=at: (k := _KEY_END.match(d, p)) and k.end() < len(d) and k) if _KEY_END.match(span.data + b" :", at) else None):
                continue
            value = span.found(lambda d, p=colon.end(): _TOKEN.match(d, p))
            if value and value[0][:1] == b'"':
                at = value.end()
                try:
                    yield span.start + lo, json.loads(token), json.loads(value[0])
                except ValueError:
                    yield span.start + lo, None, None


def _files_in(r) -> Iterator[tuple[int, str | None, str | None]]:
    """(at, path, content) of the files that begin in a range whose state is known."""
    with _opened(r.pack) as file:
        span = _span(file, r.kind, r.start, r.end, r.size)
        if span.limit <= 0:
            return
        if r.kind == "json":
            file.seek(0)
            array = file.read(1 << 12).lstrip()[:1] == b"["
            yield from _json_files(span, r.state, r.depth, bool(r.state) and _escaped(file, span.start), array)
        else:
            yield from (_markdown_files if r.kind == "markdown" else _xml_files)(span, r.state)


_COUNTED = f"{_PLACED}, n long, bad boolean"


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        valid = [[path is not None for _, path, _ in _files_in(r)] for r in b.itertuples()]
        yield b.assign(n=[len(v) for v in valid], bad=[not all(v) for v in valid])


_FILES = "pack string, i long, at long, k int, path string, content string"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    made = lambda rows: pd.DataFrame(rows, columns=[c.split()[0] for c in _FILES.split(", ")])
    rows, held = [], 0  # of many ranges, since each table handed to Spark has its own cost
    for b in batches:
        for r in b.itertuples():
            for k, (at, path, content) in enumerate(_files_in(r)):
                rows.append((r.pack, r.i, at, k, path, content))
                held += len(content or "") + 100
                if held > 8 << 20:
                    yield made(rows)
                    rows, held = [], 0
    if rows:
        yield made(rows)


def _ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The files of ranges that say how many files of their pack come before them."""
    for b in batches:
        before = dict(zip(zip(b["pack"], b["i"], strict=True), b["before"], strict=True))
        for found in _parse(iter([b])):
            found["ord"] = found["k"] + [before[key] for key in zip(found["pack"], found["i"], strict=True)]
            yield found[["pack", "ord", "path", "content"]]


def ranges(packs: DataFrame, size: int = RANGE) -> DataFrame:
    """(pack, size, kind, i, start, end) of packs (path, length); the kind by the name, null if it says nothing."""
    kind = packed_format(F.col("path"), F.lit(""))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("length") - 1) / size))))
    out = packs.select(F.col("path").alias("pack"), F.col("length").alias("size"), F.when(kind != "unknown", kind).alias("kind"), parts.alias("i"))
    return out.withColumn("start", F.col("i") * size).withColumn("end", F.least("size", (F.col("i") + 1) * size))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Ranges dealt by number: one is a few bytes here however long it is there, so Spark would put thousands of them into one task."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys)


def placed(packs: DataFrame, size: int = RANGE) -> DataFrame:
    """The ranges of packs (path, length) with the state that each begins in."""
    scanned = spread(ranges(packs, size), "pack", "i").mapInPandas(_scan, _SCANNED)
    return spread(spread(scanned, "pack").groupBy("pack").applyInPandas(_folded, _PLACED), "pack", "i")


def files(packs: DataFrame, size: int = RANGE) -> DataFrame:
    """(pack, i, at, k, path, content) of packs (path, length): the files of all ranges; ``at`` is the byte where a file begins, ``k`` its number in the range. One that
    can't be read has no path."""
    return placed(packs, size).mapInPandas(_parse, _FILES)


def places(counted: DataFrame) -> DataFrame:
    """The ranges that hold files of a pack without an invalid one, and how many of its files come ``before`` each. Only counts of ranges are put in order
    over a pack."""
    pack = Window.partitionBy("pack")
    before = counted.withColumn("before", F.sum("n").over(pack.orderBy("i")) - F.col("n")).withColumn("bad", F.max("bad").over(pack))
    return before.where("n > 0 and not bad").drop("n", "bad")


def read(spark: SparkSession, path: str, size: int = RANGE, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(pack, ord, path, content) of the packs at ``path``, in the order of each pack. One that is of no known kind, invalid or empty gives one row, its whole text.

    ``stage`` may write and reread the ranges with their counts, which are used twice: a row of numbers for each. In the map form of JSON no member but ``files`` may be
    an object.
    """
    packs = spark.read.format("binaryFile").load(path).select("path", "length")
    held = places(stage(placed(packs, size).mapInPandas(_count, _COUNTED)))
    good = held.select("pack").distinct()
    raw = [r["path"] for r in packs.join(good, packs["path"] == good["pack"], "left_anti").select("path").collect()]  # a name for each pack that can't be read
    out = spread(held, "pack", "i").mapInPandas(_ordered, "pack string, ord int, path string, content string")
    if raw:
        whole = spark.read.text(raw, wholetext=True).select(F.col("_metadata.file_path").alias("pack"), F.lit(0).alias("ord"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
        out = out.unionByName(whole)
    return out
