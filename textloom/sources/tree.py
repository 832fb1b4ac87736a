"""A source tree as a DataFrame, by a Python data source: hidden files included, ignore rules honoured, links not followed.

    register(spark)
    spark.read.format("tree").option("include", "*.py,*.md").load("/path/of/tree").where("language = 'python' and size < 100000")

Filters on path, size and language are pushed down: files that they leave out are never opened, and with the option content=false none is.

The driver lists directories and prunes ignored ones; executors read the files of their share. The tree must be a path that all of
them see. Options: include, exclude (globs over relative paths, separated by commas outside braces), on_invalid (for files that aren't
UTF-8: quarantine, the default, gives null content; or fail), on_error (for folders that can't be listed: warn, the default, goes on
without them; or fail, at the first one), on_unreadable (for files that were listed and can't be read, which is every file of a task that
doesn't see the tree: fail, the default; or quarantine, which gives null content).
"""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

from ..functions.paths import LANGUAGES, glob_regex

SCHEMA = "ord long, path string, size long, language string, content string"
SHARE_BYTES = 64 << 20
#: Folders that are never entered: version control and a run's own working folder.
NEVER = (".git", ".textloom")
log = logging.getLogger(__name__)


def split_globs(text: str) -> list[str]:
    """Globs of a list separated by commas; a comma inside braces belongs to its glob."""
    return [g.strip() for g in re.split(r",(?![^{}]*\})", text) if g.strip()]


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    keep: bool
    directory: bool


def ignore_rules(text: str, base: str = "") -> list[Rule]:
    """Rules of an ignore file that lies in ``base`` (a relative directory), in order; the last that matches decides."""
    out = []
    for line in text.splitlines():
        line = line.rstrip() if not line.endswith("\\ ") else line
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line.removeprefix("\\")
        directory = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = "".join({"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t) or (re.sub(r"^\[!", "[^", t) if t.startswith("[") else re.escape(t)) for t in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]+\]|\\.|[^*?\[/\\]+|/|\[", line.lstrip("/")))
        prefix = re.escape(base + "/") if base else ""
        out.append(Rule(re.compile(prefix + ("" if anchored else "(?:.*/)?") + body + r"\Z"), keep, directory))
    return out


def ignored(path: str, is_directory: bool, rules: list[Rule]) -> bool:
    for r in reversed(rules):
        if (is_directory or not r.directory) and r.pattern.match(path):
            return not r.keep
    return False


def walk(root: str, include: list[str] = (), exclude: list[str] = (), fail: bool = False) -> Iterator[tuple[str, int]]:
    """(relative path, size) of the files that stay, in path order. Those of ``NEVER`` are not entered. What can't be listed below the
    root is left out with a warning, or ends the walk (``fail``)."""
    inc, exc = ([re.compile(glob_regex(g) + r"\Z") for g in globs] for globs in (include, exclude))

    def listed(directory: str) -> list[os.DirEntry]:
        try:
            return sorted(os.scandir(os.path.join(root, directory)), key=lambda e: e.name)
        except OSError as e:
            if fail or not directory:
                raise
            log.warning("left out: %s", e)
            return []

    def below(directory: str, rules: list[Rule]) -> Iterator[tuple[str, int]]:
        own = os.path.join(root, directory, ".gitignore")
        if os.path.isfile(own):
            with open(own, encoding="utf-8", errors="replace") as f:
                rules = rules + ignore_rules(f.read(), directory)
        for entry in listed(directory):
            path = f"{directory}/{entry.name}" if directory else entry.name
            if entry.is_symlink() or entry.name in NEVER:
                continue
            if entry.is_dir():
                if not ignored(path, True, rules):
                    yield from below(path, rules)
            elif entry.is_file() and not ignored(path, False, rules):
                if (not inc or any(g.match(path) for g in inc)) and not any(g.match(path) for g in exc):
                    yield path, entry.stat().st_size

    yield from below("", [])


def language_of(path: str) -> str | None:
    m = re.search(r"[^/]\.([^./]+)$", path)
    return LANGUAGES.get(m[1]) if m else None


#: What a pushed filter asks of a value that isn't null.
_ASKS = {
    EqualTo: lambda v, f: v == f.value, EqualNullSafe: lambda v, f: v == f.value, In: lambda v, f: v in f.value, GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value, StringStartsWith: lambda v, f: v.startswith(f.value), StringEndsWith: lambda v, f: v.endswith(f.value), StringContains: lambda v, f: f.value in v,
    IsNotNull: lambda v, f: True,
}


def understood(f: Filter) -> bool:
    """Whether the walk can answer a filter: one of a column that it knows."""
    if isinstance(f, Not):
        return understood(f.child)
    return isinstance(f, (IsNull, *_ASKS)) and tuple(f.attribute) in (("path",), ("size",), ("language",))


def passes(f: Filter, values: dict) -> bool | None:
    """What a filter says of a file; None where SQL's answer is unknown."""
    if isinstance(f, Not):
        inner = passes(f.child, values)
        return None if inner is None else not inner
    value = values[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if value is None:
        return f.value is None if isinstance(f, EqualNullSafe) else False if isinstance(f, IsNotNull) else None
    return _ASKS[type(f)](value, f)


@dataclass
class Share(InputPartition):
    files: list[tuple[int, str, int]]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].removeprefix("file://")
        self.include, self.exclude = (split_globs(options.get(k, "")) for k in ("include", "exclude"))
        self.fail = options.get("on_invalid", "quarantine") == "fail"
        self.opens = options.get("content", "true").lower() != "false"
        self.filters: list[Filter] = []
        self.abort = options.get("on_error", "warn") == "fail"
        self.unreadable = options.get("on_unreadable", "fail")
        if self.unreadable not in ("fail", "quarantine"):
            raise ValueError("on_unreadable is fail or quarantine")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if understood(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Share]:
        shares, size = [Share([])], 0
        for i, (path, n) in enumerate(walk(self.root, self.include, self.exclude, self.abort)):
            values = {"path": path, "size": n, "language": language_of(path)}
            if not all(passes(f, values) for f in self.filters):
                continue
            if size + n > SHARE_BYTES and shares[-1].files:
                shares.append(Share([]))
                size = 0
            shares[-1].files.append((i, path, n))
            size += n
        return shares

    def read(self, partition: Share) -> Iterator[tuple]:
        for i, path, n in partition.files:
            content = None
            if not self.opens:
                yield i, path, n, language_of(path), None
                continue
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    content = f.read().decode("utf-8")
            except UnicodeDecodeError:
                if self.fail:
                    raise
            except OSError as e:
                if self.unreadable == "fail":
                    raise
                log.warning("no content: %s", e)
            yield i, path, n, language_of(path), content


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:  # noqa: ANN001
        return TreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
