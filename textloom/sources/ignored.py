"""Ignore rules as tables: which paths the ignore files of their folders leave out.

A rule belongs to the folder of its file and concerns what lies below. Every path and every folder above it is a node; a node meets the rules of
the folders above it by equality, and the last rule that matches it decides: that of the deepest folder, then of the last line. What lies in an ignored
folder is ignored whatever rules say of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wildcards, longest first, by a mark that no line has, and what they mean. ``*`` stays within a name.
_WILD = (("**/", "\x01", "(?:.*/)?"), ("/**", "\x02", "/.*"), ("**", "\x03", ".*"), ("*", "\x04", "[^/]*"), ("?", "\x05", "[^/]"))


def pattern(line: Column, folder: Column) -> Column:
    """The regular expression of a line without ``!`` and trailing ``/``, over whole paths, for a file that lies in ``folder`` ("" is the root)."""
    body = F.regexp_replace(line, "^/", "")
    for wild, mark, _ in _WILD:
        body = F.replace(body, F.lit(wild), F.lit(mark))
    # Sets keep their brackets; all else that has a meaning in an expression loses it.
    body = F.regexp_replace(body, r"\\(.)", "$1")
    body = F.regexp_replace(body, r"([.+^$(){}|\\])", r"\\$1")
    body = F.regexp_replace(body, r"\[!", "[^")
    for _, mark, meaning in _WILD:
        body = F.replace(body, F.lit(mark), F.lit(meaning))
    prefix = F.when(folder == "", "").otherwise(F.concat(F.regexp_replace(folder, r"([.+^$(){}|\\\[\]*?])", r"\\$1"), F.lit("/")))
    return F.concat(F.lit("^"), prefix, F.when(line.contains("/"), "").otherwise("(?:.*/)?"), body, F.lit(r"\z"))


def rules(files: DataFrame) -> DataFrame:
    """folder, line_no, pattern, keep, directory of the lines of ignore files (folder, content). Blank lines and comments are none."""
    lines = files.select("folder", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line"))
    line = F.when(F.col("line").endswith("\\ "), F.col("line")).otherwise(F.rtrim("line"))
    lines = lines.withColumn("line", line).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    keep = F.col("line").startswith("!")
    lines = lines.select("folder", "line_no", keep.alias("keep"), F.regexp_replace("line", r"^(!|\\(?=[#!]))", "").alias("line"))
    return lines.select("folder", "line_no", pattern(F.regexp_replace("line", "/+$", ""), F.col("folder")).alias("pattern"), "keep", F.col("line").endswith("/").alias("directory"))


def _above(path: Column) -> Column:
    """The folders above a path, the root included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct paths (path) that are ignored. Work is a row for each folder above a path and each rule of these folders."""
    every = paths.select("path").where("path <> ''").distinct()
    up = every.select("path", F.explode(F.array_append(F.filter(_above(F.col("path")), lambda f: f != ""), F.col("path"))).alias("node"))
    nodes = up.groupBy("node").agg(F.min(F.col("node") == F.col("path")).alias("file"))
    met = nodes.select("node", "file", F.explode(_above(F.col("node"))).alias("folder")).join(rules, "folder")
    met = met.where((~F.col("file") | ~F.col("directory")) & F.expr("node rlike pattern"))
    last = F.max_by("keep", F.struct(F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/"))), "line_no"))
    out = met.groupBy("node").agg(last.alias("keep")).where("not keep").select("node")
    return up.join(out, "node").select("path").distinct()


def kept(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``paths`` (path and others) that no rule leaves out."""
    return paths.join(ignored(paths, rules), "path", "left_anti")
