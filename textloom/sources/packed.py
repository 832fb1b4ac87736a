"""Packed corpora: Markdown, XML and JSON files that hold many files, parsed inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import packed_format

_FENCE = r"(?s)## File: ([^\n]+)\n+```[^\n]*\n(.*?)```"
_FILE = "array<struct<path:string,content:string>>"


def markdown_files(text: Column) -> Column:
    """Sections "## File: path" with a fenced body. A body ends at the first closing fence."""
    paths, bodies = (F.regexp_extract_all(text, F.lit(_FENCE), F.lit(i)) for i in (1, 2))
    return F.zip_with(paths, bodies, lambda p, b: F.struct(F.trim(p).alias("path"), b.alias("content")))


def xml_files(text: Column) -> Column:
    """<file path=...> elements; entities and CDATA are decoded. A file without a path makes the whole invalid (null)."""
    inner = F.from_xml(F.concat(F.lit("<root>"), F.regexp_replace(text, r"<\?xml[^>]*\?>", ""), F.lit("</root>")), "file ARRAY<STRUCT<_path:STRING,_VALUE:STRING>>, files STRUCT<file:ARRAY<STRUCT<_path:STRING,_VALUE:STRING>>>", {"ignoreSurroundingSpaces": "false"})
    found = F.coalesce(inner["file"], inner["files"]["file"])
    out = F.transform(found, lambda x: F.struct(x["_path"].alias("path"), F.coalesce(x["_VALUE"], F.lit("")).alias("content")))
    return F.when(~F.exists(out, lambda x: x["path"].isNull()), out)


def json_files(text: Column) -> Column:
    """Either an array of {path, content} or {"files": {path: content}}; files of a map are sorted by path. Anything else is null."""
    array = F.from_json(text, _FILE)
    table = F.from_json(text, "files map<string,string>")["files"]
    mapped = F.transform(F.array_sort(F.map_entries(table)), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("content")))
    return F.when(F.ltrim(text).startswith("["), F.when(~F.exists(array, lambda x: x["path"].isNull()), array)).otherwise(mapped)


def parsed(packs: DataFrame) -> DataFrame:
    """Packs (path, content) -> (pack, ord, path, content). A pack that is of no known kind, invalid or empty gives one raw row."""
    kind = packed_format(F.col("path"), F.col("content"))
    found = F.when(kind == "xml", xml_files(F.col("content"))).when(kind == "json", json_files(F.col("content"))).when(kind == "markdown", markdown_files(F.col("content")))
    raw = F.array(F.struct(F.col("path"), F.col("content")))
    rows = packs.select(F.col("path").alias("pack"), F.posexplode(F.when(F.size(found) > 0, found).otherwise(raw)).alias("ord", "f"))
    return rows.select("pack", "ord", "f.path", "f.content")


def read(spark: SparkSession, path: str) -> DataFrame:
    packs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return parsed(packs)
