"""Validation of rendered formats in three layers, as tables of findings (format, severity, layer, message, location).

A format's name may be followed by a colon and a project: "cursor:12" is the cursor format of project 12. So the rules of many
projects are validated at once; what compares formats with each other compares those of one project.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import REALITY
from ..functions.text import fence_unbalanced
from ..workspace import dealt, staged
from . import endings

#: A path in prose: after a start, blank, backtick or quote and before one of those or punctuation. Both ends are consumed.
PATH = r"(?:^|[\s`\"'])([A-Za-z0-9_./-]+\.[A-Za-z0-9]+)(?:[\s`\"',;:)]|\z)"
PLAIN = ("copilot", "windsurf", "aider", "generic")
#: Kinds of formats that there are rules for; another kind is an error.
KINDS = ("cursor", "claude", *PLAIN, "json")
CROSS = "cross-format"

FINDING = "format string, severity string, layer string, message string, location string"

# How conventions are worded (first group: the number, if there is one).
TABS, SPACES = r"(?i)\buse\s+tabs\b", r"(?i)\buse\s+spaces\b"
INDENT_WIDTH = r"(?i)(\d+)[\s-]*(?:space|indent)"
CAMEL, SNAKE = r"(?i)\bcamel\s*case\b", r"(?i)\bsnake\s*[_\s]?case\b"
LINE_LENGTH = r"(?i)(?:max(?:imum)?|line)\s*(?:line\s*)?(?:length|width|chars?)\s*(?:of\s*|:\s*|=\s*)?(\d+)"
SEMICOLONS, NO_SEMICOLONS = r"(?i)\b(?:always\s+use|require|use)\s+semicolons?\b", r"(?i)\b(?:no|omit|avoid|don'?t\s+use)\s+semicolons?\b"
SINGLE, DOUBLE = r"(?i)\bsingle\s+quotes?\b", r"(?i)\bdouble\s+quotes?\b"
LEAST_MENTIONS = 3
LEAST_LENGTH, MOST_LENGTH, MOST_NUMBER = 40, 500, 2**32 - 1


def kind(format_: Column) -> Column:
    return F.split_part(format_, F.lit(":"), F.lit(1))


def project(format_: Column) -> Column:
    return F.split_part(format_, F.lit(":"), F.lit(2))


def empty(content: Column) -> Column:
    return ~content.rlike(r"\S")


def _held(content: Column, *words: str) -> Column:
    """Whether a content holds one of some lower-case words, in any case: a search of bytes, which spares most texts the patterns that need one."""
    return reduce(Column.__or__, [F.lower(content).contains(w) for w in words])


def json_problem(content: Column) -> Column:
    """syntax, schema (null or an empty object) or null. Trailing text after a value is a syntax error: the text must be one array element."""
    value = F.try_parse_json(content)
    invalid = value.isNull() | (F.coalesce(F.expr("json_array_length(concat('[', content, ']'))"), F.lit(0)) != 1)
    kind = F.schema_of_variant(value)
    return F.when(invalid, "syntax").when((kind == "VOID") | (kind == "OBJECT<>"), "schema")


def problems(format_: Column, content: Column) -> Column:
    """What the syntax and schema layers find in a content, as an array of (severity, layer, message). A null content couldn't be rendered, which is a finding too."""
    c, f = content, kind(format_)
    blank, body = empty(c), F.when(c.startswith("---"), F.substr(c, F.lit(4)))
    close = F.locate("---", body)
    front = F.substring(body, F.lit(1), close - 1)
    problem = F.when(f == "json", json_problem(c))
    text = c.isNotNull() & (f != "json") & f.isin(*KINDS)
    rules = [
        (~f.isin(*KINDS), "error", "schema", F.lit("no rules for this format")),
        (c.isNull(), "error", "schema", F.lit("format was not rendered")),
        (text & blank, "error", "syntax", F.lit("content is empty")),
        (text & ~blank & fence_unbalanced(c), "error", "syntax", F.lit("code fence is not closed")),
        ((f == "cursor") & body.isNotNull() & (close == 0), "error", "schema", F.lit("frontmatter is not closed")),
        ((f == "cursor") & body.isNotNull() & (close > 0) & ~front.contains("description:"), "warning", "schema", F.lit("frontmatter has no description")),
        ((f == "claude") & ~c.contains("# "), "error", "schema", F.lit("no heading")),
        (f.isin(*PLAIN) & blank, "error", "schema", F.lit("content is empty")),
        ((f == "json") & (problem == "syntax"), "error", "syntax", F.lit("json syntax")),
        ((f == "json") & (problem == "schema"), "error", "schema", F.lit("json schema")),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(layer).alias("layer"), message.alias("message"))) for bad, severity, layer, message in rules]))


def _listed(told: DataFrame) -> DataFrame:
    return told.select("format", F.explode("problems").alias("w")).select("format", "w.severity", "w.layer", "w.message", F.lit(None).cast("string").alias("location"))


def syntax(rendered: DataFrame) -> DataFrame:
    """Findings of the syntax and schema layers for (format, content)."""
    return _listed(rendered.select("format", problems(F.col("format"), F.col("content")).alias("problems")))


def named_paths(content: Column) -> Column:
    """Paths that a text names, sorted, each once, without URLs, versions, host names and bare names."""
    bad = lambda r: r.startswith("http") | r.startswith("ftp") | r.contains("://") | r.rlike(r"^v[012]\.") | r.rlike(r"\.(com|org|io|dev)\z") | ~r.contains("/")
    found = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(content, F.lit(PATH), 1), lambda r: ~bad(r))))
    return F.when(content.contains("/"), found).when(content.isNotNull(), F.array().cast("array<string>"))


def path_references(rendered: DataFrame) -> DataFrame:
    """format, ref: the paths that each content names."""
    return rendered.select("format", F.explode(named_paths(F.col("content"))).alias("ref"))


def dangling(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References (format, ref) that no file (path) equals, ends with or is the end of. An end may start at any character."""
    return refs.join(endings.met(refs, files, "ref", "path"), "ref", "left_anti").select("format", "ref")


def contradiction(content: Column) -> Column:
    return _held(content, "tabs") & content.rlike(TABS) & content.rlike(SPACES)


def mentions(content: Column) -> Column:
    """How often a content names each language, as an array of (language, mentions)."""
    words = {k: (r"\bc#" if k == "c#" else rf"\b{k}\b") for k in REALITY}
    count = lambda k, w: F.when(_held(content, k), F.regexp_count(F.lower(content), F.lit(w)).cast("long")).when(content.isNotNull(), F.lit(0).cast("long"))
    return F.array(*[F.struct(F.lit(k).alias("language"), count(k, w).alias("mentions")) for k, w in words.items()])


def _without_files(named: DataFrame, files: DataFrame) -> DataFrame:
    extensions = F.explode(F.array(*[F.struct(F.lit(k).alias("language"), F.lit(e).alias("ext")) for k, es in REALITY.items() for e in es])).alias("x")
    table = named.sparkSession.range(1).select(extensions).select("x.language", "x.ext")
    present = files.select(F.regexp_extract("path", r"\.([^./]+)$", 1).alias("ext")).distinct().join(F.broadcast(table), "ext").select("language").distinct()
    return named.join(present, "language", "left_anti").select("format", "language", "mentions")


def language_mentions(rendered: DataFrame, files: DataFrame, least: int = LEAST_MENTIONS) -> DataFrame:
    """format, language, mentions of languages that are named ``least`` times or more though no file has an extension of theirs."""
    named = rendered.select("format", F.explode(mentions(F.col("content"))).alias("m")).select("format", "m.language", "m.mentions").where(F.col("mentions") >= least)
    return _without_files(named, files)


def stated(content: Column) -> list[Column]:
    """The conventions that a content states, null or empty where it states none. The first match of a number counts."""
    c = content
    said = lambda p, *words: _held(c, *words) & c.rlike(p)
    number = lambda p, *words: F.when(_held(c, *words), F.regexp_extract(c, p, 1).try_cast("long"))
    width, length = number(INDENT_WIDTH, "space", "indent"), number(LINE_LENGTH, "length", "width", "char")
    return [
        F.when(said(TABS, "tabs"), "tabs").when(said(SPACES, "spaces"), "spaces").alias("indentation_style"),
        F.when(width <= MOST_NUMBER, width).alias("indent_width"),
        F.concat_ws(",", F.when(said(CAMEL, "camel"), "camelCase"), F.when(said(SNAKE, "snake"), "snake_case")).alias("naming"),
        F.when(length.between(LEAST_LENGTH, MOST_LENGTH), length).alias("line_length"),
        F.when(said(SEMICOLONS, "semicolon"), "use").when(said(NO_SEMICOLONS, "semicolon"), "no").alias("semicolons"),
        F.when(said(SINGLE, "single"), "single").when(said(DOUBLE, "double"), "double").alias("quote_style"),
    ]


def conventions(rendered: DataFrame) -> DataFrame:
    """format and the conventions its content states."""
    return rendered.select("format", *stated(F.col("content")))


CONFLICTING = ("indentation_style", "indent_width", "line_length", "semicolons", "quote_style")
REQUIRED = ("indentation_style", "quote_style")


def _long_form(stated: DataFrame, names: tuple[str, ...]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names])).alias("p")
    return stated.select("format", project(F.col("format")).alias("project"), pairs).select("format", "project", "p.name", "p.value")


def conflicts(stated: DataFrame) -> DataFrame:
    """project, name, stated: conventions of which two formats of a project state different values. A project has a row for each kind of format."""
    values = _long_form(stated, CONFLICTING).where("value is not null")
    listed = F.array_join(F.array_sort(F.collect_list(F.concat("format", F.lit("="), "value"))), ", ")
    return values.groupBy("project", "name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), listed.alias("stated")).where("lo <> hi").select("project", "name", "stated")


def missing(stated: DataFrame) -> DataFrame:
    """project, name, without: conventions that over half of a project's formats state and some don't."""
    values = _long_form(stated, REQUIRED)
    without = F.array_join(F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.col("format")))), ", ")
    out = values.groupBy("project", "name").agg(F.count("*").alias("n"), F.count("value").alias("have"), without.alias("without"))
    return out.where("n >= 2 and have > n div 2 and have < n").select("project", "name", "without")


def _loose(refs: DataFrame, files: DataFrame) -> DataFrame:
    return dangling(refs, files).select("format", F.lit("warning").alias("severity"), F.lit("semantic").alias("layer"), F.lit("path is not in the corpus").alias("message"), F.col("ref").alias("location"))


def _contradicting(rows: DataFrame) -> DataFrame:
    return rows.select("format", F.lit("error").alias("severity"), F.lit("semantic").alias("layer"), F.lit("tabs and spaces are both prescribed").alias("message"), F.lit(None).cast("string").alias("location"))


def loose_paths(rendered: DataFrame, files: DataFrame) -> DataFrame:
    return _loose(path_references(rendered), files)


def contradictions(rendered: DataFrame) -> DataFrame:
    return _contradicting(rendered.where(contradiction(F.col("content"))))


def smoke(rules: DataFrame, files: DataFrame) -> DataFrame:
    """The check after finalising: missing paths and contradictions only, all as warnings."""
    return loose_paths(rules, files).unionByName(contradictions(rules)).withColumn("severity", F.lit("warning"))


def _consistency(stated: DataFrame) -> DataFrame:
    def rows(found: DataFrame, message: str, at: str) -> DataFrame:
        name = F.when(F.col("project") == "", F.lit(CROSS)).otherwise(F.concat(F.lit(f"{CROSS}:"), "project"))
        return found.select(name.alias("format"), F.lit("error").alias("severity"), F.lit("semantic").alias("layer"), F.concat(F.lit(message), "name").alias("message"), F.col(at).alias("location"))

    return rows(conflicts(stated), "conflicting ", "stated").unionByName(rows(missing(stated), "missing ", "without"))


def cross_format(rendered: DataFrame) -> DataFrame:
    """Findings over all formats of a project together. Both kinds are errors."""
    return _consistency(conventions(rendered.where("content is not null")))


def facts(rendered: DataFrame) -> DataFrame:
    """All that the checks need to know of each content (format, content), from one pass over the texts."""
    c = F.col("content")
    often = F.filter(mentions(c), lambda m: m["mentions"] >= LEAST_MENTIONS)
    return rendered.select("format", problems(F.col("format"), c).alias("problems"), named_paths(c).alias("refs"), contradiction(c).alias("contradicts"), often.alias("mentions"), c.isNotNull().alias("rendered"), *stated(c))


#: Checks of the semantic layer, which are switched one by one.
CHECKS = ("paths", "contradictions", "reality", "consistency")


def findings(rendered: DataFrame, files: DataFrame, overrides: Mapping[str, Mapping[str, bool]] | None = None, defaults: Mapping[str, bool] | None = None, formats: Collection[str] | None = None, stage: Callable[[DataFrame, str], DataFrame] = staged) -> DataFrame:
    """All findings. ``defaults`` switches the semantic checks (all on); ``overrides`` does so for single formats, whose defaults then
    don't count. Consistency runs over all formats if any of them has it on.

    Texts are read once: ``stage`` writes their facts, and all checks are filters and joins of these.
    """
    every, own = dict.fromkeys(CHECKS, True), dict(overrides or {})
    present = [k for k in KINDS if formats is None or k in formats]
    switches = {k: every | dict(own[k] if k in own else defaults or {}) for k in present}
    told = stage(facts(dealt(rendered)), "facts")
    checked = lambda name: told.where(F.col("rendered") & kind(F.col("format")).isin(*[k for k in present if switches[k][name]]))
    on = {name for name in CHECKS if any(s[name] for s in switches.values())}
    out = _listed(told)
    if "paths" in on:
        out = out.unionByName(_loose(checked("paths").select("format", F.explode("refs").alias("ref")), files))
    if "contradictions" in on:
        out = out.unionByName(_contradicting(checked("contradictions").where("contradicts")))
    if "reality" in on:
        unreal = _without_files(checked("reality").select("format", F.explode("mentions").alias("m")).select("format", "m.language", "m.mentions"), files)
        out = out.unionByName(unreal.select("format", F.lit("warning").alias("severity"), F.lit("semantic").alias("layer"), F.lit("language has no file").alias("message"), F.col("language").alias("location")))
    return out.unionByName(_consistency(told.where("rendered"))) if "consistency" in on else out


def results(rendered: DataFrame, found: DataFrame) -> DataFrame:
    """format, passed, errors, warnings of each rendered format, and of the formats of a project together where they have findings."""
    counts = found.groupBy("format").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    names = rendered.select("format").unionByName(found.where(kind(F.col("format")) == CROSS).select("format").distinct())
    out = names.join(counts, "format", "left").na.fill(0, ["errors", "warnings"])
    return out.select("format", (F.col("errors") == 0).alias("passed"), "errors", "warnings")
