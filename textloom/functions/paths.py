"""Column functions over paths, names and kinds: languages, globs, formats, rule types, providers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> language.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rs": "rust", "go": "go", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "rb": "ruby", "php": "php",
}
# Language word -> extensions whose absence makes a mention of it doubtful.
REALITY = {
    "typescript": ("ts", "tsx"), "javascript": ("js", "jsx"), "python": ("py",), "rust": ("rs",), "go": ("go",), "java": ("java",), "ruby": ("rb",),
    "swift": ("swift",), "kotlin": ("kt", "kts"), "c#": ("cs",), "php": ("php",),
}
#: Provider -> (context limit, input price and output price per 1000 tokens, default tokenizer family, display name).
PROVIDERS = {
    "anthropic": (200_000, 0.003, 0.015, "cl100k", "Anthropic"),
    "openai": (128_000, 0.0025, 0.010, "o200k", "OpenAI"),
    "ollama": (100_000, 0.0, 0.0, "cl100k", "Ollama"),
    "openrouter": (128_000, 0.0, 0.0, "cl100k", "OpenRouter"),
}
OTHER_CONTEXT_LIMIT = 100_000
#: Format -> path of its rendering.
FORMATS = {
    "cursor": ".cursor/rules/project.mdc", "claude": "CLAUDE.md", "copilot": ".github/copilot-instructions.md", "windsurf": ".windsurfrules",
    "aider": ".aider.conf.yml", "generic": "AI_RULES.md", "json": "AI_RULES.json",
}
RULE_TYPES = {
    "always": ("always", "alwaysapply"), "auto": ("auto", "autoattached", "intelligent"), "files": ("files", "specificfiles"), "manual": ("manual",),
}
#: Languages in the order in which one counts as the primary language of an analysis.
PRIMARY = (("rust", r"\brust\b"), ("typescript", r"\btypescript\b"), ("javascript", r"\bjavascript\b"), ("python", r"\bpython\b"), ("go", r"\b(go|golang)\b"), ("java", r"\bjava\b"), ("cpp", r"\bc\+\+"), ("csharp", r"\bc#"))


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def normalised_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def extension(path: Column) -> Column:
    """After the last dot of the file name; a name that only starts with a dot has none."""
    return F.nullif(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1), F.lit(""))


def language(path: Column) -> Column:
    """Language of a path by its case-sensitive extension, or null."""
    return _lookup(LANGUAGES, extension(path))


def primary_language(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda out, p: out.when(low.rlike(p[1]), F.lit(p[0])), PRIMARY[1:], F.when(low.rlike(PRIMARY[0][1]), F.lit(PRIMARY[0][0]))).otherwise(F.lit("text"))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression over a path relative to the root. ``*`` also crosses ``/``; ``**/`` may be nothing."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i] == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out, i = out + ".*", i + 1
        elif glob[i] == "?":
            out, i = out + ".", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end + 1
        elif glob[i] == "{" and (end := glob.find("}", i)) > 0:
            out += "(?:" + "|".join(glob_regex(x) for x in glob[i + 1 : end].split(",")) + ")"
            i = end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def any_glob(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs: one alternation."""
    return path.rlike("^(?:" + "|".join(map(glob_regex, globs)) + r")\z") if globs else F.lit(False)


def kept_path(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Include, if any is given, then exclude."""
    return (any_glob(path, include) if include else F.lit(True)) & ~any_glob(path, exclude)


def packed_format(path: Column, content: Column) -> Column:
    """Kind of a packed file: by extension, else by content in the order XML, JSON, Markdown."""
    ext = F.lower(F.coalesce(extension(path), F.lit("")))
    start = F.ltrim(content)
    return (
        F.when(ext == "xml", "xml").when(ext == "json", "json").when(ext.isin("md", "markdown"), "markdown")
        .when(content.contains("<file path="), "xml").when(start.startswith("{") | start.startswith("["), "json")
        .when(content.contains("## File:"), "markdown").otherwise("unknown")
    )


def rule_type(name: Column) -> Column:
    """Canonical rule type of a name in any case, with or without separators, or null."""
    return _lookup({alias: kind for kind, aliases in RULE_TYPES.items() for alias in aliases}, F.regexp_replace(F.lower(F.trim(name)), "[ _-]", ""))


def default_rule_type(format_: Column) -> Column:
    return F.when(format_ == "claude", "always").otherwise("auto")


def tokenizer_family(model: Column) -> Column:
    low = F.lower(model)
    return F.when(low.contains("o1") | low.contains("gpt-4o"), "o200k").otherwise(F.when(low.contains("claude"), "anthropic").otherwise("cl100k"))


def context_limit(provider: Column) -> Column:
    return F.coalesce(_lookup({k: v[0] for k, v in PROVIDERS.items()}, F.lower(provider)), F.lit(OTHER_CONTEXT_LIMIT)).cast("long")


def retryable(message: Column) -> Column:
    """Rate limits, network failures and server errors may be tried again."""
    return message.rlike(r"(?i)rate limit|network|timed? ?out|connection") | message.rlike(r"HTTP 50[0-4]|Internal Server Error|Bad Gateway|Service Unavailable|Gateway Timeout|(?i:server error)")


def output_path(format_: Column, override: Column) -> Column:
    return F.coalesce(override, _lookup(FORMATS, format_))
