"""Rule files that a project already has, and the format that each belongs to."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.writing import not_generated

# Names of existing outputs -> format.
NAMES = {
    "CLAUDE.md": "claude", ".windsurfrules": "windsurf", "CONVENTIONS.md": "aider", ".aider.conf.yml": "aider", "AI_RULES.md": "generic",
    ".cursorrules": "cursor", ".github/copilot-instructions.md": "copilot",
}
FOLDERS = {".cursor/rules": ("*.mdc", "cursor")}
SCHEMA = "ord int, format string, path string, content string"


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """ord, format, path, content of the known outputs under ``root``, in a fixed order: a handful. Those that aren't UTF-8 are left out."""
    found = [(p, f) for p, f in NAMES.items() if (Path(root) / p).is_file()]
    found += [(f"{folder}/{p.name}", f) for folder, (glob, f) in FOLDERS.items() for p in sorted((Path(root) / folder).glob(glob)) if p.is_file()]
    rows = []
    for i, (path, format_) in enumerate(found):
        try:
            rows.append((i, format_, path, (Path(root) / path).read_text(encoding="utf-8")))
        except UnicodeDecodeError:
            continue
    return spark.createDataFrame(rows, SCHEMA)


def of_other_tools(spark: SparkSession, root: str, requested: DataFrame) -> DataFrame:
    """Existing outputs of formats that aren't being generated (``requested``: format)."""
    return not_generated(discovered(spark, root), requested)
