"""Configuration: command line over environment over files over defaults. Later files win over earlier ones."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from .functions.paths import FORMATS, PROVIDERS
from .operators.chunks import ChunkConfig
from .operators.validate import CHECKS
from .operators.writing import STRATEGIES
from .sources.git import root_of
from .sources.tree import split_globs

FILE, PREFIX = "textloom.toml", "TEXTLOOM_"
#: What happens if formats still fail validation: ask at a terminal (write without one), write them, or end the run.
ON_FAILURE = ("ask", "write", "cancel")


@dataclass(frozen=True)
class Config:
    provider: str = "anthropic"
    model: str | None = None
    formats: tuple[str, ...] = ("cursor",)
    output: str | None = None
    output_paths: Mapping[str, str] = field(default_factory=dict)
    packed_file: str | None = None
    description: str | None = None
    rule_type: str = "auto"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    #: What to do about a file that is listed and can't be read: end the run, or leave it out and say so.
    on_unreadable: str = "fail"
    compress: bool = False
    chunk_size: int = 100_000
    overlap: int | None = None
    no_confirm: bool = False
    dry_run: bool = False
    retry_on_validation_failure: bool = False
    max_retries: int = 3
    #: Tokenizer file for exact counts; byte estimates without one.
    tokenizer: str | None = None
    concurrency: int = 4
    validate: bool = True
    semantic_validation: bool = True
    #: Semantic checks that are switched, for all formats and for single ones.
    checks: Mapping[str, bool] = field(default_factory=dict)
    format_checks: Mapping[str, Mapping[str, bool]] = field(default_factory=dict)
    on_failure: str = "ask"
    finalise: bool = True
    deconflict: bool = True
    normalise: bool = True
    header: bool = True
    #: Service -> what differs from its defaults: model, max_tokens, url.
    providers: Mapping[str, Mapping] = field(default_factory=dict)
    on_conflict: str = "prompt"
    quiet: bool = False
    verbose: int = 0

    def __post_init__(self) -> None:
        if self.provider not in PROVIDERS:
            raise ValueError(f"unknown provider {self.provider}")
        if unknown := set(self.formats) - set(FORMATS):
            raise ValueError(f"unknown formats {sorted(unknown)}")
        if self.on_conflict not in STRATEGIES:
            object.__setattr__(self, "on_conflict", "prompt")
        if self.output and len(self.formats) != 1:
            raise ValueError("an output path needs exactly one format")
        if self.on_unreadable not in ("fail", "quarantine"):
            raise ValueError("on_unreadable is fail or quarantine")
        if self.on_failure not in ON_FAILURE:
            raise ValueError(f"on_failure is one of {', '.join(ON_FAILURE)}")
        for checks in (self.checks, *self.format_checks.values()):
            if unknown := set(checks) - set(CHECKS):
                raise ValueError(f"unknown checks {sorted(unknown)}")
        if unknown := set(self.format_checks) - set(FORMATS):
            raise ValueError(f"checks for unknown formats {sorted(unknown)}")
        self.chunks  # noqa: B018  (raises on bad sizes)

    @property
    def chunks(self) -> ChunkConfig:
        return ChunkConfig(self.chunk_size, self.overlap)


#: Where a file's sections keep the fields, by their names there.
SECTIONS = {
    "general": {n: n for n in ("provider", "model", "compress", "chunk_size", "no_confirm", "rule_type", "description", "tokenizer", "concurrency", "on_unreadable")},
    "output": {n: n for n in ("formats", "output_paths", "on_conflict")},
    "chunking": {"chunk_size": "chunk_size", "overlap": "overlap"},
    "validation": {"enabled": "validate", "retry_on_validation_failure": "retry_on_validation_failure", "retry_on_failure": "retry_on_validation_failure", "max_retries": "max_retries", "semantic_validation": "semantic_validation", "on_failure": "on_failure"},
    "finalization": {"enabled": "finalise", "deconflict": "deconflict", "normalize_formatting": "normalise", "inject_metadata": "header"},
}
#: Names of the semantic checks in a file.
CHECK_NAMES = {"check_file_paths": "paths", "check_contradictions": "contradictions", "check_consistency": "consistency", "check_reality": "reality"}


def _checks(table: Mapping) -> dict[str, bool]:
    return {CHECK_NAMES.get(k, k): v for k, v in table.items()}


def files(explicit: str | None = None, cwd: str | None = None) -> list[Path]:
    """User directory, root of the repository, working directory, explicit path: each once, by its real path."""
    here = Path(cwd or os.getcwd())
    root = root_of(here)
    found = [Path.home() / ".config" / "textloom" / FILE, *([root / FILE] if root else []), here / FILE, *([Path(explicit)] if explicit else [])]
    return list({p.resolve(): p for p in found if p.exists()})


def from_file(path: Path) -> dict:
    data = tomllib.loads(path.read_text(encoding="utf-8"))
    out = {k: data[k] for k in ("include", "exclude", "providers") if k in data}
    for section, names in SECTIONS.items():
        out |= {names[k]: v for k, v in data.get(section, {}).items() if k in names}
    validation = data.get("validation", {})
    if "semantic" in validation:
        out["checks"] = _checks(validation["semantic"])
    if "format_overrides" in validation:
        out["format_checks"] = {k: _checks(v) for k, v in validation["format_overrides"].items()}
    return out


def _typed(name: str, value):
    default = {f.name: f.default for f in fields(Config)}[name]
    if isinstance(value, str):
        if isinstance(default, bool):
            return value.strip().lower() in ("1", "true", "yes", "on")
        if isinstance(default, int) or name == "overlap":
            return int(value)
        if isinstance(default, tuple):
            return tuple(split_globs(value))
    return tuple(value) if isinstance(value, list) else value


def load(flags: Mapping | None = None, env: Mapping | None = None, explicit: str | None = None, cwd: str | None = None) -> Config:
    """``flags`` holds only what was typed on the command line."""
    values: dict = {}
    for path in files(explicit, cwd):
        values |= from_file(path)
    names = {f.name for f in fields(Config)}
    env = os.environ if env is None else env
    values |= {k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX) and k[len(PREFIX) :].lower() in names}
    values |= {k: v for k, v in (flags or {}).items() if v is not None}
    return replace(Config(), **{k: _typed(k, v) for k, v in values.items()})
