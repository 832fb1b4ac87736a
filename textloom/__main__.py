"""Command line: ``python -m textloom PATH [options]``. ``--echo`` answers from the prompt itself instead of calling a model."""

from __future__ import annotations

import argparse
import logging
import sys
import tempfile
from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime

from . import config as settings
from . import errors
from .functions.paths import PROVIDERS
from .operators import reports
from .operators.analysis import EchoProvider
from .operators.providers import HttpProvider
from .plans import run as plan
from .sources import git
from .workspace import Temporary

log = logging.getLogger(__name__)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", argument_default=argparse.SUPPRESS)
    p.add_argument("path", nargs="?", default=".", help="a folder, or the address of a repository for a dry run")
    for name in ("provider", "model", "output", "packed-file", "description", "rule-type", "on-conflict"):
        p.add_argument(f"--{name}")
    p.add_argument("--format", dest="formats", help="comma-separated")
    p.add_argument("--config")
    p.add_argument("--work", help="folder that driver and executors share, for stage tables and model answers; PATH/.textloom on a single machine")
    for name in ("include", "exclude"):
        p.add_argument(f"--{name}", action="append")
    p.add_argument("--chunk-size", type=int)
    p.add_argument("--echo", action="store_true")
    for name in ("compress", "no-confirm", "dry-run", "retry-on-validation-failure"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--on-failure", choices=("ask", "write", "cancel"), help="what to do if formats still fail validation")
    p.add_argument("--tokenizer", help="tokenizer file for exact token counts")
    for flag, name in (("deconflict", "deconflict"), ("semantic-validation", "semantic_validation"), ("validation", "validate"), ("finalisation", "finalise"), ("header", "header"), ("normalisation", "normalise")):
        p.add_argument(f"--no-{flag}", dest=name, action="store_false")
    p.add_argument("-v", dest="verbose", action="count")
    p.add_argument("-q", dest="quiet", action="store_true")
    return p


def confirmed(cost: float, lines: list[str]) -> bool:
    """Asks at the terminal; an empty answer is a yes."""
    print(*lines, sep="\n")
    return input(f"${cost:.4f}. Go on? [Y/n] ").strip().lower() in ("", "y", "yes")


def fitted(cost: float, lines: list[str]) -> str:
    """Asks whether rules are fitted to those of other tools; an empty answer is a yes."""
    print(*lines, sep="\n")
    reply = input(f"${cost:.4f}. Go on? [Y/n/s(kip)] ").strip().lower()
    return "go" if reply in ("", "y", "yes") else "skip" if reply in ("s", "skip") else "cancel"


def written_anyway(formats: list[str]) -> bool:
    return input(f"{', '.join(formats)} failed validation. [c]ancel or [w]rite anyway? ").strip().lower() in ("w", "write")


def chosen(path: str, format_: str, answers: Callable[[str], str] = input) -> str:
    """Asks what to do about a file that exists, until an answer is understood."""
    names = {"o": "overwrite", "s": "skip", "m": "merge", "q": "quit"} | {x: x for x in ("overwrite", "skip", "merge", "quit")}
    while True:
        reply = answers(f"{path} ({format_}) exists: [o]verwrite, [s]kip, [m]erge, [a]ll, [q]uit? ").strip().lower()
        if reply in names:
            return names[reply]
        if reply in ("a", "all"):
            rest = names.get(answers("For all that are left: [o]verwrite, [s]kip, [m]erge? ").strip().lower(), "")
            if rest in ("overwrite", "skip", "merge"):
                return f"{rest} all"


def failed(error: Exception) -> int:
    about = errors.explain(error)
    for line in (about.title, *(f"  {m}" for m in errors.chain(error)), *(f"  help: {h}" for h in about.help)):
        print(line, file=sys.stderr)
    return 1


def main(argv: list[str] | None = None) -> int:
    flags = vars(parser().parse_args(argv))
    path, explicit, echo, work = flags.pop("path"), flags.pop("config", None), flags.pop("echo", False), flags.pop("work", None)
    gone = Temporary()
    try:
        if git.is_remote(path):
            copy = tempfile.mkdtemp(prefix="textloom-")
            gone.add(copy)
            path = str(git.clone(path, f"{copy}/source"))
        config = settings.load(flags, explicit=explicit, cwd=path)
        own = config.providers.get(config.provider, {})
        config = replace(config, model=config.model or own.get("model"))
        provider = EchoProvider if echo or config.dry_run else HttpProvider.from_env(config.provider, config.model, own.get("url") or own.get("host"), own.get("max_tokens"))
    except (ValueError, OSError) as e:
        gone.clear()
        return failed(e)
    logging.basicConfig(level=logging.ERROR if config.quiet else logging.DEBUG if config.verbose > 1 else logging.INFO if config.verbose else logging.WARNING)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("textloom").getOrCreate()
    try:
        person = sys.stdin.isatty() and not config.quiet
        said = (lambda step: print(f"... {step}", file=sys.stderr)) if not config.quiet and sys.stderr.isatty() else log.info
        result = plan.run(
            spark, path, config, provider, work, timestamp=f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}", progress=said,
            confirm=confirmed if person else None, on_failure=written_anyway if person and not config.no_confirm else None, ask=chosen if person else None, choose=fitted if person else None,
        )
        if not config.quiet:
            result.report.orderBy("language").show(100, False)
            if result.findings is not None:
                prices = PROVIDERS[config.provider]
                reports.cost_levels(result.calls, *prices[1:3]).orderBy("operation", "attempt").show(100, False)
                print(*reports.validation_lines(result.findings), *result.summary, sep="\n")
            for w in result.written:
                if w.backup:
                    print(f"backup     {w.backup}")
        return 0
    except Exception as e:
        return failed(e)
    finally:
        spark.stop()
        gone.clear()


if __name__ == "__main__":
    sys.exit(main())
