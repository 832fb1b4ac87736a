"""What an error means to the person who meets it: a title, and what may help."""

from __future__ import annotations

from dataclasses import dataclass

from .operators.analysis import ProviderError
from .operators.writer import WriteConflict


@dataclass(frozen=True)
class Explained:
    title: str
    help: tuple[str, ...]


#: (word in the message, explanation), first match wins; for provider errors.
_PROVIDER = (
    ("HTTP 429", Explained("Rate limit", ("wait and run again", "use a smaller chunk size or another provider"))),
    ("HTTP 401", Explained("Key refused", ("check the provider's API key",))),
    ("HTTP 403", Explained("Key refused", ("check what the API key may do",))),
    ("HTTP 404", Explained("Model not found", ("check the model's name",))),
    ("network error", Explained("Network", ("check the connection and the provider's address",))),
    ("empty answer", Explained("Empty answer", ("try again or choose another model",))),
    ("", Explained("Model provider", ("try again, or choose another provider",))),
)
_KINDS: tuple[tuple[type[BaseException], Explained], ...] = (
    (WriteConflict, Explained("Output exists", ("choose --on-conflict overwrite or skip",))),
    (UnicodeDecodeError, Explained("Not UTF-8", ("exclude the file, or let such files be set aside",))),
    (FileNotFoundError, Explained("No such file", ("check the path",))),
    (PermissionError, Explained("No permission", ("check who owns the path",))),
    (OSError, Explained("File system", ("check the path and the free space",))),
    (ValueError, Explained("Wrong setting", ("check the command line, the environment and the configuration files",))),
)


def explain(error: BaseException) -> Explained:
    # A provider's error that a task raised comes back inside Spark's own.
    if isinstance(error, ProviderError) or "ProviderError" in str(error):
        return next(e for word, e in _PROVIDER if word in str(error))
    return next((e for kind, e in _KINDS if isinstance(error, kind)), Explained("Unexpected error", ("run again with -vv",)))


def chain(error: BaseException) -> list[str]:
    """Messages of the error and its causes, outermost first."""
    out, at = [], error
    while at is not None:
        out.append(str(at) or type(at).__name__)
        at = at.__cause__
    return out
