"""Repositories as sources: where one begins, and a shallow copy of a remote one."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

_REMOTE = re.compile(r"(https?|ssh|git|file)://\S+|[\w.-]+@[\w.-]+:\S+")


def is_remote(path: str) -> bool:
    return bool(_REMOTE.fullmatch(path))


def root_of(path: str | Path) -> Path | None:
    """The nearest folder upwards that is a repository's root."""
    here = Path(path).resolve()
    return next((p for p in (here, *here.parents) if (p / ".git").exists()), None)


def is_repository(path: str | Path) -> bool:
    return (Path(path) / ".git").exists()


def clone(url: str, target: str | Path, timeout: float = 600) -> Path:
    """The newest commit of ``url`` in the new folder ``target``."""
    if not is_remote(url):
        raise ValueError(f"not the address of a repository: {url}")
    done = subprocess.run(["git", "clone", "--quiet", "--depth", "1", "--", url, str(target)], capture_output=True, text=True, timeout=timeout)
    if done.returncode:
        raise OSError(f"git clone failed: {done.stderr.strip()}")
    return Path(target)
