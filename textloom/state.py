"""Persisted run state as one JSON document; what can't be read or is out of range counts as absent."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path

VERSION = "1"
log = logging.getLogger(__name__)


@dataclass
class State:
    version: str = VERSION
    last_run: str = ""
    file_conflict_action: str | None = None
    apply_to_all: bool = False
    output_files: tuple[str, ...] = ()
    cost_spent: float = 0.0
    original_bytes: int = 0
    compression_ratio: float = 0.0

    @property
    def valid(self) -> bool:
        return 0.0 <= self.compression_ratio <= 1.0 and self.cost_spent >= 0


def save(state: State, path: str | Path) -> None:
    state.last_run = state.last_run or datetime.now(UTC).isoformat()
    Path(path).write_text(json.dumps(asdict(state), indent=2) + "\n", encoding="utf-8")


def load(path: str | Path) -> State | None:
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        if not isinstance(raw, dict):
            raise ValueError("not an object")
        known = {k: v for k, v in raw.items() if k in State.__dataclass_fields__}
        state = State(**(known | {"version": VERSION, "output_files": tuple(known.get("output_files", ()))}))
        if not state.valid:
            raise ValueError("values out of range")
    except FileNotFoundError:
        return None
    except (OSError, ValueError, TypeError) as e:
        log.warning("state at %s is not used: %s", path, e)
        return None
    return state
