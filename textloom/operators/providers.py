"""Model providers over HTTP, for ``analysis.completed``. A client is plain data, so tasks carry it; connections are made on the worker.

Each service is described by how a request is put and how a reply is read; sending, limits and errors are the same for all.
"""

from __future__ import annotations

import json
import os
import re
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..functions.text import REDACTIONS
from .analysis import Answer, Options, ProviderError


def redact(message: str) -> str:
    """Secrets in an error's text replaced, by the rules of ``functions.text.redacted``."""
    for pattern, mark in REDACTIONS:
        message = re.sub(pattern, mark.replace("$1", r"\1"), message)
    return message


def text_blocks(blocks: list[dict]) -> str:
    """The text of the blocks of kind text, joined; other kinds are left out."""
    return "".join(b.get("text") or "" for b in blocks if b.get("type") == "text")


def first_choice(choices: list[dict]) -> str:
    return (choices[0].get("message", {}).get("content") or "") if choices else ""


@dataclass(frozen=True)
class Service:
    """``key_name`` is the environment variable of the API key (none needed if null), ``may_be_empty`` whether an empty answer is valid."""

    url: str
    path: str
    model: str
    key_name: str | None
    headers: Callable[[str], dict[str, str]]
    body: Callable[[str, str, Options], dict]
    answer: Callable[[dict], tuple[str, int, int]]
    timeout: float = 120
    may_be_empty: bool = True


def _chat(model: str, prompt: str, o: Options) -> dict:
    body = {"model": model, "max_tokens": o.max_tokens, "messages": [{"role": "user", "content": prompt}]}
    return body if o.temperature is None else body | {"temperature": o.temperature}


def _local_chat(model: str, prompt: str, o: Options) -> dict:
    options = {"num_predict": o.max_tokens} | ({} if o.temperature is None else {"temperature": o.temperature})
    return {"model": model, "stream": False, "messages": [{"role": "user", "content": prompt}], "options": options}


def _choice_answer(r: dict) -> tuple[str, int, int]:
    usage = r.get("usage") or {}
    return first_choice(r.get("choices") or []), usage.get("prompt_tokens") or 0, usage.get("completion_tokens") or 0


def _bearer(key: str) -> dict[str, str]:
    return {"Authorization": f"Bearer {key}"}


# Addresses, header names and default models of the services.
SERVICES = {
    "anthropic": Service(
        "https://api.anthropic.com", "/v1/messages", "claude-sonnet-4-5-20250929", "ANTHROPIC_API_KEY",
        lambda key: {"x-api-key": key, "anthropic-version": "2023-06-01"}, _chat,
        lambda r: (text_blocks(r.get("content") or []), r["usage"]["input_tokens"], r["usage"]["output_tokens"]),
    ),
    "openai": Service("https://api.openai.com", "/v1/chat/completions", "gpt-4o", "OPENAI_API_KEY", _bearer, _chat, _choice_answer),
    "ollama": Service(
        "http://localhost:11434", "/api/chat", "llama3.1:70b", None, lambda key: {}, _local_chat,
        lambda r: ((r.get("message") or {}).get("content") or "", r.get("prompt_eval_count") or 0, r.get("eval_count") or 0), 30, False,
    ),
    "openrouter": Service("https://openrouter.ai", "/api/v1/chat/completions", "anthropic/claude-3.5-sonnet", "OPENROUTER_API_KEY", _bearer, _chat, _choice_answer, may_be_empty=False),
}


@dataclass(frozen=True)
class HttpProvider:
    """A client of one service. Rate limits, server errors and network failures may be tried again; a delay that the server names is kept."""

    service: str
    model: str | None = None
    url: str | None = None
    key: str = field(default="", repr=False)
    max_tokens: int | None = None

    def __post_init__(self) -> None:
        if self.service not in SERVICES:
            raise ValueError(f"unknown provider {self.service}")

    @classmethod
    def from_env(cls, service: str, model: str | None = None, url: str | None = None, max_tokens: int | None = None) -> HttpProvider:
        """With the key of the driver's environment."""
        name = SERVICES[service].key_name if service in SERVICES else None
        if name and not os.environ.get(name):
            raise ValueError(f"{name} is not set")
        return cls(service, model, url, os.environ[name] if name else "", max_tokens)

    def __call__(self) -> HttpProvider:
        return self

    def complete(self, prompt: str, options: Options) -> Answer:
        s = SERVICES[self.service]
        if self.max_tokens:
            options = replace(options, max_tokens=self.max_tokens)
        body = json.dumps(s.body(self.model or s.model, prompt, options)).encode()
        request = urllib.request.Request((self.url or s.url) + s.path, body, {"content-type": "application/json"} | s.headers(self.key))
        try:
            with urllib.request.urlopen(request, timeout=s.timeout) as reply:
                text, tokens_in, tokens_out = s.answer(json.load(reply))
        except urllib.error.HTTPError as e:
            wait = e.headers.get("retry-after", "")
            detail = redact(e.read().decode("utf-8", "replace"))
            raise ProviderError(f"{self.service}: HTTP {e.code}: {detail}", e.code == 429 or e.code >= 500, 1000 * int(wait) if e.code == 429 and wait.isdigit() else None) from None
        except (OSError, ValueError, KeyError) as e:  # no connection, a broken one, or a reply that can't be read
            raise ProviderError(f"{self.service}: network error: {redact(str(e))}", True) from e
        if not text and not s.may_be_empty:
            raise ProviderError(f"{self.service}: empty answer")
        return Answer(text, tokens_in, tokens_out)
