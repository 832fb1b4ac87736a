"""Services around a run: model providers, listings, existing outputs, exact tokens, the working folder, errors."""

import json
import os
import threading
import time
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, HTTPServer

import pyspark.sql.functions as F
import pytest

from textloom import config as settings
from textloom import errors, state, workspace
from textloom.functions import tokens
from textloom.operators import analysis, providers, reports, writer
from textloom.plans import run as plan
from textloom.sources import models, outputs


@pytest.fixture
def server():
    """Answers with what ``replies`` holds, in order, and keeps what was asked."""

    class Handler(BaseHTTPRequestHandler):
        replies, asked = [], []

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            self.asked.append((self.path, dict(self.headers), body))
            code, headers, reply = self.replies.pop(0)
            self.send_response(code)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(reply if isinstance(reply, bytes) else json.dumps(reply).encode())

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    Handler.url = f"http://127.0.0.1:{http.server_port}"
    yield Handler
    http.shutdown()
    http.server_close()


CHOICE = {"choices": [{"message": {"content": "hi"}}, {"message": {"content": "no"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}}
REPLIES = {
    "anthropic": ({"content": [{"type": "thinking", "text": "x"}, {"type": "text", "text": "h"}, {"type": "text", "text": "i"}], "usage": {"input_tokens": 3, "output_tokens": 1}}, "/v1/messages"),
    "openai": (CHOICE, "/v1/chat/completions"),
    "openrouter": (CHOICE, "/api/v1/chat/completions"),
    "ollama": ({"message": {"content": "hi"}, "prompt_eval_count": 3, "eval_count": 1}, "/api/chat"),
}


@pytest.mark.parametrize("service", REPLIES)
def test_providers(server, service):
    reply, path = REPLIES[service]
    server.replies[:] = [(200, {}, reply)]
    server.asked.clear()
    client = providers.HttpProvider(service, url=server.url, key="k-123")
    assert client.complete("say hi", analysis.Options(7, None)) == analysis.Answer("hi", 3, 1)
    (asked, headers, body), low = server.asked[0], {}
    low = {k.lower(): v for k, v in headers.items()}
    assert asked == path and body["messages"] == [{"role": "user", "content": "say hi"}] and "temperature" not in json.dumps(body)
    assert {"anthropic": low.get("x-api-key") == "k-123", "ollama": "authorization" not in low}.get(service, low.get("authorization") == "Bearer k-123")
    assert "k-123" not in repr(client)


def test_provider_errors(server):
    client = providers.HttpProvider("openai", url=server.url)

    def error(*reply):
        server.replies[:] = [reply]
        with pytest.raises(analysis.ProviderError) as e:
            client.complete("x", analysis.Options())
        return e.value

    limited = error(429, {"retry-after": "2"}, {})
    assert limited.retry and limited.after_ms == 2000
    assert error(503, {}, {}).retry and not error(401, {}, {}).retry
    assert "abcdefgh12" not in str(error(400, {}, b"bad key sk-abcdefgh12"))
    assert error(200, {}, b"no json").retry
    server.replies[:] = [(200, {}, {"message": {"content": ""}})]
    with pytest.raises(analysis.ProviderError, match="empty"):
        providers.HttpProvider("ollama", url=server.url).complete("x", analysis.Options())
    with pytest.raises(analysis.ProviderError, match="network") as e:
        providers.HttpProvider("openai", url="http://127.0.0.1:1").complete("x", analysis.Options())
    assert e.value.retry
    with pytest.raises(ValueError):
        providers.HttpProvider("nobody")


def test_provider_in_tasks(spark, server, tmp_path):
    server.replies[:] = [(200, {}, REPLIES["openai"][0])] * 2
    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, prompt string")
    out = analysis.Desk(providers.HttpProvider("openai", url=server.url), f"{tmp_path}/store").completed(requests, "x", F.col("k"))
    assert sorted(tuple(r) for r in out.select("k", "text", "input_tokens").collect()) == [(1, "hi", 3), (2, "hi", 3), (3, "hi", 3)]


def test_listings(spark):
    listing = spark.createDataFrame([('{"data": [{"id": "a", "pricing": {"prompt": "0.001", "completion": "x"}}, {"id": "b"}]}',), ("{broken",)], "body string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "model string")
    assert sorted(tuple(r) for r in models.priced(asked, listing).collect()) == [("a", 1.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 0.0)]
    tags = spark.createDataFrame([('{"models": [{"name": "a:latest"}, {"name": "b:7b"}]}',)], "body string")
    names = spark.createDataFrame([("a",), ("a:latest",), ("b",), ("b:7b",)], "model string")
    assert {r["model"]: r["found"] for r in models.installed(names, tags).collect()} == {"a": True, "a:latest": True, "b": False, "b:7b": True}


def test_existing_outputs(spark, tmp_path):
    for path in ("CLAUDE.md", ".github/copilot-instructions.md", ".cursor/rules/b.mdc", ".cursor/rules/a.mdc", ".cursor/rules/x.md", "other.md"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
    (tmp_path / "AI_RULES.md").write_bytes(b"\xff")
    asked = spark.createDataFrame([("claude",)], "format string")
    got = outputs.of_other_tools(spark, str(tmp_path), asked).orderBy("ord").collect()
    assert [(r["format"], r["path"]) for r in got] == [("copilot", ".github/copilot-instructions.md"), ("cursor", ".cursor/rules/a.mdc"), ("cursor", ".cursor/rules/b.mdc")]


def test_exact_tokens(spark, tmp_path):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    t = Tokenizer(WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    t.pre_tokenizer = Whitespace()
    t.save(str(tmp_path / "t.json"))
    rows = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "zz")], "k int, x string")
    got = rows.select("k", tokens.exact_tokens(F.col("x"), str(tmp_path / "t.json")).alias("n")).orderBy("k").collect()
    assert [r["n"] for r in got] == [3, 0, None, 1]
    named = {"cl100k_base": str(tmp_path / "t.json")}
    assert [r["n"] for r in rows.select("k", tokens.counted_by(F.col("x"), "cl100k_base", named).alias("n")).orderBy("k").collect()] == [3, 0, None, 1]
    for name in ("p50k_base", "o200k_base"):
        with pytest.raises(ValueError):
            tokens.counted_by(F.col("x"), name, named)


def test_workspace(spark, tmp_path):
    w = workspace.Workspace(str(tmp_path / "w"))
    assert w.stage(spark.range(3), "files").count() == 3 == w.read(spark, "files").count()
    w.save_state(state.State(cost_spent=1.0))
    for name, age in (("old", 100), ("new", 1), ("ahead", -100)):
        (w.home / name).write_text(name)
        os.utime(w.home / name, (time.time() - age,) * 2)
    assert w.clean(older_than=50) == workspace.Cleaned(1, 0, 4) and w.load_state().cost_spent == 1.0
    assert w.clean().deleted == 2 and w.load_state() is not None and w.read(spark, "files").count() == 3


def test_ignore_line_and_temporaries(tmp_path):
    (tmp_path / ".gitignore").write_text("a\n b ")
    assert workspace.ensure_ignored(str(tmp_path), "c") and not workspace.ensure_ignored(str(tmp_path), "c") and not workspace.ensure_ignored(str(tmp_path), "b")
    assert (tmp_path / ".gitignore").read_text() == "a\n b \nc\n"
    gone = workspace.Temporary()
    (tmp_path / "d").mkdir()
    gone.add(tmp_path / ".gitignore", tmp_path / "d", tmp_path / "absent")
    gone.clear()
    assert not list(tmp_path.iterdir())

    def refuse(path):
        raise OSError("no")

    gone.add("x", "y")
    with pytest.raises(OSError, match="2 temporary"):
        gone.clear(refuse)


def test_errors():
    assert errors.explain(analysis.ProviderError("p: HTTP 429: slow")).title == "Rate limit"
    assert errors.explain(writer.WriteConflict("x")).title == "Output exists" and errors.explain(FileNotFoundError("x")).title == "No such file"
    assert errors.explain(RuntimeError("... ProviderError: p: network error: x")).title == "Network" and errors.explain(KeyError("x")).title == "Unexpected error"
    outer = ValueError("outer")
    outer.__cause__ = KeyError("inner")
    assert errors.chain(outer) == ["outer", "'inner'"]


class Told:
    """Answers with the prompt's first words, and knows whether existing rules were in it."""

    def __call__(self):
        return self

    def complete(self, prompt, options):
        return analysis.Answer("# rules" + (" beside others" if "already exist" in prompt else ""), 10, 5)


def test_run_with_services(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    (root / "a.py").write_text("x = 1\n")
    (root / ".windsurfrules").write_text("old rules")
    config = settings.load({"formats": "claude", "on_conflict": "overwrite"}, {}, cwd=str(root))
    asked = []
    with pytest.raises(plan.Declined):
        plan.run(spark, str(root), config, Told(), str(tmp_path / "work"), confirm=lambda c, lines: asked.append(c))
    assert asked and asked[0] > 0 and not (root / "CLAUDE.md").exists()
    result = plan.run(spark, str(root), config, Told(), str(tmp_path / "work"), "2024-01-01", confirm=lambda c, lines: True)
    assert (root / "CLAUDE.md").read_text().endswith("# rules beside others\n") and result.smoke.count() == 0
    kept = state.load(tmp_path / "work" / workspace.STATE)
    assert kept.output_files == ("CLAUDE.md",) and kept.last_run == "2024-01-01" and kept.cost_spent == result.cost > 0
    strict = settings.load({"formats": "json", "no_confirm": True, "on_conflict": "overwrite"}, {}, cwd=str(root))
    with pytest.raises(plan.Declined, match="json"):
        plan.run(spark, str(root), strict, Told(), str(tmp_path / "work2"), on_failure=lambda formats: False)
    with pytest.raises(plan.Declined, match="json"):
        plan.run(spark, str(root), replace(strict, on_failure="cancel"), Told(), str(tmp_path / "work2"))
    anyway = plan.run(spark, str(root), replace(strict, on_failure="write"), Told(), str(tmp_path / "work2"), on_failure=lambda formats: False)
    assert [w.status for w in anyway.written] == ["new"] and "json: FAILED" in reports.validation_lines(anyway.findings) and any("Cost: $" in x for x in anyway.summary)


def test_rules_of_other_tools_are_asked_about(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    (root / "a.py").write_text("x = 1\n")
    (root / ".windsurfrules").write_text("old rules " * 40)
    config = settings.load({"formats": "claude", "on_conflict": "overwrite"}, {}, cwd=str(root))
    asked = []

    def choosing(answer):
        def choose(cost, lines):
            asked.append((cost, lines))
            return answer

        return choose

    run = lambda answer, work, **more: plan.run(spark, str(root), replace(config, **more), Told(), str(tmp_path / work), "2024-01-01", confirm=lambda c, lines: True, choose=choosing(answer))
    with pytest.raises(plan.Declined, match="other tools"):
        run("cancel", "w1")
    assert not (root / "CLAUDE.md").exists() and asked[0][0] > 0 and ".windsurfrules" in asked[0][1][0]
    skipped = run("skip", "w2")
    assert (root / "CLAUDE.md").read_text().endswith("# rules\n") and "deconflict" not in {r["operation"] for r in skipped.calls.collect()}
    gone = run("go", "w3")
    assert (root / "CLAUDE.md").read_text().endswith("# rules beside others\n") and "deconflict" in {r["operation"] for r in gone.calls.collect()}
    n = len(asked)
    run("cancel", "w4", no_confirm=True)
    assert len(asked) == n == 3 and (root / "CLAUDE.md").read_text().endswith("# rules beside others\n")
    with pytest.raises(ValueError, match="perhaps"):
        run("perhaps", "w5")


def test_a_run_reads_what_the_last_one_saved_and_clears_what_is_old(spark, tmp_path):
    root, work = tmp_path / "p", tmp_path / "work"
    root.mkdir()
    (root / "a.py").write_text("x = 1\n")
    config = settings.load({"formats": "claude", "on_conflict": "overwrite"}, {}, cwd=str(root))
    steps = []
    first = plan.run(spark, str(root), config, Told(), str(work), "2024-01-01")
    assert first.previous is None and not any("Last run" in x for x in first.summary)
    for name in ("stages/files", "calls", "requests"):
        os.utime(work / name, (0, 0))
    (work / "stages" / "old").mkdir()
    os.utime(work / "stages" / "old", (0, 0))
    second = plan.run(spark, str(root), config, Told(), str(work), "2024-01-02", progress=steps.append)
    assert second.previous.last_run == "2024-01-01" and second.previous.cost_spent == first.cost and any(x.startswith("Last run: 2024-01-01, $") for x in second.summary)
    assert steps[0].startswith("last run 2024-01-01") and not (work / "stages" / "old").exists() and (work / "stages" / "files").exists()
    answers = len(list((work / "answers").iterdir()))
    swept = workspace.sweep(spark, str(work), 0, now=time.time() + 100)
    assert swept.deleted > 5 and swept.failed == 0 and len(list((work / "answers").iterdir())) == answers
    assert workspace.sweep(spark, str(work), 0) == workspace.Cleaned()
    (work / "stages" / "ahead").mkdir(parents=True)
    os.utime(work / "stages" / "ahead", (time.time() + 1000,) * 2)
    assert workspace.sweep(spark, str(work), 0).skipped == 1
