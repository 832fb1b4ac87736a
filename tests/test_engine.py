import hashlib
import json
import os
import random
import re
import subprocess
import time
from datetime import datetime
from pathlib import Path
from xml.sax.saxutils import escape

import pandas as pd
import pytest
import pyspark.sql.functions as F

from pyspark.sql import Row

from textloom import __main__ as cli
from textloom import config as settings
from textloom import progress, state, workspace
from textloom.functions import paths, text
from textloom.operators import analysis, chunks, corpus, endings, finalise, ledger, reports, structure, switches, validate, writer
from textloom.plans import catalog
from textloom.plans import run as plan
from textloom.sources import git, ignored, packed, splits, tree
from textloom.streaming import retention
from textloom.streaming.refresh import latest, refresh


def values(df):
    return sorted(tuple(r) for r in df.collect())


def column(spark, f, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[1] for r in df.select("i", f(F.col("x"))).orderBy("i").collect()]


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "project"
    for name, body in {
        "src/main.py": "import os\n\n\ndef add(a, b):\n    return a + b\n",
        "src/app.ts": "import x from 'y';\nexport function f(a: number): number {\n  return a + 1;\n}\n",
        "_hidden/.x.md": "# notes\n",
        "build/out.py": "x = 1\n",
        "keep.log": "kept\n",
        "drop.log": "dropped\n",
        ".gitignore": "build/\n*.log\n!keep.log\n",
        ".git/config": "no\n",
        ".textloom/state.json": "{}",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    (root / "bin.dat").write_bytes(b"\xff\xfe\x00")
    os.symlink(root / "src/main.py", root / "link.py")
    return root


def test_tree(spark, project):
    tree.register(spark)
    rows = {r["path"]: r for r in spark.read.format("tree").load(str(project)).collect()}
    assert sorted(rows) == [".gitignore", "_hidden/.x.md", "bin.dat", "keep.log", "src/app.ts", "src/main.py"]
    assert rows["src/main.py"]["language"] == "python" and rows["bin.dat"]["content"] is None and rows["keep.log"]["language"] is None
    only = spark.read.format("tree").option("include", "src/**,*.md").option("exclude", "*.ts").load(str(project))
    assert sorted(r["path"] for r in only.collect()) == ["_hidden/.x.md", "src/main.py"]


def test_tree_errors(spark, project):
    tree.register(spark)
    read = lambda **options: sorted(r["path"] for r in spark.read.format("tree").options(**options).load(str(project)).collect())
    assert read(include="**/*.{py,ts},*.md") == ["_hidden/.x.md", "src/app.ts", "src/main.py"]
    assert tree.split_globs("a, b{c,d}*,{e,f}") == ["a", "b{c,d}*", "{e,f}"]
    with pytest.raises(Exception, match="utf-8"):
        read(on_invalid="fail")
    scandir = os.scandir
    try:  # permissions don't bind everyone, so the listing is made to fail
        os.scandir = lambda p: (_ for _ in ()).throw(PermissionError(p)) if str(p).endswith("_hidden") else scandir(p)
        assert [p for p, _ in tree.walk(str(project))] == [".gitignore", "bin.dat", "keep.log", "src/app.ts", "src/main.py"]
        with pytest.raises(PermissionError):
            list(tree.walk(str(project), fail=True))
    finally:
        os.scandir = scandir


def test_repositories(project, tmp_path):
    assert git.is_repository(project) and git.root_of(project / "src") == project.resolve() and not git.is_repository(tmp_path)
    assert git.is_remote("https://example.org/a.git") and git.is_remote("me@example.org:a/b") and not git.is_remote("a/b") and not git.is_remote("--upload-pack=x")
    made = tmp_path / "origin"
    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q", str(made))
    (made / "x.py").write_text("x = 1\n")
    run("-C", str(made), "add", ".")
    run("-C", str(made), "commit", "-qm", "x")
    assert (git.clone(f"file://{made}", tmp_path / "copy") / "x.py").read_text() == "x = 1\n"
    with pytest.raises(OSError):
        git.clone(f"file://{tmp_path}/nothing", tmp_path / "other")
    with pytest.raises(ValueError):
        git.clone("a/b", tmp_path / "other")


def test_texts(spark):
    assert column(spark, text.whitespace_compressed, "  a   b\t\tc \n\n\n d", "", " \n ") == ["a b c\nd\n", "", ""]
    assert column(spark, text.normalised, "a \r\nb\rc", "a\n\n\n", "", "x\n") == ["a\nb\nc\n", "a\n\n", "", "x\n"]
    assert column(spark, text.redacted, "api_key: abcdefgh12", "Authorization: BEARER abcdefgh.ij", "use sk-abcdefgh12") == ["api_key: [REDACTED]", "Authorization: BEARER [REDACTED]", "use [REDACTED]"]
    assert column(spark, paths.language, "a.py", "a.PY", ".py", "b/c.test.tsx", "x") == ["python", None, None, "typescript", None]
    assert column(spark, paths.rule_type, "Always", "auto-attached", "?") == ["always", "auto", None]
    assert column(spark, lambda c: paths.any_glob(c, ["src/**/*.{rs,py}", "*.m?"]), "src/a.py", "src/a/b.rs", "lib/a.py", "x/y.md") == [True, True, False, True]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "x" * 5000), (2, ""), (3, "y" * 1000), (4, "ab\n" * 900)], "k int, t string")
    config = chunks.ChunkConfig(1000, 100)
    rows = chunks.chunked(df, "k", "t", config).collect()
    assert [(r["start"], r["end"]) for r in sorted(rows, key=lambda r: r["chunk_id"]) if r["k"] == 1] == [(0, 1000), (800, 1800), (1700, 2700), (2600, 3600), (3500, 4500), (4400, 5000)]
    assert [r["token_count"] for r in rows if r["k"] in (2, 3)] == [0, 1000]
    snapped = sorted((r for r in chunks.chunked(df, "k", "t", config, 100).collect() if r["k"] == 4), key=lambda r: r["chunk_id"])
    assert all(r["content"].endswith("\n") for r in snapped) and all(a["end"] >= b["start"] for a, b in zip(snapped, snapped[1:], strict=False)) and snapped[-1]["end"] == 2700
    for bad in ((10000, 10000), (500, 50), (1000, 600)):
        with pytest.raises(ValueError):
            chunks.ChunkConfig(*bad)
    assert chunks.ChunkConfig(50_000).shared == 5000


FILES = [("a", i, "".join(f"{i}:{j} {'é✓' * (j % 7)} {'w ' * (j * 13 % 40)}\n" for j in range(i % 11 * 5))) for i in range(0, 5000, 97)]
FILES += [("a", 10_000, " ".join(map(str, range(6000))) + "\n"), ("b", 1, "one line"), ("c", 2, ""), ("d", 1, "".join(f"{i}\U0001f600" for i in range(3000)))]


def covered(rows, whole, start, end):
    """No gap and no end left out: each chunk lies in the corpus where it says, and begins no later than the one before ends."""
    at = 0
    for r in rows:
        lo, hi = start(r), end(r)
        assert whole[lo:hi] == r["content"] and lo <= at <= hi
        at = hi
    assert at == len(whole)


@pytest.mark.parametrize("config", [chunks.ChunkConfig(1000, 100), chunks.ChunkConfig(1000, 0), chunks.ChunkConfig(1000, 500), chunks.ChunkConfig(1000, 1), chunks.ChunkConfig(5000)])
def test_token_chunks_cover_the_corpus(spark, config):
    """No gap, no tail left out, none over the size, and one character more would be too many."""
    df = spark.createDataFrame(FILES, "k string, i long, t string").repartition(5)
    got = {}
    for r in chunks.token_chunks(df, "k", "i", "t", config).collect():
        got.setdefault(r["k"], []).append(r)
    assert sorted(got) == ["a", "b", "d"] and [(r["chunk_id"], r["content"], r["overlap_token_count"]) for r in got["b"]] == [(0, "one line", 0)]
    count = lambda x: (len(x.encode()) + 3) // 4
    for key in ("a", "d"):
        rows = sorted(got[key], key=lambda r: r["chunk_id"])
        whole = "".join(t for k, _, t in sorted(FILES) if k == key)
        raw = whole.encode()
        place = lambda b, raw=raw: len(raw[:b].decode())
        assert [r["chunk_id"] for r in rows] == list(range(len(rows))) and (len(rows) > 1 or config.size == 5000)
        covered(rows, whole, lambda r: place(r["start"]), lambda r: place(r["end"]))
        for r in rows:
            assert r["token_count"] == count(r["content"]) <= config.size and r["end"] - r["start"] == len(r["content"].encode())
            more = whole[place(r["end"]) :][:1]
            if more and config.shared:
                assert count(r["content"] + more) > config.size
        if config.shared == 0:
            assert "".join(r["content"] for r in rows) == whole and all(r["overlap_token_count"] == 0 for r in rows)
        else:
            assert all(0 < r["overlap_token_count"] <= config.shared for r in rows[1:])


@pytest.mark.parametrize("config", [chunks.ChunkConfig(1000, 100), chunks.ChunkConfig(1000, 0), chunks.ChunkConfig(1000, 500)])
def test_token_chunks_by_a_tokenizer(spark, tmp_path, config):
    """Counts are those of the chunks' own texts, none is over the size, and nothing is left out."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    own = Tokenizer.from_file(path)
    count = lambda x: len(own.encode(x, add_special_tokens=False).ids)
    df = spark.createDataFrame(FILES, "k string, i long, t string").repartition(3)
    staged = []

    def stage(df):
        staged.append(1)
        df.write.parquet(f"{tmp_path}/index")
        return spark.read.parquet(f"{tmp_path}/index")

    got = {}
    for r in chunks.token_chunks(df, "k", "i", "t", config, path, stage).collect():
        got.setdefault(r["k"], []).append(r)
    assert sorted(got) == ["a", "b", "d"] and len(staged) == 1
    for key in got:
        rows = sorted(got[key], key=lambda r: r["chunk_id"])
        whole = "".join(t for k, _, t in sorted(FILES) if k == key)
        assert [r["chunk_id"] for r in rows] == list(range(len(rows)))
        at = 0
        for r in rows:
            lo = whole.rfind(r["content"], 0, at + len(r["content"]))
            assert lo >= 0 and r["token_count"] == count(r["content"]) <= config.size
            at = max(at, lo + len(r["content"]))
        assert at == len(whole)


def test_newline_snap(spark):
    df = spark.createDataFrame([(1, ("ab cd\n" * 400)[:-1]), (2, "z" * 2500), (3, "\n" * 1500)], "k int, t string")
    rows = {(r["k"], r["chunk_id"]): r for r in chunks.chunked(df, "k", "t", chunks.ChunkConfig(1000, 100), 100).collect()}
    assert [rows[1, i]["end"] for i in range(3)] == [996, 1800, 2399] and rows[1, 0]["content"].endswith("\n") and rows[2, 0]["end"] == 1000 and rows[3, 0]["end"] == 1000


def test_outlines():
    py = structure.outline("import os\n# note\n@deco\nclass A(B):\n    x = 1\n    def f(self, a: int = 2) -> int:\n        return a\n\ndef g():\n    pass\n", "python")
    assert "import os" in py and "class A(B):" in py and "def f(self, a: int = 2) -> int: pass" in py and "return" not in py and "@deco" in py and "# note" in py
    ts = structure.outline("// top\nimport a from 'b';\ntype T = { x: number };\nexport class C extends D {\n  private n: number = 1;\n  m(a: string): void {\n    if (a) { run(\"}\"); }\n  }\n}\nfunction f(x) { return `}`; }\nconst g = (a) => { return a; };\n", "typescript")
    assert "import a from 'b';" in ts and "type T = { x: number }" in ts and "export class C extends D {" in ts and "private n: number = 1;" in ts and "m(a: string): void { /* ... */ }" in ts and "run(" not in ts and "const g = (a) => { /* ... */ }" in ts and "// top" in ts
    rs = structure.outline("use x::y;\npub struct S { a: u8 }\nimpl S {\n  pub fn f(&self) -> u8 { self.a }\n}\nfn main() { let c = '}'; }\n", "rust")
    assert "use x::y;" in rs and "pub struct S { a: u8 }" in rs and "pub fn f(&self) -> u8 { /* ... */ }" in rs and "self.a" not in rs and "let c" not in rs
    go = structure.outline("package p\nimport \"fmt\"\ntype T struct {\n\tA int\n}\nfunc (t T) F(a int) error {\n\treturn nil\n}\n", "go")
    assert "type T struct {\n\tA int\n}" in go and "func (t T) F(a int) error { /* ... */ }" in go and "return" not in go
    assert structure.outline("function f( {", "typescript") is None and structure.outline("def f(:", "python") is None and structure.outline("x", "java") is None


def test_packed(spark):
    packs = [
        ("a.md", "## File: x/y.py\n\n```py\nprint(1)\n```\n\n## File: z.md\n```\nhi\n```\n"),
        ("b.xml", '<files><file path="a">1 &lt; 2</file><file path="b"><![CDATA[<x>]]></file></files>'),
        ("c.json", '[{"path": "p", "content": "c"}]'),
        ("d.json", '{"files": {"q": "2", "a": "1"}}'),
        ("e", "nothing"),
        ("f.json", "{broken"),
    ]
    got = values(packed.parsed(spark.createDataFrame(packs, "path string, content string")).select("pack", "path", "content"))
    assert got == [("a.md", "x/y.py", "print(1)\n"), ("a.md", "z.md", "hi\n"), ("b.xml", "a", "1 < 2"), ("b.xml", "b", "<x>"), ("c.json", "p", "c"), ("d.json", "a", "1"), ("d.json", "q", "2"), ("e", "e", "nothing"), ("f.json", "f.json", "{broken")]


PIECES = ["", "a\n", "## File: x\n", "x ## File: y\n\n", "\n\n## File: q\nbody", "<file path='z'>", "]]>", "<!-- c -->", 'q"uo\\te"', "\\", '{"path": "a"}', "é\n✓", "``", '", "', "}, {", ":", "</file>", "<![CDATA["]


def written_pack(draw, kind):
    """Files of a pack and its text, with all that looks like a boundary inside of them."""
    held = [(f"p{draw.randint(0, 9)}/{i}", "".join(draw.choices(PIECES, k=draw.randint(0, 4)))) for i in range(draw.randint(1, 6))]
    if kind == "markdown":
        held = [(p, c) for p, c in held if "```" not in c and not c.endswith("`")]
        head = draw.choice(["", "# Pack\n```\ntree\n```\n\n"])
        return held, head + "".join(f"## File: {p}{chr(10) * draw.randint(1, 3)}```{draw.choice(['', 'py'])}\n{c}```{draw.choice(['', chr(10) * 2, ' x ' + chr(10)])}" for p, c in held)
    if kind == "xml":
        body = lambda c: f"<![CDATA[{c}]]>" if "]]>" not in c and draw.random() < 0.5 else escape(c)
        return held, "<files>" + "".join(draw.choice(["\n", "", "<!-- <file path='no'> -->"]) + f'<file path="{p}">{body(c)}</file>' for p, c in held) + "</files>"
    if kind == "array":
        rows = [draw.choice([{"path": p, "content": c}, {"content": c, "path": p, "n": {"path": "no"}}]) for p, c in held]
        return held, json.dumps(rows, indent=draw.choice([None, 1]), ensure_ascii=draw.random() < 0.5)
    around = [{key: "1"} if draw.random() < 0.3 else {} for key in "vw"]
    return held, json.dumps(around[0] | {"files": dict(held)} | around[1], indent=draw.choice([None, 1]), ensure_ascii=False)


@pytest.mark.parametrize("kind", ["markdown", "xml", "array", "map"])
def test_packs_are_the_same_however_they_are_split(tmp_path, kind):
    draw, path = random.Random(kind), tmp_path / "pack"
    for _ in range(120):
        held, text_ = written_pack(draw, kind)
        path.write_bytes(text_.encode())
        for size in (draw.randint(1, 12), draw.randint(5, 60), 10**6):
            n = path.stat().st_size
            rows = [(f"file:{path}", n, {"array": "json", "map": "json"}.get(kind, kind), i, i * size, min(n, (i + 1) * size)) for i in range(max(1, -(-n // size)))]
            scanned = list(splits._scan(iter([pd.DataFrame(rows, columns=["pack", "size", "kind", "i", "start", "end"])])))
            found = [f for b in splits._parse(iter([splits._folded(pd.concat(scanned))])) for f in zip(b["path"], b["content"], strict=True)]
            assert found == held, (size, text_)


def test_packs_in_splits(spark, tmp_path):
    """Kinds are told by content too; packs that can't be read are one row; no task reads a whole pack."""
    (tmp_path / "in").mkdir()
    texts = [(f"d/{i}.txt", f"text {i} " + "é\n" * (i % 50)) for i in range(300)]
    table = {
        "a.md": "".join(f"## File: {p}\n\n```\n{c}```\n" for p, c in texts), "b": "<files>" + "".join(f'<file path="{p}">{c}</file>' for p, c in texts) + "</files>",
        "c.json": json.dumps([{"path": p, "content": c} for p, c in texts]), "d": json.dumps({"files": dict(texts)}), "e.json": "{broken", "f": "nothing at all", "g.xml": "<files><file>x</file></files>", "h": "",
    }
    for name, body in table.items():
        (tmp_path / "in" / name).write_text(body)
    got = {}
    for r in splits.read(spark, str(tmp_path / "in"), 1000).collect():
        got.setdefault(r["pack"].rsplit("/", 1)[1], []).append((r["ord"], r["path"].removeprefix(f"file:{tmp_path}/in/"), r["content"]))
    whole = [(i, p, c) for i, (p, c) in enumerate(texts)]
    assert all(sorted(got[k]) == whole for k in ("a.md", "b", "c.json", "d"))
    assert all(got[k] == [(0, k, table[k])] for k in ("e.json", "f", "g.xml"))
    packs = spark.read.format("binaryFile").load(str(tmp_path / "in")).select("path", "length")
    by_range = splits.files(packs, 1000).where("pack like '%/in/c.json'").groupBy("i").count().collect()
    assert len(by_range) > 10 and sum(r["count"] for r in by_range) == 300


def test_ranges_are_dealt_to_all_cores(spark, tmp_path):
    """Rows that name ranges are small, and would all be put into one task by their size."""
    (tmp_path / "c.json").write_text(json.dumps([{"path": f"{i}", "content": "x" * 50} for i in range(400)]))
    packs = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    tasks = splits.files(packs, 500).select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks >= spark.sparkContext.defaultParallelism


def test_no_text_of_a_pack_is_staged(spark, tmp_path):
    """Only ranges and their counts are; a pack with an invalid file, and one whose only file begins in a late range, are told by them too."""
    (tmp_path / "in").mkdir()
    for name, body in {"a.xml": "<files>" + "<file path='p'>x</file>" * 40 + "<file>no path</file></files>", "b.md": "-\n" * 300 + "## File: p\n\n```\nx\n```\n"}.items():
        (tmp_path / "in" / name).write_text(body)
    seen = []
    found = splits.read(spark, str(tmp_path / "in"), 100, lambda df: seen.append(df) or df).collect()
    assert sorted((r["pack"][-5:], r["ord"], r["content"][:2]) for r in found) == [("/b.md", 0, "x\n"), ("a.xml", 0, "<f")]
    assert [df.columns[-2:] for df in seen] == [["n", "bad"]] and not {"path", "content"} & set(seen[0].columns)


def test_packs_go_in_waves(spark, tmp_path, monkeypatch):
    """Packs of one wave are there at a time, they and all shuffles are deleted, and a text from four packs takes the room of one."""
    draw = random.Random(4)
    rows = [(2000 * p + i, "".join(draw.choices("abcdefgh ", k=20_000)), "s") for p in (0, 1, 5, 6, 90, 91) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    shared, there, held = Path(catalog.shared_folder(spark)), [], catalog.removed
    tables = set(shared.iterdir())
    monkeypatch.setattr(catalog, "LEAST_PACKS", 2)
    monkeypatch.setattr(catalog, "removed", lambda s, home: (there.append(len(list(Path(home).glob("*/*")))), held(s, home)))
    found = catalog.QUERIES["pack_splits"](spark, str(tmp_path))
    assert there == [8, 8, 8]
    made = set(shared.iterdir()) - tables
    assert not [p for p in made if p.name.startswith("packs-")]
    assert sum(f.stat().st_size for p in made for f in p.rglob("*.parquet")) < sum(len(t) for _, t, _ in rows)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    kinds = ("array", "map", "markdown", "xml")
    assert sorted(map(tuple, found.collect())) == sorted((k, d // 2000, d % 2000, f"s/{d}.txt", t) for d, t, _ in rows for k in kinds)


@pytest.mark.parametrize("ids", [[], [None, None], [-4001, -1, 0, 1999, 2000, None], list(range(0, 90_000, 700)), [0] * 500, [*range(50), 10**9, 10**9 + 2000, 10**9 + 4000, 10**12], list(range(-60_000, 40_000, 900))])
def test_every_document_is_in_one_wave(spark, monkeypatch, ids):
    monkeypatch.setattr(catalog, "LEAST_PACKS", 1)
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(3).withColumn("pack", F.expr("doc_id div 2000"))
    waves = [{tuple(r) for r in docs.where(w).collect()} for w in catalog._waves(docs, 2000)]
    assert sum(map(len, waves)) == len(set(ids)) and {d for w in waves for d, _ in w} == set(ids)
    packs = [{p for _, p in w} for w in waves]
    assert sum(map(len, packs)) == len(set().union(*packs)) and (all(packs) or not ids)


def test_a_range_reads_little_beyond_its_end(tmp_path):
    path = tmp_path / "pack"
    path.write_bytes(b"<file path='a'>" + b"x" * 3_000_000)
    with splits._opened(f"file:{path}") as file:
        span = splits.Span(file, 0, 1000, path.stat().st_size)
        assert span.more() and len(span.data) < 100_000
        assert span.found(lambda d: len(d) > 1_000_000) and len(span.data) < 2_200_000


def test_ends_that_meet(spark):
    """In one sorted pass over many ranges, against all pairs."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("ab/", k=draw.randint(1, 7)))
    for ranges in (1, 3, 40):
        names, held = {word() for _ in range(150)}, {word() for _ in range(12)}
        got = endings.met(spark.createDataFrame([(x,) for x in [*names, "", None]], "ref string"), spark.createDataFrame([(x,) for x in [*held, "", None]], "path string"), "ref", "path", ranges)
        assert {r["ref"] for r in got.collect()} == {n for n in names if any(n.endswith(h) or h.endswith(n) for h in held)}
    none = spark.createDataFrame([], "path string")
    assert endings.met(spark.createDataFrame([("a",)], "ref string"), none, "ref", "path").collect() == []


def test_ignore_rules_as_tables_and_by_the_walker(spark):
    draw = random.Random(6)
    held = ["a.log", "b/a.log", "b/c/keep.log", "build/x", "b/build/y/z", "src/a.py", "src/x/a.py", "doc/t.md", "doc/x/t.md", "[x].txt", "!odd", "#hash", "a+b.c", "deep/a/b/c/d.txt"]
    lines = ["*.log", "!keep.log", "build/", "/src/*.py", "doc/**", "!doc/t.md", "**/y", "[ab].log", "[!a].log", "\\!odd", "\\#hash", "a+b.?", "deep/**/d.txt", "x", "x/", "/x", "!b/", "c/", "**/c/", "t.m[dx]", "# no", ""]
    paths_ = spark.createDataFrame([(p,) for p in held], "path string")
    for _ in range(12):
        own = [(f, "\n".join(draw.sample(lines, draw.randint(0, 4)))) for f in draw.sample(["", "b", "doc", "src", "deep"], draw.randint(1, 3))]

        def out(path, own=own):
            parts = path.split("/")
            for i in range(1, len(parts) + 1):
                node = "/".join(parts[:i])
                above = sorted((x for x in own if x[0] == "" or node.startswith(x[0] + "/")), key=lambda x: len(x[0]))
                if tree.ignored(node, i < len(parts), [r for f, c in above for r in tree.ignore_rules(c, f)]):
                    return True
            return False

        rules = ignored.rules(spark.createDataFrame(own, "folder string, content string"))
        assert {r["path"] for r in ignored.ignored(paths_, rules).collect()} == {p for p in held if out(p)}, own
    assert {r["path"] for r in ignored.kept(paths_, rules).collect()} == {p for p in held if not out(p)}


def test_filters_reach_the_tree(spark, project, tmp_path):
    """Files that a filter leaves out are never opened: they are made unreadable, and nobody notices."""
    tree.register(spark)
    every = sorted((r["path"], r["size"], r["language"], r["content"]) for r in spark.read.format("tree").load(str(project)).collect())
    where = ["language = 'python'", "language is null and size > 3", "path like 'src/%' and language <> 'python'", "path in ('keep.log', 'bin.dat')", "language <=> null and not path like '%.dat'", "size <= 9", "path like '%.py' and content like '%def%'", "not (language = 'python')", "path > 'k' and path <= 'src/app.ts'"]
    for condition in where:
        kept = spark.read.format("tree").load(str(project)).where(condition)
        want = spark.createDataFrame(every, "path string, size long, language string, content string").where(condition)
        assert values(kept.select("path", "size", "language", "content")) == values(want), condition
    reader = tree.TreeReader({"path": str(project)})
    left = list(reader.pushFilters([tree.EqualTo(("language",), "python"), tree.EqualTo(("content",), "x"), tree.Not(tree.IsNull(("language",)))]))
    assert [type(f) for f in left] == [tree.EqualTo] and left[0].attribute == ("content",)
    assert [p for s in reader.partitions() for _, p, _ in s.files] == ["src/main.py"]
    opened = []

    class Spy:
        def __init__(self, real):
            self.real = real

        def __call__(self, path, *a, **k):
            if str(project) in str(path) and not str(path).endswith(".gitignore"):
                opened.append(path)
            return self.real(path, *a, **k)

    tree.open = Spy(open)
    try:
        assert len([r for s in reader.partitions() for r in reader.read(s)]) == 1 and len(opened) == 1
        names = tree.TreeReader({"path": str(project), "content": "false"})
        assert len([r for s in names.partitions() for r in names.read(s)]) == 6 and len(opened) == 1
    finally:
        del tree.open
    assert spark.read.format("tree").option("content", "false").load(str(project)).where("content is not null").count() == 0


def test_sizes_are_observed_and_tasks_are_shown(spark, project, tmp_path):
    """What a run reports of its tables comes with their writing; the steps say how many tasks are done."""
    space = workspace.Workspace(str(tmp_path / "home"), f"{tmp_path}/shared")
    staged = space.stage(spark.range(1000).repartition(3), "numbers", n=F.count("*"), total=F.sum("id"))
    assert space.metrics["numbers"] == {"n": 1000, "total": 499500} and staged.count() == 1000
    said = []
    with progress.Progress(spark, said.append, 0.05) as steps:
        steps("slow")
        slow = F.udf(lambda x: time.sleep(0.2) or x, "long")
        spark.range(8).repartition(8).select(slow("id")).collect()
    assert said[0] == "slow" and any(re.fullmatch(r"slow: \d+ of \d+ tasks", x) for x in said[1:])
    n = len(said)
    spark.range(8).repartition(8).select(slow("id")).collect()
    assert len(said) == n  # it ended with the block


def test_files_that_cannot_be_read(spark, project):
    tree.register(spark)
    for option, n in (("quarantine", 6), ("fail", None)):
        df = spark.read.format("tree").option("on_unreadable", option).load(str(project))
        reader = tree.TreeReader({"path": str(project), "on_unreadable": option})
        shares = reader.partitions()
        (project / "src/main.py").rename(project / "src/main.away")
        try:
            if n:
                rows = [r for s in shares for r in reader.read(s)]
                assert len(rows) == n and [r[1] for r in rows if r[4] is None] == ["bin.dat", "src/main.py"]
            else:
                with pytest.raises(FileNotFoundError):
                    [r for s in shares for r in reader.read(s)]
        finally:
            (project / "src/main.away").rename(project / "src/main.py")
        assert df.count() == 6
    with pytest.raises(ValueError):
        tree.TreeReader({"path": str(project), "on_unreadable": "perhaps"})


def test_without_compression_files_reach_the_prompt_byte_for_byte(spark, project, tmp_path):
    class Keeping(Counting):
        def complete(self, prompt, options):
            with open(self.log + ".prompts", "a") as f:
                f.write(prompt)
            return super().complete(prompt, options)

    body = "def f():\n    if x:\n\treturn  1   \n\n\n"
    (project / "src/main.py").write_text(body)
    client = Keeping(str(tmp_path / "log"))
    result = plan.run(spark, str(project), settings.load({"formats": "claude"}, {}, cwd=str(project)), client, str(tmp_path / "work"))
    assert f"--- src/main.py ---\n{body}\n\n" in open(client.log + ".prompts").read()
    assert not any("Compression" in x for x in result.summary) and "Left out: 1 that aren't readable text" in result.summary
    files = spark.createDataFrame([(0, "a.py", "python", "a  b"), (1, "b", None, "c  d"), (2, "c", None, " e ")], "ord long, path string, language string, original_content string")
    got = values(corpus.compressed(files, F.when(F.col("language") == "python", "out"), F.col("ord") < 2).select("compressed_content", "compression_method"))
    assert got == [(" e ", "none"), ("c d\n", "whitespace"), ("out", "structural")]


def test_validation(spark):
    rows = [
        ("cursor", "---\nname: x\n---\nuse tabs"),
        ("claude", "no heading, see `src/a.py` and `gone/b.rs`"),
        ("generic", "use spaces\n```"),
        ("json", '{"a": 1} x'),
        ("aider", "  "),
    ]
    rendered = spark.createDataFrame(rows, "format string, content string")
    files = spark.createDataFrame([("project/src/a.py",), ("b",)], "path string")
    found = validate.findings(rendered, files)
    got = values(found.select("format", "severity", "message"))
    assert got == sorted([("cursor", "warning", "frontmatter has no description"), ("claude", "error", "no heading"), ("claude", "warning", "path is not in the corpus"), ("generic", "error", "code fence is not closed"), ("json", "error", "json syntax"), ("aider", "error", "content is empty"), ("aider", "error", "content is empty"), ("cross-format", "error", "conflicting indentation_style")])
    assert {r["format"]: r["passed"] for r in validate.results(rendered, found).collect()} == {"cursor": True, "claude": False, "generic": False, "json": False, "aider": False, "cross-format": False}


def test_plain_texts_are_spared_most_patterns(spark):
    """Some thirty patterns over every text took twenty times as long as one."""
    texts = spark.range(0, 400, 1, 4).select(F.lit("generic").alias("format"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" vero at min esse \n"), 3000)).alias("content")).cache()
    texts.count()

    def seconds(df):
        best = 1e9
        for _ in range(3):
            start = time.monotonic()
            df.write.format("noop").mode("overwrite").save()
            best = min(best, time.monotonic() - start)
        return best

    assert seconds(validate.facts(texts)) < 8 * seconds(texts.select(F.regexp_count(F.lower("content"), F.lit(r"\brust\b"))))
    texts.unpersist()


def test_patterns_are_the_same_in_any_case(spark):
    texts = ["USE\tTABS, Use Spaces", "\u00a0", " \t\n\x0b\f\r", "", None, "4 SPACE c# C# c# Rust rUST a/b.c", "Max Width=88 Snake  Case CAMELcase", "OMIT SEMICOLONS 'Single Quotes'", "use \u212aotlin \u017fpaces", "see `x/y.py` no.slash"]
    c = F.col("content")
    plain = [F.trim(F.regexp_replace(c, r"\s+", " ")) == "", c.rlike(validate.TABS) & c.rlike(validate.SPACES), *[F.regexp_count(F.lower(c), F.lit(rf"\b{k}\b" if k != "c#" else r"\bc#")) for k in paths.REALITY]]
    plain += [c.rlike(p) for p in (validate.CAMEL, validate.SNAKE, validate.NO_SEMICOLONS, validate.SINGLE)] + [F.regexp_extract(c, p, 1) for p in (validate.INDENT_WIDTH, validate.LINE_LENGTH)]
    said = validate.stated(c)
    ours = [validate.empty(c), validate.contradiction(c), *[validate.mentions(c)[i]["mentions"] for i in range(len(paths.REALITY))]]
    ours += [said[2].contains("camel"), said[2].contains("snake"), said[4] == "no", said[5] == "single", *[F.coalesce(said[i].cast("string"), F.lit("")) for i in (1, 3)]]
    rows = spark.createDataFrame([(t,) for t in texts], "content string").where("content is not null")
    for r in rows.select("content", F.array(*[x.cast("string") for x in plain]).alias("a"), F.array(*[F.coalesce(x.cast("string"), F.lit("false")) for x in ours]).alias("b")).collect():
        assert r["a"] == r["b"], r["content"]


class Counting:
    """Writes the prompt's digest for each call, for tests on one machine. Prompts that hold ``bad`` fail."""

    def __init__(self, log, answer="# ok description: x", bad=None):
        self.log, self.answer, self.bad = log, answer, bad

    def __call__(self):
        return self

    def complete(self, prompt, options):
        with open(self.log, "a") as f:
            f.write(hashlib.sha256(prompt.encode()).hexdigest() + "\n")
        if self.bad and self.bad in prompt:
            raise analysis.ProviderError("refused")
        return analysis.Answer(self.answer, 10, 5)

    @property
    def asked(self):
        return open(self.log).read().split() if os.path.exists(self.log) else []

    @property
    def calls(self):
        return len(self.asked)


FACTS = "key string, file_count int, languages string, compression_ratio double"


def test_map_and_merge(spark, tmp_path):
    client = Counting(str(tmp_path / "log"))
    parts = spark.createDataFrame([("k", 0, "a"), ("k", 1, "b"), ("single", 0, "c")], "key string, chunk_id int, content string")
    facts = spark.createDataFrame([("k", 2, "python", 0.5), ("single", 1, "go", 1.0)], FACTS)
    for _ in range(2):  # the second run is answered from the store, and its ledger is the same
        desk = analysis.Desk(client, f"{tmp_path}/store")
        whole = values(analysis.merged(analysis.analysed(parts, "key", facts, desk), "key", desk))
        assert whole == [("k", client.answer), ("single", client.answer)]
        assert client.calls == 4
        got = values(desk.ledger(spark).select("operation", "item", "attempt", "input_tokens", "output_tokens"))
        assert got == [("analysis", "k 1", 1, 10, 5), ("analysis", "k 2", 1, 10, 5), ("analysis", "single 1", 1, 10, 5), ("merge", "k", 1, 10, 5)]


def test_a_failing_prompt_costs_no_other_twice(spark, tmp_path):
    parts = spark.createDataFrame([("k", i, f"part {i}.") for i in range(10)], "key string, chunk_id int, content string")
    facts = spark.createDataFrame([("k", 2, "python", 0.5)], FACTS)
    log = str(tmp_path / "log")
    with pytest.raises(analysis.ProviderError, match="refused"):
        analysis.analysed(parts, "key", facts, analysis.Desk(Counting(log, bad="part 3."), f"{tmp_path}/store", 2))
    desk = analysis.Desk(Counting(log), f"{tmp_path}/store", 2)
    assert analysis.analysed(parts, "key", facts, desk).count() == 10 == desk.ledger(spark).count()
    asked = Counting(log).asked
    assert len(set(asked)) == 10 and len(asked) == 11  # the refused one alone was asked again


def test_waves(spark, tmp_path):
    n = 3 * analysis.PER_TASK + 1
    parts = spark.createDataFrame([("k", i, f"part {i}.") for i in range(n)], "key string, chunk_id int, content string")
    client = Counting(str(tmp_path / "log"))
    desk = analysis.Desk(client, f"{tmp_path}/store", 1)
    out = analysis.analysed(parts, "key", spark.createDataFrame([("k", 2, "python", 0.5)], FACTS), desk)
    assert out.count() == n == client.calls and len(os.listdir(tmp_path / "store" / "answers")) == 4 + 1


@pytest.mark.parametrize("seconds", [60, 0])
def test_waves_grow_while_answers_come_fast(spark, tmp_path, monkeypatch, seconds):
    """Each wave is a job, so their number must not grow as the prompts'; where answers are slow, a task keeps to few prompts."""
    monkeypatch.setattr(analysis, "TASK_SECONDS", seconds)
    n = 600 if seconds else 40
    parts = spark.createDataFrame([("k", i, f"part {i}.") for i in range(n)], "key string, chunk_id int, content string")
    client = Counting(str(tmp_path / "log"))
    desk = analysis.Desk(client, f"{tmp_path}/store", 1)
    out = analysis.analysed(parts, "key", spark.createDataFrame([("k", 2, "python", 0.5)], FACTS), desk)
    waves = len(os.listdir(tmp_path / "store" / "answers")) - 1
    assert out.count() == n == client.calls == len(set(client.asked))
    assert waves < 14 if seconds else waves == n // analysis.PER_TASK


def test_fix_loop(spark, tmp_path):
    client = Counting(str(tmp_path / "log"))
    rules = spark.createDataFrame([("claude", "bad"), ("generic", "fine")], "format string, content string")
    out, attempts, clean = analysis.fixed(rules, validate.syntax, analysis.Desk(client, f"{tmp_path}/store"))
    assert (attempts, clean, client.calls) == (1, True, 1) and values(out) == [("claude", client.answer, 1), ("generic", "fine", 0)]
    still = Counting(str(tmp_path / "log2"), "no heading")
    desk = analysis.Desk(still, f"{tmp_path}/store2")
    assert analysis.fixed(rules, validate.syntax, desk)[1:] == (3, False)
    cost = reports.cost_by_operation(desk.ledger(spark), 0.003, 0.015).collect()
    assert [(r["operation"], r["operations"], r["input_tokens"], r["total_cost"]) for r in cost] == [("fix", 3, 30, pytest.approx(30 / 1000 * 0.003 + 15 / 1000 * 0.015))]


def test_rounds_read_failing_rules_only(spark, tmp_path):
    """Rules that pass are looked at once; each round looks at what failed in the one before."""
    rows = [(f"claude:{i}", "# ok") for i in range(40)] + [("claude:90", "```"), ("claude:91", "bad ``` use tabs, use spaces"), ("cursor:92", "---\nx")]
    seen = []

    def find(rows):
        seen.append(rows.count())
        return validate.syntax(rows).unionByName(validate.contradictions(rows))

    desk = analysis.Desk(analysis.RepairProvider, f"{tmp_path}/store")
    out, attempts, clean = analysis.fixed(spark.createDataFrame(rows, "format string, content string"), find, desk)
    got = {r["format"]: (r["content"], r["attempts"]) for r in out.collect()}
    assert seen == [43, 3, 2, 1] and attempts == 3 and clean and len(got) == 43
    assert got["claude:90"] == ("# Rules\n```\n```", 2) and got["cursor:92"] == ("\nx", 1) and got["claude:0"] == ("# ok", 0)
    assert got["claude:91"] == ("# Rules\nbad ``` no tabs, use spaces\n```", 3)
    assert desk.ledger(spark).count() == 6
    assert analysis.fixed(spark.createDataFrame([], "format string, content string"), find, desk)[1:] == (0, True)


def test_retries():
    def failing(retry):
        calls = []

        def call():
            calls.append(1)
            raise analysis.ProviderError("x", retry)

        with pytest.raises(analysis.ProviderError):
            analysis.with_retries(call, 3, sleep=lambda s: None)
        return len(calls)

    assert failing(True) == 4 and failing(False) == 1
    waits = []
    with pytest.raises(analysis.ProviderError):
        analysis.with_retries(lambda: (_ for _ in ()).throw(analysis.ProviderError("x", True)), 3, 1000, 3000, waits.append, lambda: 1.0)
    assert waits == [1.0, 2.0, 3.0]


def test_template_is_filled_once(spark):
    out = spark.range(1).select(analysis.rendered("{{a}}-{{b}}", a=F.lit("{{b}}"), b=F.lit("x"))).first()[0]
    assert out == "{{b}}-x"


def test_header_after_frontmatter(spark):
    rules = spark.createDataFrame([("cursor", "---\ndescription: x\n---\nbody"), ("json", "{}"), ("claude", "# a")], "format string, content string")
    got = dict(values(finalise.finalised(rules, "p", "m", "t", (1, 2, 0.5))))
    assert "1 + 2 tokens, $0.5000" in got["claude"]
    assert dict(values(finalise.finalised(rules, "p", "m", "t", (1, 2, 0.5), normalise=False, header=False))) == {"cursor": "---\ndescription: x\n---\nbody", "json": "{}", "claude": "# a"}
    assert got["cursor"].startswith("---\ndescription: x\n---\n<!-- generated t") and got["json"] == "{}\n" and got["claude"].startswith("<!--")


def test_writes_and_backups(spark, tmp_path):
    (tmp_path / "CLAUDE.md").write_text("old")
    plan_rows = lambda action: spark.createDataFrame([("claude", "CLAUDE.md", action, "new")], "format string, path string, action string, content string")
    assert writer.write(plan_rows("skip"), str(tmp_path))[0].status == "skipped" and (tmp_path / "CLAUDE.md").read_text() == "old"
    for _ in range(7):
        assert writer.write(plan_rows("overwrite"), str(tmp_path))[0].status == "backup"
        time.sleep(0.002)
    assert len(list(tmp_path.glob("CLAUDE.md*.bak"))) == 5
    assert writer.write(plan_rows("merge"), str(tmp_path))[0].status == "merged" and (tmp_path / "CLAUDE.md").read_text() == "new"


def held_files(root):
    return {str(p.relative_to(root)): p.read_text() for p in sorted(root.rglob("*")) if p.is_file()}


def test_a_write_is_done_as_a_whole_or_not_at_all(spark, tmp_path):
    schema = "format string, path string, action string, content string"
    for name in ("a.md", "c.md"):
        (tmp_path / name).write_text(f"old {name}")
    (tmp_path / "file").write_text("not a folder")
    before = held_files(tmp_path)
    rows = [(c, f"{c}.md", "overwrite", f"new {c}") for c in "abcd"]

    @F.udf("string")
    def broken(content):
        if content == "new d":
            raise RuntimeError("a task fails")
        return content

    with pytest.raises(Exception, match="a task fails"):
        writer.write(spark.createDataFrame(rows, schema).repartition(4).withColumn("content", broken("content")), str(tmp_path))
    assert held_files(tmp_path) == before and not list((tmp_path / ".textloom/staged").iterdir())
    for bad, match in ((("z", "file/x.md", "create", "x"), "irectory|exists"), (("z", "a.md", "create", "twice"), "more than one"), (("z", "../x.md", "create", "x"), "outside"), (("z", "/x.md", "create", "x"), "outside")):
        with pytest.raises(Exception, match=match):
            writer.write(spark.createDataFrame([*rows, bad], schema).repartition(3), str(tmp_path))
        assert held_files(tmp_path) == before  # what was published before the failure is put back
    done = writer.write(spark.createDataFrame(rows, schema).repartition(3), str(tmp_path))
    assert [(w.format, w.status) for w in done] == [("a", "backup"), ("b", "new"), ("c", "backup"), ("d", "new")]
    after = held_files(tmp_path)
    assert after == before | {f"{c}.md": f"new {c}" for c in "abcd"} | {"a.md.bak": "old a.md", "c.md.bak": "old c.md"}


def test_rules_of_very_many_projects_are_written(spark, tmp_path):
    n = 10_000
    rows = spark.range(n).selectExpr("concat('claude:', id) as format", "concat('p', id % 100, '/', id, '/CLAUDE.md') as path", "if(id % 10 = 0, 'skip', 'create') as action", "repeat(cast(id as string), 50) as content")
    done = writer.write(rows, str(tmp_path))
    assert len(done) == n and sum(w.status == "skipped" for w in done) == n // 10
    assert (tmp_path / "p37/1037/CLAUDE.md").read_text() == "1037" * 50 and not (tmp_path / "p0/1000").exists() and not list((tmp_path / ".textloom/staged").iterdir())


def test_conflicts_are_settled(spark):
    row = lambda f, a: Row(format=f, path=f + ".md", action=a)
    rows = [row("d", "ask"), row("a", "create"), row("b", "ask"), row("c", "ask")]
    answers = iter(["skip", "overwrite all"])
    assert writer.settled(rows, lambda path, format_: next(answers)) == [("a", "a.md", "create"), ("b", "b.md", "skip"), ("c", "c.md", "overwrite"), ("d", "d.md", "overwrite")]
    with pytest.raises(writer.WriteConflict, match="stopped"):
        writer.settled(rows, lambda path, format_: "quit")
    for bad in (rows, [row("a", "error")]):
        with pytest.raises(writer.WriteConflict, match="--on-conflict"):
            writer.settled(bad)
    with pytest.raises(ValueError):
        writer.settled(rows, lambda path, format_: "perhaps")


def test_questions_at_the_terminal():
    replies = lambda *r: (lambda it: lambda question: next(it))(iter(r))
    assert cli.chosen("p", "claude", replies("?", "O")) == "overwrite" and cli.chosen("p", "claude", replies("q")) == "quit"
    assert cli.chosen("p", "claude", replies("all", "what", "a", "m")) == "merge all"


@pytest.mark.parametrize("strategy", ["prompt", "smart-merge"])
def test_conflicts_end_a_run_before_it_pays(spark, project, tmp_path, strategy):
    (project / "CLAUDE.md").write_text("# mine\n")
    config = settings.load({"formats": "claude,generic", "on_conflict": strategy}, {}, cwd=str(project))
    client = Counting(str(tmp_path / "log"))
    with pytest.raises(writer.WriteConflict):
        plan.run(spark, str(project), config, client, str(tmp_path / "work"))
    assert client.calls == 0 and (project / "CLAUDE.md").read_text() == "# mine\n" and not (project / "AI_RULES.md").exists()


def test_smart_merge(spark, project, tmp_path):
    (project / "CLAUDE.md").write_text("# mine\nkeep this\n")
    config = settings.load({"formats": "claude,generic", "on_conflict": "smart-merge"}, {}, cwd=str(project))
    client = Counting(str(tmp_path / "log"))
    asked = []
    result = plan.run(spark, str(project), config, client, str(tmp_path / "work"), "2024-01-01", confirm=lambda cost, lines: not asked.append(lines), ask=lambda path, format_: "skip")
    assert [(w.format, w.status) for w in result.written] == [("claude", "merged"), ("generic", "new")] and client.calls == 4
    assert len(asked) == 2 and "Smart merge of claude" in asked[1][0] and any("Tokens:" in x for x in asked[0])
    calls = values(result.calls.groupBy("operation").count())
    assert calls == [("analysis", 1), ("format", 2), ("smart merge", 1)]
    total = 4 * (10 / 1000 * 0.003 + 5 / 1000 * 0.015)
    kept = state.load(tmp_path / "work" / "state.json")
    assert result.cost == kept.cost_spent == pytest.approx(total) and f"40 + 20 tokens, ${total:.4f}" in (project / "CLAUDE.md").read_text()
    assert list(project.glob("CLAUDE.md.bak"))[0].read_text() == "# mine\nkeep this\n"
    with pytest.raises(plan.Declined, match="merge"):
        plan.run(spark, str(project), config, client, str(tmp_path / "work"), confirm=lambda cost, lines: "Smart" not in lines[0], ask=lambda path, format_: "merge")


def test_config(tmp_path):
    (tmp_path / "textloom.toml").write_text('include = ["*.py"]\n[general]\nprovider = "openai"\nchunk_size = 2000\n[output]\nformats = ["claude", "json"]\n')
    load = lambda flags=None, env=None: settings.load(flags, env or {}, cwd=str(tmp_path))
    assert (load().provider, load().chunk_size, load().formats, load().include, load().compress) == ("openai", 2000, ("claude", "json"), ("*.py",), False)
    assert load(env={"TEXTLOOM_PROVIDER": "ollama", "TEXTLOOM_COMPRESS": "true"}).provider == "ollama"
    assert load({"provider": "anthropic"}, {"TEXTLOOM_PROVIDER": "ollama"}).provider == "anthropic"
    assert load({"on_conflict": "nonsense"}).on_conflict == "prompt"
    for bad in ({"formats": "nope"}, {"chunk_size": 10}, {"output": "x"}):
        with pytest.raises(ValueError):
            load(bad)
    (tmp_path / "textloom.toml").write_text("[validation]\nenabled = false\nretry_on_failure = true\n[validation.semantic]\ncheck_reality = false\n[validation.format_overrides.json]\ncheck_consistency = false\n[finalization]\ninject_metadata = false\n[providers.ollama]\nhost = 'http://h'\nmodel = 'm'\n")
    got = load()
    assert (got.validate, got.retry_on_validation_failure, got.checks, got.format_checks, got.header, got.normalise, got.providers) == (False, True, {"reality": False}, {"json": {"consistency": False}}, False, True, {"ollama": {"host": "http://h", "model": "m"}})
    for bad in ({"checks": {"nothing": True}}, {"format_checks": {"nobody": {}}}, {"on_failure": "perhaps"}):
        with pytest.raises(ValueError):
            load(bad)
    (tmp_path / "empty").mkdir()
    assert settings.load({}, {}, cwd=str(tmp_path / "empty")).chunk_size == 100_000


def test_state(tmp_path):
    path = tmp_path / "state.json"
    assert state.load(path) is None
    state.save(state.State(cost_spent=1.5, output_files=("a",)), path)
    assert state.load(path).cost_spent == 1.5 and state.load(path).output_files == ("a",)
    for bad in ("{", "[]", '{"compression_ratio": 2.0}', '{"cost_spent": -1}'):
        path.write_text(bad)
        assert state.load(path) is None


def test_whole_run(spark, project, tmp_path):
    config = settings.load({"formats": "claude,generic", "compress": True, "on_conflict": "overwrite"}, {}, cwd=str(project))
    dry = plan.run(spark, str(project), settings.load({"dry_run": True}, {}, cwd=str(project)))
    assert {r["language"]: r["files"] for r in dry.report.collect()} == {"python": 1, "typescript": 1, "unknown": 3} and not dry.written
    client = Counting(str(tmp_path / "log"))
    result = plan.run(spark, str(project), config, client, str(tmp_path / "work"), "2024-01-01")
    assert [(w.path, w.status) for w in result.written] == [("CLAUDE.md", "new"), ("AI_RULES.md", "new")]
    assert client.calls == 3 and (project / "CLAUDE.md").read_text().endswith("# ok description: x\n")
    assert all(r["passed"] for r in result.results.collect())


def test_roll_up(spark):
    rows = [("a", "x", 1, 10, 4), ("a", "x", 2, 20, 8), ("a", None, 1, 1, 0), ("b", "x", 1, 5, 4)]
    got = values(ledger.rollup(spark.createDataFrame(rows, "project string, operation string, attempt int, input_tokens long, output_tokens long"), 1.0, 2.0, "project", "operation", "attempt").select("project", "operation", "attempt", "level", "operations", "input_tokens", "total_cost").na.fill("all"))
    cost = lambda i, o: i / 1000 * 1.0 + o / 1000 * 2.0
    assert got == sorted([
        ("a", "x", "1", 0, 1, 10, cost(10, 4)), ("a", "x", "2", 0, 1, 20, cost(20, 8)), ("a", "none", "1", 0, 1, 1, cost(1, 0)), ("b", "x", "1", 0, 1, 5, cost(5, 4)),
        ("a", "x", "all", 1, 2, 30, cost(30, 12)), ("a", "none", "all", 1, 1, 1, cost(1, 0)), ("b", "x", "all", 1, 1, 5, cost(5, 4)),
        ("a", "all", "all", 2, 3, 31, cost(31, 12)), ("b", "all", "all", 2, 1, 5, cost(5, 4)), ("all", "all", "all", 3, 4, 36, cost(36, 16)),
    ])
    assert ledger.rollup(spark.createDataFrame([], "operation string, input_tokens long, output_tokens long"), 1.0, 1.0, "operation").where("operations > 0").count() == 0


def test_layered_switches(spark):
    """Against the switches of a run's own configuration, for every mix of layers."""
    draw = random.Random(3)
    some = lambda: {c: draw.choice([True, False]) for c in validate.CHECKS if draw.random() < 0.5}
    users, projects = {"u": some(), "v": some()}, {i: some() for i in range(6)}
    overrides = {(i, f): some() for i in range(7) for f in ("cursor", "claude") if draw.random() < 0.5}
    formats = [("u" if i % 2 else "w" if i == 4 else "v", i, f) for i in range(7) for f in ("cursor", "claude", "aider")]
    rows = lambda table, key: [(*(k if isinstance(k, tuple) else (k,)), *(v.get(c) for c in validate.CHECKS)) for k, v in table.items()]
    checks = ", ".join(f"{c} boolean" for c in validate.CHECKS)
    out = switches.resolved(spark.createDataFrame(formats, "user string, project int, format string"), spark.createDataFrame(rows(users, 1), f"user string, {checks}"), spark.createDataFrame(rows(projects, 1), f"project int, {checks}"), spark.createDataFrame(rows(overrides, 2), f"project int, format string, {checks}"))
    every = dict.fromkeys(validate.CHECKS, True)
    want = sorted((u, p, f, *(every | (overrides[p, f] if (p, f) in overrides else users.get(u, {}) | projects.get(p, {}))).values()) for u, p, f in formats)
    assert values(out.select("user", "project", "format", *validate.CHECKS)) == want


def test_switches(spark):
    text = "use tabs and use spaces, kotlin kotlin kotlin, see `gone/b.rs`"
    rows = spark.createDataFrame([("claude:1", "# a\n" + text), ("generic:1", "use tabs, double quotes " + text), ("generic:2", "double quotes"), ("nobody", "x"), ("aider:2", None)], "format string, content string")
    files = spark.createDataFrame([("a.py",)], "path string")
    both, path, unreal = "tabs and spaces are both prescribed", "path is not in the corpus", "language has no file"
    always = [("aider:2", "format was not rendered"), ("nobody", "no rules for this format")]
    seen = lambda *a, **k: sorted((r["format"], r["message"]) for r in validate.findings(rows, files, *a, **k).collect())
    own = [("claude:1", both), ("claude:1", path), ("claude:1", unreal), ("generic:1", both), ("generic:1", path), ("generic:1", unreal)]
    assert seen() == sorted(always + own)
    assert seen(defaults={"paths": False, "reality": False}) == sorted(always + [("claude:1", both), ("generic:1", both)])
    off = dict.fromkeys(validate.CHECKS, False)
    assert seen(defaults=off) == sorted(always)
    assert seen({"generic": {"paths": False}}, off) == sorted(always + [("generic:1", both), ("generic:1", unreal)])


def test_conventions_by_hand(spark):
    texts = [
        "Use tabs. Max line length: 100. Single quotes.", "use  spaces, 4-space indent; camel case and snake_case", "2\n-\nspaces; dont use semicolons; line chars=88", "Omit semicolon, double quote, maximumwidth of 79",
        "camel_case camelcased linewidth 30", "Always use semicolons, avoid semicolons, max width 501", "99999999999 spaces, snakecase", "reuse tabs, misuse spaces", "",
    ]
    want = [
        ("tabs", None, "", 100, None, "single"), ("spaces", 4, "camelCase,snake_case", None, None, None), (None, 2, "", 88, "use", None), (None, None, "", 79, "no", "double"),
        (None, None, "", None, None, None), (None, None, "", None, "use", None), (None, None, "snake_case", None, None, None), (None, None, "", None, None, None), (None, None, "", None, None, None),
    ]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "format string, content string")
    assert [tuple(r)[1:] for r in sorted(validate.conventions(rows).collect(), key=lambda r: int(r["format"]))] == want


def test_consistency_by_project(spark):
    rows = [("cursor:1", "use tabs"), ("claude:1", "use spaces"), ("aider:1", "single quotes"), ("cursor:2", "use tabs, single quotes"), ("claude:2", "single quotes"), ("aider:2", "")]
    found = values(validate.cross_format(spark.createDataFrame(rows, "format string, content string")).select("format", "message", "location"))
    assert found == [("cross-format:1", "conflicting indentation_style", "claude:1=spaces, cursor:1=tabs"), ("cross-format:1", "missing indentation_style", "aider:1"), ("cross-format:2", "missing quote_style", "aider:2")]


def test_structural_ratio(spark):
    body = "\n".join(f"def f{i}(a):\n    '''doc'''\n" + "    x = a + 1\n" * 10 + "    return x" for i in range(10))
    files = spark.createDataFrame([(0, "a.py", "python", body), (1, "b.py", "python", "def ("), (2, "c.txt", None, "a  b")], "ord long, path string, language string, original_content string")
    rows = {r["path"]: r for r in corpus.compressed(files, structure.structural(F.col("original_content"), F.col("language"))).collect()}
    assert rows["a.py"]["compression_method"] == "structural" and rows["a.py"]["compressed_size"] < 0.35 * rows["a.py"]["original_size"]
    assert rows["b.py"]["compression_method"] == "whitespace" == rows["c.txt"]["compression_method"]


def test_stream(spark, tmp_path):
    schema, target = "path string, version long, content string", f"{tmp_path}/out"
    batches = [[("a", 1, "x"), ("b", 1, "y")], [("a", 3, "z"), ("a", 2, "old"), ("c", 1, "w")], [("d", 1, "v")], [("a", 1, "late"), ("b", 2, "u")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        refresh(stream, target, f"{tmp_path}/cp", buckets=64).awaitTermination()
    assert values(latest(spark, target, 3)) == [("a", 3, "z"), ("b", 2, "u"), ("c", 1, "w"), ("d", 1, "v")]
    assert values(latest(spark, target, 2)) == [("a", 3, "z"), ("b", 1, "y"), ("c", 1, "w"), ("d", 1, "v")]
    with pytest.raises(ValueError, match="knows nothing"):
        refresh(stream, target, f"{tmp_path}/cp-new", buckets=64)
    held = {str(p.relative_to(tmp_path / "out/data")).split("/")[0] for p in (tmp_path / "out/data").glob("v=*/bucket=*")}
    first = [p.name for p in (tmp_path / "out/data/v=0").glob("bucket=*")]
    assert held == {"v=0", "v=1", "v=2", "v=3"} and len(first) == 1  # the part of a that batch 1 replaced is gone, that of b is not


def test_retention_as_a_stream(spark, tmp_path):
    """Late rows, restarts and repeats; the end is what a batch job over all rows expires."""
    retention.ready(spark)
    draw = random.Random(8)
    rows = [(f"f{draw.randint(0, 3)}", datetime(2024, 1, 1, 0, 0, draw.randint(0, 40)), i) for i in range(120)] + [(None, datetime(2024, 1, 1), 900), ("f0", None, 901)]
    draw.shuffle(rows)
    schema = "file string, t timestamp, id long"
    for part in (rows[:10], rows[10:70], rows[70:], rows[:5]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = retention.expired(stream, "file", "t", "id")
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {(r["file"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = set()
    for f in {f for f, _, _ in rows if f}:
        own = sorted(((t, i) for g, t, i in rows if g == f and t is not None), reverse=True)
        want |= {(f, i) for _, i in own[5:]}
    assert got == want
    timed = retention.expired(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "file", "t", "id", idle_ms=3_600_000)
    query = timed.writeStream.format("memory").queryName("timed").option("checkpointLocation", f"{tmp_path}/cp2").start()
    for _ in range(100):
        if spark.table("timed").count() >= len(want):
            break
        time.sleep(0.3)
    query.stop()
    assert {(r["file"], r["id"]) for r in spark.table("timed").collect()} == want
