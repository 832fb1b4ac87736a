import hashlib
import random

import numpy as np
import pytest

from textloom.llm import induced, suffixes


def plain(rows, window=50):
    """The contract over a table of all windows."""
    least = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - window + 1 if doc is not None else 0):
            w = raw[i : i + window]
            least[w] = min(doc, least.get(w, doc))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - window + 1 if doc is not None else 0):
            if least[raw[i : i + window]] < doc:
                gone[i : i + window] = True
        spans = sum(1 for i in range(len(raw)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


SMALL = {"chunk": 3000, "shard": 2000, "hot": 3, "limits": (512, 300, 400)}


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_same_as_a_table_of_all_windows(edge_docs, sizes):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    want = plain(rows)
    assert sum(1 for r in want if r[2]) > 20
    assert got(suffixes.dedup_bytes(edge_docs, **sizes)) == want


def test_the_given_table(corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]
    assert got(suffixes.dedup_bytes(corpus)) == plain(rows)


def test_repeats_of_every_kind(spark):
    draw = random.Random(8)
    letters = lambda n, k="ab": "".join(draw.choices(k, k=n))
    base = letters(120, "abcdefgh é")
    rows = [(9, base), (3, base[10:100]), (9, base), (9, base[:70] + letters(30)), (5, "a" * 400), (6, "a" * 49), (7, "a" * 50 + "b"), (2, None), (4, ""), (None, base), (8, "é" * 60), (11, "x" + "é" * 30), (-1, base[40:95])]
    rows += [(20 + i, letters(8) + base[:60] + letters(60)) for i in range(40)]  # one common passage in many surroundings
    rows += [(90, base[:49]), (91, "ab" * 60), (92, "b" + "ab" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for sizes in ({}, SMALL, SMALL | {"gram": 8, "hot": 2}):
        assert got(suffixes.dedup_bytes(docs, **sizes)) == plain(rows)
    assert got(suffixes.dedup_bytes(docs, window=20, **SMALL)) == plain(rows, 20)
    cut = {r["doc_id"]: r for r in suffixes.dedup_bytes(docs.where("doc_id = 3 or doc_id = 20"), with_text=True).collect()}
    assert cut[3]["text"] is None and bytes(cut[20]["text"]).decode() == rows[13][1].replace(base[10:60], "")
    assert cut[20]["text_sha256"] == hashlib.sha256(rows[13][1].encode()).hexdigest()


def test_an_empty_table_and_other_columns(spark, empty_docs):
    assert got(suffixes.dedup_bytes(empty_docs)) == []
    docs = spark.createDataFrame([(1, None, 5, "p"), (2, "", 6, "q")], "doc_id long, text string, n_bytes int, part string")
    assert got(suffixes.dedup_bytes(docs)) == plain([(1, None), (2, "")])


def naive(chars, limit):
    order = sorted(range(len(chars)), key=lambda i: chars[i:])
    prefix = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while k < limit and max(a, b) + k < len(chars) and chars[a + k] == chars[b + k]:
            k += 1
        prefix.append(k)
    return order, prefix


@pytest.mark.parametrize("limits", [(64 << 20, 1 << 17, 1 << 24), (16, 5, 7), (64, 40, 30)])
def test_suffix_order_and_prefixes_in_memory_and_on_disk(limits):
    draw = random.Random(3)
    for _ in range(400):
        n, k = draw.randint(1, 150), draw.choice([1, 2, 3, 10])
        text = [draw.randint(1, k) for _ in range(n)]
        if draw.random() < 0.4:
            text = text[: n // 2] * 3 + text[n // 2 :]
        chars, limit = np.array([*text, 0], np.uint16), draw.choice([0, 3, 50])
        scratch = induced.Scratch(*limits)
        order, prefix = induced.suffixes(chars, scratch, limit)
        want = naive([*text, 0], limit)
        assert np.asarray(order).tolist() == want[0]
        assert prefix is None if not limit else np.asarray(prefix).tolist() == want[1]
        assert scratch.on_disk if limits[0] < 100 and n > 20 else limits[0] < 100 or not scratch.on_disk


def test_keys_of_windows_depend_on_their_bytes_alone():
    draw = np.random.default_rng(4)
    data = draw.integers(97, 100, 5000).astype(np.uint8)
    ends = np.array([0, 30, 1200, 1249, 1299, 5000])
    key, start, count = suffixes.strings_of(data, ends, slice_bytes=700)
    windows = {int(s + j): int(k) for k, s, n in zip(key, start, count, strict=True) for j in range(n)}
    assert set(windows) == {i for lo, hi in zip([0, *ends], ends, strict=False) for i in range(lo, hi - 49)}
    for i in list(windows)[::97]:
        alone = suffixes.strings_of(data[i : i + 50], np.array([50]))
        assert alone[0].tolist() == [windows[i]] and alone[2].tolist() == [1]
