import hashlib

import pytest

from textloom.llm import substring


def plain(docs, window=50):
    """{doc: (words, removed, digest)} by a table of all windows."""
    words = {d: (t or "").encode().split() for d, t in docs.items()}
    first = {}
    for d, w in words.items():
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()
    return out


@pytest.mark.parametrize("which", ["corpus", "edge_docs"])
@pytest.mark.parametrize("bucket", [60, substring.BUCKET])
def test_same_as_all_windows(which, bucket, request):
    docs = request.getfixturevalue(which)
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    want = plain(texts)
    rows = [r for r in substring.dedup_substrings(docs, bucket=bucket).collect() if r["doc_id"] is not None]
    assert len(rows) == docs.where("doc_id is not null").count()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == want
    assert any(n for _, n, _ in want.values())


def test_small_windows(spark):
    docs = {1: "a b c d e", 2: "x b c d y", 3: "b c d", 4: "c d", 5: "b c d b c d"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = substring.dedup_substrings(df, window=3, gram=2).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == plain(docs, 3)


def test_cut_text_keeps_the_rest():
    import numpy as np

    assert substring.cut_text("  a\nb  c\td \n".encode(), np.array([False, True, True, False])) == b"  a\td \n"


def test_text_agrees_with_digest(edge_docs):
    for r in substring.dedup_substrings(edge_docs, with_text=True).collect():
        if r["text"] is not None:
            assert hashlib.sha256(b" ".join(bytes(r["text"]).split())).hexdigest() == r["kept_sha256"]


def test_empty(empty_docs):
    assert substring.dedup_substrings(empty_docs).count() == 0


@pytest.mark.parametrize("bucket", [1, substring.BUCKET])
def test_two_texts_under_one_id(spark, bucket):
    rows = [(1, "a b c d"), (2, "p q r s t u v b c d w"), (2, "short"), (2, "k l m n o e f g h i j x"), (3, "k l m z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"]): (r["n_removed"], r["text"] and bytes(r["text"])) for r in substring.dedup_substrings(df, 3, 2, bucket, with_text=True).collect()}
    assert got == {(1, 4): (0, None), (2, 11): (3, b"p q r s t u v w"), (2, 1): (0, None), (2, 12): (0, None), (3, 4): (3, b" z")}


@pytest.mark.parametrize("bucket", [300, substring.BUCKET])
def test_a_passage_that_a_third_of_the_documents_share(spark, bucket):
    """Its buckets hold a string of its own for each document, where the passage meets other text; small blocks must agree across."""
    import random

    draw = random.Random(4)
    prose = lambda n: " ".join(str(draw.randrange(3000)) for _ in range(n))
    passage = prose(90)
    texts = {i: f"{prose(draw.randrange(30))} {passage} {prose(draw.randrange(30))}" if i % 3 == 0 else prose(60) for i in range(5, 1500)}
    texts |= {i + 2000: texts[i] for i in range(5, 200)}  # pairs that share more than the passage
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup_substrings(df, bucket=bucket).collect()}
    assert got == plain(texts)


def test_blocks_exchange_few_windows_where_a_passage_meets_other_text(spark, monkeypatch):
    """Nearly all windows of these buckets are a document's own; each was a row of the exchange."""
    import random

    draw = random.Random(7)
    prose = lambda n: " ".join(str(draw.randrange(10**6)) for _ in range(n))
    passage = prose(60)
    texts = {i: f"{prose(60)} {passage} {prose(60)}" for i in range(200)}
    made = {}
    write = substring.materialise
    monkeypatch.setattr(substring, "materialise", lambda df, name: made.setdefault(name, write(df, name)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup_substrings(df, bucket=300).collect()}
    assert got == plain(texts)
    windows = sum(bytes(r["packed"]).count(b" ") - 48 for r in made["packed"].where("blocks > 1").select("packed").collect())
    assert windows > 4000 and 0 < made["seen"].count() < windows / 2


def test_rows_of_equal_text_and_id(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(2, words)] * 5 + [(1, words)] * 3 + [(None, words)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_removed"]) for r in substring.dedup_substrings(df).collect()))
    assert got == [(0, 0)] * 2 + [(1, 0)] * 3 + [(2, 60)] * 5
