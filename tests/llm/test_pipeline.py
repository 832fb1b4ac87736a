import numpy as np

import corpus_pipeline
from textloom.llm import packing, secret_scan, toxicity
from textloom.llm.queries import tokenizer_path

from .test_simhash import plain_components, plain_fingerprint
from .test_substring import plain


def test_stages_against_plain_versions(spark, corpus, sf, tmp_path):
    docs, kept = corpus, [corpus.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == corpus.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(docs.collect())
    by_id = [{r["doc_id"]: r for r in rows} for rows in kept]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.score(corpus, labels).where("predicted = 1").collect()}
    assert set(by_id[1]) == set(by_id[0]) - toxic
    component = plain_components({d: plain_fingerprint(r["text"]) for d, r in by_id[1].items()})
    assert set(by_id[2]) == {d for d, c in component.items() if d == c}
    cut = plain({d: r["text"] for d, r in by_id[2].items()})
    assert set(by_id[3]) == {d for d, (n, gone, _) in cut.items() if not gone or gone < n}
    for d, r in by_id[3].items():
        n, gone, _ = cut[d]
        assert len((r["text"] or "").encode().split()) == n - gone and r["n_chars"] == len(r["text"])
        if not gone:
            assert r == by_id[2][d]
    assert set(by_id[4]) == set(by_id[3])
    for d, r in by_id[4].items():
        if not secret_scan.base_spans(by_id[3][d]["text"]):
            continue
        assert "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])
    encode = packing.word_tokens(tokenizer_path("word_bpe_49k.json")).encode
    pieces: dict = {}
    for r in kept[5]:
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    assert {d: b"".join(x for _, x in sorted(p)) for d, p in pieces.items()} == {d: encode(r["text"]) + np.array([2], "<u4").tobytes() for d, r in by_id[4].items()}


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert "sequence_id" in out.columns and out.count() > 0


def test_edges(spark, edge_docs, empty_docs, sf):
    clash = {"new_text": "text", "emptied": "doc_id", "score": "lang"}
    for docs in (edge_docs, empty_docs):
        docs = docs.withColumns({new: docs[old] for new, old in clash.items()})
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, sf)
            assert docs.columns == columns
        assert docs.where("doc_id = 0").count() == docs.where("doc_id is not null").limit(1).count()


def test_every_row_gets_its_own_decision(spark, corpus, sf):
    scores = toxicity.score(corpus, spark.read.parquet(f"{sf}/labels.parquet"))
    text = {r["doc_id"]: r["text"] for r in corpus.collect()}
    toxic = min((r["doc_id"] for r in scores.where("predicted = 1").collect()))
    clean = min((r["doc_id"] for r in scores.where("predicted = 0").collect()))
    added = [(None, text[toxic]), (None, text[clean]), (clean, text[toxic]), (toxic, text[clean])]
    docs = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(added, "doc_id long, text string"))
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()]
    assert [kept.count(x) for x in added] == [0, 1, 0, 1]
    assert kept.count((toxic, text[toxic])) == 0 and kept.count((clean, text[clean])) == 1

    secret = "password = hunter2hunter2 end"
    rows = [(None, secret), (None, "no id"), (None, None), (5, secret), (5, "clean words"), (5, "token: abcdefgh1"), (6, secret), (6, secret)]
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows], "doc_id long, text string, n_chars long")
    got = sorted((tuple(r) for r in corpus_pipeline.redact_secrets(spark, docs, sf).collect()), key=str)
    new = {secret: "password = [SECRET] end", "token: abcdefgh1": "token: [SECRET]"}
    assert got == sorted(((d, t, len(t or "")) for d, t in ((d, new.get(t, t)) for d, t in rows)), key=str)

    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (2, "head " + words), (2, "other text"), (3, words), (3, "another one")]
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long")
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.cut_repeats(spark, docs, sf).collect()) == [(1, words), (2, "head"), (2, "other text"), (3, "another one")]
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()) == [rows[0], rows[2]]

    draw = np.random.default_rng(2)
    text = [f"w{x}" for x in draw.integers(0, 10**6, 3000)]
    rows = [(1, " ".join(text)), (5, " ".join([*text[:1500], "other", *text[1501:]])), (5, words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()) == [rows[0], rows[2]]
