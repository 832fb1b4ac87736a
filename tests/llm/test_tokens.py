import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from textloom.llm import bpe, packing
from textloom.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def odd_texts():
    draw = random.Random(9)
    alphabet = "aeiou tstrhn\n\t  .,!'‘é日本\x1c\x1d　 0123ABCxyz\U0001f389ſ"
    out = ["".join(draw.choices(alphabet, k=draw.randrange(60))) for _ in range(1500)]
    out += ["".join(draw.choices("ab ", k=40)) for _ in range(300)]
    out += [x * draw.randrange(1, 300) for x in ("a", "ab", "=", "-", " ", "!!", "\n", "aaab", "\x00")]
    return [*out, "a<|endoftext|> b  <|endoftext|>", "<|startoftext|>x", "  \n b", "it's 'LL don't", "ΑΣ ΣΑΣ.", "İ x ́y a ́b", ""]


def test_bpe_same_as_library(corpus):
    model, library = bpe.byte_bpe(BYTES), tokenizers.Tokenizer.from_file(BYTES)
    for text in [r["text"] for r in corpus.collect()] + odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        ids = model.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert model.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_same_as_merging():
    """Every piece's ids are those of merging the lowest rank first."""
    model = bpe.byte_bpe(BYTES)
    draw = random.Random(2)
    for _ in range(400):
        piece = "".join(draw.choices("etaoin shrdlu", k=draw.randint(1, 25))).encode()
        parts = [model.vocab[bytes([b])] for b in piece]
        while True:
            ranked = [(model.rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in model.rank]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [model.vocab[model.content[parts[i]] + model.content[parts[i + 1]]]]
        assert model.piece_ids(piece) == parts


def test_bpe_rows(edge_docs, empty_docs):
    library = tokenizers.Tokenizer.from_file(BYTES)
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, library.encode(r["text"] or "", add_special_tokens=False).ids) for r in edge_docs.collect())
    rows = bpe.encode(edge_docs, BYTES, digests=True).collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"]) for r in rows)
    assert got == sorted((d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for d, i in want)
    assert bpe.encode(empty_docs, BYTES).count() == 0


def test_words_same_as_library(corpus):
    ours, library = packing.word_tokens(WORDS), tokenizers.Tokenizer.from_file(WORDS)
    for text in [r["text"] for r in corpus.collect()] + odd_texts():
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [5000, packing.BLOCK_TOKENS])
def test_packing_is_an_exact_cover(edge_docs, block):
    library = tokenizers.Tokenizer.from_file(WORDS)
    want = defaultdict(list)
    for r in edge_docs.collect():
        want[r["doc_id"]].append([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2])
    rows = packing.pack(edge_docs, WORDS, block_tokens=block, with_ids=True).collect()
    sequences = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0 and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        assert any(len(x) == r["doc_tokens"] and x[r["start"] : r["start"] + r["length"]] == ids for x in want[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(x) for xs in want.values() for x in xs)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 4096 or at & at - 1 == 0
    covered = defaultdict(int)
    for r in rows:
        covered[r["doc_id"], r["start"], r["length"]] += 1
    repeated = [d for d, xs in want.items() if len(xs) > 1]
    for (d, _, _), n in covered.items():
        assert n <= (2 if d in repeated else 1)


def test_balance():
    lengths = [9000, 5, 1, 4096, 300, 300, 2000, 77]
    pieces = packing.balance(lengths)
    for d, n in enumerate(lengths):
        spans = sorted((s, s + k) for e, s, k, _, _ in pieces if e == d)
        assert [s for s, _ in spans] == [0, *(e for _, e in spans[:-1])] and spans[-1][1] == n
    assert packing.capacities(4096 + 5) == [4096, 4, 1] and packing.balance([]) == []


def test_packing_empty(empty_docs):
    assert packing.pack(empty_docs, WORDS).count() == 0
