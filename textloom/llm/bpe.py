"""Byte-level BPE by dynamic programming over prefixes.

An automaton over the vocabulary reports, for each prefix of a word, the tokens that are suffixes of it. The last token of a
prefix's encoding is unique: it is the suffix token that encodes to itself and is compatible with the last token of the prefix
before it. Storing that token for every prefix and following the back-pointers from the end gives the ids that merging would give.

Two neighbouring tokens are compatible if no merge crosses their boundary: of the tokens along the boundary (the right edge of the
left one's merge tree, the left edge of the right one's), none merges across before it is used up inside its own token.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import LATIN, MARKS, SPACE, Memo, slices, table, texts_of

#: The published pattern of this tokenizer family (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of white space with the text after it; the pattern never joins text to white space that follows it.
_CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: A word and its punctuation, which the pattern always parts.
_PLAIN = re.compile(f"( ?[{LATIN}]+)([{MARKS}]*)")
NEVER = 1 << 60


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: printable Latin-1 ones for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_characters()
        model = spec["model"]
        self.vocab = {bytes(byte[c] for c in k): v for k, v in model["vocab"].items()}
        self.content = {v: k for k, v in self.vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.content |= {v: k.encode() for k, v in self.specials.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        #: (left, right) -> rank of their merge; token -> its two halves and that rank.
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = (self.vocab[bytes(byte[c] for c in x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[a, b] = r
            self.halves.setdefault(self.vocab[self.content[a] + self.content[b]], (a, b, r))
        self.fits: dict[tuple[int, int], bool] = {}
        # Only tokens that encode to themselves can be the last one of a prefix.
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for content, i in self.vocab.items():
            if len(content) == 1 or i in self.halves and self.whole(i):
                self.automaton.add_word(content.decode("latin-1"), (i, len(content)))
        self.automaton.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.pieces = Memo(lambda piece: array("I", self.piece_ids(piece.encode())).tobytes())
        self.chunks = Memo(self.chunk, 1 << 17)

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """(token, rank at which it is used up) down one edge of a token's merge tree; the token itself lasts."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in self.halves:
                return out
            a, b, until = self.halves[token]
            token = b if right else a

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes together encode to just these two."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 1 << 20:
                self.fits.clear()
            known = self.fits[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        rights = self.edge(right, False)
        for a, a_until in self.edge(left, True):
            for b, b_until in rights:
                r = self.rank.get((a, b))
                # Of equal merges the leftmost comes first: on a tie, the left token is already used, the right one isn't yet.
                if r is not None and r < a_until and r <= b_until:
                    return False
        return True

    def whole(self, token: int) -> bool:
        """Whether a token's bytes encode to it alone: its halves do, and they stay apart until they merge."""
        a, b, r = self.halves[token]
        if any(x in self.halves and not self.whole(x) for x in (a, b)):
            return False
        for x, x_until in self.edge(a, True):
            for y, y_until in self.edge(b, False):
                q = self.rank.get((x, y))
                if q is not None and q < r and q < x_until and q <= y_until:
                    return False
        return True

    def piece_ids(self, piece: bytes) -> list[int]:
        """Ids of one pre-tokenised piece."""
        n = len(piece)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        ending: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(piece.decode("latin-1")):
            ending[end].append(match)
        for end in range(1, n + 1):
            for token, length in ending[end - 1]:  # the longest first
                before = last[end - length]
                if end == length or before >= 0 and self.compatible(before, token):
                    last[end], size[end] = token, length
                    break
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def chunk(self, text: str) -> bytes:
        """Ids of a chunk as little-endian 32-bit bytes."""
        if (m := _PLAIN.fullmatch(text)) is None:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        word, marks = m.groups()
        return self.pieces[word] + self.pieces[marks] if marks else self.pieces[word]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit bytes; strings of special tokens become those tokens."""
        if self.split_special is not None and any(s in text for s in self.specials):
            parts = [p for p in self.split_special.split(text) if p]
            return b"".join(np.array([self.specials[p]], "<u4").tobytes() if p in self.specials else self._encode(p) for p in parts)
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text)))

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.content.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_models: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One model for each vocabulary file and worker."""
    if path not in _models:
        _models[path] = ByteBpe(path)
    return _models[path]


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _encode_batches(path: str, digests: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = byte_bpe(path)
    for b in slices(batches, 1, 4 << 20):
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = model.encode(text.decode("utf-8", "replace"))
            decoded = model.decode(ids)
            if digests:
                rows.append((doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            else:
                rows.append((doc, len(ids) // 4, ids, decoded))
        yield table(_DIGESTS if digests else _ENCODED, list(map(list, zip(*rows, strict=True))) if rows else [[]] * 4)


def encode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian 32-bit) and the text decoded from them, or SHA-256 digests of these two.

    A null text is empty: no tokens, empty text. Repeated rows each come back, a null doc_id stays null, other columns are ignored,
    and an empty table gives no rows.
    """
    texts = texts_of(docs)
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    return texts.mapInArrow(partial(_encode_batches, path, digests), f"doc_id long, n_tokens long, {kinds}")
