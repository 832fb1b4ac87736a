"""Packing token sequences: cost-balanced, without padding.

Attention costs a linear plus a quadratic share of a piece's length. Within a block of documents, the longest document comes first
and each piece goes to the sequence of lowest cost so far that has token capacity left; what doesn't fit is cut and goes on to the
next. A block's sequences have 4096 tokens each; what remains of its tokens becomes sequences of powers of two, which need no padding.

Blocks are runs of an input partition, so nothing is shuffled and a lost task is simply run again.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import byte_characters
from .common import LATIN, MARKS, SPACE, Memo, slices, table, texts_of

CAPACITY = 4096
END = 2
#: Tokens of a block, which a task holds at once (4 bytes each); a longer document is a block of its own.
BLOCK_TOKENS = 2_000_000
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

#: Text between white space, where the tokenizer's pattern always cuts.
_CHUNK = re.compile(f"[^{SPACE}]+")
#: A word, which the pattern always parts from the punctuation after it.
_LATIN = re.compile(f"[{LATIN}]+")
#: The only characters at which ``str.split`` cuts and the pattern doesn't.
_ODD = "\x1c\x1d\x1e\x1f"


class WordTokens:
    """Encoder of text to ids as little-endian 32-bit bytes. The tokenizer never joins text across white space, so chunks between it
    are encoded once and remembered; a word with punctuation or capitals is put together from its plain word and its marks."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.byte_text = {b: c for c, b in byte_characters().items()}
        self.chunks = Memo(self.chunk, 1 << 19)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a normalised piece straight from the tokenizer's model, which takes each UTF-8 byte as its character."""
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.byte_text)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(MARKS)
        if not (word.isalpha() if word.isascii() else _LATIN.fullmatch(word)):
            return self.whole(chunk) if word else self.word(chunk)
        low = word.lower()
        if low == chunk:
            return self.word(chunk)
        ids = self.chunks[low]
        return ids if len(word) == len(chunk) else ids + self.chunks[chunk[len(word) :]]

    def encode(self, text: str) -> bytes:
        chunks = _CHUNK.findall(text) if any(c in text for c in _ODD) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One encoder for each vocabulary file and worker."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def capacities(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the sequences that hold ``total`` tokens: full ones, then the powers of two of the remainder."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def balance(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that fill all sequences. Ties go to the earlier document or sequence."""
    room = capacities(sum(lengths), capacity)
    heap = [(0.0, s) for s in range(len(room))]
    filled = [0] * len(room)
    pieces = []
    for d in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start = 0
        while start < lengths[d]:
            cost, s = heapq.heappop(heap)
            n = min(lengths[d] - start, room[s] - filled[s])
            pieces.append((d, start, n, s, filled[s]))
            filled[s] += n
            start += n
            if filled[s] < room[s]:
                heapq.heappush(heap, (cost + LINEAR * n + QUADRATIC * n * n, s))
    return pieces


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pack_batches(path: str, capacity: int, block_tokens: int, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode, end = word_tokens(path).encode, np.array([END], "<u4").tobytes()
    # Sequences are numbered from the partition's own range: 2 ** 40 for each.
    number = TaskContext.get().partitionId() << 40
    block: list[tuple[int, bytes]] = []
    size = 0

    def packed() -> Iterator[pa.RecordBatch]:
        nonlocal number
        rows = []
        for d, start, n, s, offset in balance([len(ids) // 4 for _, ids in block], capacity):
            doc, ids = block[d]
            piece = ids[4 * start : 4 * (start + n)]
            rows.append((doc, start, n, zlib.crc32(piece), len(ids) // 4, number + s, offset, piece if with_ids else None))
        number += max((r[5] for r in rows), default=number - 1) + 1 - number
        for lo in range(0, len(rows), 10_000):
            yield table(_PIECES, list(map(list, zip(*rows[lo : lo + 10_000], strict=True))))

    for b in slices(batches, 1):
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = encode(text.decode("utf-8", "replace")) + end
            block.append((doc, ids))
            size += len(ids) // 4
            if size >= block_tokens:
                yield from packed()
                block, size = [], 0
    if block:
        yield from packed()


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, the ids (little-endian).

    Every document ends with token 2, so a null or empty text is one piece of one token. Rows are packed one by one: repeated rows
    each take their place, a null doc_id stays null. Other columns are ignored; an empty table gives no rows.
    """
    texts = texts_of(docs)
    out = texts.mapInArrow(partial(_pack_batches, path, capacity, block_tokens, with_ids), PIECES)
    return out if with_ids else out.drop("ids")
