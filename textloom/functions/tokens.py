"""Exact token counts, ends and cuts with a tokenizer file; the byte estimates of ``functions.text`` stay the default."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType


@functools.cache
def _tokenizer(path: str):
    """Loaded once in each Python worker."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def exact_tokens(text: Column, path: str, special: bool = True) -> Column:
    """Tokens of a text by the tokenizer file ``path``, which every worker can read; null for null. Special tokens are known unless ``special`` is off."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        t = _tokenizer(path)
        return texts.map(lambda x: None if x is None else len(t.encode(x, add_special_tokens=special)), na_action="ignore").astype("Int64")

    return count(text)


#: Encodings that go by a name.
ENCODINGS = ("cl100k_base", "o200k_base")


def counted_by(text: Column, encoding: str, files: Mapping[str, str]) -> Column:
    """``exact_tokens`` with special tokens by the tokenizer file that ``files`` has for an encoding's name; another name is an error."""
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding}: one of {', '.join(ENCODINGS)}")
    if encoding not in files:
        raise ValueError(f"no tokenizer file for {encoding}")
    return exact_tokens(text, files[encoding])


def indexed(files: DataFrame, key: str, order: str, path: str) -> DataFrame:
    """Files (key, order, entry) with the number of their tokens, ``n``, and where each token begins, in characters: where the one before ends, or at the
    character that both have a part of."""
    schema = StructType([*(files.schema[c] for c in (key, order, "entry")), StructField("n", LongType()), StructField("begins", ArrayType(IntegerType()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for b in batches:
            found = []
            for x in b.column("entry").to_pylist():
                offsets = t.encode(x, add_special_tokens=False).offsets
                found.append([min(begin, end) for (begin, _), (_, end) in zip(offsets, [(0, 0), *offsets], strict=False)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (key, order, "entry")), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=schema.names)

    return files.mapInArrow(index, schema)


def cut(chunks: DataFrame, key: str, path: str, size: int) -> DataFrame:
    """Texts (key, chunk_id, start, content, must, own, last) cut after the last token that fits ``size``: key, chunk_id, sub, start, content, token_count,
    overlap_token_count. ``must`` are the characters that no later chunk has, ``own`` those before the chunk's own part; the last chunk has no later
    one. What the first cut leaves of them is cut again, as ``sub`` 1 and so on."""
    names = ("chunk_id", "start")
    schema = StructType([*(chunks.schema[c] for c in (key, *names)), StructField("sub", IntegerType()), StructField("content", StringType()), StructField("token_count", LongType()), StructField("overlap_token_count", LongType())])

    def fitting(t, text: str) -> tuple[int, int]:
        """(characters, tokens) of the longest beginning, by whole tokens, with at most ``size`` of its own."""
        ends = [end for _, end in t.encode(text, add_special_tokens=False).offsets]
        if len(ends) <= size:
            return len(text), len(ends)
        for k in range(size, 0, -1):
            if k == size or ends[k - 1] < ends[k]:
                n = len(t.encode(text[: ends[k - 1]], add_special_tokens=False).ids)
                if n <= size:
                    return ends[k - 1], n
        raise ValueError("no token fits")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(path)
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                text, must, sub, start = r["content"], len(r["content"]) if r["last"] else r["must"], 0, r["start"]
                while not sub or must > 0:
                    n, count = fitting(t, text)
                    shared = len(t.encode(text[: min(n, r["own"])], add_special_tokens=False).ids) if r["chunk_id"] and not sub else 0
                    rows.append((r[key], r["chunk_id"], start, sub, text[:n], count, shared))
                    text, must, sub, start = text[n:must], must - n, sub + 1, start + count
            yield pd.DataFrame(rows, columns=[key, *names, "sub", "content", "token_count", "overlap_token_count"])

    return chunks.mapInPandas(run, schema)
