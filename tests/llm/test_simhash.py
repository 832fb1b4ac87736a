import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from textloom.llm import simhash
from textloom.llm.components import connected_components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps, limit=4):
    """{doc: component} by comparing all pairs, in blocks."""
    ids = np.array(sorted(fps))
    f = np.array([fps[i] for i in ids], np.uint64)
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[:i]) <= limit):
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    return {int(d): int(ids[root(i)]) for i, d in enumerate(ids)}


@pytest.mark.parametrize("which", ["corpus", "edge_docs"])
def test_same_as_all_pairs(which, request):
    docs = request.getfixturevalue(which)
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    want = plain_components(fps)
    got = [r for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None]
    assert len(got) == docs.where("doc_id is not null").count()
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in got} == fps
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_spark_hash_agrees(spark):
    import pyspark.sql.functions as F

    (h,) = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()
    assert h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("block, segments", [(7, None), (2048, None), (7, 2), (2048, 2), (2048, 4)])
def test_buckets_in_blocks(spark, block, segments):
    """A dense cloud of fingerprints, split over a grid of small blocks, has the components of all pairs."""
    draw = np.random.default_rng(3)
    centre = draw.integers(0, 2**63, 3)
    fps = {}
    for i in range(600):
        x = int(centre[i % 3])
        for b in draw.choice(64, draw.integers(0, 7), replace=False):
            x ^= 1 << int(b)
        fps[i] = x
    distinct = {}
    for i, x in fps.items():
        distinct.setdefault(x, i)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x), i) for x, i in distinct.items()], "fp long, rep long")
    edges = simhash.near_links(df, segments=segments, block=block)
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    want = plain_components({i: x for x, i in distinct.items()})
    assert {i: got.get(i, i) for i in want} == want


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 400)]
    df = spark.createDataFrame([*chain, *star, (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in [5, *range(200, 400)]}


def test_probes_of_a_bucket_with_one_stored_row_take_linear_time_and_little_memory():
    """Very many probes of one key: they are verified as they come."""
    n, rows = 1_000_000, 500
    draw = np.random.default_rng(5)
    fps = draw.integers(0, 2**62, n)
    near = draw.choice(n, 50, replace=False)
    fps[near] = 12345 ^ (1 << draw.integers(0, 60, 50))

    def batches(n):
        zeros = np.zeros(rows, np.int32)
        head = [np.zeros(1, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int8), np.array([12345]), np.array([n])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in head], names=NAMES)
        for lo in range(0, n, rows):
            columns = [zeros, zeros.astype(np.int64), zeros, zeros, np.ones(rows, np.int8), fps[lo : lo + rows], np.arange(lo, lo + rows)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=NAMES)

    def taken(n):
        began = time.perf_counter()
        edges = [e for b in simhash._link_batches(4, batches(n)) for e in zip(*b.to_pydict().values(), strict=True)]
        return edges, time.perf_counter() - began

    edges, long = taken(n)
    assert {x for e in edges for x in e} == {*near.tolist(), n} and len(edges) == len(set(near.tolist()))
    _, short = taken(n // 4)
    assert long < 8 * short + 1 and long < 60


NAMES = ["seg", "key", "tb", "pb", "probe", "fp", "rep"]


@pytest.mark.parametrize("probe_block", [5, 1 << 16])
def test_probes_are_dealt_where_a_neighbour_is_stored_often(spark, probe_block):
    """One key of very many rows beside a key of one: the probes that meet it are dealt, and its links found."""
    draw = np.random.default_rng(7)
    hot = {int(x) << 1 for x in draw.integers(0, 2**20, 300)}
    distinct = sorted(hot | {1 << 45, (1 << 45) | 3})
    df = spark.createDataFrame([(x, i) for i, x in enumerate(distinct)], "fp long, rep long")
    stored, _ = simhash._keys(df, 3, 1)
    dealt = simhash.dealt_keys(stored, 4, 3, 10, probe_block).collect()
    assert max(r["tblocks"] for r in dealt) > 10 and any(r["tblocks"] == 1 and r["pblocks"] >= (60 if probe_block == 5 else 1) for r in dealt)
    got = {r["node"]: r["component"] for r in connected_components(simhash.near_links(df, block=10, probe_block=probe_block)).collect()}
    want = plain_components(dict(enumerate(distinct)))
    assert {i: got.get(i, i) for i in want} == want


def test_texts_under_one_id_are_reached_by_their_own_fingerprints(spark):
    draw = np.random.default_rng(2)
    words = [f"w{x}" for x in draw.integers(0, 10**6, 3000)]
    near = " ".join([*words[:1500], "other", *words[1501:]])
    unrelated = " ".join(f"u{x}" for x in draw.integers(0, 10**6, 200))
    docs = spark.createDataFrame([(1, " ".join(words)), (5, near), (5, unrelated), (7, unrelated + " x"), (7, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    f = {t: signed(plain_fingerprint(t)) for t in (" ".join(words), near, unrelated, unrelated + " x", None)}
    links = (f[unrelated] ^ f[unrelated + " x"]).bit_count() <= 4
    assert got == {(1, f[" ".join(words)]): 1, (5, f[near]): 1, (5, f[unrelated]): 5, (7, f[unrelated + " x"]): 5 if links else 7, (7, 0): 7}


def test_empty(empty_docs):
    assert simhash.near_duplicates(empty_docs).count() == 0
