import math

import numpy as np
import pytest

from textloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every=100):
    """The contract, pair by pair. Repeated rows each count."""
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for n, (i, label, v) in enumerate(kept):
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, own) for m, (j, own, w) in enumerate(kept) if m != n)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            near = [(t, k) for t, k, own in scored if own != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(near, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def some_rows(n, seed=2):
    draw = np.random.default_rng(seed)
    centres = draw.normal(scale=0.4, size=(4, 8))
    rows = [(i, (centres[i % 4] + draw.normal(scale=0.2, size=8)).tolist(), int(draw.integers(0, 10))) for i in range(n)]
    hot = [0.5] * 8
    rows += [(n + 3 * i, hot, i % 3) for i in range(200)]  # one very common vector: ties beyond every k
    return rows


ODD = [
    (None, [0.1] * 8, 1), (70_001, None, 1), (70_002, [0.1] * 8, None), (70_003, [0.1] * 7 + [None], 1), (70_004, [float("nan")] * 8, 2), (70_005, [float("inf")] * 8, 2),
    (70_006, [0.4] * 5, 2), (70_007, [], 3), (100, [0.3] * 8, 4), (100, [0.3] * 8, 4), (-700, [0.2] * 8, 9), (70_008, [0.0] * 8, 4), (70_100, [0.0] * 8, 4),
]


@pytest.mark.parametrize("sizes", [{}, {"candidate_block": 60, "anchor_block": 3, "digit": 3}])
def test_same_as_all_pairs(spark, sizes):
    rows = some_rows(700) + ODD
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", rank string, row int")
    assert got(hard_negatives.mine(vectors, **sizes)) == plain(rows)


def test_the_given_table(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = plain([(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()])
    assert want and got(hard_negatives.mine(vectors)) == want


def test_empty_tables_and_single_rows(spark):
    assert got(hard_negatives.mine(spark.createDataFrame([], SCHEMA))) == []
    assert got(hard_negatives.mine(spark.createDataFrame([(100, [1.0], 1)], SCHEMA))) == []
    assert got(hard_negatives.mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA))) == []
    rows = [(100, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (6, [0.5, 0.9], 2), (8, [0.95, 0.0], 3), (9, [-1.0, 0.0], 2)]
    assert got(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA))) == plain(rows) == [(100, 5, 1, 6, 65536, 32768)]


def test_digits_are_counted_no_further_than_the_block_needs():
    s, ids = np.array([90, 80, 70, 70, 10, 95]), np.array([1, 2, 3, 4, 5, 6])
    window = {"lo": 0, "hi": 90, "shift": 4, "need": 3, "score": None}
    digits, n = hard_negatives.counted(window, s, ids)
    assert digits.tolist() == [0, 1] and n.tolist() == [2, 2]  # 90 and 80, then twice 70; 10 isn't needed, 95 is above the window
    tied = {"lo": 1, "hi": 6, "shift": 0, "need": 1, "score": 70}
    assert [x.tolist() for x in hard_negatives.counted(tied, s, ids)] == [[2], [1]]
    settled = {"lo": 70, "hi": 90, "need": 3, "score": 3}
    assert ids[hard_negatives.best_rows(settled, s, ids)].tolist() == [1, 2, 3]


def test_scores_are_exact_at_every_size():
    for top in (100, 40_000, 1 << 28):
        draw = np.random.default_rng(1)
        a, b = draw.integers(-top, top, (3, 16)), draw.integers(-top, top, (5, 16))
        assert hard_negatives.scores(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
