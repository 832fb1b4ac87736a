import hashlib
import math

import numpy as np
import pytest

from textloom.llm import kdtree


def lloyd(rows, k=8, rounds=10):
    """The contract, plainly: rows of (vec_id, components); ties to the smaller number."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (away(v, centres[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        centres = [[sum(x) // len(x) for x in zip(*members, strict=True)] if (members := [v for (_, v), o in zip(kept, own, strict=True) if o == c]) else centres[c] for c in range(len(centres))]
    out = [(i, c, away(v, centres[c])) for i, v in kept for c in [nearest(v)]]
    inertia = {c: sum(d for _, o, d in out if o == c) for c in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def some_vectors(n, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, 64))
    rows = [(i, (centres[i % 6] + draw.normal(scale=0.4, size=64)).tolist()) for i in range(n)]
    return rows + [(n + i, rows[3][1]) for i in range(40)]  # a group of copies


ODD = [(9001, None), (9002, [0.5] * 63), (9003, [0.5] * 63 + [None]), (9004, [0.5] * 63 + [float("nan")]), (9005, [0.5] * 63 + [float("inf")]), (None, [0.25] * 64), (9006, []), (5, [0.1] * 64), (5, [0.1] * 64), (9007, [0.0] * 64), (-4, [-3.5] * 64)]


@pytest.mark.parametrize("block", [8192, 50])
def test_same_as_plain_rounds(spark, block):
    rows = some_vectors(300) + ODD
    vectors = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    assert rows_of(kdtree.cluster(vectors, block=block)) == lloyd(rows)


def test_the_given_table(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    assert rows_of(kdtree.cluster(vectors)) == lloyd(rows)


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = [(7, [0.5] * 64), (8, [-0.25] * 64), (9, [0.5] * 64)]
    assert rows_of(kdtree.cluster(spark.createDataFrame(few, schema))) == lloyd(few)
    assert kdtree.cluster(spark.createDataFrame([], schema)).collect() == []
    assert kdtree.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema)).collect() == []


def test_a_centroid_is_pruned_only_if_another_is_strictly_nearer_everywhere():
    points = np.array([[x, y] for x in range(8) for y in range(8)])
    tree, order = kdtree.Tree.build(points, leaf=4)
    assert sorted(order.tolist()) == list(range(64)) and (points[order] == tree.points).all()
    for n in range(len(tree.left)):
        own = tree.points[tree.start[n] : tree.end[n]]
        assert (own.min(0) == tree.low[n]).all() and (own.max(0) == tree.high[n]).all() and (own.sum(0) == tree.sums[n]).all()
    for centres in ([[1, 1], [6, 6], [6, 1]], [[3, 3], [3, 3], [50, 50]], [[0, 7], [7, 0], [3, 4]], [[2, 3], [4, 3], [3, 2]]):
        c = np.array(centres)
        away = ((tree.points[:, None] - c) ** 2).sum(2)
        want = away.argmin(1)
        owner, distance = tree.owners(c)
        assert (owner == want).all() and (distance == away.min(1)).all()
        count, total = tree.totals(c)
        assert count.tolist() == [int((want == k).sum()) for k in range(3)] and all((total[k] == tree.points[want == k].sum(0)).all() for k in range(3))
    whole, leaves = tree.filtered(np.array([[1, 1], [60, 60]]))
    assert whole == [(0, 0)] and not leaves  # a whole tree without a distance
    whole, leaves = tree.filtered(np.array([[3, 3], [3, 3]]))
    assert not whole  # equal centroids: none is strictly nearer


def test_large_components_stay_exact_and_too_large_ones_are_refused(spark):
    p, c = np.array([[(1 << 27) - 1] * 64, [-(1 << 26)] * 64]), np.array([[-(1 << 27) + 1] * 64])
    assert kdtree.distances(p, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c[0], strict=True))] for x in p]
    with pytest.raises(Exception, match="64 bits"):
        kdtree.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()
