import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sombra.llm import negatives


def brute(rows, is_anchor, kp=5, kn=3, low=50, high=95):
    vecs = [(i, lab, [math.floor(256.0 * x) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v is not None
            and not any(x is None or not math.isfinite(x) for x in v)]
    out = []
    for a, (i, lab, v) in enumerate(vecs):
        if not is_anchor(i):
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), j, m) for b, (j, m, w) in enumerate(vecs)
                        if b != a and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == lab][:kp]:
            fit = [x for x in scored if x[2] != lab and low * -s <= 100 * -x[0] <= high * -s][:kn]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, anchor="vec_id % 5 = 0", **kw):
    df = spark.createDataFrame([(i, v, lab, 0, "x") for i, v, lab in rows],
                               "vec_id long, embedding array<float>, label int, rid int, v string")
    return sorted(tuple(r) for r in negatives.mine(negatives.labelled(df), F.expr(anchor), **kw).collect())


def test_odd_rows_ties_repeats_and_blocks(spark):
    r = random.Random(11)
    f32 = lambda d=12: [round(r.uniform(-1, 1) * 64) / 64 for _ in range(d)]  # noqa: E731  exact as floats
    rows = [(i, f32(), r.randrange(3)) for i in range(120)]
    rows += [(200 + i, rows[10][1], i % 3) for i in range(12)]           # ties
    rows += [(10, rows[10][1], rows[10][2]), (15, f32(), 1)]             # a repeated row, an id with two vectors
    rows += [(300, None, 1), (305, [None] * 12, 1), (310, [float("nan")] * 12, 1), (315, [float("inf")] * 12, 2),
             (320, f32(), None), (None, f32(), 1), (325, [0.0] * 12, 0), (330, [0.0] * 12, 1),
             (400, f32(3), 0), (401, f32(3), 0), (402, f32(3), 1), (403, [], 0), (405, [], 0), (406, [], 1)]
    want = brute(rows, lambda i: i % 5 == 0)
    assert want
    assert run(spark, rows, anchor_block=7, candidate_block=16) == want
    assert run(spark, rows) == want


def test_nothing_to_find(spark):
    assert run(spark, [(0, [1.0], 1)]) == []
    assert run(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert run(spark, [(1, None, 1)]) == []


def test_large_components_stay_exact(spark):
    r = random.Random(3)
    rows = [(i, [float(r.randrange(-30000, 30000)) for _ in range(40)], i % 2) for i in range(40)]
    assert run(spark, rows, candidate_block=8) == brute(rows, lambda i: i % 5 == 0)


@pytest.mark.parametrize("n", [1, 2, 40])
def test_spanning_tree(n):
    X = np.random.default_rng(n).integers(-300, 300, (n, 6)).astype(np.int32)
    order, parent, edge = negatives.spanning_tree(X)
    assert sorted(order.tolist()) == list(range(n)) and (parent < 0).sum() == 1
    place = np.argsort(order)
    for i in range(n):
        if parent[i] >= 0:
            assert place[parent[i]] < place[i]
            assert edge[i] >= np.sqrt(((X[i] - X[parent[i]]).astype(float) ** 2).sum())


def test_bounds_skip_rows():
    """Near anchors score few rows exactly, and all that matter."""
    g = np.random.default_rng(5)
    base = g.normal(0, 200, 32)
    A = np.round(base + g.normal(0, 3, (20, 32))).astype(np.int32)
    X = np.round(g.normal(0, 200, (3000, 32))).astype(np.int32)
    order, parent, edge = negatives.spanning_tree(A)
    ids = np.arange(3000, dtype=np.int64)
    cand = negatives.Block({"n": 3000, "dim": 32, "mat": X.tobytes(), **{c: ids.tobytes() for c in ("vec_id", "rid", "label")}})
    anchors = {"n": 20, "dim": 32, "mat": A.tobytes(), "tree": order.tobytes() + parent.tobytes() + edge.tobytes()}
    low, high = 200_000, 400_000
    scored = 0
    for i, rows, exact in negatives.walk(anchors, cand, lambda i, lo, hi: np.flatnonzero((hi >= low) & (lo <= high))):
        full = X.astype(np.int64) @ A[i].astype(np.int64)
        assert (exact == full[rows]).all()
        assert set(np.flatnonzero((full >= low) & (full <= high))) <= set(rows.tolist())
        scored += len(rows)
    assert scored < 0.6 * 20 * 3000


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert run(spark, rows, "vec_id % 50 = 0") == brute(rows, lambda i: i % 50 == 0)
