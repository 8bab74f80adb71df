import math

from pyspark.sql import functions as F

from sombra.llm import topk


def brute(rows, queries, k):
    """As the registered SQL: every row a candidate, ranked per query id."""
    ints = [(i, [math.floor(256.0 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and not any(x is None or not math.isfinite(x) for x in v)]
    out = []
    for q in queries:
        best = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for o, own in ints if o == q
                      for i, v in ints if i != q and len(v) == len(own))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, queries, k=5, **kw):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, h string")
    v = topk.quantise(df, "vec_id", "embedding")
    return sorted(tuple(r) for r in topk.top_k(v, v.where(F.col("vec_id").isin(queries)), k, **kw).collect())


def test_odd_rows_ties_and_blocks(spark):
    import random

    r = random.Random(4)
    f32 = lambda: [round(r.uniform(-1, 1) * 64) / 64 for _ in range(20)]  # noqa: E731  exact as floats
    rows = [(i, f32()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(9)]              # ties
    rows += [(3, rows[3][1]), (4, [0.0] * 20)]                     # repeats, and an id with two vectors
    rows += [(200, None), (201, [None] * 20), (202, [float("nan")] * 20), (203, [float("inf")] * 20), (None, rows[0][1]),
             (204, [1.0, 2.0]), (205, [0.5, -1.0]), (206, []), (207, [])]
    queries = [0, 3, 4, 100, 200, 204, 206]
    assert run(spark, rows, queries, block=16, query_block=3) == brute(rows, queries, 5)


def test_repeated_ids_keep_all_rows(spark):
    rows = [(0, [8.0, 8.0]), (1, [9.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 2.0]), (0, [-1.0, 0.0])]
    got = run(spark, rows, [0], k=3)
    assert got == brute(rows, [0], 3) and got[0][2:] == (1, 9 * 8 * 256 * 256)


def test_fewer_than_k_and_empty(spark):
    rows = [(1, [1.0]), (2, [0.5])]
    assert run(spark, rows, [1]) == [(1, 1, 2, 256 * 128)]
    assert run(spark, [(1, [1.0])], [1]) == []
    assert run(spark, [(1, None)], [1]) == []


def test_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    v = topk.quantise(df, "vec_id", "embedding")
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5, block=64).collect())
    assert got == brute(rows, [i for i, _ in rows if i % 50 == 0], 5)
